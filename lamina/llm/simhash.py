"""SimHash near-dedup over vantage-point trees.

Fingerprints are cut into bit blocks. If two fingerprints differ in fewer bits than
blocks * (radius + 1), some block of theirs differs in at most radius bits; each block has a
vantage-point tree over its values. At a node a fingerprint goes to the inner child if its block lies
within the threshold of the vantage point, else to the outer one; one that lies outside by at most
the radius also visits the inner shard, as by the triangle inequality its partners may be there. All
other branches are pruned. Vantage points are hashed from the node's number, so routing needs no
driver, sample or broadcast, and depth follows the number of fingerprints. Within a shard distances
are exact. Shards send back spanning links, never all pairs. Where shingle sets are to be compared, the
components of these links are only candidates: within each, every pair of sets is compared exactly, in
tiles, and components are built anew from the links that hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Rows that a shard should have, and rows above which it is compared in tiles.
SHARD_ROWS, TILE_ROWS = 2048, 8192
#: Oversized shards whose tile counts are broadcast; more are joined by a shuffle.
BROADCAST_SHARDS = 50_000
#: Linked documents whose ids are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Documents and shingles of a side of the tiles in which candidates are compared.
VERIFY_ROWS, VERIFY_SHINGLES = 1024, 1 << 20
#: Shingles of up to so many documents of a tile are counted pair by pair, others by matrix products.
RARE = 32


@dataclass(frozen=True)
class Plan:
    """How texts become fingerprints, and which link: those that differ in at most max_bits bits and, if least is set, whose shingle sets then have that Jaccard similarity."""

    shingle: int = 4
    words: int = 1
    blocks: int = 3
    radius: int = 1
    max_bits: int = 4
    least: float | None = None

    def edges(self) -> list[tuple[int, int]]:
        """(first bit, width) of each block."""
        cuts = [round(i * 64 * self.words / self.blocks) for i in range(self.blocks + 1)]
        return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


#: All pairs within 4 of 64 bits: 4 < 3 * (1 + 1), so none is lost.
EXACT_64 = Plan()
#: Five-word shingles and a similarity of 0.8: then about 38 of 256 bits differ, rarely over 58; what is found is verified. A pair
#: at 0.8 is near in some block with probability 0.98, at 0.9 with 0.9999.
SIMILAR_08 = Plan(shingle=5, words=4, blocks=15, radius=1, max_bits=58, least=0.8)


def _remix(x: np.ndarray) -> np.ndarray:
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BIT_OF_BYTE = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each of the 64 bits set, from the highest bit."""
    b = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    if len(b) <= 400:
        return np.unpackbits(b, axis=1).sum(0, dtype=np.int64)
    return np.concatenate([np.bincount(b[:, k], minlength=256) @ _BIT_OF_BYTE for k in range(8)])


def shingle_hashes(text: str | None, shingle: int, step: int = 1 << 20) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of the word shingles, some at a time."""
    tokens = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not tokens:
        return
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    joined, digest = b" ".join(tokens), xxhash.xxh64_digest
    k = min(shingle, len(tokens))
    starts, ends = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    for i in range(0, len(starts), step):
        yield np.frombuffer(b"".join([digest(joined[s:e], 42) for s, e in zip(starts[i : i + step], ends[i : i + step], strict=True)]), ">u8").astype(np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    parts = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(parts)).view(np.int64) if parts else np.zeros(0, np.int64)


def fingerprint(text: str | None, shingle: int = 4, words: int = 1, step: int = 1 << 20) -> list[int]:
    """The fingerprint's 64-bit words, as signed numbers. The first is over XXH64 (seed 42); further words remix it."""
    n, ones = 0, np.zeros((words, 64), np.int64)
    for h in shingle_hashes(text, shingle, step):
        n += len(h)
        for w in range(words):
            ones[w] += _ones(h)
            h = _remix(h)
    if not n:
        return [0] * words
    return np.packbits(2 * ones > n, axis=1).view(">u8").astype(np.int64).ravel().tolist()


def set_fingerprint(shingles: np.ndarray, words: int) -> list[int]:
    """As fingerprint(), but over distinct shingles: how often each occurs doesn't count."""
    if not len(shingles):
        return [0] * words
    ones, h = np.zeros((words, 64), np.int64), shingles.view(np.uint64)
    for w in range(words):
        ones[w] = _ones(h)
        h = _remix(h)
    return np.packbits(2 * ones > len(shingles), axis=1).view(">u8").astype(np.int64).ravel().tolist()


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell shingle sets apart."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def with_fingerprints(docs: DataFrame, plan: Plan) -> DataFrame:
    """(doc_id, fp): fp is an array of plan.words longs. If plan.least is set, fp is over the shingle set, and its key and size n follow."""

    def run_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, keys, sizes = [], [], []
            for text in batch.column("text").to_pylist():
                s = shingle_set(text, plan.shingle)
                fps.append(set_fingerprint(s, plan.words))
                keys.append(set_key(s))
                sizes.append(len(s))
            columns = [batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64())), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t, plan.shingle, plan.words) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps, pa.list_(pa.int64()))], names=["doc_id", "fp"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, fp array<long>") if plan.least is None else texts.mapInArrow(run_sets, "doc_id long, fp array<long>, key binary, n long")


def block_values(fps: np.ndarray, plan: Plan) -> list[np.ndarray]:
    """fps (n, words) of uint64 -> one array of block values for each block."""
    out = []
    for first, width in plan.edges():
        value = np.zeros(len(fps), np.uint64)
        for bit in range(first, first + width):
            value = value << np.uint64(1) | (fps[:, bit // 64] >> np.uint64(63 - bit % 64)) & np.uint64(1)
        out.append(value)
    return out


def route(values: np.ndarray, block: int, width: int, depth: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row index, leaf) of every shard that each value lives in or visits."""
    at, node = np.arange(len(values)), np.ones(len(values), np.uint64)
    inside = (width - 1) // 2
    for _ in range(depth):
        vantage = _remix(node * np.uint64(1009) + np.uint64(block)) >> np.uint64(64 - width)
        far = np.bitwise_count(values[at] ^ vantage)
        inner, visit = far <= inside, (far > inside) & (far <= inside + radius)
        child = node << np.uint64(1)
        at = np.concatenate([at, at[visit]])
        node = np.concatenate([child + (~inner).astype(np.uint64), child[visit]])
    return at, node.astype(np.int64)


def depth_for(n: int, plan: Plan) -> int:
    """Tree depth at which a shard has about SHARD_ROWS rows: a child takes about this part of its parent's."""
    width = min(w for _, w in plan.edges())
    t = (width - 1) // 2
    cum = lambda k: sum(math.comb(width, i) for i in range(k + 1)) / 2**width
    part = (cum(t + plan.radius) + 1 - cum(t)) / 2
    return max(0, math.ceil(math.log(n / SHARD_ROWS) / -math.log(part))) if n > SHARD_ROWS else 0


def _roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label (each node's smallest known partner) after the links a-b are added."""
    while len(a):
        x, y = label[a], label[b]
        open_ = x != y
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, jumped := label[label]):
            label = jumped
    return label


def _hits(fps: np.ndarray, max_bits: int, block: np.ndarray | None = None, radius: int = 0, rows: int = 256) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b) with a < b of all pairs that differ in at most max_bits bits, some rows at a time.

    With block, the values of the shard's block, only of those within the radius there; the others meet in another shard or not at all.
    """
    first = np.ascontiguousarray(fps[:, 0]) if block is None else block
    within = max_bits if block is None else radius
    for i in range(0, len(fps), rows):
        a, b = np.nonzero(np.bitwise_count(first[i : i + rows, None] ^ first[None, i:]) <= within)
        keep = a < b
        a, b = a[keep] + i, b[keep] + i
        near = np.bitwise_count(fps[a] ^ fps[b]).sum(1, dtype=np.int64) <= max_bits
        yield a[near], b[near]


def shard_links(ids: np.ndarray, fps: np.ndarray, max_bits: int, block: np.ndarray | None = None, radius: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (id, smallest id of its component here) of the fingerprints that differ in at most max_bits bits; block and radius as in _hits."""
    order = np.argsort(ids, kind="stable")
    ids, label = ids[order], np.arange(len(ids))
    for a, b in _hits(fps[order], max_bits, None if block is None else block[order], radius):
        label = _roots(label, a, b)
    linked = label != np.arange(len(ids))
    return ids[linked], ids[label[linked]]


def link(nodes: DataFrame, plan: Plan) -> DataFrame:
    """nodes(id long, fp array<long>), distinct -> links (a, b) whose components are those of all pairs within plan.max_bits."""
    depth = depth_for(nodes.count(), plan)

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array(batch.column("fp").flatten()).view(np.uint64).reshape(-1, plan.words)
            values, ids, fp = block_values(fps, plan), batch.column("id"), batch.column("fp")
            for k, (_, width) in enumerate(plan.edges()):
                at, leaf = route(values[k], k, width, depth, plan.radius)
                at = pa.array(at)
                yield pa.RecordBatch.from_arrays([pa.array(leaf * plan.blocks + k), ids.take(at), fp.take(at)], names=["shard", "id", "fp"])

    rows = nodes.mapInArrow(routed, "shard long, id long, fp array<long>")
    large = stored(rows.groupBy("shard").count().where(F.col("count") > TILE_ROWS).select("shard", F.ceil(F.col("count") / TILE_ROWS).cast("int").alias("cuts")), "shards")
    if large.count() <= BROADCAST_SHARDS:
        large = F.broadcast(large)
    cut = rows.join(large, "shard", "left").withColumn("cuts", F.coalesce("cuts", F.lit(1)))
    own = F.pmod(F.xxhash64("id"), F.col("cuts")).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.least(own, o) * F.col("cuts") + F.greatest(own, o))).alias("tile")
    tiles = cut.select("shard", tile, "id", "fp")

    def compare(group: pa.Table) -> pa.Table:
        fps = np.array(group.column("fp").combine_chunks().flatten()).view(np.uint64).reshape(-1, plan.words)
        ids = np.array(group.column("id"))
        if plan.least is None:
            a, b = shard_links(ids, fps, plan.max_bits)
        else:
            block = block_values(fps, plan)[group.column("shard")[0].as_py() % plan.blocks]
            a, b = shard_links(ids, fps, plan.max_bits, block, plan.radius)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("shard", "tile").applyInArrow(compare, "a long, b long")


def alike(rows: np.ndarray, shingles: np.ndarray, sizes: np.ndarray, split: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of documents with a Jaccard similarity of at least least: of all if split is 0, else a below split and b from it on.

    shingles[k] is in the set of document rows[k], once; sizes has the sets' sizes. Exact: every pair's common shingles are counted.
    """
    n = len(sizes)
    n_a, first_b = (split, split) if split else (n, 0)
    n_b = n - first_b
    _, value, held_by = np.unique(shingles, return_inverse=True, return_counts=True)
    common = np.zeros((n_a, n_b), np.float32)
    often = held_by > RARE
    column, at = np.cumsum(often) - 1, np.flatnonzero(often[value])
    at = at[np.argsort(value[at], kind="stable")]
    r, c = rows[at], column[value[at]]
    for start in range(0, int(often.sum()), 1024):
        some = slice(*np.searchsorted(c, [start, start + 1024]))
        held = np.zeros((n, 1024), np.float32)
        held[r[some], c[some] - start] = 1
        common += held[:n_a] @ held[first_b:].T
    at = np.flatnonzero((held_by[value] > 1) & ~often[value])
    at = at[np.lexsort((rows[at], value[at]))]
    r, v = rows[at], value[at]
    for step in range(1, RARE):
        same = np.flatnonzero(v[:-step] == v[step:])
        if not len(same):
            break
        a, b = r[same], r[same + step]
        if split:
            across = (a < split) & (b >= split)
            a, b = a[across], b[across]
        common += np.bincount(a * n_b + b - first_b, minlength=n_a * n_b).reshape(n_a, n_b)
    union = sizes[:n_a, None] + sizes[None, first_b:] - common.astype(np.float64)
    a, b = np.nonzero(np.divide(common, union, out=np.ones_like(union), where=union > 0) >= least)
    b = b + first_b
    return a[a < b], b[a < b]


def verified(links: DataFrame, groups: DataFrame, docs: DataFrame, plan: Plan) -> DataFrame:
    """Links (a, b: doc_ids) whose components are those of all pairs of documents in a component of links whose shingle sets have a Jaccard similarity of at least plan.least.

    groups(id, n) has the size of each document's set.
    """
    of = components(links).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))
    members = stored(groups.select(F.col("id").alias("doc_id"), "n").join(of, "doc_id"), "members")
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / VERIFY_ROWS, F.sum("n") / VERIFY_SHINGLES)).cast("int").alias("cuts")
    large = stored(members.groupBy("cluster").agg(cuts).where("cuts > 1"), "large")
    if large.count() <= BROADCAST_SHARDS:
        large = F.broadcast(large)
    members = stored(members.select("doc_id", "cluster").distinct().join(large, "cluster", "left").select("doc_id", "cluster", F.coalesce("cuts", F.lit(1)).alias("cuts")), "linked")
    members = F.broadcast(members) if members.count() <= BROADCAST_IDS else members

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, plan.shingle) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in ("doc_id", "cluster", "cuts")] + [pa.array([set_key(s) for s in sets], pa.binary()), pa.array(sets, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "cluster", "cuts", "key", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, "doc_id").select("doc_id", "cluster", "cuts", "text")
    sets = stored(texts.mapInArrow(run, "doc_id long, cluster long, cuts int, key binary, s array<long>"), "shingles").dropDuplicates(["doc_id", "key"])
    own = F.pmod(F.xxhash64("doc_id"), F.col("cuts")).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))).alias("tile")
    tiles = sets.select("cluster", tile, own.alias("own"), "doc_id", "s").select("cluster", "tile.x", "tile.y", "own", "doc_id", "s")

    def compare(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        group = group.sort_by([("own", "ascending"), ("doc_id", "ascending")])
        ids, s = np.array(group.column("doc_id")), group.column("s").combine_chunks()
        sizes, label = np.diff(np.array(s.offsets)), np.arange(len(ids))
        split = int((np.array(group.column("own")) == x).sum()) if x != y else 0
        if len(ids) > 1 and (x == y or 0 < split < len(ids)):
            label = _roots(label, *alike(np.repeat(label, sizes), np.array(s.flatten()), sizes, split, plan.least))
        linked = label != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(ids[label[linked]], pa.int64())})

    return tiles.groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, plan: Plan = EXACT_64) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id reachable over links, itself included.

    Null and empty texts have fingerprint zero and link like any other. Documents without doc_id link to nothing and
    have no component. Rows that repeat a doc_id stay; they count as one document. Other columns of docs are not read.
    """
    prints = stored(with_fingerprints(docs, plan), "fingerprints")
    # Equal fingerprints are near, but equal sets only have equal keys.
    key, more = ("fp", []) if plan.least is None else ("key", [F.first("fp").alias("fp"), F.first("n").alias("n")])
    groups = stored(prints.where("doc_id IS NOT NULL").groupBy(key).agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last"), *more), "groups")
    # Two keys may share their smallest doc_id, if rows repeat it; then they are one node with two fingerprints.
    links = link(groups.select("id", "fp"), plan)
    found = stored(components(links if plan.least is None else verified(links, groups, docs, plan)), "components")
    of = groups.join(found, groups["id"] == found["node"], "left").select(key, F.coalesce("component", "id").alias("component_id"), "last").where("component_id != last").drop("last")
    return prints.join(of, key, "left").select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_duplicates(docs: DataFrame, plan: Plan = SIMILAR_08) -> DataFrame:
    """The rows of docs, one of each component: that with the smallest doc_id. Of rows that repeat a doc_id that with the least text stays (null counts as least; of equal texts that with the least hash of all columns); rows without doc_id stay."""
    gone = stored(near_duplicates(docs, plan).where("doc_id != component_id").select("doc_id").distinct(), "gone")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    least = F.min_by(F.struct(*docs.columns), F.struct(F.coalesce("text", F.lit("")), F.xxhash64(*docs.columns))).alias("row")
    one = kept.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(least).select("row.*")
    return one.unionByName(kept.where("doc_id IS NULL"))


def hex_digits(fp: str = "fp"):
    """The first word of a fingerprint in 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(fp)[0]), 16, "0"))
