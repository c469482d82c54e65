"""Exact Jaccard join of word n-gram sets by a size-aware heavy-light split.

Equal sets are one. Small sets enumerate their subsets of each size that a partner must share: two sets that share
such a subset, and are small enough for it, are linked, and a star from the smallest set links all of them. Large
sets scan inverted lists: two linked sets share one of their rarest elements, so only those are listed. The sizes at which
enumeration ends are chosen by the cost of both, counted over all sets. What a list's scan can't rule out by sizes and by
bucket counts of the sets makes candidate components, and within each all pairs of sets are compared exactly, in tiles.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .components import components
from .simhash import _roots, alike

SHINGLE, PERCENT = 3, 90
#: Sets above this size are always large: one of 39 has 9,920 subsets.
MOST_SMALL = 39
#: Costs of a row of subset keys, of a listed element and of a pair of a list, in rows shuffled.
KEY_COST, LISTED_COST, PAIR_COST = 1.0, 4.0, 0.02
#: One element in so many is ordered by its frequency and comes first; the others follow by their hash, unsorted by frequency.
ORDERED = 5
BUCKETS = 64
#: Members of a list, and sets and elements of a component, that are compared in one task against as many others.
LIST_TILE, TILE_SETS, TILE_ELEMENTS = 2048, 2048, 1 << 20
#: Tables of at most so many rows of a few numbers are broadcast: cuts of components, and the ids of sets whose texts are fetched (some 100 MB); more are joined by a shuffle.
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 1_000_000
_WORDS = 1 << 19


def shared(percent: int, s: int, t: int) -> int:
    """Elements that sets of these sizes must share to be linked."""
    return -(-percent * (s + t) // (100 + percent))


def subset_sizes(percent: int, n: int) -> list[int]:
    """Sizes of the subsets that a set of n shares with some partner, at least."""
    smaller = range(-(-percent * n // 100), n + 1)
    larger = range(n, 100 * n // percent + 1)
    return sorted({shared(percent, n, t) for t in (*smaller, *larger)})


def subsets(percent: int, n: int) -> int:
    return sum(math.comb(n, m) for m in subset_sizes(percent, n))


def _mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def element_sets(texts: Sequence[str | None], shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The set of each text as sorted 64-bit hashes of its n-grams of ASCII-lower-cased words; with fewer words, the whole sequence is the one element."""
    held: list[list[bytes]] = []
    size = 0
    for i, text in enumerate(texts):
        held.append((text or "").encode("utf-8", "surrogatepass").lower().split())
        size += len(held[-1])
        if size < _WORDS and i < len(texts) - 1:
            continue
        known: defaultdict[bytes, int] = defaultdict()
        known.default_factory = known.__len__
        ids = np.fromiter((known[w] for ws in held for w in ws), np.int64, size)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, known), np.uint64, len(known))[ids]
        sizes = np.array([len(ws) for ws in held])
        ends = np.cumsum(sizes)
        with np.errstate(over="ignore"):
            grams = np.full(max(0, size - shingle + 1), shingle, np.uint64)
            for k in range(shingle):
                grams = _mixed(grams + hashes[k : k + len(grams)])
            for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
                if n >= shingle:
                    yield np.unique(grams[end - n : end - shingle + 1])
                else:
                    whole = np.full(min(n, 1), n, np.uint64)
                    for h in hashes[end - n : end]:
                        whole = _mixed(whole + h)
                    yield whole
        held, size = [], 0


def _key(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def _prints(docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(doc_id, key, n, ordered, more, counts, small) for each row of docs: the set's key and size; its elements that are ordered by frequency; as many others as its
    prefix needs beyond those; how many elements each bucket has (255 at most); all elements of a set that may count as small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, ordered, more, counts, small = [], [], [], [], [], []
            for s in element_sets(batch.column("text").to_pylist(), shingle):
                n = len(s)
                first = s % np.uint64(ORDERED) == 0
                # Lists only bring candidates together, so 40 bits of an element will do.
                own = np.unique(s[first] >> np.uint64(24)).astype(np.int64)
                lacking = max(0, n - -(-percent * n // 100) + 1 - len(own))
                keys.append(_key(s))
                sizes.append(n)
                ordered.append(own)
                more.append(np.unique(s[~first] >> np.uint64(24))[:lacking].astype(np.int64) | 1 << 41 if lacking else own[:0])
                counts.append(np.minimum(np.bincount((s >> np.uint64(58)).astype(np.int64), minlength=BUCKETS), 255).astype(np.uint8).tobytes())
                small.append(s.view(np.int64) if n <= MOST_SMALL else own[:0])
            longs = pa.list_(pa.int64())
            arrays = [pa.array(keys, pa.binary()), pa.array(sizes, pa.int32()), pa.array(ordered, longs), pa.array(more, longs), pa.array(counts, pa.binary()), pa.array(small, longs)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=["doc_id", "key", "n", "ordered", "more", "counts", "small"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(run, "doc_id long, key binary, n int, ordered array<long>, more array<long>, counts binary, small array<long>")


def _prefix(n: Column, percent: int) -> Column:
    """How many of the first elements of a set, by any fixed order, are sure to hold one that a linked set has among its own."""
    return (n - F.floor((percent * n + 99) / 100) + 1).cast("int")


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """(token, prev, sid, n, listed): the shared elements of each set's prefix, prev being the one before, and how many sets have the element (0: not counted)."""
    elements = sets.select("sid", "n", (_prefix(F.col("n"), percent) - F.size("ordered")).alias("left"), F.explode("ordered").alias("token"))
    often = stored(elements.groupBy("token").agg(F.count(F.lit(1)).alias("listed")).where("listed > 1"), "frequencies")
    # Elements that one set has come first of all, and are of no use: so the prefix is that much shorter.
    of = elements.join(often, "token").groupBy("sid", "n", "left").agg(F.array_sort(F.collect_list(F.struct("listed", "token"))).alias("s"))
    ranked = of.select("sid", "n", F.slice("s", 1, F.greatest(F.lit(0), F.col("left") + F.size("s"))).alias("s"))
    rows = ranked.select("sid", "n", F.explode(F.transform("s", lambda x, i: F.struct(x["token"].alias("token"), F.when(i > 0, F.get("s", i - 1)["token"]).alias("prev"), x["listed"].alias("listed")))).alias("x"))
    more = sets.where(F.size("more") > 0).select("sid", "n", F.explode(F.transform("more", lambda x, i: F.struct(x.alias("token"), F.when(i > 0, F.get("more", i - 1)).alias("prev"), F.lit(0).cast("long").alias("listed")))).alias("x"))
    return rows.unionByName(more).select("x.token", "x.prev", "sid", "n", "x.listed")


def boundary(sets: DataFrame, postings: DataFrame, percent: int) -> int:
    """The size up to which sets count as small: that of the least cost of enumerating those up to it and scanning lists for those beyond."""
    counts = {r.n: r.c for r in sets.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}  # MOST_SMALL rows at most
    scans = {r.n: r.c for r in postings.where(F.col("n") <= MOST_SMALL).groupBy("n").agg(F.sum(LISTED_COST + PAIR_COST * F.col("listed")).alias("c")).collect()}
    least = min(range(MOST_SMALL + 1), key=lambda x: sum(KEY_COST * c * subsets(percent, n) for n, c in counts.items() if n <= x) + sum(c for n, c in scans.items() if n > x))
    return least


def small_links(sets: DataFrame, most: int, percent: int) -> DataFrame:
    """Links (a, b) of sets of at most so many elements, whose components are those of all linked pairs of them.

    Sets that share a subset of m elements are linked if their sizes sum to (100 + percent) m / percent at most. Of those with one
    subset in common, each that is linked to any is linked to the smallest.
    """
    # Sets too small to have a partner but their equal have no subsets to offer.
    wanted = {n: sizes for n in range(1, most + 1) if (sizes := [m for m in subset_sizes(percent, n) if m < n or shared(percent, n, n + 1) <= n])}

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            held = 0

            def full(out=out) -> pa.RecordBatch:
                arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
                for x in out:
                    x.clear()
                return pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "m", "n", "sid"])

            for sid, s in zip(batch.column("sid").to_pylist(), batch.column("small"), strict=True):
                s = np.asarray(s.values).view(np.uint64)
                n = len(s)
                with np.errstate(over="ignore"):
                    one, two = _mixed(s + np.uint64(1)), _mixed(s ^ np.uint64(0x9E3779B97F4A7C15))
                    for m in wanted.get(n, ()):
                        gone = np.array(list(itertools.combinations(range(n), n - m)), np.int64).reshape(math.comb(n, m), n - m)
                        out[0].append((one.sum() - one[gone].sum(1)).view(np.int64))
                        out[1].append((two.sum() - two[gone].sum(1) + np.uint64(m)).view(np.int64))
                        for column, value in zip(out[2:], (m, n, sid), strict=True):
                            column.append(np.full(len(gone), value))
                        held += len(gone)
                if held >= 1 << 16:
                    yield full()
                    held = 0
            yield full()

    rows = sets.where(F.col("n") <= most).select("sid", "small").mapInArrow(keys, "k1 long, k2 long, m long, n long, sid long")
    leads = stored(rows.groupBy("k1", "k2", "m").agg(F.min(F.struct("n", "sid")).alias("lead"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "subset-leads")
    return rows.join(leads, ["k1", "k2", "m"]).where((F.col("sid") != F.col("lead.sid")) & (percent * (F.col("n") + F.col("lead.n")) <= (100 + percent) * F.col("m"))).select(F.col("sid").alias("a"), F.col("lead.sid").alias("b"))


def near_in_list(ids: np.ndarray, prev: np.ndarray, n: np.ndarray, counts: np.ndarray, block: np.ndarray, blocks: tuple[int, int], beyond: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of the pairs of a list's tile that sizes and bucket counts can't rule out.

    Pairs with one prev meet in that element's list (prev < 0: none); pairs of small sets have been linked. A tile of one block has
    its pairs, one of two blocks the pairs across. Two sets differ in as many elements at least as their bucket counts differ by.
    """
    label = np.arange(len(ids))
    x, y = blocks
    rows = np.flatnonzero(block == x)
    others = np.flatnonzero(block == y)
    for start in range(0, len(rows), 128):
        r = rows[start : start + 128, None]
        s, t = np.minimum(n[r], n[others]), np.maximum(n[r], n[others])
        open_ = (100 * s >= percent * t) & (t > beyond) & ((prev[r] != prev[others]) | (prev[r] < 0))
        if x == y:
            open_ &= r < others
        a, b = np.nonzero(open_)
        a, b = r[a, 0], others[b]
        for k in range(0, len(a), 1 << 16):
            u, v = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            both = n[u] + n[v]
            apart = np.abs(counts[u] - counts[v]).sum(1)
            near = apart <= both + 2 * (-percent * both // (100 + percent))  # all elements less twice the shared ones
            label = _roots(label, u[near], v[near])
    linked = label != np.arange(len(ids))
    return ids[linked], ids[label[linked]]


def list_links(sets: DataFrame, postings: DataFrame, beyond: int, percent: int) -> DataFrame:
    """Links (a, b) whose components contain every linked pair with a set of more than beyond elements.

    A long list is cut into blocks, and blocks meet in tiles. Members that share the list's commonest prev don't meet each other here.
    """
    used = postings.where(F.col("n") >= F.ceil(F.lit(percent * (beyond + 1) / 100)))
    by_prev = used.groupBy("token", "prev").agg(F.count(F.lit(1)).alias("c"), F.max("n").alias("n"))
    per_list = by_prev.groupBy("token").agg(F.sum("c").alias("c"), F.max(F.when(F.col("prev").isNotNull(), F.struct("c", "prev"))).alias("top"), F.max("n").alias("n"))
    most, minor = F.coalesce("top.c", F.lit(0)), F.col("c") - F.coalesce("top.c", F.lit(0))
    worth = per_list.where((F.col("c") > 1) & (minor > 0) & (F.col("n") > beyond))
    lists = stored(worth.select("token", F.col("top.prev").alias("top"), F.ceil(minor / LIST_TILE).cast("int").alias("minors"), F.ceil(most / LIST_TILE).cast("int").alias("majors")), "lists")
    major = F.coalesce(F.col("prev") == F.col("top"), F.lit(False))
    hashed = F.xxhash64("sid")
    block = F.when(major, F.col("minors") + F.pmod(hashed, F.col("majors"))).otherwise(F.pmod(hashed, F.col("minors"))).cast("int")
    met = used.join(lists, "token").select("token", "prev", "sid", "n", block.alias("block"), F.when(major, F.col("minors")).otherwise(F.col("minors") + F.col("majors")).alias("meets"))
    whole = stored(met, "listed").join(sets.select("sid", "counts"), "sid")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("meets") - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))).alias("tile")
    tiles = whole.select("token", tile, "block", "sid", "prev", "n", "counts").select("token", "tile.x", "tile.y", "block", "sid", "prev", "n", "counts")

    def compare(group: pa.Table) -> pa.Table:
        counts = np.frombuffer(b"".join(group.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS).astype(np.int16)
        prev = group.column("prev").combine_chunks().fill_null(-1).to_numpy()
        columns = (np.array(group.column(c)) for c in ("n", "block"))
        n, blocks = columns
        a, b = near_in_list(np.array(group.column("sid")), prev, n.astype(np.int64), counts, blocks, (group.column("x")[0].as_py(), group.column("y")[0].as_py()), beyond, percent)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return tiles.groupBy("token", "x", "y").applyInArrow(compare, "a long, b long")


def verified(links: DataFrame, sets: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of sets in a component of links that are linked, each pair compared exactly."""
    of = components(links)
    members = stored(of.join(sets.select("sid", "key", "n", "doc_id"), of["node"] == sets["sid"]).select("sid", "key", "n", "doc_id", F.col("component").alias("cluster")), "members")
    cuts = F.ceil(F.greatest(F.count(F.lit(1)) / TILE_SETS, F.sum("n") / TILE_ELEMENTS)).cast("int").alias("cuts")
    large = stored(members.groupBy("cluster").agg(cuts).where("cuts > 1"), "large")
    large = F.broadcast(large) if large.count() <= BROADCAST_ROWS else large
    wanted = members.join(large, "cluster", "left").select("sid", "key", "doc_id", "cluster", F.coalesce("cuts", F.lit(1)).alias("cuts"))
    wanted = stored(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(element_sets(batch.column("text").to_pylist(), shingle))
            own = pa.array([_key(s) == k for s, k in zip(sets, batch.column("key").to_pylist(), strict=True)], pa.bool_())  # a doc_id may have other rows
            columns = [*(batch.column(c) for c in ("sid", "cluster", "cuts")), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([c.filter(own) for c in columns], names=["sid", "cluster", "cuts", "s"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id").select("sid", "cluster", "cuts", "key", "text")
    found = stored(texts.mapInArrow(run, "sid long, cluster long, cuts int, s array<long>"), "elements").dropDuplicates(["sid"])
    own = F.pmod(F.xxhash64("sid"), F.col("cuts")).cast("int")
    tile = F.explode(F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(F.least(own, o).alias("x"), F.greatest(own, o).alias("y")))).alias("tile")
    tiles = found.select("cluster", tile, own.alias("own"), "sid", "s").select("cluster", "tile.x", "tile.y", "own", "sid", "s")

    def compare(group: pa.Table) -> pa.Table:
        x, y = group.column("x")[0].as_py(), group.column("y")[0].as_py()
        group = group.sort_by([("own", "ascending"), ("sid", "ascending")])
        ids, s = np.array(group.column("sid")), group.column("s").combine_chunks()
        sizes, label = np.diff(np.array(s.offsets)), np.arange(len(ids))
        split = int((np.array(group.column("own")) == x).sum()) if x != y else 0
        if len(ids) > 1 and (x == y or 0 < split < len(ids)):
            label = _roots(label, *alike(np.repeat(label, sizes), np.array(s.flatten()), sizes, split, percent / 100))
        linked = label != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[linked], pa.int64()), "b": pa.array(ids[label[linked]], pa.int64())})

    return tiles.groupBy("cluster", "x", "y").applyInArrow(compare, "a long, b long")


def joined(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs (doc_id, text): two documents are linked if 100 * intersection >= percent * union of their sets of
    n-grams of words; component_id is the smallest doc_id reachable over links, itself included.

    Words are parted by the white space of ASCII and A-Z are lower-cased. A text with fewer words than an n-gram has its whole
    sequence as its one element; a null text or one without words has the empty set and is linked with nothing. Repeated rows stay, each a
    document of its own; rows without doc_id link to nothing and have no component. No documents give no rows. Other columns are not read.
    Elements are told apart by 64 bits, sets by 128.
    """
    prints = stored(_prints(docs, shingle, percent), "prints")
    grouped = prints.where("n > 0 AND doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.max("doc_id").alias("last"), *[F.first(c).alias(c) for c in ("n", "ordered", "more", "counts", "small")]
    )
    sets = stored(grouped.withColumn("sid", F.monotonically_increasing_id()), "sets")  # numbered once: the table is written
    postings = stored(_postings(sets, percent), "postings")
    most = boundary(sets, postings, percent)
    exact = verified(list_links(sets, postings, most, percent), sets, docs, shingle, percent)
    found = components(exact.unionByName(small_links(sets, most, percent)))
    named = stored(found.join(sets.select("sid", "key", "doc_id", "last"), found["node"] == F.col("sid")).select("key", "doc_id", "last", "component"), "linked")
    least = stored(named.groupBy("component").agg(F.min("doc_id").alias("component_id")), "least-ids")
    whole = named.join(least, "component").select("key", "component_id")
    alone = sets.where("doc_id != last").select("key", F.col("doc_id").alias("component_id")).join(named.select("key"), "key", "left_anti")
    of = stored(whole.unionByName(alone), "components-of-sets")
    named_rows = prints.select("doc_id", "key", F.col("n").cast("long").alias("n_shingles"))
    out = named_rows.where("n_shingles > 0 AND doc_id IS NOT NULL").join(of, "key", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.unionByName(named_rows.where("n_shingles = 0 OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: All pairs of sets that share an n-gram, then all that each reaches.
ORACLE = rf"""
WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, len(w) AS n, unnest(w) AS word, unnest(range(len(w))) AS p FROM docs),
grams AS (SELECT r, n, p, concat_ws(' ', word, lead(word) OVER ahead, lead(word, 2) OVER ahead) AS g FROM words WINDOW ahead AS (PARTITION BY r ORDER BY p)),
elements AS MATERIALIZED (SELECT DISTINCT r, g FROM grams WHERE p = 0 OR p + {SHINGLE} <= n),
sizes AS MATERIALIZED (SELECT r, count(*) AS n FROM elements GROUP BY r),
links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.r AS a, y.r AS b, count(*) AS c FROM elements x JOIN elements y USING (g) WHERE x.r <> y.r GROUP BY 1, 2)
  JOIN sizes s ON s.r = a JOIN sizes t ON t.r = b WHERE 100 * c >= {PERCENT} * (s.n + t.n - c)),
reached AS (SELECT a, a AS b FROM links UNION SELECT reached.a, links.b FROM reached JOIN links ON links.a = reached.b),
least AS (SELECT a AS r, min(doc_id) AS component_id FROM reached JOIN docs ON docs.r = b GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM docs LEFT JOIN sizes USING (r) LEFT JOIN least USING (r)
"""
