"""Removal of repeated byte strings by a sparse, distributed suffix sort.

A 400-byte string (or of another length) that starts at p takes as its anchor the least hashed 16-byte
gram among the next 256 starts; equal strings have their anchors at the same offset. So only the suffixes at anchors are
sorted, about one in 128 bytes.

1. A map finds anchors. The hash of the bytes that all strings of an anchor share is counted over all
   documents; anchors whose hash occurs once can't repeat and go.
2. Tasks sort the remaining suffixes, settle what repeats within their own run, and emit the runs
   front-coded, cut at range splitters.
3. Each range is merged by a loser tree that carries common-prefix lengths and never compares a known
   prefix again. The merged common prefixes, with those of the reversed left contexts, tell for each
   start of a string whether an equal one exists.
4. The spans found are cut out of their documents.

A hash only rules out; every removed string was compared byte by byte.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash, shuffle_partitions, stored

#: Bytes of the repeated strings, if no other length is asked for.
LENGTH = 400
#: Offsets, and so windows, stay below this.
MAX_WINDOW = 1024
#: Text bytes handled by one vectorised step, and suffixes sorted into one run.
PIECE, RUN = 1 << 19, 60_000
#: Anchors of one range of the merge; strings of a hash with more anchors are dealt by cells of their offsets.
RANGE_ROWS = 40_000
#: Splitters that the driver holds; beyond so many ranges each is parted by the hashes of the shared bytes.
MAX_RANGES = 10_000
#: Hot hashes, and cells to be cut, are no more than this: their least size grows with the corpus. They are broadcast (8 MB).
MOST_HOT = 1_000_000
#: Widths of the cells of offsets that a hot hash is cut into: the next width is for cells that hold too many different contexts. In cells of one offset equal keys are equal strings.
CELLS = (64, 8, 1)
_POS = np.uint64((1 << 24) - 1)


def window_of(length: int) -> int:
    """How many starts in a row choose their anchor together: 16 / 25 of the length."""
    return min(MAX_WINDOW, length * 16 // 25)


def shared_of(length: int) -> int:
    """All strings of an anchor hold at least these bytes from the anchor on."""
    return length - window_of(length) + 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _loads(data: bytes) -> np.ndarray:
    """The 8 bytes from each position on, as one number; data must end in 16 spare bytes."""
    n = len(data) - 16
    out = np.empty(n + 8, np.uint64)
    for o in range(8):
        part = np.frombuffer(data, "<u8", count=(len(data) - o) // 8, offset=o)
        at = out[o::8]
        at[:] = part[: len(at)]
    return out


def anchors(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchors of the texts data[starts:ends], which follow one another.

    Returns text index, anchor position in data, first and last start of a string, hash of the shared
    bytes, and the first 8 bytes as a number in byte order.
    """
    window, shared = window_of(length), shared_of(length)
    long_enough = ends - starts >= length
    which, s, e = np.flatnonzero(long_enough), starts[long_enough], ends[long_enough]
    if not len(which):
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + (np.zeros(0, np.uint64),) * 2
    v = _loads(data + b"\0" * 16)
    n = len(data)
    gram = _mix(v[:n] * np.uint64(0x9E3779B97F4A7C15) + v[8 : n + 8] * np.uint64(0xC2B2AE3D27D4EB4F))
    packed = gram & ~_POS | np.arange(n, dtype=np.uint64)
    rows = -(-n // window) + 1
    padded = np.full(rows * window, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = packed
    grid = padded.reshape(rows, window)
    before = np.minimum.accumulate(grid, axis=1).ravel()
    after = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    counts = e - s - length + 1
    first = np.cumsum(counts) - counts
    p = np.arange(counts.sum()) - np.repeat(first - s, counts)
    a = (np.minimum(after[p], before[p + window - 1]) & _POS).astype(np.int64)
    text = np.repeat(which, counts)
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (text[1:] != text[:-1])
    lead = np.flatnonzero(new)
    last = np.append(lead[1:], len(a)) - 1
    at = a[lead]
    key = np.full(len(at), np.uint64(shared))
    for o in [*range(0, shared - 8, 8), shared - 8]:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + v[at + o])
    return text[lead], at, p[lead], p[last], key, v[at].byteswap()


def text_anchors(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """anchors() of each text, with positions in the text; long texts go piece by piece, short ones together."""
    out: list[tuple[np.ndarray, ...]] = []
    batch: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if batch:
            ends = np.cumsum([len(texts[i]) for i in batch])
            starts = ends - [len(texts[i]) for i in batch]
            t, at, lo, hi, key, head = anchors(b"".join(texts[i] for i in batch), starts, ends, length)
            shift = starts[t] if len(t) else t
            out.append((np.array(batch)[t], at - shift, lo - shift, hi - shift, key, head))
        batch.clear()
        held = 0

    for i, text in enumerate(texts):
        if len(text) < length:
            continue
        if len(text) > PIECE:
            parts = []
            for s in range(0, len(text) - length + 1, PIECE):
                piece = text[s : s + PIECE + length - 1]
                t, at, lo, hi, key, head = anchors(piece, np.array([0]), np.array([len(piece)]), length)
                parts.append([np.full(len(t), i), at + s, lo + s, hi + s, key, head])
                if len(parts) > 1 and parts[-2][1][-1] == parts[-1][1][0]:  # one anchor on both sides of the cut
                    parts[-1][2][0] = parts[-2][2][-1]
                    parts[-2] = [x[:-1] for x in parts[-2]]
            out += [tuple(p) for p in parts]
            continue
        if held + len(text) > PIECE:
            flush()
        batch.append(i)
        held += len(text)
    flush()
    if not out:
        return anchors(b"", np.zeros(0, int), np.zeros(0, int), length)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def common(x: bytes, y: bytes, at: int) -> int:
    """Length of the common prefix, of which the first at bytes are known."""
    n = min(len(x), len(y))
    while at < n:
        a, b = x[at : at + 48], y[at : at + 48]
        if a != b:
            m = min(len(a), len(b))
            if a[:m] == b[:m]:
                return at + m
            return at + m - 1 - ((int.from_bytes(a[:m]) ^ int.from_bytes(b[:m])).bit_length() - 1) // 8
        at += len(a)
    return n


def front_code(strings: list[bytes]) -> tuple[bytes, bytes, bytes]:
    """(common prefix with the one before, length of the rest, the rests) of a list of strings."""
    lcp, rest, before = [], [], b""
    for x in strings:
        n = common(before, x, 0)
        lcp.append(n)
        rest.append(x[n:])
        before = x
    return np.array(lcp, np.uint16).tobytes(), np.array([len(r) for r in rest], np.uint16).tobytes(), b"".join(rest)


def front_decode(lcp: bytes, lengths: bytes, rest: bytes) -> tuple[list[bytes], list[int]]:
    out, before, at = [], b"", 0
    shared = np.frombuffer(lcp, np.uint16).tolist()
    for n, m in zip(shared, np.frombuffer(lengths, np.uint16).tolist(), strict=True):
        before = before[:n] + rest[at : at + m]
        at += m
        out.append(before)
    return out, shared


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> Iterator[tuple[int, int, int]]:
    """Loser tree over sorted runs of (strings, common prefix with the one before in the run).

    Yields (run, index, common prefix with the string yielded before). A player's known prefix is what
    it shares with the last winner. Of two players the one that shares more is less; only if they share
    as much are they compared, from there on, and the loser keeps what it shares with the winner.
    """
    k = 1
    while k < len(runs):
        k *= 2
    at = [0] * k
    shared = [0] * k
    head: list[bytes | None] = [r[0][0] if r[0] else None for r in runs] + [None] * (k - len(runs))
    losers = [-1] * k

    def less(x: int, y: int) -> bool:
        """x wins over y. Afterwards the loser's shared is what it has in common with the winner."""
        if head[x] is None or head[y] is None:
            return head[y] is None
        if shared[x] != shared[y]:
            return shared[x] > shared[y]
        n = common(head[x], head[y], shared[x])
        won = head[x][n : n + 1] <= head[y][n : n + 1] if n < len(head[x]) and n < len(head[y]) else len(head[x]) <= len(head[y])
        shared[y if won else x] = n
        return won

    def play(node: int) -> int:
        if node >= k:
            return node - k
        x, y = play(2 * node), play(2 * node + 1)
        won, lost = (x, y) if less(x, y) else (y, x)
        losers[node] = lost
        return won

    winner = play(1)
    while head[winner] is not None:
        strings, lcps = runs[winner]
        yield winner, at[winner], shared[winner]
        at[winner] += 1
        i = at[winner]
        if i < len(strings):
            head[winner], shared[winner] = strings[i], lcps[i]
        else:
            head[winner] = None
        node = (winner + k) // 2
        while node:
            if not less(winner, losers[node]):
                winner, losers[node] = losers[node], winner
            node //= 2


def _levels(lcp: np.ndarray, level: int) -> np.ndarray:
    """Class of each string in a sorted list by its first level bytes."""
    return np.cumsum(lcp < level)


def repeated_starts(right_lcp: np.ndarray, lefts: list[bytes], lo: np.ndarray, hi: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For anchors sorted by right context: (anchor, first offset, last offset) runs whose strings occur more than once here.

    The string that starts d bytes left of an anchor equals another's, if both have d in their offsets
    lo..hi, the same d bytes on the left and the same length - d on the right.
    """
    n, window = len(lefts), window_of(length)
    if not n:
        return (np.zeros(0, np.int64),) * 3
    order = sorted(range(n), key=lefts.__getitem__)
    size = np.array([len(x) for x in lefts])
    grid = np.frombuffer(b"".join(lefts[i].ljust(window, b"\0") for i in order), np.uint8).reshape(n, window)
    left_lcp = np.zeros(n, int)
    for i in range(1, n, 4096):
        j = min(i + 4096, n)
        differs = grid[i - 1 : j - 1] != grid[i:j]
        left_lcp[i:j] = np.where(differs.any(1), differs.argmax(1), window)
    order = np.array(order)
    left_lcp[1:] = np.minimum(left_lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
    twice = np.zeros((n, window + 1), bool)
    left_class = np.empty(n, np.int64)
    for d in range(int(lo.min()), int(hi.max()) + 1):
        active = np.flatnonzero((lo <= d) & (d <= hi))
        if len(active) < 2:
            continue
        left_class[order] = _levels(left_lcp, d)
        both = _levels(right_lcp, length - d)[active] * (n + 1) + left_class[active]
        by = np.argsort(both, kind="stable")
        same = both[by[1:]] == both[by[:-1]]
        twice[active[by[1:][same]], d] = True
        twice[active[by[:-1][same]], d] = True
    edge = np.diff(np.pad(twice, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    at, first = np.nonzero(edge == 1)
    _, beyond = np.nonzero(edge == -1)
    return at, first, beyond - 1


#: One sorted, front-coded run of suffixes for one range, and the spans settled within the run.
RUN_SCHEMA = "target int, part int, r_lcp binary, r_len binary, r_rest binary, l_lcp binary, l_len binary, l_rest binary, id binary, h binary, pos binary, lo binary, hi binary, s_id binary, s_h binary, s_from binary, s_to binary"


def _emit(target: int, part: int, entries: list[tuple], settled: dict[tuple[int, int], list], length: int) -> dict:
    """entries: (right, reversed left, id, h, pos, lo, hi). Of equal contexts all are settled, and one is sent on."""
    entries.sort(key=lambda x: x[:2])
    sent = []
    i = 0
    while i < len(entries):
        j = i + 1
        while j < len(entries) and entries[j][0] == entries[i][0] and entries[j][1] == entries[i][1]:
            j += 1
        sent.append(entries[i])
        if j - i > 1:  # equal contexts are as long, and so have the same offsets
            for e in entries[i:j]:
                settled.setdefault((e[2], e[3]), []).append((e[4] - e[6], e[4] - e[5] + length))
        i = j
    r, left = front_code([e[0] for e in sent]), front_code([e[1] for e in sent])
    return {
        "target": target, "part": part, "r_lcp": r[0], "r_len": r[1], "r_rest": r[2], "l_lcp": left[0], "l_len": left[1], "l_rest": left[2],
        "id": _packed(sent, 2), "h": _packed(sent, 3), "pos": _packed(sent, 4), "lo": _packed(sent, 5, np.int16), "hi": _packed(sent, 6, np.int16),
        "s_id": b"", "s_h": b"", "s_from": b"", "s_to": b"",
    }


def _packed(rows: list[tuple], k: int, kind: type = np.int64) -> bytes:
    return np.array([r[k] for r in rows], kind).tobytes()


def _emit_settled(settled: dict[tuple[int, int], list], parts: int) -> list[dict]:
    """A run's settled spans, put together for each document; they pass the merge untouched, in parts of their own."""
    dealt: dict[int, list] = {}
    for (doc, h), spans in settled.items():
        dealt.setdefault(h % parts, []).extend((doc, h, s, e) for s, e in merge_spans(spans))
    return [_emit(-1, part, [], {}, 0) | {c: _packed(rows, k) for k, c in enumerate(("s_id", "s_h", "s_from", "s_to"))} for part, rows in dealt.items()]


def _merge_range(group: pa.Table, length: int) -> pa.Table:
    """Spans (id, h, s, e) of one range: what runs settled, and what the merged runs show."""
    cols = {c: group.column(c).to_pylist() for c in group.column_names}
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in cols[c]])
    spans = [[join(c, np.int64) for c in ("s_id", "s_h", "s_from", "s_to")]]
    runs = [front_decode(*x) for x in zip(cols["r_lcp"], cols["r_len"], cols["r_rest"], strict=True)]
    lefts = [y for x in zip(cols["l_lcp"], cols["l_len"], cols["l_rest"], strict=True) for y in front_decode(*x)[0]]
    base = np.cumsum([0] + [len(r[0]) for r in runs])
    merged = np.array([(base[r] + i, n) for r, i, n in merge_runs(runs)], np.int64).reshape(-1, 2)
    at, lcp = merged[:, 0], merged[:, 1]
    near = np.zeros(len(at), bool)  # has a neighbour that shares enough
    near[1:] |= lcp[1:] >= shared_of(length)
    near[:-1] |= lcp[1:] >= shared_of(length)
    lcp = np.where(lcp >= shared_of(length), lcp, 0)[near]
    at = at[near]
    lo, hi = join("lo", np.int16)[at].astype(int), join("hi", np.int16)[at].astype(int)
    which, first, last = repeated_starts(lcp, [lefts[i] for i in at], lo, hi, length)
    own = at[which]
    pos = join("pos", np.int64)[own]
    spans.append([join("id", np.int64)[own], join("h", np.int64)[own], pos - last, pos - first + length])
    return pa.table({c: np.concatenate([x[i] for x in spans]) for i, c in enumerate(("id", "h", "s", "e"))})


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def keyed(docs: DataFrame) -> DataFrame:
    """docs with _id and _h, which together name a document."""
    return docs.withColumns({"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "_h": row_hash(F.col("text"))})


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), signed=True)


def _cells(data: bytes, p: int, lo: int, hi: int, width: int, length: int) -> Iterator[tuple]:
    """(lo, hi, deal) of each cell that holds offsets from lo to hi of the anchor at p. All strings of a cell hold the bytes that deal is a hash of."""
    for first in range(lo // width * width, hi + 1, width):
        last = min(first + width - 1, length)
        yield max(lo, first), min(hi, last), _digest(first.to_bytes(2), data[p - first : p + length - last])


def _hot_cells(batches: Iterator[pa.RecordBatch], hot: Broadcast, crowded: list[Broadcast], length: int) -> Iterator[pa.RecordBatch]:
    """Cells of the anchors whose hash is hot; with crowded, the deals to be cut at each width so far, only what lies in these."""
    names = ("id", "h", "pos", "lo", "hi", "deal", "context")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int16(), pa.int16(), pa.int64(), pa.int64())
    packed = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))
    cut = [set(c.value.tolist()) for c in crowded]
    rows = []
    for batch in batches:
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
        which, at, low, high, key, _ = text_anchors(texts, length)
        for k in np.flatnonzero(np.isin(key.view(np.int64), hot.value)).tolist():
            data, p = texts[which[k]], int(at[k])
            found = [(p - int(high[k]), p - int(low[k]), 0)]
            for width, within in zip(CELLS, [None, *cut]):
                found = [cell for lo, hi, deal in found if within is None or deal in within for cell in _cells(data, p, lo, hi, width, length)]
            doc, h = batch.column("_id")[which[k]].as_py(), batch.column("_h")[which[k]].as_py()
            rows += [(doc, h, p, lo, hi, deal, _digest(lo.to_bytes(2), hi.to_bytes(2), data[p - hi : p + length - lo])) for lo, hi, deal in found]
            if len(rows) >= RUN:
                yield packed(rows)
                rows = []
    if rows:
        yield packed(rows)


def dealt_cells(docs: DataFrame, hot: np.ndarray, length: int) -> DataFrame:
    """The strings of anchors with a hash in hot: (id, h, pos, lo, hi), cut to cells of their offsets, with deal and context. Cells whose deal occurs once go, as nothing in them repeats.

    Equal strings have the same offset, so the same cell, and the same bytes where all strings of the cell overlap, which deal is a hash of. No deal has more than RANGE_ROWS
    different contexts (nor a millionth of all cells, beyond that), as cells with more are cut further, down to single strings. So what surrounds a frequent passage parts its copies, and
    the passage itself is one context. Each width is one scan of the texts without a shuffle of them.
    """
    share = docs.sparkSession.sparkContext.broadcast
    keys, crowded, ready = share(hot), [], None
    while True:
        scan = functools.partial(_hot_cells, hot=keys, crowded=list(crowded), length=length)
        cells = stored(docs.select("_id", "_h", "text").mapInArrow(scan, "id long, h long, pos long, lo short, hi short, deal long, context long"), "cells")
        most = max(RANGE_ROWS, cells.count() // MOST_HOT)
        contexts = cells.groupBy("deal", "context").agg(F.count(F.lit(1)).alias("times"))
        deals = stored(contexts.groupBy("deal").agg(F.sum("times").alias("times"), F.count(F.lit(1)).alias("n")).where("times > 1"), "deals")
        fine = cells.join(deals.where(F.col("n") <= most).select("deal"), "deal").select(*cells.columns)
        ready = fine if ready is None else ready.unionByName(fine)
        further = np.array([r.deal for r in deals.where(F.col("n") > most).select("deal").collect()], np.int64)  # MOST_HOT at most
        if not len(further):
            return ready
        crowded.append(share(further))


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs of keyed() -> (_id, _h, _spans array<struct<s,e>>) of those that hold repeated strings; byte spans, not yet merged."""
    spark = docs.sparkSession

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()]
            t, at, lo, hi, key, head = text_anchors(texts, length)
            t = pa.array(t, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id").take(t), batch.column("_h").take(t), pa.array(at, pa.int64()), pa.array((at - hi).astype(np.int16)), pa.array((at - lo).astype(np.int16)), pa.array(key.view(np.int64)), pa.array((head >> np.uint64(1)).astype(np.int64))],
                names=["id", "h", "pos", "lo", "hi", "key", "head"],
            )

    found = stored(docs.select("_id", "_h", "text").mapInArrow(find, "id long, h long, pos long, lo short, hi short, key long, head long"), "anchors")
    # Written first, so that the join below is of two plain exchanges and a key with very many anchors can be split.
    often = stored(found.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "repeated-hashes")
    total = often.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    least = max(RANGE_ROWS, total // MOST_HOT)
    hot = F.col("times") > least
    kept = stored(found.join(often, "key").select("id", "h", "pos", "lo", "hi", "head", hot.alias("hot"), F.pmod("key", F.lit(1 << 30)).cast("int").alias("bits")), "candidates")
    n = kept.count()
    hot_keys = np.array([r.key for r in often.where(hot).select("key").collect()], np.int64)  # MOST_HOT at most
    ranges = min(MAX_RANGES, max(shuffle_partitions(spark), -(-n // RANGE_ROWS)))
    marks = kept.agg(F.percentile_approx("head", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if n and ranges > 1 else None
    # A head of so many anchors that it is several marks is parted by hashes. Equal strings have equal hashes, and so stay together.
    splitters, times = np.unique(np.array(marks or [], np.int64), return_counts=True)
    shares = np.append(1, times) * max(1, -(-n // (ranges * RANGE_ROWS)))

    entries = kept.where("NOT hot").select("id", "h", "pos", "lo", "hi", "bits", F.lit(False).alias("hot"))
    if len(hot_keys):  # deals of hot hashes get numbers below zero, others stay above
        cells = dealt_cells(docs, hot_keys, length)
        entries = entries.unionByName(cells.select("id", "h", "pos", "lo", "hi", (F.lit(-1) - F.pmod("deal", F.lit((1 << 31) - 1))).cast("int").alias("bits"), F.lit(True).alias("hot")))
    listed = entries.groupBy(F.col("id").alias("_of"), F.col("h").alias("_of_h")).agg(F.collect_set(F.struct("pos", "lo", "hi", "bits", "hot")).alias("_at"))
    # All columns go through, so that the exchange of docs is the same as that of the final join, and Spark makes it once.
    contexts = docs.join(listed.hint("shuffle_hash"), (docs["_id"] == listed["_of"]) & (docs["_h"] == listed["_of_h"]))

    def sort_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list] = {}
        size = 0

        def out() -> pa.RecordBatch:
            settled: dict[tuple[int, int], list] = {}
            rows = [_emit(target, part, entries, settled, length) for (target, part), entries in held.items()]
            rows += _emit_settled(settled, ranges)
            held.clear()
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        kinds = {"int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in RUN_SCHEMA.split(", ")])
        for batch in batches:
            for doc, h, text, at in zip(*(batch.column(c) for c in ("_id", "_h", "text", "_at")), strict=True):
                doc, h, data = doc.as_py(), h.as_py(), text.as_py().encode("utf-8", "surrogatepass")
                for x in at.as_py():
                    p, lo, hi = x["pos"], x["lo"], x["hi"]
                    right, left = data[p : p + length - lo], data[p - hi : p][::-1]
                    head = int.from_bytes(right[:8]) >> 1
                    target = int(np.searchsorted(splitters, head, side="right"))
                    share = int(shares[target])
                    part = x["bits"] if x["hot"] else x["bits"] % share if share > 1 else 0
                    held.setdefault((target, part), []).append((right, left, doc, h, p, lo, hi))
                    size += 1
                    if size >= RUN:
                        yield out()
                        size = 0
        if held:
            yield out()

    spans = contexts.mapInArrow(sort_runs, RUN_SCHEMA).groupBy("target", "part").applyInArrow(lambda group: _merge_range(group, length), "id long, h long, s long, e long")
    return spans.groupBy(F.col("id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("s", "e")).alias("_spans"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, as_text: bool = False, words: int = 0) -> DataFrame:
    """docs plus kept (the bytes left; as_text: a string of them, without characters that were cut through), n_bytes, n_removed and n_spans.

    Every byte inside a length-byte string that starts at more than one place of the corpus is removed; with words, only
    runs of such bytes that hold so many words (parts of words at their ends included). A null text counts
    as empty; texts below length bytes stay whole; rows that repeat a doc_id are documents of their own (whole repeats
    therefore remove each other). Columns of docs with the new names are replaced, and those
    named like the keys (_id, _h, _of, _of_h, _at, _spans) are left out. No documents give no rows.
    """
    new = ["kept", "n_bytes", "n_removed", "n_spans"]
    own = [c for c in docs.columns if c not in (*new, "_id", "_h", "_of", "_of_h", "_at", "_spans")]
    named = keyed(docs.select(*own))
    joined = named.join(repeated_spans(named, length), ["_id", "_h"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_bytes, n_removed, n_spans = [], [], [], []
            for text, found in zip(batch.column("text"), batch.column("_spans"), strict=True):
                data = (text.as_py() or "").encode("utf-8", "surrogatepass")
                whole = merge_spans([(x["s"], x["e"]) for x in found.as_py() or ()])
                if words:
                    whole = [(s, e) for s, e in whole if len(data[s:e].split(None, words - 1)) >= words]
                left, at = [], 0
                for s, e in whole:
                    left.append(data[at:s])
                    at = e
                left.append(data[at:])
                kept.append(b"".join(left))
                n_bytes.append(len(data))
                n_removed.append(len(data) - len(kept[-1]))
                n_spans.append(len(whole))
            first = pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            arrays = [first, *(pa.array(x, pa.int64()) for x in (n_bytes, n_removed, n_spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *arrays], names=[*own, *new])

    kept_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*own).schema.fields)
    return joined.mapInArrow(cut, f"{kept_schema}, kept {'string' if as_text else 'binary'}, n_bytes long, n_removed long, n_spans long")


#: All 400-byte strings by the hash of each; runs of starts that touch are one removed run.
ORACLE = """
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents),
strings AS (SELECT r, p, md5(b[p : p + 399]) AS k FROM (SELECT r, b, unnest(range(1, n - 398)) AS p FROM docs)),
repeated AS (SELECT r, p FROM strings JOIN (SELECT k FROM strings GROUP BY k HAVING count(*) > 1) USING (k)),
opened AS (SELECT r, p, coalesce(p > lag(p) OVER (PARTITION BY r ORDER BY p) + 400, TRUE) AS opens FROM repeated),
numbered AS (SELECT r, p, count(*) FILTER (opens) OVER (PARTITION BY r ORDER BY p) AS run FROM opened),
runs AS (SELECT r, min(p) AS s, max(p) + 400 AS e FROM numbered GROUP BY r, run),
pieces AS (
  SELECT r, 1 AS s, (SELECT min(s) FROM runs WHERE runs.r = docs.r) AS e FROM docs
  UNION ALL SELECT r, e, lead(s) OVER (PARTITION BY r ORDER BY s) FROM runs),
kept AS (
  SELECT r, unhex(string_agg(CASE WHEN coalesce(e, n + 1) > s THEN hex(b[s : coalesce(e, n + 1) - 1]) ELSE '' END, '' ORDER BY s)) AS bytes
  FROM pieces JOIN docs USING (r) GROUP BY r),
removed AS (SELECT r, sum(e - s) AS n_removed, count(*) AS n_spans FROM runs GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(bytes) AS kept_sha256
FROM docs JOIN kept USING (r) LEFT JOIN removed USING (r)
"""
