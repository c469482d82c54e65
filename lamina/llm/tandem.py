"""Runs of repeated words, by the linear tandem-repeat method over a suffix tree.

A square is a string that stands twice in a row. For each block of the Lempel-Ziv parse, common extensions
from the block's ends give pairs (start, half length) that cover the leftmost occurrence of every
square. These are marked in the suffix tree; walks along suffix links, each to the next rotation, complete the
vocabulary of squares. The leaves below the mark of a square with a primitive half are its occurrences, and
those of one half length at consecutive places merge into a run.

Only stretches of a text that can hold a run of the asked length and exponent are searched: a run repeats the
word triples of all but its first period from no further back than its period, so a stretch without enough
such triples in a row holds none. Stretches of many texts share a tree, parted by symbols that occur once.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position

#: A run has at least so many words and so many periods.
LENGTH, EXPONENT = 24, 3
#: Texts are read, and stretches put into one tree, up to about so many words at a time; one text may have more.
WORDS, TREE_WORDS = 1 << 19, 1 << 17


class Extensions:
    """Names of all substrings whose length is a power of two: common extensions of any two places, both ways, in log n steps."""

    def __init__(self, s: np.ndarray) -> None:
        n = len(s)
        name = np.unique(s, return_inverse=True)[1].astype(np.int64)
        self.n, self.names, width = n, [name.astype(np.int32)], 1
        order = np.argsort(name, kind="stable")
        while width < n and int(name[order[-1]]) < n - 1:
            key = (name + 1) * (n + 1)
            key[: n - width] += name[width:] + 1
            order = np.argsort(key)
            ranked = key[order]
            name = np.empty(n, np.int64)
            name[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
            self.names.append(name.astype(np.int32))
            width *= 2
        self.suffixes, self.rank = order, name

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at i and j, where i != j; places from n on have none."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            at = np.flatnonzero(np.maximum(i, j) + width <= self.n)
            at = at[name[i[at]] == name[j[at]]]
            i[at] += width
            j[at] += width
        return i - start

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Length of the longest common suffix of what ends at i and j, both inclusive."""
        i, j = i.copy(), j.copy()
        start = i.copy()
        for level in range(len(self.names) - 1, -1, -1):
            name, width = self.names[level], 1 << level
            at = np.flatnonzero(np.minimum(i, j) + 1 >= width)
            at = at[name[i[at] - width + 1] == name[j[at] - width + 1]]
            i[at] -= width
            j[at] -= width
        return start - i


class SuffixTree:
    """Nodes 0..n-1 are the leaves by position, the others are inner nodes. The last symbol must occur once."""

    def __init__(self, s: np.ndarray, ext: Extensions) -> None:
        self.s, n, sa = s, len(s), ext.suffixes
        common = np.concatenate([[0], ext.forward(sa[:-1], sa[1:])]) if n > 1 else np.zeros(n, np.int64)
        depth, parent, low, high = [n - i for i in range(n)], [-1] * n, [0] * n, [0] * n
        first = list(range(n))  # the least position below a node
        of_boundary = [0] * n  # the node that parts two neighbours in suffix order
        root = n
        depth.append(0), parent.append(-1), low.append(0), high.append(n), first.append(0)
        open_ = [root]
        boundary = common.tolist()
        boundary.append(0)
        for r, leaf in enumerate(sa.tolist()):
            low[leaf], high[leaf] = r, r + 1
            last, shared = leaf, boundary[r + 1]
            while depth[top := open_[-1]] > shared:
                parent[last] = top
                if first[last] < first[top]:
                    first[top] = first[last]
                high[top] = r + 1
                last = open_.pop()
            if depth[top] < shared:
                top = len(depth)
                depth.append(shared), parent.append(-1), low.append(low[last]), high.append(r + 1), first.append(first[last])
                open_.append(top)
            parent[last] = top
            if first[last] < first[top]:
                first[top] = first[last]
            if r + 1 < n:
                of_boundary[r + 1] = top
        self.root, self.depth, self.parent, self.low, self.high, self.first = root, depth, parent, low, high, first
        symbols, stride = s.tolist(), int(s.max()) + 1
        self.stride, self.symbols = stride, symbols
        self.child = {up * stride + symbols[first[v] + depth[up]]: v for v, up in enumerate(parent) if up >= 0}
        self.link = self._links(ext, common, np.array(of_boundary))

    def _links(self, ext: Extensions, common: np.ndarray, of_boundary: np.ndarray) -> list[int]:
        """For each inner node (less n) the node of its string without the first symbol: the lowest above the next suffixes of its outer leaves."""
        n = len(self.s)
        inner = np.arange(n + 1, len(self.depth))
        out = np.full(len(self.depth) - n, self.root)
        if len(inner):
            low, high = np.array(self.low)[inner], np.array(self.high)[inner]
            a, b = ext.rank[ext.suffixes[low] + 1], ext.rank[ext.suffixes[high - 1] + 1]
            a, b = np.minimum(a, b) + 1, np.maximum(a, b)  # boundaries between the two
            least, span = [np.arange(n, dtype=np.int32)], 1
            while 2 * span <= n:
                x, y = least[-1][: n - 2 * span + 1], least[-1][span : n - span + 1]
                least.append(np.where(common[x] <= common[y], x, y))
                span *= 2
            level = np.frexp(b - a + 1)[1] - 1
            for k in np.unique(level):
                some = np.flatnonzero(level == k)
                x, y = least[k][a[some]], least[k][b[some] - (1 << int(k)) + 1]
                out[inner[some] - n] = of_boundary[np.where(common[x] <= common[y], x, y)]
        return out.tolist()


def lempel_ziv(ext: Extensions) -> np.ndarray:
    """Starts of the blocks, and n: each block is the longest string from there that also starts earlier, or one symbol."""
    n = ext.n
    rank = ext.rank.tolist()
    sa = ext.suffixes.tolist()
    up, down = [r - 1 for r in range(n)], [r + 1 for r in range(n)]
    above, below = [-1] * n, [-1] * n
    for i in range(n - 1, -1, -1):  # of the positions up to i the neighbours in suffix order
        r = rank[i]
        u, d = up[r], down[r]
        if u >= 0:
            above[i] = sa[u]
            down[u] = d
        if d < n:
            below[i] = sa[d]
            up[d] = u
    earlier = np.zeros(n, np.int64)
    for near in (np.array(above), np.array(below)):
        at = np.flatnonzero(near >= 0)
        earlier[at] = np.maximum(earlier[at], ext.forward(at, near[at]))
    step, starts, i = np.maximum(earlier, 1).tolist(), [], 0
    while i < n:
        starts.append(i)
        i += step[i]
    return np.array([*starts, n])


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of its size, number from 1) for sizes[i] numbers each."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + 1


def leftmost_cover(ext: Extensions, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, half length) of squares: the leftmost occurrence of any square is one of these or follows one of its half length place by place.

    A leftmost square whose second half begins in block [h, h1) crosses h1, with its first half inside, or it crosses h; in the
    latter case the second half ends within the next block, as its symbols from h1 on have occurred before.
    """
    n, h, h1 = ext.n, blocks[:-1], blocks[1:]
    size = h1 - h
    b, k = _counted(np.where(h1 < n, size, 0))
    border = h1[b]
    q = border - k
    ahead, back = ext.forward(border, q), np.zeros(len(q), np.int64)
    some = np.flatnonzero(q > 0)
    back[some] = ext.backward(border[some] - 1, q[some] - 1)
    found = (ahead > 0) & (ahead + back >= k)
    starts, halves = [np.maximum(q - back, q - k + 1)[found]], [k[found]]
    b, k = _counted(np.where(h > 0, np.minimum(size + np.append(size[1:], 0), n - h), 0))
    border = h[b]
    q = border + k
    inside = q < n
    ahead = np.zeros(len(q), np.int64)
    ahead[inside] = ext.forward(border[inside], q[inside])
    back = ext.backward(border - 1, q - 1)
    start = np.maximum(border - back, border - k)
    found = (back > 0) & (ahead + back >= k) & (start + k < h1[b])
    return np.concatenate([starts[0], start[found]]), np.concatenate([halves[0], k[found]])


def vocabulary(tree: SuffixTree, starts: np.ndarray, halves: np.ndarray) -> list[tuple[int, int]]:
    """(node at or below its end, length) of every square that occurs."""
    depth, parent, first, symbols, child, stride, n = tree.depth, tree.parent, tree.first, tree.symbols, tree.child, tree.stride, len(tree.s)
    of: dict[int, list[int]] = defaultdict(list)
    for p, k in zip(starts.tolist(), halves.tolist(), strict=True):
        of[p].append(2 * k)
    marked: set[tuple[int, int]] = set()
    for p, lengths in of.items():  # from its leaf up, as long as the leaf is the leftmost below
        v = p
        for length in sorted(set(lengths), reverse=True):
            while depth[parent[v]] >= length and first[parent[v]] == p:
                v = parent[v]
            if depth[parent[v]] >= length:
                break
            marked.add((v, length))
    for v, length in list(marked):
        while True:  # to the square one place on: the first symbol goes, and must follow at the end
            begin = first[v]
            up = parent[v]
            w = tree.link[up - n] if up != tree.root else tree.root
            while depth[w] < length - 1:
                w = child[w * stride + symbols[begin + 1 + depth[w]]]
            if depth[w] == length - 1:
                w = child.get(w * stride + symbols[begin], -1)
                if w < 0:
                    break
            elif symbols[first[w] + length - 1] != symbols[begin]:
                break
            if (w, length) in marked:
                break
            marked.add((w, length))
            v = w
    return list(marked)


def _primitive(ext: Extensions, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the first half of each square is no power of a shorter string."""
    top = int(half.max(initial=1))
    factor = np.arange(top + 1)
    for p in range(2, int(top**0.5) + 1):
        if factor[p] == p:
            multiples = np.arange(p * p, top + 1, p)
            factor[multiples] = np.minimum(factor[multiples], p)
    out, rest = np.ones(len(at), bool), half.copy()
    while (some := np.flatnonzero(rest > 1)).size:
        p = factor[rest[some]]
        q = half[some] // p
        out[some] &= ext.forward(at[some], at[some] + q) < 2 * half[some] - q
        while (again := (rest[some] % p == 0)).any():
            rest[some[again]] //= p[again]
            some, p = some[again], p[again]
    return out


def square_runs(s: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start, length, period) by start, then period: the maximal runs of at least so many symbols and periods in s. The last symbol must occur once."""
    ext = Extensions(s)
    tree = SuffixTree(s, ext)
    squares = vocabulary(tree, *leftmost_cover(ext, lempel_ziv(ext)))
    if not squares:
        return np.empty((0, 3), np.int64)
    node, size = np.array(squares).T
    half = size // 2
    keep = _primitive(ext, np.array(tree.first)[node], half)
    node, half = node[keep], half[keep]
    low, high = np.array(tree.low)[node], np.array(tree.high)[node]
    of, k = _counted(high - low)
    at, period = ext.suffixes[low[of] + k - 1], half[of]
    order = np.lexsort((at, period))
    at, period = at[order], period[order]
    begins = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (period[1:] != period[:-1])]))
    ends = np.append(begins[1:], len(at)) - 1
    runs = np.stack([at[begins], at[ends] + 2 * period[begins] - at[begins], period[begins]], 1)
    runs = runs[runs[:, 1] >= np.maximum(length, exponent * runs[:, 2])]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def stretches(ids: np.ndarray, text_of: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> list[tuple[int, int]]:
    """Disjoint spans of ids, each within a text, that contain every run of at least so many words and periods; text_of ascends."""
    n = len(ids)
    least = length - length // exponent - 2  # triples that come again in the shortest run
    if least < 1 or exponent < 2:
        bounds = np.flatnonzero(np.diff(text_of, prepend=-1, append=-1)) if n else []
        return list(zip(bounds, bounds[1:], strict=False))
    if n < length:
        return []
    mix = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        key = text_of[:-2].astype(np.uint64)
        for k in range(3):
            key = (key ^ ids[k : n - 2 + k].astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)) * mix
            key ^= key >> np.uint64(29)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    back = np.zeros(n - 2, np.int64)  # how far back the triple stood last, 0 if it didn't
    back[order[1:][same]] = order[1:][same] - order[:-1][same]
    back[text_of[2:] != text_of[:-2]] = 0
    good = back > 0
    while True:  # a run of m such triples has a period of at most (m + 2) / (exponent - 1)
        edges = np.flatnonzero(np.diff(good.astype(np.int8), prepend=0, append=0))
        begin, end = edges[::2], edges[1::2]
        size = end - begin
        limit = np.where(size >= least, (size + 2) // (exponent - 1), 0)
        at = np.flatnonzero(good)
        still = back[at] <= np.repeat(limit, size)
        if still.all():
            break
        good[at[~still]] = False
    first = np.searchsorted(text_of, text_of[begin])  # of the text
    out: list[tuple[int, int]] = []
    for x, y in sorted(zip(np.maximum(begin - limit, first).tolist(), (end + 2).tolist(), strict=True)):
        if out and x < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def runs_of(ids: np.ndarray, text_of: np.ndarray, length: int = LENGTH, exponent: int = EXPONENT) -> np.ndarray:
    """Rows (start in ids, length, period) of the runs inside texts, by start, then period."""
    found, some, size = [], [], 0
    spans = stretches(ids, text_of, length, exponent)
    for i, (x, y) in enumerate(spans):
        some.append((x, y))
        size += y - x
        if size >= TREE_WORDS or i == len(spans) - 1:
            alphabet = np.unique(np.concatenate([ids[x:y] for x, y in some]), return_inverse=True)[1]
            parts, marks, at, places = [], int(alphabet.max()) + 1, 0, []
            for k, (x, y) in enumerate(some):
                parts += [alphabet[at : at + y - x], [marks + k]]
                places.append(np.arange(x, y + 1))
                at += y - x
            runs = square_runs(np.concatenate(parts), length, exponent)
            runs[:, 0] = np.concatenate(places)[runs[:, 0]]
            found.append(runs)
            some, size = [], 0
    return np.concatenate(found) if found else np.empty((0, 3), np.int64)


def _groups(texts: Sequence[bytes]) -> Iterator[tuple[int, list[list[bytes]]]]:
    """(index of the first, words of each) of consecutive texts, about WORDS words together."""
    first, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.split())  # by the six white space bytes of ASCII
        size += len(held[-1])
        if size >= WORDS or i == len(texts) - 1:
            yield first, held
            first, held, size = i + 1, [], 0


def find_runs(docs: DataFrame, length: int = LENGTH, exponent: int = EXPONENT) -> DataFrame:
    """docs (with text) plus runs, an array of (start, length, period) by start, then period, counted in words, and collapsed, the text's words without
    those that a run contains after its first period, joined by a space.

    A word is a longest stretch without the white space of ASCII. A run is a stretch with a smallest period that
    no neighbouring word extends, of at least length words and exponent periods. A null or empty text has no runs and collapses to
    the empty string. Repeated rows stay. Columns of docs named like the results are replaced, others stay. One text's words
    are held in memory at a time, or texts of WORDS words.
    """
    new = ["runs", "collapsed"]
    frame, own = by_position(docs, new)
    where = own.index("text")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(where).to_pylist()]
            for first, words in _groups(texts):
                known: defaultdict[bytes, int] = defaultdict()
                known.default_factory = known.__len__
                sizes = np.array([len(w) for w in words])
                ids = np.fromiter((known[w] for ws in words for w in ws), np.int64, int(sizes.sum()))
                starts = np.cumsum(sizes) - sizes
                found = runs_of(ids, np.repeat(np.arange(len(words)), sizes), length, exponent)
                text_of = np.searchsorted(starts, found[:, 0], side="right") - 1
                ends, rows, collapsed = np.searchsorted(text_of, np.arange(len(words) + 1)), [], []
                for i, ws in enumerate(words):
                    own = found[ends[i] : ends[i + 1]] - np.array([starts[i], 0, 0])
                    rows.append([{"start": a, "length": b, "period": q} for a, b, q in own.tolist()])
                    if len(own):
                        inside = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(inside, own[:, 0] + own[:, 2], 1)
                        np.add.at(inside, own[:, 0] + own[:, 1], -1)
                        ws = [w for w, gone in zip(ws, (np.cumsum(inside[:-1]) > 0).tolist(), strict=True) if not gone]
                    collapsed.append(b" ".join(ws).decode("utf-8", "surrogatepass"))
                part = batch.slice(first, len(words))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(rows, kind), pa.array(collapsed, pa.string())], names=[*part.schema.names, *new])

    kept = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kept}, runs array<struct<start: long, length: long, period: long>>, collapsed string").toDF(*own, *new)


def with_planted_runs(doc_id: Column, text: Column) -> Column:
    """The text; for one in ten ids, by crc32 h of the decimal id, a periodic one: with n words, a = h div 10 mod n and p = 1 + (n - a) div (3 + h div 10 mod 8), word i >= a becomes word a + (i - a) mod p. A null id changes nothing."""
    g = F.floor(F.crc32(doc_id.cast("string").cast("binary")) / 10)
    words = F.regexp_extract_all(text, F.lit("[^\\x20\\x09-\\x0D]+"), 0)

    def changed(ws: Column) -> Column:
        n = F.size(ws)
        a = F.pmod(g, n).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        named = F.transform(F.array(F.struct(a.alias("a"), p.alias("p"))), lambda x: F.transform(ws, lambda w, i: F.when(i >= x["a"], F.element_at(ws, x["a"] + F.pmod(i - x["a"], x["p"]) + 1)).otherwise(w)))[0]
        return F.when(n > 0, F.array_join(named, " ")).otherwise(text)

    edited = F.transform(F.array(words), changed)[0]
    return F.when(text.isNotNull() & (F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0), edited).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """find_runs() -> doc_id, n_runs, start, length and period of the run with the greatest exponent (of equal ones that with the least start, then period), exponent_milli, runs_sha256 and collapsed_sha256."""
    better = lambda r, b: r["length"] * b["period"] > b["length"] * r["period"]
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    best = F.aggregate("runs", none, lambda b, r: F.when(b.isNull() | better(r, b), r).otherwise(b))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("_best"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    milli = F.floor(1000 * F.col("_best.length") / F.col("_best.period")).cast("long")
    return out.select("doc_id", "n_runs", *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")], milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
