"""Product codes of vectors in exact integers, with annular norm pruning.

A vector's part is nearest to one of the entries of its codebook. Entries are sorted by norm; as |norm(x) - norm(e)| is never
above the distance of x and e, only the annulus of norms within the best distance so far can hold a nearer entry or an
equal one. It is found by binary search, and shrinks with each better entry; all inside it is measured exactly.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_position, stored

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Integer components are below this, so that squared distances and their sums fit a long for vectors of up to 2^10 components.
LARGEST = 1 << 25
#: Entries of an annulus that are measured in one step, on either side.
STEP = 8


def integer_vectors(column: pa.Array, width: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept: neither null nor with null or non-finite components; coded: kept, of this width, all components in range; the coded vectors' integers)."""
    column = column.cast(pa.list_(pa.float64()))
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    finite = np.isfinite(values.fill_null(np.nan).to_numpy(zero_copy_only=False))
    ends = np.concatenate([[0], np.cumsum(sizes)])
    wrong = np.concatenate([[0], np.cumsum(~finite)])
    kept = (wrong[ends[1:]] == wrong[ends[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    x = np.floor(np.where(finite, values.fill_null(0.0).to_numpy(zero_copy_only=False), 0.0) * SCALE)
    wide = np.concatenate([[0], np.cumsum(np.abs(x) >= LARGEST)])
    coded = kept & (wide[ends[1:]] == wide[ends[:-1]]) & (sizes > 0) & (sizes % PARTS == 0)
    if width is not None:
        coded &= sizes == width
    rows = np.flatnonzero(coded)
    if not len(rows):
        return kept, coded, np.empty((0, width or 0), np.int64)
    if len(set(sizes[rows].tolist())) > 1:
        raise ValueError("vectors of several lengths")
    w = int(sizes[rows[0]])
    return kept, coded, x[ends[rows][:, None] + np.arange(w)].astype(np.int64)


class Codebook:
    """Entries (k, d) of integers, sorted by norm for the search."""

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        norms = np.sqrt((entries.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.sorted, self.norms = entries[self.order], norms[self.order]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(index, squared distance) of each row's nearest entry, ties to the lower index, and the number of distances measured."""
        n, k = len(x), len(self.norms)
        norm = np.sqrt((x.astype(float) ** 2).sum(1))
        best, index = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        # [low, high) has been measured; [left, right) is the annulus
        low = np.clip(np.searchsorted(self.norms, norm) - STEP // 2, 0, max(0, k - STEP))
        high = low.copy()
        left, right = np.zeros(n, np.int64), np.full(n, k)
        rows, measured = np.arange(n), 0
        while len(rows):
            before = np.maximum(low[rows] - STEP, left[rows])
            after = np.minimum(high[rows] + STEP, right[rows])
            for begin, end in ((before, low[rows]), (high[rows], after)):
                for step in range(STEP):
                    some = np.flatnonzero(begin + step < end)
                    if not len(some):
                        break
                    r, at = rows[some], begin[some] + step
                    d = x[r] - self.sorted[at]
                    d = np.einsum("ij,ij->i", d, d)
                    i = self.order[at]
                    better = (d < best[r]) | (d == best[r]) & (i < index[r])
                    best[r[better]], index[r[better]] = d[better], i[better]
                    measured += len(r)
            low[rows], high[rows] = np.minimum(before, low[rows]), np.maximum(after, high[rows])
            # Inclusive: entries at the very distance may have a lower index. The margin is above the rounding of the norms.
            reach = np.sqrt(best[rows].astype(float))
            slack = 1e-9 * (1 + norm[rows] + reach)
            left[rows] = np.searchsorted(self.norms, norm[rows] - reach - slack, side="left")
            right[rows] = np.searchsorted(self.norms, norm[rows] + reach + slack, side="right")
            rows = rows[(left[rows] < low[rows]) | (right[rows] > high[rows])]
        return index, best, measured


def _assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, np.ndarray]:
    """(codes (n, parts), squared distances (n, parts)) of integer vectors."""
    parts = np.split(x, PARTS, axis=1)
    found = [book.nearest(part) for part, book in zip(parts, books, strict=True)]
    return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)


def _batches(batches: Iterator[pa.RecordBatch], width: int, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, 4096):
            part = batch.slice(start, 4096)
            yield part, *integer_vectors(part.column(column), width)


def first_entries(vectors: DataFrame) -> np.ndarray:
    """The codebooks' start, (parts, entries, width): of the coded vectors of the smallest id's length those of the ENTRIES smallest ids."""

    def usable(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("v").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for width in np.unique(sizes[sizes > 0]):  # one length at a time
                rows = np.flatnonzero(sizes == width)
                some = batch.take(pa.array(rows))
                coded, x = integer_vectors(some.column("v"), int(width))[1:]
                ids = some.column("vec_id").filter(pa.array(coded))
                order = np.argsort(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), kind="stable")[:ENTRIES]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(order)), pa.array(list(x[order]), pa.list_(pa.int64()))], names=["vec_id", "x"])

    found = vectors.select("vec_id", "v").mapInArrow(usable, "vec_id long, x array<long>")
    least = found.orderBy(F.col("vec_id").asc_nulls_last(), "x").select(F.size("x").alias("w")).first()
    if least is None:
        return np.empty((PARTS, 0, 0), np.int64)
    rows = found.where(F.size("x") == least.w).orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(ENTRIES).collect()  # ENTRIES rows at most
    x = np.array([r.x for r in rows], np.int64)
    return np.stack(np.split(x, PARTS, axis=1))


def refined(vectors: DataFrame, entries: np.ndarray) -> np.ndarray:
    """One round: entries replaced by the floored means of the parts that are nearest to them; unused ones stay."""
    parts, n, d = entries.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries]
        count, total = np.zeros((parts, n), np.int64), np.zeros((parts, n, d), np.int64)
        for _, _, _, x in _batches(batches, parts * d, "v"):
            codes = _assigned(x, books)[0]
            for p, part in enumerate(np.split(x, parts, axis=1)):
                count[p] += np.bincount(codes[:, p], minlength=n)
                np.add.at(total[p], codes[:, p], part)
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(p * n + e, pa.int64()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["entry", "n", "total"])

    partial = vectors.select("v").mapInArrow(sums, "entry long, n long, total array<long>")
    wide = partial.groupBy("entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(d)])
    out = entries.reshape(parts * n, d).copy()
    for row in wide.collect():  # parts * entries rows at most
        out[row.entry] = [int(row[f"t{i}"]) // row.n for i in range(d)]
    return out.reshape(parts, n, d)


def fit(vectors: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts, entries, width) of vectors (vec_id, v)."""
    entries = first_entries(vectors)
    for _ in range(rounds if entries.size else 0):
        entries = refined(vectors, entries)
    return entries


def codebooks_text(entries: np.ndarray) -> str:
    return ",".join(map(str, entries.ravel().tolist()))


def encode(vectors: DataFrame, entries: np.ndarray) -> DataFrame:
    """vectors (vec_id, v, ...) that are kept, without v, plus code (two hex digits for each part) and error (the squared distance to the coded vector).

    Rows with a null vector, or null or non-finite components go. Kept vectors of another length than the codebooks', or with a component beyond +-LARGEST / SCALE, have
    neither code nor error. Repeated rows stay.
    """
    parts, n, d = entries.shape
    frame, names = by_position(vectors, ["code", "error"])
    own, v = [c for c, name in zip(frame.columns, names, strict=True) if name != "v"], frame.columns[names.index("v")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = [Codebook(e) for e in entries] if n else []
        for batch, kept, coded, x in _batches(batches, parts * d, v):
            codes, errors = np.full(len(kept), None, object), np.full(len(kept), None, object)
            if n and len(x):
                at, distance = _assigned(x, books)
                codes[coded] = ["".join(f"{c:02x}" for c in row) for row in at.tolist()]
                errors[coded] = distance.sum(1)
            keep = pa.array(kept)
            columns = [batch.column(c).filter(keep) for c in own]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(codes[kept], pa.string()), pa.array(errors[kept], pa.int64())], names=[*own, "code", "error"])

    kept_schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.select(*own).schema.fields)
    return frame.mapInArrow(run, f"{kept_schema}, code string, error long").toDF(*[c for c in names if c != "v"], "code", "error")


def coded(embeddings: DataFrame) -> DataFrame:
    """embeddings (vec_id, embedding, label) -> vec_id, code, error, label_error (the errors of equal labels summed, nulls together; null where none has one) and codebooks_sha256.

    No usable rows give no rows. Of rows that repeat a vec_id the one with the least vector comes first in the codebooks' start; null ids come last.
    """
    vectors = embeddings.select("vec_id", F.col("embedding").alias("v"), "label")
    entries = fit(vectors)
    digest = hashlib.sha256(codebooks_text(entries).encode()).hexdigest()
    codes = stored(encode(vectors, entries), "codes")  # read for the sums and for the rows
    sums = stored(codes.groupBy("label").agg(F.sum("error").alias("label_error")), "label-errors")
    of = sums.select(F.col("label").alias("_label"), "label_error")
    return codes.join(of, F.col("label").eqNullSafe(F.col("_label"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    return f"""
near{k} AS MATERIALIZED (
  SELECT v, p, e, dist FROM (
    SELECT x.v, x.p, b.e, list_sum(list_transform(list_zip(x.c, b.c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS dist, row_number() OVER (PARTITION BY x.v, x.p ORDER BY dist, b.e) AS rank
    FROM parts x JOIN book{k} b ON b.p = x.p) WHERE rank = 1)"""


def _book_sql(k: int) -> str:
    return f"""
means{k} AS (SELECT p, e, i, sum(c) AS s, count(*) AS n FROM (SELECT near{k}.p, e, unnest(c) AS c, unnest(range(len(c))) AS i FROM near{k} JOIN parts USING (v, p)) GROUP BY p, e, i),
book{k + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{k} b LEFT JOIN (
    SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS c FROM means{k} GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)"""


#: Every round by all distances, for vectors of one length with components in range and distinct ids.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER () AS v, vec_id, label, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS c FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT v, vec_id, p, c[p * (len(c) // {PARTS}) + 1 : (p + 1) * (len(c) // {PARTS})] AS c FROM kept, range({PARTS}) r(p)),
book0 AS MATERIALIZED (SELECT p, rank AS e, c FROM (SELECT p, c, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS rank FROM parts) WHERE rank < {ENTRIES}),
{",".join(_round_sql(k) + "," + _book_sql(k) for k in range(ROUNDS))},
{_round_sql(ROUNDS)},
coded AS (SELECT v, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(dist)::BIGINT AS error FROM near{ROUNDS} GROUP BY v),
digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{ROUNDS})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (v), digest
"""
