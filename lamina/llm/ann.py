"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks of rows. Query blocks meet candidate blocks in tiles; an int8 product of
a tile gives every inner product with a proven error bound. What may still be among a query's k
nearest is recomputed from the floats, and heaps merge the tiles of a task and then the tasks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, stored

#: Rows of a block of queries and of one of candidates.
QUERY_ROWS, BLOCK_ROWS = 8192, 2048
#: Candidate blocks that a lane has at least: each lane sends k rows back for each query.
LANE_BLOCKS = 4


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, norm of the quantised row, norm of the rounding error), the norms as upper bounds."""
    scale = np.maximum(np.abs(x).max(1), 1e-300) / 127
    unit = x / scale[:, None]  # squares of these don't overflow
    q = np.rint(unit).astype(np.int8)
    up = 1 + 1e-9
    return q, scale, np.sqrt((q.astype(float) ** 2).sum(1)) * scale * up, np.sqrt(((unit - q) ** 2).sum(1)) * scale * up + scale * 1e-12


def exact_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in the order of the components."""
    out = np.zeros(len(a))
    for i in range(a.shape[1]):
        out += a[:, i] * b[:, i]
    return out


def tile_nearest(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int, rows: int = 256) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, product) of the pairs that may be among a query's k nearest in this tile, a query's own id left out.

    With x = x8 + e: |x.y - x8.y8| <= |x8| |e_y| + |y8| |e_x| + |e_x| |e_y|.
    """
    with np.errstate(over="ignore", invalid="ignore"):
        return _tile_nearest(q_ids, q, quantise(q), c_ids, c, quantise(c), k, rows)


def _tile_nearest(q_ids, q, q_parts, c_ids, c, c_parts, k: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    (q8, qs, qn, qe), (c8, cs, cn, ce) = q_parts, c_parts
    c_float = c8.astype(np.float32).T
    at_q, at_c, out = [], [], []
    for i in range(0, len(q), rows):
        # Sums of int8 products are whole numbers below 2**24 up to 1040 dimensions, so float32 holds them exactly; beyond, sum in float64.
        kind = np.float32 if q.shape[1] <= 1040 else np.float64
        near = (q8[i : i + rows].astype(kind) @ c_float.astype(kind)).astype(np.float64) * qs[i : i + rows, None] * cs[None, :]
        slack = qn[i : i + rows, None] * ce[None, :] + cn[None, :] * qe[i : i + rows, None] + qe[i : i + rows, None] * ce[None, :] + 1e-12 * (qn[i : i + rows, None] * cn[None, :])
        own = q_ids[i : i + rows, None] == c_ids[None, :]
        low, high = near - slack, near + slack
        beyond = ~(np.isfinite(low) & np.isfinite(high))  # too large for a bound
        low[beyond], high[beyond] = -np.inf, np.inf
        low[own], high[own] = -np.inf, -np.inf
        if low.shape[1] > k:
            least = np.partition(low, -k, axis=1)[:, -k]
            keep = (high >= least[:, None]) & ~own
        else:
            keep = ~own
        a, b = np.nonzero(keep)
        at_q.append(a + i)
        at_c.append(b)
        out.append(exact_products(q[a + i], c[b]))
    return np.concatenate(at_q), np.concatenate(at_c), np.concatenate(out)


def _packed(vectors: DataFrame, block_rows: int, role: str) -> tuple[DataFrame, int]:
    """((dim, block, ids, rows) of about block_rows rows each, dealt by a hash of the id; number of blocks)."""
    blocks = max(1, -(-vectors.count() // block_rows))

    def pack(group: pa.Table) -> pa.Table:
        order = np.argsort(np.array(group.column("id")), kind="stable")
        flat = np.array(group.column("vector").combine_chunks().flatten(), np.float64).reshape(len(order), -1)[order]
        ids = np.array(group.column("id"), np.int64)[order]
        with np.errstate(over="ignore"):
            narrow = flat.astype(np.float32)
        rows = narrow if (narrow == flat).all() else flat  # half the bytes of each copy where nothing is lost
        return pa.table({"dim": group.column("dim").slice(0, 1), "block": group.column("block").slice(0, 1), "ids": [ids.tobytes()], "rows": [rows.tobytes()]})

    dealt = vectors.select("id", "vector", F.size("vector").alias("dim"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    packed = dealt.groupBy("dim", "block").applyInArrow(pack, "dim int, block int, ids binary, rows binary")
    return stored(packed, f"{role}-blocks"), blocks


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector array<double>) of the vectors that are neither null nor zero and hold only finite numbers."""
    v = F.col(vector_col).cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    good = F.forall("vector", finite) & F.exists("vector", lambda x: x != 0)
    return vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vector")).where(F.col("id").isNotNull() & F.col("vector").isNotNull()).where(F.coalesce(good, F.lit(False)))


def nearest(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """queries and candidates of usable() -> (query_id, rank, vec_id, score): the k candidates of the largest inner product.

    Ties go to the smaller vec_id; candidates that carry the query's id are left out. Exact: only pairs that the error bound
    excludes are dropped. Rows that repeat an id with the same vector count once; vectors of unlike lengths do not meet. An
    empty side gives no rows. Every candidate block meets every query block once, as a stated set of queries asks for.
    """
    (q, n_q), (c, n_c) = _packed(queries.distinct(), QUERY_ROWS, "q"), _packed(candidates.distinct(), BLOCK_ROWS, "c")
    lanes = min(-(-n_c // LANE_BLOCKS), max(1, -(-2 * shuffle_partitions(q.sparkSession) // n_q)))
    # A candidate block is sent once to each query block, a query block once to each lane of candidates; they meet in a task, not in a join's rows.
    asked = c.select("dim", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q_block"), F.pmod("block", F.lit(lanes)).alias("lane"), F.lit(1).alias("side"), "ids", "rows")
    asking = q.select("dim", F.col("block").alias("q_block"), F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"), F.lit(0).alias("side"), "ids", "rows")
    key = ["dim", "q_block", "lane"]
    tiles = asking.unionByName(asked).repartition(*key).sortWithinPartitions(*key, "side")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        at, query = None, None

        def out() -> pa.RecordBatch:
            rows = [(i, -v, s) for i, heap in heaps.items() for s, v in heap]
            heaps.clear()
            cols = zip(*rows, strict=True) if rows else [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "vec_id", "score"])

        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in batch.schema.names}
                now = tuple(row[x].as_py() for x in key)
                if now != at:
                    if heaps and now[:2] != at[:2]:  # lanes of one query block that share a task share the heaps
                        yield out()
                    at, query = now, None
                ids = np.frombuffer(row["ids"].as_buffer(), np.int64)
                packed = row["rows"].as_buffer()
                kind = np.float32 if packed.size == 4 * len(ids) * row["dim"].as_py() else np.float64
                x = np.frombuffer(packed, kind).reshape(len(ids), -1).astype(np.float64, copy=False)
                if not row["side"].as_py():  # the query block comes first, if there are queries of this length
                    query = (ids.copy(), x.copy())
                    continue
                if query is None:
                    continue
                a, b, scores = tile_nearest(*query, ids, x, k)
                for asks, vec, s in zip(query[0][a].tolist(), ids[b].tolist(), scores.tolist(), strict=True):
                    heap = heaps.setdefault(asks, [])
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -vec))
                    elif (s, -vec) > heap[0]:
                        heapq.heapreplace(heap, (s, -vec))
        yield out()

    found = tiles.mapInArrow(run, "query_id long, vec_id long, score double")
    # At most k rows from each lane are left of a query.
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The 20 nearest of queries whose vec_id is divisible by 20, over all pairs.
ORACLE = """
WITH vectors AS (
  SELECT DISTINCT vec_id AS id, embedding::DOUBLE[] AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0),
pairs AS (
  SELECT q.id AS query_id, c.id AS vec_id, list_inner_product(q.x, c.x) AS score
  FROM vectors q JOIN vectors c ON len(q.x) = len(c.x) AND q.id <> c.id WHERE q.id % 20 = 0)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
FROM pairs QUALIFY rank <= 20
"""
