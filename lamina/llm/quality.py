"""Quality by ordinal cumulative-link regression over hashed text.

P(grade > k) = sigmoid(score - threshold_k) with one weight vector for all grades and ordered
thresholds. A text's features are the relative frequencies of its hashed byte 4-grams (letter case
and punctuation kept), so every byte of the text counts, and one bucket for words that repeat the
word before them. Scoring is a map with a weight vector of
fixed size; fitting takes a bounded, hash-chosen sample of rated rows.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_value, pieces, received

BITS = 16
#: Hashed buckets, then the share of words that repeat the word before them.
WIDTH = (1 << BITS) + 1
#: Rated rows that the fit takes, those with the smallest hash of doc_id, and the bytes of each (scoring reads whole texts).
SAMPLE, SAMPLE_BYTES = 3000, 1 << 13
#: A document is kept if P(grade > lowest) is at least this.
KEEP = 0.5


def gram_codes(data: bytes) -> np.ndarray:
    """Hashes of the byte 4-grams; texts are framed by spaces, so none is too short."""
    b = np.frombuffer(b"  " + data + b"  ", np.uint8).astype(np.uint32)
    x = b[:-3] | b[1:-2] << np.uint32(8) | b[2:-1] << np.uint32(16) | b[3:] << np.uint32(24)
    x *= np.uint32(2654435761)
    x ^= x >> np.uint32(15)
    x *= np.uint32(2246822519)
    return x >> np.uint32(32 - BITS)


def chunks(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    for i in range(0, len(data) or 1, size):
        yield data[i : i + size]


def text_features(text: str | None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids and square roots of relative frequencies (the 4-grams' have unit length); most: over that many bytes only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    data = data if most is None else pieces(data, most)
    counts = np.zeros(1 << BITS)
    for part in chunks(data):
        counts += np.bincount(gram_codes(part), minlength=1 << BITS)
    at, words = np.flatnonzero(counts), data.split()
    again = sum(map(operator.eq, words, words[1:])) / len(words) if words else 0.0
    return np.append(at, WIDTH - 1).astype(np.int32), np.append(np.sqrt(counts[at] / counts.sum()), np.sqrt(again)).astype(np.float32)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade > grades[k]) for each k but the last."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - scores[:, None], -60, 60)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, l2: float = 2e-4, steps: int = 160, rate: float = 0.12) -> OrdinalModel:
    """Adam on the mean cumulative-link loss. Thresholds are a first one plus sums of exponentials, and so stay ordered."""
    grades = np.unique(y).astype(float)
    if len(grades) < 2:  # nothing to tell apart: every text has the one grade
        only = grades if len(grades) else np.array([1.0])
        return OrdinalModel(np.zeros(WIDTH, np.float32), np.full(1, -60.0), np.array([only[0] - 1, only[0]]))
    level = np.searchsorted(grades, y)
    beyond = (level[:, None] > np.arange(len(grades) - 1)[None, :]).astype(float)
    idx, val = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    row = np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    share = np.clip(beyond.mean(0), 1e-3, 1 - 1e-3)
    first = np.log((1 - share) / share)
    w, t0, gaps = np.zeros(WIDTH), first[0], np.log(np.maximum(np.diff(first), 1e-2))
    params = [w, np.array([t0]), gaps]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        scores = np.bincount(row, params[0][idx] * val, len(rows))
        thresholds = params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))])
        p = 1 / (1 + np.exp(np.clip(thresholds[None, :] - scores[:, None], -60, 60)))
        slope = (p - beyond) / len(rows)
        g_score, g_thr = slope.sum(1), -slope.sum(0)
        grads = [np.bincount(idx, g_score[row] * val, WIDTH) + l2 * params[0], np.array([g_thr.sum()]), np.array([g_thr[k + 1 :].sum() * np.exp(x) for k, x in enumerate(params[2])])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            params[i] -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    thresholds = params[1][0] + np.concatenate([[0.0], np.cumsum(np.exp(params[2]))])
    return OrdinalModel(params[0].astype(np.float32), thresholds, grades)


def fit(docs: DataFrame, labels: DataFrame, grade: str = "quality", sample: int = SAMPLE) -> OrdinalModel:
    """Fit on at most sample rated rows and SAMPLE_BYTES of each, so the driver gets 8 bytes for each of sample * SAMPLE_BYTES at most.

    A doc_id rated more than once counts with its mean grade, rounded down; of texts that repeat a doc_id the least counts; null ids and grades are left out.
    """
    rated = labels.where(F.col(grade).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.floor(F.avg(grade)).cast("double").alias("_grade"))
    chosen = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # sample rows at most
    texts = texts.groupBy("doc_id", "_grade").agg(F.min("text").alias("text"))

    def featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            feats = [text_features(t, SAMPLE_BYTES) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("_grade"), pa.array([f[0] for f in feats], pa.list_(pa.int32())), pa.array([f[1] for f in feats], pa.list_(pa.float32()))], names=["doc_id", "_grade", "at", "val"])

    got = texts.mapInArrow(featurize, "doc_id long, _grade double, at array<int>, val array<float>").toArrow().combine_chunks()
    if not got.num_rows:
        return fit_ordinal([], np.zeros(0))
    ids, y, (at, val) = np.asarray(got["doc_id"]), np.asarray(got["_grade"]), (got[c].chunk(0) for c in ("at", "val"))
    ends, at, val = np.asarray(at.offsets), np.asarray(at.values), np.asarray(val.values)  # views of the Arrow buffers
    order = np.lexsort((np.diff(ends), ids))
    return fit_ordinal([(at[ends[i] : ends[i + 1]], val[ends[i] : ends[i + 1]]) for i in order], y[order])


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs plus grade_score, expected_grade, tail_probs (P(grade > k) for each k but the highest) and tail_prob (the first of them).

    Null and empty texts are scored as the empty text. Columns with the new names are replaced. Repeated rows stay.
    """
    new = ["grade_score", "expected_grade", "tail_probs", "tail_prob"]
    frame = docs.select(*[c for c in docs.columns if c not in new])
    sent = by_value(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = received(sent)
        for batch in batches:
            scores = np.zeros(batch.num_rows)
            for i, text in enumerate(batch.column("text").to_pylist()):
                at, val = text_features(text)
                scores[i] = float(m.weights[at].astype(float) @ val.astype(float))
            tails = m.tails(scores)
            arrays = [pa.array(scores), pa.array(m.expected(tails)), pa.array(list(tails), pa.list_(pa.float64())), pa.array(tails[:, 0])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *new])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kept}, grade_score double, expected_grade double, tail_probs array<double>, tail_prob double")


def select_quality(docs: DataFrame, labels: DataFrame, keep: float = KEEP, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs with P(grade > lowest) >= keep, in their own columns."""
    return score(docs, fit(docs, labels, sample=sample)).where(F.col("tail_prob") >= keep).select(*docs.columns)
