"""Toxicity by compression distance.

zstandard trains a dictionary on windows of ordinary text and one on the passages that mark toxic
text: the words that toxic texts hold significantly more often than ordinary ones, where they stand. The
toxic side compresses with both, the ordinary side with the first alone. A window's distance is its
compressed length on the ordinary side less that on the toxic side. Windows start at words, so that a
passage meets the dictionary in the same phase wherever it stands. A text's largest distances and its
number of windows go through a logistic calibration, whose value of a half is the threshold; it is
fitted on rows that the dictionaries have not seen.

A dictionary trained on all windows of toxic texts tells little: they are ordinary but for a few words.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, stored

#: Bytes of a window, letters of the words that windows start at, and zstandard's level.
WINDOW, LETTERS, LEVEL = 32, 5, 9
#: Labelled rows of each class that the fit takes, those with the smallest hash of doc_id, and bytes of each that reach the driver.
SAMPLE, SAMPLE_BYTES = 2000, 1 << 14
#: The part of them that trains the dictionaries; the others fit the calibration.
DICTIONARY_PART = 0.6
#: Bytes of the two dictionaries, and windows of ordinary text that train the first.
ORDINARY_BYTES, TOXIC_BYTES, ORDINARY_WINDOWS = 4096, 3000, 20_000
#: A word marks toxic text from this many standard errors on, a word's first bytes from so many.
SIGNIFICANT, STEM_SIGNIFICANT, STEM_BYTES = 6.0, 8.0, (4, 5, 6)
#: A passage trains as often as it occurs, up to so many times; few passages are repeated up to so many.
PASSAGE_TIMES, PASSAGES = 3, 3000
#: Text bytes whose windows are compressed by one call, and windows of a long text by one.
STEP_BYTES, STEP_WINDOWS = 1 << 19, 1 << 16
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WORD = re.compile(rb"[a-z\x80-\xff]+")
_IS_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])


def folded(text: str | None) -> bytes:
    """A-Z in lower case, behind one space: the first word starts like any other."""
    return b" " + (text or "").encode("utf-8", "surrogatepass").translate(_LOWER)


def window_starts(data: bytes, first: np.ndarray) -> np.ndarray:
    """Starts of windows in data, which holds folded texts that start at first: each text's start, the byte before each word, and every WINDOW bytes where no word starts. Every byte is in some window."""
    letter = _IS_LETTER[np.frombuffer(data + b" " * LETTERS, np.uint8)]
    n = len(data)
    at = ~letter[:n]
    for k in range(1, LETTERS + 1):
        at &= letter[k : n + k]
    at[first] = True
    starts = np.flatnonzero(at)
    steps = np.maximum(1, -(-np.diff(np.append(starts, n)) // WINDOW))
    nth = np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)
    return np.repeat(starts, steps) + WINDOW * nth


class WindowLengths:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, content: bytes) -> None:
        self.content = content
        d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)

    def __reduce__(self):
        return WindowLengths, (self.content,)

    def __call__(self, data: bytes, segments: bytes) -> np.ndarray:
        out = self.zstd.multi_compress_to_buffer(zstandard.BufferWithSegments(data, segments))
        return np.fromiter(map(len, out), np.int64, len(segments) // 16)


@dataclass
class CompressionModel:
    ordinary: WindowLengths
    toxic: WindowLengths
    weights: np.ndarray

    def distances(self, texts: list[bytes]) -> list[np.ndarray]:
        """Distances of all windows of each folded text; short texts share a call."""
        out: list[np.ndarray] = []
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= STEP_BYTES):
                size += len(texts[j])
                j += 1
            data = b"".join(texts[i:j])
            ends = np.cumsum([len(t) for t in texts[i:j]])
            first = ends - [len(t) for t in texts[i:j]]
            starts = window_starts(data, first)
            text = np.searchsorted(first, starts, side="right") - 1
            segments = np.stack([starts, np.minimum(starts + WINDOW, ends[text]) - starts], axis=1).astype(np.uint64)
            found = []
            for s in range(0, len(starts), STEP_WINDOWS):
                part = segments[s : s + STEP_WINDOWS].tobytes()
                found.append(self.ordinary(data, part) - self.toxic(data, part))
            out += np.split(np.concatenate(found), np.searchsorted(text, np.arange(1, j - i)))
            i = j
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(d) for d in self.distances([folded(t) for t in texts])]).reshape(len(texts), -1)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))) if len(texts) else np.zeros(0)


def features(d: np.ndarray) -> np.ndarray:
    top = np.sort(d)[::-1][:8].astype(float)
    n = np.log(len(d))
    return np.array([top[0], top[:2].mean(), top[:4].mean(), top.mean(), top[0] - 0.5 * n, n, 1.0])


def marking_words(toxic: list[bytes], ordinary: list[bytes]) -> set[bytes]:
    """Words that significantly more toxic than ordinary texts hold, or whose beginnings are such."""
    words, stems = (Counter(), Counter()), (Counter(), Counter())
    for side, texts in enumerate((toxic, ordinary)):
        for t in texts:
            own = set(_WORD.findall(t))
            words[side].update(own)
            stems[side].update({w[:k] for w in own for k in STEM_BYTES if len(w) >= k})
    (in_toxic, in_ordinary), nt, no = words, max(1, len(toxic)), max(1, len(ordinary))

    def excess(counts: tuple[Counter, Counter], w: bytes) -> float:
        p = (counts[0][w] + counts[1][w]) / (nt + no)
        return (counts[0][w] / nt - counts[1][w] / no) / (p * (1 - p) * (1 / nt + 1 / no) + 1e-12) ** 0.5

    beginnings = {w for w, n in stems[0].items() if n >= 3 and excess(stems, w) > STEM_SIGNIFICANT and n / nt > 8 * stems[1][w] / no}
    sure = {w for w, n in in_toxic.items() if n >= 3 and excess(words, w) > SIGNIFICANT}
    return sure | {w for w, n in in_toxic.items() if n > in_ordinary[w] and any(w[:k] in beginnings for k in STEM_BYTES)}


def trained(samples: list[bytes], size: int) -> bytes:
    """The content of a dictionary that zstandard trains on samples. Too few samples for it are taken whole.

    A trained dictionary is entropy tables, three start offsets (1, 4 and 8), and content. Only the content is used: tables fitted to one class would change all lengths.
    """
    try:
        whole = zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(dict.fromkeys(samples))[-size:]
    return whole.partition(np.array([1, 4, 8], "<u4").tobytes())[2]


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[WindowLengths, WindowLengths]:
    """(ordinary, toxic), from folded texts."""
    windows = [t[i : i + WINDOW] for t in ordinary for i in range(0, len(t), WINDOW)]
    at = np.random.default_rng(0).permutation(len(windows))[:ORDINARY_WINDOWS]
    base = trained([windows[i] for i in at], ORDINARY_BYTES)
    marks = marking_words(toxic, ordinary)
    passages = Counter(t[max(0, m.start() - 1) : m.end() + 1] for t in toxic for m in _WORD.finditer(t) if m[0] in marks)
    samples = [p for p, n in passages.items() for _ in range(min(n, PASSAGE_TIMES))]
    samples *= max(1, PASSAGES // max(1, len(samples)))
    return WindowLengths(base or b" "), WindowLengths(base + (trained(samples, TOXIC_BYTES) if samples else b"") or b" ")


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float = 1e-2, steps: int = 60) -> np.ndarray:
    """Weighted logistic regression by Newton steps; the last column is the constant."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    mean[-1], sd[-1] = 0.0, 1.0
    z, w = (x - mean) / sd, np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (weight * (p - y)) + l2 * w
        hess = (z * (weight * p * (1 - p))[:, None]).T @ z + (l2 + 1e-9) * np.eye(len(w))
        w -= np.linalg.solve(hess, grad)
    out = w / sd
    out[-1] = w[-1] - (w / sd * mean)[:-1].sum()
    return out


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, toxic, share, text): at most sample rows of each class among the rows that are not held out; share is the class's share of the labels.

    A doc_id labelled more than once is toxic if any of its labels is; of texts that repeat a doc_id the least counts. Null ids and labels are left out.
    """
    label = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    open_ = label.where(~held_out("doc_id"))
    total = {r.toxic: r.n for r in open_.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two classes
    chosen = None
    for value in (0, 1):
        part = open_.where(F.col("toxic") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
        part = part.withColumn("share", F.lit(total.get(value, 0) / max(1, sum(total.values()))))
        chosen = part if chosen is None else chosen.unionByName(part)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # 2 * sample rows at most
    return found.groupBy("doc_id", "toxic", "share").agg(F.min("text").alias("text"))


def held_out(doc_id: str):
    """A null doc_id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> CompressionModel:
    """DICTIONARY_PART of the sample trains the dictionaries, the rest the calibration. The driver gets SAMPLE_BYTES at most of a text and the features of whole texts.

    Where one class is missing, every text gets the score of the other (0 or 1 but for 1e-13); without any labels that of the ordinary one.
    """
    rows = stored(training_rows(docs, labels, sample).select(F.col("doc_id").cast("long").alias("doc_id"), "toxic", "share", "text"), "toxicity-sample")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [pieces(folded(t), SAMPLE_BYTES) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(data, pa.binary())], names=["doc_id", "toxic", "share", "data"])

    got = sorted(rows.mapInArrow(cut, "doc_id long, toxic int, share double, data binary").toArrow().to_pylist(), key=lambda r: r["doc_id"])
    half = [{0: [], 1: []}, {0: [], 1: []}]
    for i, r in enumerate(got):
        n0, n1 = (len(side[r["toxic"]]) for side in half)
        half[n0 >= DICTIONARY_PART * (n0 + n1 + 1)][r["toxic"]].append(i)
    ordinary, toxic = train_dictionaries([got[i]["data"] for i in half[0][1]], [got[i]["data"] for i in half[0][0]])
    model = CompressionModel(ordinary, toxic, np.array([0.0] * 6 + [-30.0 if not half[1][1] else 30.0]))
    if not half[1][0] or not half[1][1]:
        return model
    sent = docs.sparkSession.sparkContext.broadcast((ordinary.content, toxic.content))  # some 12 KB

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CompressionModel(*map(WindowLengths, sent.value), np.zeros(0))
        for batch in batches:
            x = [features(d) for d in m.distances([folded(t) for t in batch.column("text").to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

    of = {r["doc_id"]: r["x"] for r in rows.mapInArrow(measure, "doc_id long, x array<double>").toArrow().to_pylist()}
    at = half[1][0] + half[1][1]
    x, y = np.array([of[got[i]["doc_id"]] for i in at]), np.array([got[i]["toxic"] for i in at], float)
    each = {v: got[half[1][v][0]]["share"] / len(half[1][v]) for v in (0, 1)}
    model.weights = calibrate(x, y, np.array([each[int(v)] for v in y]) * len(y))
    return model


def score(docs: DataFrame, model: CompressionModel) -> DataFrame:
    """docs plus toxic_score (0 to 1). Null and empty texts are scored as one space. A column toxic_score of docs is replaced; repeated rows stay."""
    frame = docs.select(*[c for c in docs.columns if c != "toxic_score"])
    sent = docs.sparkSession.sparkContext.broadcast((model.ordinary.content, model.toxic.content, model.weights))  # some 12 KB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, t, w = sent.value
        m = CompressionModel(WindowLengths(o), WindowLengths(t), w)
        for batch in batches:
            scores = pa.array(m.scores(batch.column("text").to_pylist()), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, "toxic_score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
    return frame.mapInArrow(run, f"{kept}, toxic_score double")
