"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the word windows of the benchmark items. For each pattern length a shift table over
blocks of two words (one word for one-word patterns) tells how far the scan may jump; only a block
that ends some pattern opens a bucket, which the hash of the pattern's last words selects, and its
patterns are compared word by word. Documents are scanned in place by a map; only benchmark text is
broadcast, in blocks of bounded size, and each Python worker builds a block's tables once.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_hash

WINDOW = 10
#: Bytes of benchmark text searched at once: tables take some 40 times as much (about 160 MB in a Python worker). A larger benchmark is searched in several such blocks.
BLOCK_BYTES = 4 << 20
#: Last words of a pattern whose hash selects its bucket.
SUFFIX = 4

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz"
#: ASCII letters in lower case, digits and all bytes of non-ASCII characters stay; the rest becomes a space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _WORD_BYTES else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class ShiftTable:
    """Wu-Manber tables of patterns that all have m words. Words are numbers; text keeps those of the items, one item after the other."""

    def __init__(self, m: int, vocabulary: dict[bytes, int]) -> None:
        self.m, self.block, self.suffix = m, min(2, m), min(SUFFIX, m)
        self.far = m - self.block + 1
        self.vocabulary = vocabulary
        self.text = array("i")
        self.ends: list[int] = []
        self.owners: list[str] = []
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, int | list[int]] = {}

    def _block(self, at: int) -> int:
        """The block of words that ends at at, as one number."""
        return self.text[at - 1] << 32 | self.text[at] if self.block == 2 else self.text[at]

    def add(self, words: list[bytes], owner: str) -> None:
        """All windows of an item."""
        first = len(self.text)
        self.text.extend(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words)
        self.owners.append(owner)
        self.ends.append(len(self.text))
        for start in range(first, len(self.text) - self.m + 1):
            end = start + self.m
            key = hash(self.text[end - self.suffix : end].tobytes())
            held = self.buckets.setdefault(key, start)
            if isinstance(held, list):
                held.append(start)
            elif held != start:
                self.buckets[key] = [held, start]
        # A block may be followed by m - block words at most in some pattern; the least distance to a pattern's end counts.
        for at in range(first + self.block - 1, len(self.text)):
            block, least = self._block(at), max(0, first + self.m - 1 - at)
            if self.shift.get(block, self.far) > least:
                self.shift[block] = least

    def search(self, words: list[bytes]) -> Iterator[tuple[int, set[str]]]:
        """(index of the first word, owners) of each occurrence."""
        m, far, jump, number, i, n = self.m, self.far, self.shift.get, self.vocabulary.get, self.m - 1, len(words)
        pairs = self.block == 2
        while i < n:
            block = number(words[i - 1], -1) << 32 | number(words[i], -1) if pairs else number(words[i], -1)
            step = jump(block, far)
            if step:
                i += step
                continue
            here = array("i", (number(w, -1) for w in words[i - m + 1 : i + 1]))
            starts = self.buckets.get(hash(here[m - self.suffix :].tobytes()), ())
            owners = {self.owners[bisect_right(self.ends, s)] for s in ((starts,) if isinstance(starts, int) else starts) if self.text[s : s + m] == here}
            if owners:
                yield i - m + 1, owners
            i += 1


def build_tables(items: Iterable[tuple[str, str | None]], window: int = WINDOW) -> list[ShiftTable]:
    """One table for each pattern length: window, and the lengths of shorter items."""
    tables: dict[int, ShiftTable] = {}
    vocabulary: dict[bytes, int] = {}
    for owner, text in items:
        words = words_of(text)
        m = min(window, len(words))
        if m:
            tables.setdefault(m, ShiftTable(m, vocabulary)).add(words, owner)
    return list(tables.values())


def find(words: list[bytes], tables: list[ShiftTable]) -> tuple[list[list[int]], set[str]]:
    """Disjoint sorted [start, end) word spans inside occurrences, and the owners found."""
    found, owners = [], set()
    for t in tables:
        for at, own in t.search(words):
            found.append((at, at + t.m))
            owners |= own
    return merged(found), owners


def merged(spans: Iterable) -> list[list[int]]:
    out: list[list[int]] = []
    for s, e in sorted(map(tuple, spans)):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return out


def _benchmark_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return [items] if n == 1 else [items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i) for i in range(n)]


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs (any columns, with text) plus n_words, hit_spans (array of [start, end) word spans) and items (array of found item ids as strings, sorted).

    Null or empty text: no words, no hits. An empty benchmark hits nothing. Repeated rows stay and are judged alike.
    A null item_id is named ''. Input columns that clash with the three new ones are replaced; those named _k and _l are
    left out. A benchmark above block_bytes is searched block by block; what the other blocks find, by two hashes of the
    text, is joined to what the first found.
    """
    own = [c for c in docs.columns if c not in ("n_words", "hit_spans", "items", "_k", "_l")]
    base = docs.select(*own)
    extra = "n_words long, hit_spans array<array<long>>, items array<string>"
    first, *others = _benchmark_blocks(benchmark, block_bytes)
    sc = docs.sparkSession.sparkContext

    def search(frame: DataFrame, block: DataFrame) -> DataFrame:
        # Bounded: block_bytes of text at most, plus one item.
        sent = sc.broadcast({"items": [(r.item, r.text) for r in block.collect()]})

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = sent.value  # one object for all tasks of a worker
            if "tables" not in held:
                held["tables"] = build_tables(held["items"], window)
            tables = held["tables"]
            for batch in batches:
                n_words, spans, items = [], [], []
                for text in batch.column("text").to_pylist():
                    words = words_of(text)
                    hit, owners = find(words, tables)
                    n_words.append(len(words))
                    spans.append(hit)
                    items.append(sorted(owners))
                new = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "n_words", "hit_spans", "items"])

        kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema.fields)
        return frame.mapInArrow(scan, f"{kept}, {extra}")

    if not others:
        return search(base, first)
    keys = [row_hash(F.col("text")).alias("_k"), F.xxhash64("text", F.lit(11)).alias("_l")]
    parts = None
    for block in others:
        part = search(base.select("text", *keys), block).where("size(items) > 0").select("_k", "_l", "hit_spans", "items")
        parts = part if parts is None else parts.unionByName(part)
    # Equal texts have equal hits: of a text's rows that a block finds, one is enough.
    more = parts.distinct().groupBy("_k", "_l").agg(F.flatten(F.collect_list("hit_spans")).alias("_spans"), F.flatten(F.collect_list("items")).alias("_items"))
    joined = search(base, first).withColumns({"_k": keys[0], "_l": keys[1]}).join(more, ["_k", "_l"], "left")
    spans = F.array_sort(F.concat("hit_spans", F.coalesce("_spans", F.array().cast("array<array<long>>"))))
    grow = F.aggregate(
        spans, F.array().cast("array<array<long>>"),
        lambda out, s: F.when((F.size(out) > 0) & (s[0] <= F.element_at(out, -1)[1]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.array(F.element_at(out, -1)[0], F.greatest(F.element_at(out, -1)[1], s[1]))))).otherwise(F.concat(out, F.array(s))),
    )
    items = F.array_sort(F.array_distinct(F.concat("items", F.coalesce("_items", F.array().cast("array<string>")))))
    return joined.select(*own, "n_words", F.when(F.col("_spans").isNull(), F.col("hit_spans")).otherwise(grow).alias("hit_spans"), items.alias("items"))


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of what decontaminate() found."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )



#: Windows as joined strings, by an equi-join of the item's with the documents' of that length.
ORACLE = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
starts AS (SELECT item, w, least(len(w), {WINDOW}) AS m, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS p FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, m, array_to_string(w[p : p + m - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT m FROM windows),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
runs AS (
  SELECT r, p, m, count(*) OVER ahead AS n, string_agg(word, ' ') OVER ahead AS k FROM words, sizes WHERE m = {WINDOW}
  WINDOW ahead AS (PARTITION BY r, m ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
short AS (
  SELECT r, p, m, array_to_string(w[p : p + m - 1], ' ') AS k
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS p FROM docs, sizes WHERE m < {WINDOW})),
found AS (
  SELECT r, p, m, item FROM (SELECT r, p, m, k FROM runs WHERE n = m UNION ALL SELECT * FROM short) JOIN windows USING (m, k)),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(p, p + m)) AS place FROM found) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT r, item FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN named USING (r)
"""
