"""The corpus pipeline: stages over documents, each written as Parquet and reread."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import decontam, mixing, quality, simhash, suffix
from lamina.llm.common import removed, shared_dir, table


#: Repeated passages of so many words are cut out. Repeats are sought from so many bytes on, which hold 51 words of two letters.
PASSAGE_WORDS, PASSAGE_BYTES = 51, 160


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal quality model rejects go. Null and empty texts are judged as the empty text; repeated rows are judged alike."""
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(docs.columns)])  # none is named like a result
    return quality.select_quality(own, table(spark, sf_dir, "labels")).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest doc_id stays.

    Null and empty texts are copies of each other; of rows that repeat a doc_id that with the least text stays; rows without doc_id stay.
    """
    return simhash.drop_near_duplicates(docs, simhash.SIMILAR_08)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of PASSAGE_WORDS that occur more than once are cut out wherever they stand; documents of which nothing but white space stays go. n_chars follows the text.

    Null and empty texts stay as they are. Rows that repeat a doc_id and a text are repeats like any other.
    """
    own = [F.col(c).alias(f"own{i}") if c not in ("doc_id", "text", "n_chars") else F.col(c) for i, c in enumerate(docs.columns)]  # none is named like a result
    cut = suffix.remove_repeats(docs.select(*own), PASSAGE_BYTES, as_text=True, words=PASSAGE_WORDS).where("n_removed = 0 OR kept RLIKE '\\\\S'")
    n_chars = F.length("kept").cast(docs.schema["n_chars"].dataType)
    text, n_chars = (F.when(F.col("n_removed") > 0, new).otherwise(F.col(old)) for new, old in ((F.col("kept"), "text"), (n_chars, "n_chars")))
    return cut.withColumns({"text": text, "n_chars": n_chars}).drop("kept", "n_bytes", "n_removed", "n_spans").toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go; those without words stay."""
    own = docs.toDF(*[c if c in ("doc_id", "text") else f"own{i}" for i, c in enumerate(docs.columns)])  # none is named like a result
    found = decontam.decontaminate(own, table(spark, sf_dir, "benchmark")).where("size(items) = 0")
    return found.select(*own.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target shares and shuffled; a null source is one of its own, a null n_chars counts as zero, rows of one doc_id draw the same count."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("near_dedup", near_dedup_stage), ("suffix_dedup", suffix_dedup_stage), ("decontamination", decontamination_stage), ("mixing", mixing_stage)]

#: The stages train a model, compare fingerprints and sort suffixes: no SQL expresses them. tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
