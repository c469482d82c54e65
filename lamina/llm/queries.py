"""The queries of this subpackage and their SQL. Each applies its operator to a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontam, heavy_light, html_main, mixing, quality, simhash, suffix, tandem, toxicity, url_filter, vector_codes
from .common import table


def op1_simhash_vptree(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), simhash.EXACT_64)
    return found.select("doc_id", simhash.hex_digits().alias("fingerprint"), "component_id")


def op2_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = html_main.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return texts.withColumn("n_chars", F.length("text").cast("long"))


def op3_quality_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs.select("doc_id", "text"), quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", "expected_grade", "tail_prob", (F.col("tail_prob") >= quality.KEEP).alias("keep"))


def op4_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_block_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return ann.nearest(vectors.where("id % 20 = 0"), vectors, k=20)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    control = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", control), (-7, 1, "assistant", control)], rows.schema)
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op8_url_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_compression_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out("doc_id").alias("held_out"), F.col("toxic_score").alias("score"), (F.col("toxic_score") >= 0.5).cast("int").alias("predicted"))


def op10_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text"))


def op11_heavy_light_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heavy_light.joined(table(spark, sf_dir, "documents"))


def op12_annular_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(table(spark, sf_dir, "embeddings"))


def op13_tandem_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return tandem.digest(tandem.find_runs(docs.select("doc_id", tandem.with_planted_runs(F.col("doc_id"), F.col("text")).alias("text"))))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash_vptree, op2_line_blocks, op3_quality_ordinal, op4_poisson_mix, op5_block_ann,
        op6_suffix_dedup, op7_chat_spans, op8_url_words, op9_compression_toxicity, op10_wu_manber,
        op11_heavy_light_join, op12_annular_codes, op13_tandem_runs,
    )
}

ORACLES = {"op4_poisson_mix": mixing.ORACLE, "op5_block_ann": ann.ORACLE, "op6_suffix_dedup": suffix.ORACLE, "op7_chat_spans": chat.ORACLE, "op10_wu_manber": decontam.ORACLE, "op11_heavy_light_join": heavy_light.ORACLE, "op12_annular_codes": vector_codes.ORACLE}
