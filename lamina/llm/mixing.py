"""Mixing sources to target weights by Poisson replication.

Each source gets a repetition rate: the share it should have over the share it has. Each document
draws a Poisson count with that mean by inverting the distribution at a uniform number hashed from
its doc_id, is exploded by its count, and all copies are shuffled by another hash. The text crosses
the network once; rates come from a scan of two narrow columns.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_position

SEED = 1729
#: Target share of a source is its size to this power, where no weights are given.
TEMPERATURE = 0.5
#: Sources whose rates are broadcast; more are joined by a shuffle that splits skewed sources.
BROADCAST_SOURCES = 10_000
#: A larger mean is drawn as a sum of independent draws of at most this mean, as exp(-mean) must not vanish.
MEAN_STEP = 64.0


def unit(*parts: Column | str) -> Column:
    """A uniform number in [0, 1) of 52 bits, from the md5 of the parts joined by ':'."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2**52))


def rates(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, volume: float = 1.0) -> DataFrame:
    """source, size, rate: rate = volume * total size * weight / sum of weights / size. Sources not in weights get none; a source of size zero keeps rate volume."""
    size = docs.groupBy("source").agg(F.sum(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0))).alias("size"))
    if weights is None:
        weighted = size.withColumn("weight", F.pow("size", F.lit(temperature)))
    else:
        named = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()], "source string, weight double")
        weighted = size.join(F.broadcast(named), "source", "left").fillna(0.0, ["weight"])
    total = weighted.agg(F.sum("size").alias("all_size"), F.sum("weight").alias("all_weight"))
    rate = F.when(F.col("size") > 0, F.lit(volume) * F.col("all_size") * F.col("weight") / F.col("all_weight") / F.col("size")).otherwise(F.lit(volume))
    return weighted.join(F.broadcast(total)).select("source", "size", F.coalesce(rate, F.lit(0.0)).alias("rate"))


def with_cdf(rated: DataFrame) -> DataFrame:
    """draws: how many draws make a count; cdf: P(count of one draw <= k) for k from 0, until no 52-bit number lies beyond."""
    mean = F.col("rate") / F.col("draws")
    last = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    # cdf[k] = cdf[k-1] + p_k with p_k = p_(k-1) * mean / k
    grown = F.aggregate(
        F.sequence(F.lit(1), last), F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf")),
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["cdf"], F.array(F.element_at(a["cdf"], -1) + a["p"] * mean / k)).alias("cdf")),
    )
    return rated.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / MEAN_STEP)).cast("int")).withColumn("cdf", grown["cdf"])


def mix(docs: DataFrame, weights: Mapping[str, float] | None = None, temperature: float = TEMPERATURE, volume: float = 1.0, seed: int = SEED) -> DataFrame:
    """The columns of docs plus replica (int, from 0) and mix_key (long, the shuffled order; partitions are sorted by it).

    A null source is a source of its own; a null n_chars counts as size 0; a null doc_id draws by its text's md5.
    Rows that repeat a doc_id draw the same count. Empty docs give no rows; weights that sum to zero give rate 0.
    Columns replica and mix_key of docs are replaced, others may have any name.
    """
    named, own = by_position(docs, ["replica", "mix_key"])
    at = {c: F.col(named.columns[own.index(c)]) for c in ("doc_id", "source", "text") if c in own}
    rated = with_cdf(rates(docs, weights, temperature, volume)).select(F.col("source").alias("_source"), "draws", "cdf")
    if rated.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        rated = F.broadcast(rated)
    key = F.coalesce(at["doc_id"].cast("string"), F.md5(F.coalesce(at["text"], F.lit("")))) if "text" in own else at["doc_id"].cast("string")
    joined = named.select("*", key.alias("_key")).join(rated, at["source"].eqNullSafe(F.col("_source")))
    # The number is an array of one first, so that it is computed once for each draw and not for each entry of the cdf.
    draw = lambda j: F.transform(F.array(unit(F.lit(str(seed)), "_key", j.cast("string"))), lambda u: F.size(F.filter("cdf", lambda c: c <= u)))[0]
    drawn = F.aggregate(F.sequence(F.lit(1), F.col("draws")), F.lit(0), lambda a, j: a + draw(j))
    counted = joined.withColumn("_n", drawn).where("_n > 0")
    copies = counted.select(*named.columns, "_key", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("replica"))
    mix_key = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"order{seed}"), "_key", F.col("replica").cast("string"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn("mix_key", mix_key).drop("_key").repartition("mix_key").sortWithinPartitions("mix_key").toDF(*own, "replica", "mix_key")


ORACLE = f"""
WITH RECURSIVE size AS (SELECT source, sum(coalesce(n_chars, 0)::DOUBLE) AS size FROM documents GROUP BY source),
total AS (SELECT sum(size) AS all_size, sum(pow(size, {TEMPERATURE})) AS all_weight FROM size),
rated AS (
  SELECT source, CASE WHEN size > 0 THEN 1.0::DOUBLE * all_size * pow(size, {TEMPERATURE}) / all_weight / size ELSE 1.0::DOUBLE END AS rate
  FROM size, total),
cdf(source, rate, k, p, c) AS (
  SELECT source, rate, 0, exp(-rate), exp(-rate) FROM rated
  UNION ALL
  SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cdf WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
tables AS (SELECT source, list(c ORDER BY k) AS cdf FROM cdf GROUP BY source),
drawn AS (
  SELECT d.*, len(list_filter(t.cdf, lambda x: x <= ('0x' || substr(md5('{SEED}:' || d.doc_id || ':1'), 1, 13))::BIGINT / {2**52}.0::DOUBLE)) AS n
  FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source),
copies AS (SELECT *, unnest(range(0, n))::INTEGER AS replica FROM drawn WHERE n > 0)
SELECT doc_id, text, lang, source, n_chars, replica,
  ('0x' || substr(md5('order{SEED}:' || doc_id || ':' || replica), 1, 15))::BIGINT AS mix_key
FROM copies
"""
