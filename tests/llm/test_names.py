"""Columns of any name pass through the operators that keep a frame's columns."""

import pytest
from pyspark.sql import functions as F

from lamina.llm import mixing, tandem, url_filter

INTERNAL = ["cdf", "draws", "_key", "_source", "_n", "rate", "_fit", "_says", "fit", "says", "c0", "c1", "key", "x.y", "h", "at"]


@pytest.mark.parametrize("extra", INTERNAL)
def test_names_pass_through(spark, extra):
    docs = spark.createDataFrame([(1, "a b", "s", 3, "http://casino.example/x"), (2, None, None, None, None)], "doc_id long, text string, source string, n_chars long, url string").withColumn(extra, F.lit("mine"))
    for out, new in ((mixing.mix(docs, volume=3.0), ["replica", "mix_key"]), (url_filter.judge(docs), ["host", "path", "rule", "url_words", "url_score", "verdict"]), (tandem.find_runs(docs), ["runs", "collapsed"])):
        assert out.columns == [*docs.columns, *new]
        rows = out.select(f"`{extra}`").distinct().collect()
        assert [r[0] for r in rows] == ["mine"]
