"""The pipeline's stages, each on what the one before it kept."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from lamina.llm import decontam, mixing, queries
from lamina.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages_in_order(spark):
    assert [n for n, _ in P.STAGES] == ["quality", "near_dedup", "suffix_dedup", "decontamination", "mixing"]
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in P.STAGES:
        before, docs = docs, stage(spark, docs, SF).persist()
        ids, was = {r.doc_id for r in docs.select("doc_id").collect()}, {r.doc_id for r in before.select("doc_id").collect()}
        assert ids <= was
        if name != "mixing":
            assert docs.columns == columns
            assert len(ids) > 0.7 * len(was)  # clean documents stay
        if name == "decontamination":
            assert decontam.decontaminate(docs, table(spark, SF, "benchmark")).where("size(items) > 0").count() == 0
    assert set(columns) < set(docs.columns)


def test_run_equals_its_stages(spark):
    got = P.run(spark, SF)
    assert got.count() > 0 and got.columns == mixing.mix(table(spark, SF, "documents")).columns


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = c.execute(queries.ORACLES[name]).fetchdf()
    got = queries.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert got.dtypes.to_list() == want.dtypes.to_list()
    rows = lambda df: sorted(map(tuple, df.astype(object).values.tolist()), key=str)
    assert rows(got) == rows(want)


LONG = " ".join(f"w{i}" for i in range(60_000))
PASSAGE = " ".join(f"p{i % 10}" for i in range(55))  # 164 bytes


def odd_documents(spark):
    rows = [
        (1, None, "en", "a", None, "x"), (2, "", "en", None, 0, "x"), (3, " \n", None, "a", 2, None), (4, LONG, "en", "b", len(LONG), "x"), (None, "no id here", "en", "a", 10, "x"),
        (5, f"one {PASSAGE} two", "en", "a", 170, "x"), (6, f"three {PASSAGE} four", "en", "a", 170, "x"), (7, "same text", "en", "a", 9, "x"), (7, "same text", "en", "a", 9, "x"),
        (8, "same text", "en", "a", 9, "x"), (9, "ab", "en", "a", 2, "x"), (9, "aa", "en", "a", 2, "x"),
    ]
    # columns named like those that the operators make
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumns({c: F.lit(7) for c in ("component_id", "fp", "spans", "items", "tail_prob", "h", "at")})


@pytest.mark.parametrize("name", [n for n, _ in P.STAGES])
def test_stages_on_odd_documents(spark, name):
    stage, docs = dict(P.STAGES)[name], odd_documents(spark)
    got = stage(spark, docs, SF)
    rows = got.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    ids = sorted(r.doc_id for r in rows if r.doc_id is not None)
    if name == "mixing":
        assert got.columns == [*docs.columns, "replica", "mix_key"]
        return
    assert got.columns == docs.columns and any(r.doc_id is None for r in rows) or name == "quality"
    if name == "near_dedup":
        assert ids == [1, 4, 5, 6, 7, 9] and [r.text for r in rows if r.doc_id == 9] == ["aa"]
        again = stage(spark, docs.repartition(5), SF).collect()
        assert sorted(map(str, again)) == sorted(map(str, rows))
    if name == "suffix_dedup":
        assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 9]
        text = {r.doc_id: r for r in rows}
        assert text[1].text is None and text[4].text == LONG and text[4].n_chars == len(LONG)
        assert text[5].text == "ontwo" and text[5].n_chars == 5 and text[6].text == "threfour"
    if name == "decontamination":
        assert ids == [1, 2, 3, 4, 5, 6, 7, 7, 8, 9, 9]


def test_short_repeats_stay(spark):
    fifty = " ".join(f"longword{i}" for i in range(50))
    docs = spark.createDataFrame([(1, f"x {fifty} y", 5), (2, f"z! {fifty} u", 5)], "doc_id long, text string, n_chars long")
    assert {r.text for r in P.suffix_dedup_stage(spark, docs, SF).collect()} == {f"x {fifty} y", f"z! {fifty} u"}
