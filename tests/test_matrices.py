"""Binary matrices: .npy and raw files by row range."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.operators import order
from lamina.sources import matrices as X


def test_files_of_a_folder_are_one_matrix(spark, tmp_path):
    parts = [np.arange(n * 3, dtype="<f4").reshape(n, 3) + 100 * k for k, n in enumerate((5, 1, 40, 0))]
    for k, p in enumerate(parts):
        np.save(tmp_path / f"part-{k}.npy", p)
    df = X.read_matrix(spark, str(tmp_path), partition_bytes=60)  # five rows
    assert df.schema.simpleString() == "struct<row:bigint,x:array<float>>" and df.rdd.getNumPartitions() == 1 + 1 + 8
    rows = sorted(df.collect())
    assert [r.row for r in rows] == list(range(46)) and np.array_equal([r.x for r in rows], np.concatenate(parts))


@pytest.mark.parametrize(("dtype", "npy"), [("<f4", True), ("<f8", False), ("<i8", True), ("<i4", False)])
def test_round_trip(spark, tmp_path, monkeypatch, dtype, npy):
    monkeypatch.setattr(X, "FILE_ROWS", 700)
    rows = spark.range(5000).select((F.lit(4999) - F.col("id")).alias("row"), F.array(F.col("id") * 2, F.col("id") + 1).cast("array<double>").alias("x"))
    X.write_matrix(rows, f"{tmp_path}/m", 2, dtype, npy)
    want = np.array([[2 * (4999 - i), 5000 - i] for i in range(5000)])
    if npy:
        files = sorted((tmp_path / "m").glob("*.npy"))
        assert len(files) >= 7 and np.array_equal(np.concatenate([np.load(f) for f in files]), want)
    else:
        assert np.array_equal(np.concatenate([np.fromfile(f, dtype) for f in sorted((tmp_path / "m").glob("*.bin"))]).reshape(-1, 2), want)
    got = X.read_matrix(spark, f"{tmp_path}/m", None if npy else dtype, None if npy else 2).orderBy("row").collect()
    assert [r.row for r in got] == list(range(5000)) and np.array_equal([r.x for r in got], want)
    with pytest.raises(Exception, match="exist|Exist"):
        X.write_matrix(rows, f"{tmp_path}/m", 2, dtype, npy)
    X.write_matrix(rows.where("row < 3"), f"{tmp_path}/m", 2, dtype, npy, overwrite=True)
    assert X.read_matrix(spark, f"{tmp_path}/m", None if npy else dtype, None if npy else 2).count() == 3


def test_what_is_refused(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    np.save(tmp_path / "f.npy", np.asfortranarray(np.ones((2, 3))))
    for path, more in (("a.bin", {}), ("a.bin", {"dtype": "<f4", "width": 1}), ("f.npy", {}), ("none.npy", {})):
        with pytest.raises(Exception, match="npy|bytes|order|NotFound"):
            X.read_matrix(spark, f"{tmp_path}/{path}", **more).collect()
    with pytest.raises(Exception, match="2 numbers"):
        X.write_matrix(spark.createDataFrame([(0, [1.0])], "row long, x array<double>"), f"{tmp_path}/w", 2)


def test_permutations_and_columns(spark, tmp_path):
    p = order.by_hash(spark.range(300).select("id"))
    X.write_permutation_npy(p, f"{tmp_path}/p")
    assert sorted(map(tuple, X.read_permutation_npy(spark, f"{tmp_path}/p").collect())) == sorted((r.pos, r.id) for r in p.collect())
    rng = np.random.default_rng(1)
    for degrees in (np.array([0, 1, 2, 0, 0, 1]), rng.integers(0, 4, 300), np.array([70_000, 0, 70_000]), np.array([0, 0])):
        at = tmp_path / f"g{len(degrees)}-{degrees.sum()}"
        at.mkdir()
        indptr, indices = np.concatenate([[0], np.cumsum(degrees)]), rng.integers(0, 50, degrees.sum())
        np.save(at / "indptr.npy", indptr)
        np.save(at / "indices.npy", indices)
        got = sorted(map(tuple, X.read_csc_npy(spark, str(at)).collect()))
        assert got == sorted(zip(indices.tolist(), np.repeat(np.arange(len(degrees)), degrees).tolist(), strict=True))
