"""Array archives and footers."""

from __future__ import annotations

import os

import numpy as np
import pytest

from chronomesh.sources.arrays import Archives, footers


@pytest.fixture(scope="module")
def spark_npz(spark):
    spark.dataSource.register(Archives)
    return spark


def test_round_trip(spark_npz, tmp_path):
    rows = [(i, float(i) / 3, [float(i), -0.0, 1e300]) for i in range(1000)]
    df = spark_npz.createDataFrame(rows, "id long, x double, features array<double>").repartition(4)
    path = str(tmp_path / "a")
    df.write.format("npz").mode("append").save(path)
    assert all(n.endswith(".npz") for n in os.listdir(path))
    back = spark_npz.read.format("npz").option("rows", 70).load(path)
    assert dict(back.dtypes) == dict(df.dtypes) and sorted(map(tuple, back.collect())) == sorted(rows)
    assert back.rdd.getNumPartitions() >= 1000 // 70
    df.limit(5).write.format("npz").mode("overwrite").save(path)
    assert spark_npz.read.format("npz").load(path).count() == 5


def test_archives_of_numpy(spark_npz, tmp_path):
    features = np.arange(60, dtype=np.float32).reshape(20, 3)
    np.savez(tmp_path / "plain.npz", features=features, y=np.arange(20, dtype=np.int32))
    np.savez_compressed(tmp_path / "packed.npz", features=features, y=np.arange(20, dtype=np.int32))
    for name in ("plain.npz", "packed.npz"):
        got = spark_npz.read.format("npz").option("rows", 6).load(str(tmp_path / name)).orderBy("y").collect()
        assert [r.features for r in got] == features.tolist() and [r.y for r in got] == list(range(20))
    assert spark_npz.read.format("npz").schema("y long").load(str(tmp_path)).count() == 40


def test_failed_jobs_leave_nothing(spark_npz, tmp_path):
    path = str(tmp_path / "a")
    df = spark_npz.createDataFrame([(1, [1.0]), (2, None)], "id long, v array<double>").repartition(2)
    with pytest.raises(Exception, match="nulls"):
        df.write.format("npz").mode("append").save(path)
    assert not os.path.exists(path) or os.listdir(path) == []


def test_unequal_lengths(spark_npz, tmp_path):
    np.savez(tmp_path / "bad.npz", a=np.arange(3), b=np.arange(4))
    with pytest.raises(Exception, match="different lengths"):
        spark_npz.read.format("npz").load(str(tmp_path / "bad.npz")).collect()


def test_footers(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).repartition(3).write.parquet(path)
    whole = next(f"{path}/{n}" for n in sorted(os.listdir(path)) if n.startswith("part"))
    with open(whole, "rb") as f, open(f"{path}/broken.parquet", "wb") as g:
        g.write(f.read()[:-20])
    open(f"{path}/short.parquet", "wb").write(b"PAR1")
    got = {os.path.basename(r.path): r for r in footers(spark, path).where("path NOT LIKE '%_SUCCESS'").collect()}
    assert sum(r.n_rows or 0 for r in got.values()) == 100 and set(got) == {n for n in os.listdir(path) if not n.startswith(('.', '_'))}
    assert all(r.columns == ["id"] and r.error is None for r in got.values() if r.readable)
    assert [not got[n].readable and got[n].error is not None for n in ("broken.parquet", "short.parquet")] == [True, True]
