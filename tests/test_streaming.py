"""Streaming jobs over several files: late rows, restarts, group counting."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators.forest import ForestParams, fit_forest
from tidemark.operators.preprocess import fit_columns
from tidemark.streaming import jobs as J

START = dt.datetime(2024, 3, 1)
SCHEMA = "id long, timestamp timestamp_ntz, x double"


def write(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/{name}")


@pytest.fixture
def source(spark, tmp_path):
    """Three files in time order; the third holds two rows that are days late."""
    rng = np.random.default_rng(2)

    def rows(first, n, hours, late=()):
        made = [(first + i, START + dt.timedelta(hours=hours + i * 0.5), float(rng.normal())) for i in range(n)]
        return made + [(900 + k, START + dt.timedelta(hours=h), 0.0) for k, h in enumerate(late)]

    folder = str(tmp_path / "in")
    files = [rows(0, 100, 0), rows(100, 100, 50), rows(200, 100, 100, late=(1, 2))]
    return folder, files


def stream(spark, folder):
    return J.read_stream(spark, f"{folder}/*", SCHEMA, "part-*.parquet")


def test_windows_and_restart(spark, source, tmp_path):
    folder, files = source
    ref = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=200)], "x double")
    base = D.fit_baseline(ref, ["x"])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for i, rows in enumerate(files):
        write(spark, folder, f"f{i}", rows)
        J.monitor_windows(stream(spark, folder), base, out, check).awaitTermination()
    got = {r.window_start.date(): r for r in spark.read.parquet(f"{out}/results").collect()}
    # 150 hours of data; the watermark closes six whole days
    assert sorted(d.day for d in got) == [1, 2, 3, 4, 5, 6]
    assert all(r.cur_rows == 48 for r in got.values())
    day3 = spark.createDataFrame([r for f in files for r in f if r[1].day == 3], SCHEMA)
    want = D.ks_test(base, day3).first()
    assert np.isclose(got[dt.date(2024, 3, 3)].statistic, want.statistic)


def test_window_state_is_the_open_windows(spark, source, tmp_path):
    """What a batch leaves for the next is its newest time and the open windows; late rows are counted, not tested."""
    folder, files = source
    ref = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=200)], "x double")
    base, out = D.fit_baseline(ref, ["x"]), str(tmp_path / "out")
    for i, rows in enumerate(files):
        write(spark, folder, f"f{i}", rows)
        J.monitor_windows(stream(spark, folder), base, out, str(tmp_path / "check")).awaitTermination()
    state = {r.batch_id: r for r in spark.read.parquet(f"{out}/windows").where("batch_id >= 0").collect()}
    days = {k: [(dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=w)).day for w in r.open] for k, r in state.items()}
    assert days == {0: [3], 1: [5], 2: [7]} and [state[k].late for k in range(3)] == [0, 0, 2]
    # the log holds counts of values by window and batch, each batch once even if it runs again
    log = spark.read.parquet(f"{out}/log")
    assert log.agg(F.sum(D.WEIGHT)).first()[0] == 300
    results = spark.read.parquet(f"{out}/results")
    assert results.count() == results.select("window_start", "feature").distinct().count() == 6


def test_every_n_over_batches(spark, source, tmp_path):
    folder, files = source
    ref = spark.createDataFrame([(float(v),) for v in np.random.default_rng(1).normal(size=200)], "x double")
    out = str(tmp_path / "out")
    for i, rows in enumerate(files):
        write(spark, folder, f"f{i}", rows)
        J.monitor_every(
            stream(spark, folder), D.fit_baseline(ref, ["x"]), 70, ["timestamp", "id"], out, f"{out}/check"
        ).awaitTermination()
    got = sorted(spark.read.parquet(f"{out}/results").collect(), key=lambda r: r.gate)
    assert [r.gate for r in got] == [0, 1, 2, 3] and all(r.cur_rows == 70 for r in got)
    second = [r for r in files[0][70:]] + files[1][:40]
    want = D.ks_test(D.fit_baseline(ref, ["x"]), spark.createDataFrame(second, SCHEMA)).first()
    assert np.isclose(got[1].statistic, want.statistic)
    assert spark.read.parquet(f"{out}/pending").where("batch_id = 2").count() == 302 - 280


def test_late_rows(spark, source, tmp_path):
    folder, files = source
    out = str(tmp_path / "late")
    for i, rows in enumerate(files):
        write(spark, folder, f"f{i}", rows)
        J.count_late(stream(spark, folder), out, str(tmp_path / "check"), delay="1 hour").awaitTermination()
    counts = {r.batch_id: (r["rows"], r.late) for r in spark.read.parquet(out).where("batch_id >= 0").collect()}
    assert counts == {0: (100, 0), 1: (100, 0), 2: (102, 2)}


def test_scoring(spark, source, tmp_path):
    folder, files = source
    history = spark.createDataFrame(files[0], SCHEMA).withColumn("y", F.col("x") * 2)
    columns = fit_columns(history, ["x"])
    model = fit_forest(history, columns, "y", ForestParams(3, 3))
    out = str(tmp_path / "scores")
    for i, rows in enumerate(files[:2]):
        write(spark, folder, f"f{i}", rows)
        J.score_stream(stream(spark, folder), model, columns, ["id"], out, str(tmp_path / "check"), "9").awaitTermination()
    got = spark.read.parquet(out)
    assert got.count() == 200 and got.select("id").distinct().count() == 200
    assert {r.model_version for r in got.select("model_version").distinct().collect()} == {"9"}
