"""Monitored batches as one record each, and MMD against stored sums."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import mmd as K
from tidemark.sources.stores import load_baseline, save_baseline
from tidemark.streaming import jobs as J
from tidemark.streaming import monitoring as M

SCHEMA = "id long, x double, y double, c string"


def rows(seed, n, shift=0.0, first=0):
    rng = np.random.default_rng(seed)
    return [(first + i, float(rng.normal(shift)), float(rng.normal()), str(rng.choice(["a", "b"]))) for i in range(n)]


@pytest.fixture(scope="module")
def baseline(spark):
    return D.fit_baseline(spark.createDataFrame(rows(1, 800), SCHEMA), ["x", "y"], ["c"], fourier_features=128)


def arrive(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(2).write.mode("append").parquet(folder)


def test_gate_restart_and_replay(spark, baseline, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrivals = [rows(2, 60), rows(3, 300, shift=2.0), rows(4, 50), rows(5, 1), rows(6, 40), rows(1, 200)]  # the last are rows of the reference
    for data in arrivals:
        arrive(spark, folder, data)
        stream = J.read_stream(spark, folder, SCHEMA)
        M.monitor_batches(stream, baseline, out, f"{out}-check", every=2, methods=("ks", "mmd")).awaitTermination()
    reports = {r.call: r for r in M.read_reports(spark, out).collect()}
    assert sorted(reports) == [1, 2, 3, 4, 5, 6] and [reports[k].batch_size for k in range(1, 7)] == [len(a) for a in arrivals]
    assert [reports[k].check_skipped for k in range(1, 7)] == [True, False] * 3
    assert all(reports[k].results == [] and not reports[k].drift_detected for k in (1, 3, 5))
    # the shifted batch: both methods, and the feature that moved
    shifted = reports[2]
    assert shifted.drift_detected and shifted.overall_drift.detected and shifted.feature_drift.detected
    assert shifted.feature_drift.results["x"][0].is_drift and not shifted.feature_drift.results["y"][0].is_drift
    assert {(a.method, a.feature_name) for a in shifted.alerts} == {("ks", None), ("ks", "x"), ("mmd", None)}
    # one row: ks has a verdict, mmd says why it has none
    single = {(r.method, r.feature_name): r for r in reports[4].results}
    assert single["mmd", None].status == "too few rows" and single["mmd", None].is_drift is None and single["ks", None].status == "ok"
    assert not reports[6].drift_detected
    assert M.call_counts(spark, out).first() == (6, 3, 3, sum(map(len, arrivals)))
    assert {r.batch_id for r in M.read_alerts(spark, out).collect()} == {"1"}
    assert M.read_history(spark, out).count() == 3 * 4
    summary = D.drift_summary(M.read_history(spark, out)).first()
    assert summary.total_checks == 12 and summary.drift_detected == 3
    # a batch that runs again replaces its own record, whatever it was before
    M.commit_batch(baseline, spark.createDataFrame(arrivals[1], SCHEMA), 1, out, every=2, methods=("ks",))
    assert M.call_counts(spark, out).first() == (6, 3, 3, sum(map(len, arrivals)))
    assert M.read_history(spark, out).count() == 3 * 4 - 1


def test_failing_method_does_not_end_the_batch(spark, baseline, monkeypatch):
    def broken(*_, **__):
        raise RuntimeError("no such luck\nsecond line")

    monkeypatch.setattr(K, "fourier_test", broken)
    batch = spark.createDataFrame(rows(3, 200, shift=2.0), SCHEMA)
    r = M.monitored_batch(baseline, batch, "b", methods=("mmd", "other", "ks")).first()
    status = {x.method: x.status for x in r.results}
    assert status == {"mmd": "failed: RuntimeError: no such luck", "other": "unknown method", "ks": "ok"}
    assert r.drift_detected
    only = M.monitored_batch(baseline, batch, "b", methods=("mmd",)).first()
    assert only.drift_detected is None and only.alerts == []


def test_switches(spark, baseline):
    batch = spark.createDataFrame(rows(3, 200, shift=2.0), SCHEMA)
    at = F.lit(dt.datetime(2024, 5, 1))
    quiet = M.monitored_batch(baseline, batch, "b", alert_on_drift=False, at=at).first()
    assert quiet.drift_detected and quiet.alerts == [] and quiet.timestamp == dt.datetime(2024, 5, 1) == quiet.results[0].timestamp
    off = M.monitored_batch(baseline, batch, "b", enabled=False).first()
    assert (off.monitoring_enabled, off.check_skipped, off.drift_detected, off.batch_size, off.results) == (False, False, False, 0, [])
    calls = [M.should_check(i, 5) for i in range(1, 11)]
    assert calls == [False] * 4 + [True] + [False] * 4 + [True]


def test_single_payload(spark, baseline):
    payload = {"id": 1, "x": 0.1, "y": -0.2, "c": "a"}
    r = M.monitor_payload(spark, baseline, payload, SCHEMA, "p-1", methods=("ks", "mmd")).first()
    assert (r.batch_id, r.batch_size, r.check_skipped) == ("p-1", 1, False)
    assert {x.method: x.status for x in r.results} == {"ks": "ok", "mmd": "too few rows"}


def test_one_row_by_blocks(spark):
    data = spark.createDataFrame(rows(1, 50), SCHEMA)
    base = D.fit_baseline(data, ["x"], key="id")
    out = D.check_batch(base, data.limit(1), F.current_timestamp(), ["ks", "mmd"], key="id").collect()
    assert [r.status for r in out if r.method == "mmd"] == ["too few rows"]


def unbiased(z, w):
    n, m = len(z), len(w)
    xx, yy, xy = z @ z.T, w @ w.T, z @ w.T
    np.fill_diagonal(xx, 0)
    np.fill_diagonal(yy, 0)
    return xx.sum() / (n * (n - 1)) + yy.sum() / (m * (m - 1)) - 2 * xy.mean()


def vectors(spark, x):
    return spark.createDataFrame([(r.tolist(),) for r in x], "v array<double>")


def test_stored_sums_statistic(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(300, 3)), rng.normal(0.5, 1, size=(120, 3))
    features = K.FourierMap(3, 96, 1.5, 11)
    sums = K.fourier_sums(vectors(spark, x), "v", features)
    halves = K.fourier_sums(vectors(spark, x[:100]), "v", features) + K.fourier_sums(vectors(spark, x[100:]), "v", features)
    assert sums.rows == halves.rows == 300 and np.allclose(sums.second, halves.second) and np.allclose(sums.total, halves.total)
    got = K.fourier_test(sums, vectors(spark, y), "v").first()
    assert np.isclose(got.mmd2, unbiased(features.apply(x), features.apply(y)))
    assert got.p_value < 0.01 and got.is_drift
    # with many features the kernel is the Gaussian one
    wide = K.FourierMap(3, 4096, 1.5, 2)
    z, w = wide.apply(x), wide.apply(y)
    kernel = lambda a, b: np.exp(-((a[:, None] - b[None]) ** 2).sum(2) / (2 * 1.5**2))
    assert abs((z @ w.T).mean() - kernel(x, y).mean()) < 0.02
    with pytest.raises(ValueError):
        sums + K.FourierSums(wide, 1, np.zeros(1), np.zeros((1, 1)))
    with pytest.raises(K.TooFewRows):
        K.fourier_test(sums, vectors(spark, y[:1]), "v")


def test_stored_sums_level(spark):
    """Batches of the reference's kind drift about as often as the threshold says."""
    rng = np.random.default_rng(9)
    sums = K.fourier_sums(vectors(spark, rng.normal(size=(3000, 2))), "v", K.FourierMap(2, 64))
    found = [K.fourier_test(sums, vectors(spark, rng.normal(size=(60, 2))), "v", threshold=0.1).first() for _ in range(30)]
    assert 0 <= sum(r.is_drift for r in found) <= 9
    assert 0.25 < np.mean([r.p_value for r in found]) < 0.75


def test_stored_baseline_has_all_that_a_check_reads(spark, tmp_path):
    """After saving, the reference can go."""
    source = str(tmp_path / "reference")
    spark.createDataFrame(rows(1, 400), SCHEMA).write.parquet(source)
    fitted = D.fit_baseline(spark.read.parquet(source), ["x", "y"], ["c"], key="id", fourier_features=64)
    save_baseline(fitted, str(tmp_path / "saved"))
    loaded = load_baseline(spark, str(tmp_path / "saved"))
    assert loaded.fourier.map == fitted.fourier.map and loaded.fourier.rows == 400
    assert np.array_equal(loaded.fourier.second, fitted.fourier.second)
    batch = spark.createDataFrame(rows(8, 90), SCHEMA)
    spark.createDataFrame([], SCHEMA).write.mode("overwrite").parquet(source)
    spark.catalog.clearCache()
    at = F.lit(dt.datetime(2024, 5, 1))
    both = [
        {(r.method, r.feature_name): (r.drift_score, r.p_value) for r in D.check_batch(b, batch, at, ["ks", "mmd"]).collect()}
        for b in (fitted, loaded)
    ]
    assert both[0].keys() == both[1].keys() and len(both[0]) == 4
    assert all(np.allclose(v, both[1][k]) for k, v in both[0].items())
    assert fitted.rows.count() == 400 and loaded.rows.count() == 400


def test_state_of_the_gate_does_not_grow(spark, tmp_path):
    """Only the last unfinished group is kept, however many batches came."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    base = D.fit_baseline(spark.createDataFrame(rows(1, 100), SCHEMA), ["x"])
    for k in range(5):
        arrive(spark, folder, rows(k, 33, first=100 * k))
        stream = J.read_stream(spark, folder, SCHEMA)
        J.monitor_every(stream, base, 20, ["id"], out, f"{out}/check").awaitTermination()
    waiting = {r.batch_id: r["count"] for r in spark.read.parquet(f"{out}/pending").groupBy("batch_id").count().collect()}
    assert waiting == {3: 132 % 20, 4: 165 % 20}
    assert sorted(r.gate for r in spark.read.parquet(f"{out}/results").collect()) == list(range(8))
