"""Metrics, slices and backtests against NumPy, on the plain and on the range-cut path."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import bands as N
from tidemark.operators import metrics as M
from tidemark.operators import slices as L


def suite(y, p):
    with np.errstate(all="ignore"):
        e, rel = np.abs(y - p), np.abs((y - p) / y)
        tail = lambda q: e[y >= np.percentile(y, q)].mean()
        step = np.mean((np.diff(y) > 0) == (np.diff(p) > 0)) * 100 if len(y) > 1 else 0.0
        return {
            "mae": e.mean(), "mse": (e * e).mean(), "rmse": np.sqrt((e * e).mean()), "wape": e.sum() / np.abs(y).sum() * 100,
            "mape": rel.mean() * 100, "smape": (2 * e / (np.abs(y) + np.abs(p))).mean() * 100, "tail_mae_90": tail(90),
            "tail_mae_95": tail(95), "directional_accuracy": step, "hit_rate_5pct": (rel <= 0.05).mean() * 100,
            "hit_rate_10pct": (rel <= 0.10).mean() * 100,
        }


@pytest.fixture(scope="module")
def forecast(spark):
    """Group a holds most rows, b has zeros on both sides, c has one row."""
    rng = np.random.default_rng(11)
    g = np.array(["a"] * 300 + ["b"] * 60 + ["c"])
    y = rng.gamma(2, 50, len(g)).round(1)
    p = (y * rng.normal(1, 0.15, len(g))).round(1)
    y[310], y[320], p[320] = 0, 0, 0
    pdf = pd.DataFrame({"g": g, "t": rng.permutation(len(g)), "y_true": y, "y_pred": p})
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("limit", [50, 10**9])
def test_suite(forecast, limit):
    pdf, df = forecast
    rows = {r.g: r.asDict() for r in M.metric_suite(df, ["g"], ["t"], rows_per_range=limit).collect()}
    assert set(rows) == {"a", "b", "c"}
    for g, part in pdf.sort_values("t").groupby("g"):
        for k, v in suite(part.y_true.to_numpy(), part.y_pred.to_numpy()).items():
            assert np.isclose(rows[g][k], v, equal_nan=True), (g, k)


def test_suite_without_groups(forecast):
    pdf, df = forecast
    row = M.metric_suite(df, order=["t"]).first().asDict()
    s = pdf.sort_values("t")
    for k, v in suite(s.y_true.to_numpy(), s.y_pred.to_numpy()).items():
        assert np.isclose(row[k], v, equal_nan=True), k


def test_rows_without_a_prediction_are_left_out(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 1.0), (3.0, None)], "y_true double, y_pred double")
    assert M.metric_suite(df).first().mae == 1.0


def test_pinball_and_r2(forecast):
    pdf, df = forecast
    a = pdf[pdf.g == "a"]
    e = (a.y_true - a.y_pred).to_numpy()
    row = M.quantile_losses(df, ["g"], [0.9]).where("g = 'a'").first()
    assert np.isclose(row.pinball_90, np.maximum(0.9 * e, -0.1 * e).mean())
    r2 = 1 - (e**2).sum() / ((a.y_true - a.y_true.mean()) ** 2).sum()
    assert np.isclose(M.r2_by_group(df, ["g"]).where("g = 'a'").first().r2, r2)


def test_small_and_null_slices_are_skipped(spark):
    rows = [("big", float(i), float(i) + 1) for i in range(1, 12)] + [("small", 1.0, 2.0)] * 9 + [(None, 1.0, 1.0)] * 20
    df = spark.createDataFrame(rows, "k string, y_true double, y_pred double")
    out = L.analyze_slices(df, {"by_k": F.col("k")}).collect()
    assert [r.slice_value for r in out] == ["big"] and out[0].sample_count == 11


@pytest.mark.parametrize("limit", [200, 10**9])
def test_backtest(spark, limit):
    rng = np.random.default_rng(3)
    y = rng.uniform(50, 100, 1001)
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(1001), "price": y}))
    out = B.backtest_forecast(B.naive_forecast(df, ["t"], "price"), ["t"], 400, 100, 50, rows_per_range=limit)
    rows = {r.period: r for r in out.collect()}
    assert sorted(rows) == list(range(1, 12))
    t, p = y[1:], y[:-1]
    for k, r in rows.items():
        a = slice((k - 1) * 50 + 400, (k - 1) * 50 + 500)
        assert np.isclose(r.mae, np.abs(t[a] - p[a]).mean()) and r.val_size == 100
        assert np.isclose(r.r2, 1 - ((t[a] - p[a]) ** 2).sum() / ((t[a] - t[a].mean()) ** 2).sum())
    slope = np.polyfit(sorted(rows), [rows[k].wape for k in sorted(rows)], 1)[0]
    trend = {r.metric: r for r in B.backtest_trend(out).collect()}
    assert np.isclose(trend["wape"].slope, slope)
    worst = {r.metric: r.period for r in B.worst_periods(out).collect()}
    assert worst["wape"] == max(rows, key=lambda k: rows[k].wape) and worst["r2"] == min(rows, key=lambda k: rows[k].r2)


def test_worst_period_ties_take_the_first(spark):
    df = spark.createDataFrame([(i, 5.0, 1.0, 0.5) for i in (3, 1, 2)], "period int, wape double, mae double, r2 double")
    assert {r.period for r in B.worst_periods(df).collect()} == {1}


def test_conformal(spark):
    df = spark.createDataFrame([(float(i), 0.0) for i in range(1, 20)], "y_true double, y_pred double")
    assert N.conformal_radius(df, 0.1) == 18.0
    assert N.conformal_radius(df, 0.1, rows_per_range=4) == 18.0
    assert N.conformal_radius(df, 0.01) == float("inf")
