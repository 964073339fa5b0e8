"""Queries: forecast metrics, backtests and slices."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import backtest as B
from tidemark.operators import metrics as M
from tidemark.operators import slices as L
from tidemark.operators.splits import expanding_folds, ratio_split
from tidemark.plans.registry import query
from tidemark.plans.series import (
    EVENTS, EVENTS_FORECAST_SQL, ORDER_KEYS, ORDERS_FORECAST_SQL, ORDERS_PRICE_SQL, events_forecast, orders_forecast,
    orders_price,
)
from tidemark.plans.splitting import walk_forward_sql

SUITE = [
    "mae", "mse", "rmse", "wape", "mape", "smape", "hit_rate_5pct", "hit_rate_10pct", "directional_accuracy",
    "tail_mae_90", "tail_mae_95",
]


def suite_sql(source: str, by: str, order: str) -> str:
    return f"""
WITH f AS ({source}),
 d AS (SELECT f.*, y_true > lag(y_true) OVER w AS up_t, y_pred > lag(y_pred) OVER w AS up_p FROM f
       WINDOW w AS (PARTITION BY {by} ORDER BY {order})),
 c AS (SELECT {by}, quantile_cont(y_true, 0.90) AS q90, quantile_cont(y_true, 0.95) AS q95 FROM f GROUP BY {by}),
 e AS (SELECT d.*, q90, q95, abs(y_true - y_pred) AS ae, abs((y_true - y_pred) / y_true) AS rel FROM d JOIN c USING ({by}))
SELECT {by}, avg(ae) AS mae, avg(ae * ae) AS mse, sqrt(avg(ae * ae)) AS rmse, sum(ae) / sum(abs(y_true)) * 100 AS wape,
 avg(rel) * 100 AS mape, avg(2 * ae / (abs(y_true) + abs(y_pred))) * 100 AS smape,
 avg(CASE WHEN NOT isnan(rel) AND rel <= 0.05 THEN 1.0 ELSE 0.0 END) * 100 AS hit_rate_5pct,
 avg(CASE WHEN NOT isnan(rel) AND rel <= 0.10 THEN 1.0 ELSE 0.0 END) * 100 AS hit_rate_10pct,
 coalesce(avg(CASE WHEN up_t IS NULL THEN NULL WHEN up_t = up_p THEN 1.0 ELSE 0.0 END) * 100, 0) AS directional_accuracy,
 avg(ae) FILTER (WHERE y_true >= q90) AS tail_mae_90, avg(ae) FILTER (WHERE y_true >= q95) AS tail_mae_95
FROM e GROUP BY {by}"""


@query("metric_suite", suite_sql(EVENTS_FORECAST_SQL, "event_type", "timestamp, event_id"), six=SUITE)
def metric_suite(spark, sf):
    return M.metric_suite(events_forecast(spark, sf), ["event_type"], EVENTS.order)


@query(
    "quantile_loss",
    "SELECT event_type, "
    + ", ".join(
        f"avg(greatest({q} * (y_true - y_pred), ({q} - 1) * (y_true - y_pred))) AS pinball_{n}"
        for q, n in ((0.1, 10), (0.5, 50), (0.9, 90))
    )
    + f" FROM ({EVENTS_FORECAST_SQL}) GROUP BY event_type",
    six=["pinball_10", "pinball_50", "pinball_90"],
)
def quantile_loss(spark, sf):
    return M.quantile_losses(events_forecast(spark, sf), ["event_type"], [0.1, 0.5, 0.9])


@query(
    "r2_by_group",
    f"""SELECT user_id, CASE WHEN var_pop(y_true) > 0 THEN 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*))
 END AS r2 FROM ({EVENTS_FORECAST_SQL}) GROUP BY user_id""",
    six=["r2"],
)
def r2_by_group(spark, sf):
    return M.r2_by_group(events_forecast(spark, sf), ["user_id"])


SPLIT_SQL = f"""SELECT *, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'val' ELSE 'test' END AS split
 FROM (SELECT *, row_number() OVER (ORDER BY timestamp, o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM ({ORDERS_FORECAST_SQL}))"""


@query(
    "split_metrics", suite_sql(SPLIT_SQL, "split", "timestamp, o_orderkey"), digits={c: 1 if c == "mse" else 4 for c in SUITE}
)
def split_metrics(spark, sf):
    split = ratio_split(orders_forecast(spark, sf), ORDER_KEYS)
    return M.metric_suite(split, ["split"], ORDER_KEYS)


def _scores_sql(source: str, by: str, extra: str = "") -> str:
    return f"""SELECT {by}, count(*) AS sample_count, sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 AS wape,
 avg(abs(y_true - y_pred)) AS mae, 1 - sum((y_true - y_pred) * (y_true - y_pred)) / (var_pop(y_true) * count(*)) AS r2,
 avg(abs(y_true - y_pred)) FILTER (WHERE y_true >= q90) AS tail_mae, avg(y_true) AS mean_actual,
 stddev_pop(y_true) AS std_actual
 FROM (SELECT *, quantile_cont(y_true, 0.9) OVER (PARTITION BY {by}) AS q90 FROM ({source})) GROUP BY {by} {extra}"""


PLACED_FORECAST_SQL = f"""SELECT *, row_number() OVER (ORDER BY timestamp, o_orderkey) - 1 AS pos FROM ({ORDERS_FORECAST_SQL})"""
PERIODS_SQL = f"""SELECT period, CAST(2000 AS BIGINT) AS train_size, sample_count AS val_size, wape, mae, r2, tail_mae
 FROM ({_scores_sql(walk_forward_sql(PLACED_FORECAST_SQL, roles=['val']), 'period')})"""


def _periods(spark, sf):
    return B.backtest_forecast(orders_forecast(spark, sf), ORDER_KEYS)


@query("backtest_naive", PERIODS_SQL, six=["wape", "r2"], digits={"mae": 3, "tail_mae": 3})
def backtest_naive(spark, sf):
    return _periods(spark, sf)


ROLLING_SQL = f"""SELECT * FROM (SELECT s.*, price AS y_true, avg(price) OVER (ORDER BY timestamp, o_orderkey
 ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS y_pred FROM ({ORDERS_PRICE_SQL}) s) WHERE y_pred IS NOT NULL"""


@query(
    "backtest_rolling_mean",
    f"""SELECT period, CAST(2000 AS BIGINT) AS train_size, sample_count AS val_size, wape, mae, r2, tail_mae FROM ({_scores_sql(
        walk_forward_sql('SELECT *, row_number() OVER (ORDER BY timestamp, o_orderkey) - 1 AS pos FROM (' + ROLLING_SQL + ')',
                         roles=['val']), 'period')})""",
    six=["wape", "r2"], digits={"mae": 3, "tail_mae": 3},
)
def backtest_rolling_mean(spark, sf):
    return B.backtest_forecast(B.rolling_mean_forecast(orders_price(spark, sf), ORDER_KEYS, "price", window=7), ORDER_KEYS)


@query(
    "backtest_latest_predictions",
    f"""SELECT o_orderkey, max(period) AS period, any_value(y_pred) AS y_pred FROM ({walk_forward_sql(
        PLACED_FORECAST_SQL, roles=['val'])}) GROUP BY o_orderkey""",
)
def backtest_latest(spark, sf):
    kept = B.backtest_predictions(orders_forecast(spark, sf), ORDER_KEYS, 2000, 500, 100, "latest")
    return kept.select("o_orderkey", "period", "y_pred")


SUMMARY = [f"{a}_{s}" for a in ("mean", "std") for s in B.SCORES] + ["min_wape", "max_wape"]


@query(
    "backtest_summary",
    "SELECT count(*) AS total_periods, "
    + ", ".join(f"avg({s}) AS mean_{s}, stddev_pop({s}) AS std_{s}" for s in B.SCORES)
    + f", min(wape) AS min_wape, max(wape) AS max_wape FROM ({PERIODS_SQL})",
    digits={c: 3 if "mae" in c else 6 for c in SUMMARY},
)
def backtest_summary(spark, sf):
    return B.backtest_summary(_periods(spark, sf))


@query(
    "backtest_trend",
    " UNION ALL ".join(
        f"SELECT '{m}' AS metric, s AS slope, CASE WHEN s > 0 THEN '{up}' ELSE '{down}' END AS trend "
        f"FROM (SELECT regr_slope({m}, period) AS s FROM ({PERIODS_SQL}))"
        for m, up, down in (
            ("wape", "degrading", "improving"), ("mae", "degrading", "improving"), ("r2", "improving", "degrading"),
        )
    ),
    six=["slope"],
)
def backtest_trend(spark, sf):
    return B.backtest_trend(_periods(spark, sf))


@query(
    "backtest_worst",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{m}' AS metric, period, {m} AS value FROM ({PERIODS_SQL}) ORDER BY {m} {d}, period LIMIT 1)"
        for m, d in (("wape", "DESC"), ("mae", "DESC"), ("r2", "ASC"))
    ),
    digits={"value": 3},
)
def backtest_worst(spark, sf):
    return B.worst_periods(_periods(spark, sf))


@query(
    "backtest_band",
    f"""SELECT period, wape, avg(wape) OVER () AS mean, avg(wape) OVER () - stddev_pop(wape) OVER () AS low,
 avg(wape) OVER () + stddev_pop(wape) OVER () AS high FROM ({PERIODS_SQL})""",
    six=["wape", "mean", "low", "high"],
)
def backtest_band(spark, sf):
    return B.score_band(_periods(spark, sf), "wape")


@query(
    "fold_score_summary",
    f"""WITH p AS ({PLACED_FORECAST_SQL}), n AS (SELECT count(*) AS n FROM p),
 m AS (SELECT CAST((pos - (n - 5 * (n // 6))) // (n // 6) AS INTEGER) AS fold, y_true, y_pred FROM p, n
       WHERE pos >= n - 5 * (n // 6)),
 s AS (SELECT fold, sum(abs(y_true - y_pred)) / sum(abs(y_true)) * 100 AS wape FROM m GROUP BY fold)
 SELECT avg(wape) AS mean, stddev_pop(wape) AS std, min(wape) AS min, max(wape) AS max FROM s""",
    six=["mean", "std", "min", "max"],
)
def fold_score_summary(spark, sf):
    members = expanding_folds(orders_forecast(spark, sf), ORDER_KEYS, 5).where("role = 'val'")
    scores = M.period_metrics(members, ["fold"])
    return B.score_summary(scores, "wape")


SLICE = ["wape", "mae", "r2", "tail_mae", "mean_actual", "std_actual"]


def slices_sql(keys: dict[str, str], source: str = EVENTS_FORECAST_SQL) -> str:
    cells = " UNION ALL ".join(
        f"SELECT '{n}' AS slice_type, CAST({c} AS VARCHAR) AS slice_value, y_true, y_pred FROM src" for n, c in keys.items()
    )
    long = f"WITH src AS ({source}) SELECT * FROM ({cells}) WHERE slice_value IS NOT NULL"
    return _scores_sql(long, "slice_type, slice_value", "HAVING count(*) >= 10")


TIME_KEYS = {
    "by_year": "CAST(year(timestamp) AS INTEGER)", "by_quarter": "CAST(quarter(timestamp) AS INTEGER)",
    "by_month": "CAST(month(timestamp) AS INTEGER)", "by_day_of_week": "CAST(isodow(timestamp) - 1 AS INTEGER)",
}


@query("slice_time", slices_sql(TIME_KEYS), six=SLICE)
def slice_time(spark, sf):
    return L.time_slices(events_forecast(spark, sf), "timestamp")


CUTS_SQL = f"""SELECT s.*, quantile_cont(y_true, 0.25) OVER () AS a, quantile_cont(y_true, 0.5) OVER () AS b,
 quantile_cont(y_true, 0.75) OVER () AS c, quantile_cont(y_true, 0.9) OVER () AS d,
 quantile_cont(y_true, 0.95) OVER () AS e FROM ({EVENTS_FORECAST_SQL}) s"""
TIER_CASE = "CASE " + " ".join(f"WHEN y_true <= {q} THEN '{t}'" for q, t in zip("abcd", L.PRICE_TIERS)) + f" ELSE '{L.PRICE_TIERS[4]}' END"


@query("slice_price_tier", slices_sql({"by_price_tier": TIER_CASE}, CUTS_SQL), six=SLICE)
def slice_price_tier(spark, sf):
    return L.price_tier_slices(events_forecast(spark, sf))


def _one(q: str) -> str:
    return f"format('{{:.1f}}', {q})"


BAND_CASE = f"CASE WHEN y_true <= a THEN '0-' || {_one('a')} " + " ".join(
    f"WHEN y_true <= {hi} THEN {_one(lo)} || '-' || {_one(hi)}" for lo, hi in zip("abcd", "bcde")
) + " END"


@query(
    "slice_price_band",
    f"SELECT slice_type, slice_value, sample_count, wape, mae, r2, mean_actual FROM ({slices_sql({'by_price_percentiles': BAND_CASE}, CUTS_SQL)})",
    six=["wape", "mae", "r2", "mean_actual"],
)
def slice_price_band(spark, sf):
    return L.price_band_slices(events_forecast(spark, sf))


@query("slice_category", slices_sql({"by_event_type": "event_type", "by_user_id": "user_id"}), six=SLICE)
def slice_category(spark, sf):
    return L.category_slices(events_forecast(spark, sf), ["event_type", "user_id", "absent"])


EDGES_SQL = f"""SELECT s.*, min(feature1) OVER () AS f_lo, max(feature1) OVER () AS f_hi, min(y_true) OVER () AS y_lo,
 max(y_true) OVER () AS y_hi FROM ({EVENTS_FORECAST_SQL}) s"""


def _bin(x: str, lo: str, hi: str, n: int = 5) -> str:
    return f"CAST(least(greatest(ceil(({x} - {lo}) / (({hi} - {lo}) / {n}.0)) - 1, 0), {n - 1}) AS INTEGER)"


@query(
    "slice_bins",
    slices_sql({"by_feature1_bins": _bin("feature1", "f_lo", "f_hi"), "by_y_true_bins": _bin("y_true", "y_lo", "y_hi")}, EDGES_SQL),
    six=SLICE,
)
def slice_bins(spark, sf):
    return L.bin_slices(events_forecast(spark, sf), ["feature1", "y_true"])


@query(
    "slice_summary",
    f"""WITH s AS ({slices_sql({**TIME_KEYS, 'by_event_type': 'event_type'})})
 SELECT slice_type, arg_min(slice_value, (wape, slice_value)) AS best_slice, min(wape) AS best_wape,
  arg_min(slice_value, (-wape, slice_value)) AS worst_slice, max(wape) AS worst_wape, max(wape) - min(wape) AS wape_range,
  count(*) AS num_slices FROM s GROUP BY slice_type""",
    six=["best_wape", "worst_wape", "wape_range"],
)
def slice_summary(spark, sf):
    keys = {**L.time_keys("timestamp"), "by_event_type": F.col("event_type")}
    return L.slice_summary(L.analyze_slices(events_forecast(spark, sf), keys))
