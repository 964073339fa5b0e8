"""Queries: features, scaling and encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import features as X
from tidemark.operators.preprocess import fit_columns, target_encode
from tidemark.operators.profile import correlation_pairs
from tidemark.operators.sparse import fit_sparse, nonzero, vector_size
from tidemark.operators.splits import ratio_split
from tidemark.plans.registry import query
from tidemark.plans.series import (
    EVENT_TYPES, EVENTS, EVENTS_SQL, ORDER_KEYS, ORDERS, ORDERS_PRICE_SQL, ORDERS_SQL, events_series, orders_price,
    orders_series, read,
)

PI2 = "2 * pi()"
CALENDAR_SQL = f"""CAST(year(timestamp) AS INTEGER) AS year, CAST(month(timestamp) AS INTEGER) AS month,
 CAST(day(timestamp) AS INTEGER) AS day, CAST(isodow(timestamp) - 1 AS INTEGER) AS dayofweek,
 CAST(dayofyear(timestamp) AS INTEGER) AS dayofyear, CAST(weekofyear(timestamp) AS INTEGER) AS week,
 CAST(quarter(timestamp) AS INTEGER) AS quarter,
 sin({PI2} * month(timestamp) / 12.0) AS month_sin, cos({PI2} * month(timestamp) / 12.0) AS month_cos,
 sin({PI2} * (isodow(timestamp) - 1) / 7.0) AS dayofweek_sin, cos({PI2} * (isodow(timestamp) - 1) / 7.0) AS dayofweek_cos,
 CAST(floor(epoch(timestamp)) AS BIGINT) AS timestamp_numeric"""
WAVES = ["month_sin", "month_cos", "dayofweek_sin", "dayofweek_cos"]


def lag_sql(over: str, lags=X.LAGS) -> str:
    return ", ".join(f"lag(price, {k}) OVER {over} AS price_lag_{k}" for k in lags)


def rolling_sql(over: str, windows=X.WINDOWS, safe: bool = False) -> str:
    cells = []
    for k in windows:
        frame = f"ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING" if safe else f"ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW"
        w = f"OVER ({over[1:-1]} {frame})"
        cells += [
            f"avg(price) {w} AS price_rolling_mean_{k}", f"stddev_samp(price) {w} AS price_rolling_std_{k}",
            f"min(price) {w} AS price_rolling_min_{k}", f"max(price) {w} AS price_rolling_max_{k}",
        ]
    return ", ".join(cells)


def change_sql(over: str, periods=X.PERIODS) -> str:
    cells = []
    for k in periods:
        was = f"lag(price, {k}) OVER {over}"
        cells += [f"(price - {was}) / {was} AS price_pct_change_{k}", f"price - {was} AS price_diff_{k}"]
    return ", ".join(cells)


def rolling_names(windows=X.WINDOWS) -> list[str]:
    return [f"price_rolling_{s}_{k}" for k in windows for s in ("mean", "std")]


def change_names(periods=X.PERIODS) -> list[str]:
    return [f"price_{s}_{k}" for k in periods for s in ("pct_change", "diff")]


BY_USER = "(PARTITION BY user_id ORDER BY timestamp, event_id)"
BY_TYPE = "(PARTITION BY event_type ORDER BY timestamp, event_id)"
GLOBAL = "(ORDER BY timestamp, o_orderkey)"


@query("time_features", f"SELECT event_id, {CALENDAR_SQL} FROM ({EVENTS_SQL})", six=WAVES)
def time_features(spark, sf):
    made = X.add_time_features(events_series(spark, sf).select("event_id", "timestamp"))
    return made.drop("timestamp")


@query("lag_features", f"SELECT event_id, {lag_sql(BY_USER)} FROM ({EVENTS_SQL})")
def lag_features(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "user_id")
    return X.add_lag_features(rows, EVENTS).drop("timestamp", "price", "user_id")


@query("rolling_features", f"SELECT event_id, {rolling_sql(BY_TYPE)} FROM ({EVENTS_SQL})", six=rolling_names())
def rolling_features(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "event_type")
    return X.add_rolling_features(rows, EVENT_TYPES).drop("timestamp", "price", "event_type")


@query("change_features", f"SELECT event_id, {change_sql(BY_USER)} FROM ({EVENTS_SQL})", six=change_names())
def change_features(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "user_id")
    return X.add_change_features(rows, EVENTS).drop("timestamp", "price", "user_id")


@query(
    "all_features",
    f"SELECT event_id, {CALENDAR_SQL}, {lag_sql(BY_TYPE)}, {rolling_sql(BY_TYPE)}, {change_sql(BY_TYPE)} FROM ({EVENTS_SQL})",
    six=WAVES + rolling_names() + change_names(),
)
def all_features(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "event_type")
    return X.create_all_features(rows, EVENT_TYPES).drop("timestamp", "price", "event_type")


FEATURE_NAMES = (
    ["year", "month", "day", "dayofweek", "dayofyear", "week", "quarter", *WAVES, "timestamp_numeric"]
    + [f"price_lag_{k}" for k in X.LAGS]
    + [f"price_rolling_{s}_{k}" for k in X.WINDOWS for s in ("mean", "std", "min", "max")]
    + change_names()
)
CORR_CELLS = ", ".join(
    f"{{'a': '{a}', 'b': '{b}', 'corr': CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL ELSE corr({a}, {b}) END}}"
    for i, a in enumerate(FEATURE_NAMES)
    for b in FEATURE_NAMES[i + 1 :]
)


@query(
    "feature_correlation",
    f"""WITH f AS MATERIALIZED (
  SELECT {CALENDAR_SQL}, {lag_sql(BY_TYPE)}, {rolling_sql(BY_TYPE)}, {change_sql(BY_TYPE)} FROM ({EVENTS_SQL}))
 SELECT unnest([{CORR_CELLS}], recursive := true) FROM f""",
    six=["corr"],
)
def feature_correlation(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "event_type")
    return correlation_pairs(X.create_all_features(rows, EVENT_TYPES), FEATURE_NAMES)


@query("safe_rolling", f"SELECT event_id, {rolling_sql(BY_USER, safe=True)} FROM ({EVENTS_SQL})", six=rolling_names())
def safe_rolling(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "price", "user_id")
    return X.add_rolling_features(rows, EVENTS, safe=True).drop("timestamp", "price", "user_id")


@query(
    "global_rolling", f"SELECT o_orderkey, {rolling_sql(GLOBAL)} FROM ({ORDERS_PRICE_SQL})", digits={c: 4 for c in rolling_names()}
)
def global_rolling(spark, sf):
    rows = orders_price(spark, sf).select("o_orderkey", "timestamp", "price")
    return X.add_rolling_features(rows, ORDERS).drop("timestamp", "price")


@query("global_lag", f"SELECT o_orderkey, {lag_sql(GLOBAL)} FROM ({ORDERS_PRICE_SQL})")
def global_lag(spark, sf):
    rows = orders_price(spark, sf).select("o_orderkey", "timestamp", "price")
    return X.add_lag_features(rows, ORDERS).drop("timestamp", "price")


SCALED = ["price", "feature1", "feature2", "feature3"]


@query(
    "standard_scale",
    f"""WITH s AS ({ORDERS_SQL}), m AS (SELECT {', '.join(
        f'avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}' for c in SCALED)} FROM s)
 SELECT o_orderkey, {', '.join(f'({c} - m_{c}) / s_{c} AS num__{c}' for c in SCALED)} FROM s, m""",
    six=[f"num__{c}" for c in SCALED],
)
def standard_scale(spark, sf):
    rows = orders_series(spark, sf)
    return fit_columns(rows, SCALED).apply(rows, ["o_orderkey"])


EVENT_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "one_hot",
    f"""SELECT event_id, {', '.join(
        f"CASE WHEN event_type = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS cat__event_type_{v}" for v in EVENT_KINDS)}
 FROM events""",
)
def one_hot(spark, sf):
    rows = events_series(spark, sf).select("event_id", "event_type")
    return fit_columns(rows, [], ["event_type"]).apply(rows, ["event_id"])


@query(
    "one_hot_sparse",
    """WITH t AS (SELECT *, o_orderdate < DATE '1997-01-01' AS train FROM orders),
 k AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS v FROM t WHERE train)),
 p AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i FROM (SELECT DISTINCT o_orderpriority AS v FROM t WHERE train)),
 m AS (SELECT avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM t WHERE train),
 z AS (SELECT (SELECT count(*) FROM k) AS nk, (SELECT count(*) FROM p) AS np)
 SELECT o_orderkey, CAST(1 + nk + np AS INTEGER) AS size, (o_totalprice - mean) / std AS num__o_totalprice,
  concat_ws(',', CAST(1 + k.i AS VARCHAR), CAST(1 + nk + p.i AS VARCHAR)) AS places
 FROM t LEFT JOIN k ON k.v = CAST(o_custkey AS VARCHAR) LEFT JOIN p ON p.v = o_orderpriority, m, z""",
    six=["num__o_totalprice"],
)
def one_hot_sparse(spark, sf):
    """Customers as categories, fitted on the orders before 1997; customers that first order later have no place."""
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_custkey", "o_orderpriority")
    before = rows.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("date"))
    fitted = fit_sparse(before, ["o_totalprice"], ["o_custkey", "o_orderpriority"])
    cells = F.filter("cells", lambda p: p["place"] > 0)
    made = fitted.apply(rows, ["o_orderkey"])
    made = made.select("o_orderkey", vector_size("features").alias("size"), nonzero("features").alias("cells"))
    return made.select(
        "o_orderkey", "size",
        F.coalesce(F.filter("cells", lambda p: p["place"] == 0)[0]["value"], F.lit(0.0)).alias("num__o_totalprice"),
        F.array_join(F.transform(cells, lambda p: p["place"].cast("string")), ",").alias("places"),
    )


@query(
    "fit_on_train",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY timestamp, o_orderkey) - 1 AS pos, count(*) OVER () AS n
  FROM ({ORDERS_PRICE_SQL})),
 m AS (SELECT avg(price) AS mean, stddev_pop(price) AS std FROM p WHERE pos < floor(n * 0.6))
 SELECT o_orderkey, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * (0.6 + 0.2)) THEN 'val' ELSE 'test' END
   AS split, (price - mean) / std AS num__price FROM p, m""",
    six=["num__price"],
)
def fit_on_train(spark, sf):
    rows = orders_price(spark, sf).select("o_orderkey", "timestamp", "price")
    split = ratio_split(rows, ORDER_KEYS)
    return fit_columns(split.where("split = 'train'"), ["price"]).apply(split, ["o_orderkey", "split"])


@query(
    "target_encode",
    f"""WITH p AS (SELECT *, timestamp < TIMESTAMP '2024-01-20' AS train FROM ({EVENTS_SQL})),
 m AS (SELECT event_type, avg(price) AS v FROM p WHERE train AND event_type <> 'error' GROUP BY event_type),
 g AS (SELECT avg(price) AS v FROM p WHERE train AND event_type <> 'error')
 SELECT event_id, coalesce(m.v, g.v) AS event_type_encoded FROM p LEFT JOIN m USING (event_type), g""",
    six=["event_type_encoded"],
)
def target_encoding(spark, sf):
    rows = events_series(spark, sf).select("event_id", "timestamp", "event_type", "price")
    before = F.col("timestamp") < F.lit("2024-01-20").cast("timestamp_ntz")
    train = rows.where(before & (F.col("event_type") != "error"))
    return target_encode(train, rows, "event_type", "price").select("event_id", "event_type_encoded")
