"""Queries: positions and time-ordered splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import splits as S
from tidemark.operators.ordering import positions
from tidemark.plans.registry import query
from tidemark.plans.series import BY_CUSTOMER, ORDER_KEYS, ORDERS_PRICE_SQL, orders_price

PLACED_SQL = f"""SELECT o_orderkey, timestamp, row_number() OVER (ORDER BY timestamp, o_orderkey) - 1 AS pos,
 count(*) OVER () AS n FROM ({ORDERS_PRICE_SQL})"""


def _keys(spark, sf):
    return orders_price(spark, sf).select("o_orderkey", "timestamp")


@query("positions", f"SELECT o_orderkey, pos FROM ({PLACED_SQL})")
def global_positions(spark, sf):
    return positions(_keys(spark, sf), ORDER_KEYS).drop("timestamp")


@query(
    "positions_by_customer",
    f"""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY timestamp, o_orderkey) - 1 AS pos
 FROM ({ORDERS_PRICE_SQL})""",
)
def customer_positions(spark, sf):
    rows = orders_price(spark, sf).select("o_orderkey", "o_custkey", "timestamp")
    return positions(rows, ORDER_KEYS, BY_CUSTOMER).select("o_orderkey", "pos")


@query(
    "ratio_split",
    f"""SELECT o_orderkey, pos, CASE WHEN pos < floor(n * 0.6) THEN 'train' WHEN pos < floor(n * 0.8) THEN 'val'
 ELSE 'test' END AS split FROM ({PLACED_SQL})""",
)
def ratio_split(spark, sf):
    return S.ratio_split(_keys(spark, sf), ORDER_KEYS).drop("timestamp")


DATES = {"train": (None, "1999-01-01"), "val": ("1998-07-01", "2000-01-01"), "test": ("2000-01-01", "2001-01-01")}


@query(
    "date_split",
    f"""SELECT o_orderkey, 'train' AS split FROM ({ORDERS_PRICE_SQL}) WHERE timestamp < TIMESTAMP '1999-01-01'
 UNION ALL SELECT o_orderkey, 'val' FROM ({ORDERS_PRICE_SQL})
  WHERE timestamp >= TIMESTAMP '1998-07-01' AND timestamp < TIMESTAMP '2000-01-01'
 UNION ALL SELECT o_orderkey, 'test' FROM ({ORDERS_PRICE_SQL})
  WHERE timestamp >= TIMESTAMP '2000-01-01' AND timestamp < TIMESTAMP '2001-01-01'""",
)
def date_split(spark, sf):
    return S.date_split(_keys(spark, sf), "timestamp", **DATES).drop("timestamp")


FOLDS = 5
FOLDS_SQL = f"""SELECT o_orderkey, timestamp, CAST(fold AS INTEGER) AS fold, CASE WHEN pos < s THEN 'train' ELSE 'val' END AS role FROM (
 SELECT p.*, f.fold, n // {FOLDS + 1} AS size, n - {FOLDS} * (n // {FOLDS + 1}) + f.fold * (n // {FOLDS + 1}) AS s
 FROM ({PLACED_SQL}) p, (SELECT unnest(range({FOLDS})) AS fold) f) WHERE pos < s + size"""


@query("expanding_folds", f"SELECT o_orderkey, fold, role FROM ({FOLDS_SQL})")
def expanding_folds(spark, sf):
    return S.expanding_folds(_keys(spark, sf), ORDER_KEYS, FOLDS).select("o_orderkey", "fold", "role")


@query(
    "fold_ranges",
    f"""SELECT fold, role, count(*) AS rows, min(timestamp) AS first_time, max(timestamp) AS last_time
 FROM ({FOLDS_SQL}) GROUP BY fold, role""",
)
def fold_ranges(spark, sf):
    return S.fold_ranges(S.expanding_folds(_keys(spark, sf), ORDER_KEYS, FOLDS), "timestamp")


TRAIN, VAL, STEP = 2000, 500, 100


def walk_forward_sql(placed: str, train: int = TRAIN, val: int = VAL, step: int = STEP, roles=("train", "val")) -> str:
    """(period, role, pos) membership by a plain range join on the period number."""
    ends = {"train": (0, train), "val": (train, train + val)}
    return " UNION ALL ".join(
        f"""SELECT CAST(w.p + 1 AS INTEGER) AS period, '{r}' AS role, d.* FROM ({placed}) d
 JOIN (SELECT unnest(range(greatest((SELECT count(*) FROM ({placed})) - {train} - {val}, -{step}) // {step} + 1)) AS p) w
 ON d.pos >= w.p * {step} + {ends[r][0]} AND d.pos < w.p * {step} + {ends[r][1]}"""
        for r in roles
    )


@query(
    "walk_forward_windows",
    f"""SELECT period, role, count(*) AS rows, CAST(min(pos) AS BIGINT) AS first_pos, CAST(max(pos) AS BIGINT) AS last_pos,
 CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM ({walk_forward_sql(PLACED_SQL)}) GROUP BY period, role""",
)
def walk_forward_windows(spark, sf):
    members = S.walk_forward(_keys(spark, sf), ORDER_KEYS, TRAIN, VAL, STEP)
    return members.groupBy("period", "role").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("pos").alias("first_pos"),
        F.max("pos").alias("last_pos"),
        F.sum("o_orderkey").alias("key_sum"),
    )


K = 7


@query(
    "kfold_contiguous",
    f"""SELECT o_orderkey, CAST(CASE WHEN pos < (n % {K}) * (n // {K} + 1) THEN pos // (n // {K} + 1)
  ELSE (n % {K}) + (pos - (n % {K}) * (n // {K} + 1)) // (n // {K}) END AS INTEGER) AS fold FROM ({PLACED_SQL})""",
)
def kfold_contiguous(spark, sf):
    return S.contiguous_folds(_keys(spark, sf), ORDER_KEYS, K).select("o_orderkey", "fold")


@query(
    "random_split",
    f"""SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY md5(CAST(o_orderkey AS VARCHAR) || '|{S.RANDOM_SEED}'), o_orderkey)
  <= ceil(count(*) OVER () * 0.2) THEN 'test' ELSE 'train' END AS split FROM orders""",
)
def random_split(spark, sf):
    return S.random_split(_keys(spark, sf).select("o_orderkey"), ["o_orderkey"])


@query(
    "first_n",
    f"SELECT o_orderkey, timestamp FROM ({ORDERS_PRICE_SQL}) ORDER BY timestamp, o_orderkey LIMIT 100",
)
def first_n(spark, sf):
    return S.first_rows(_keys(spark, sf), ORDER_KEYS, 100)
