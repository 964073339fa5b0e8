"""The driver's tables seen as price series, with the SQL of the same views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.backtest import naive_forecast
from tidemark.roles import Roles
from tidemark.sources.tables import load_table

EVENTS = Roles("timestamp", "price", "user_id", ("event_id",), ("feature1",), ("event_type",))
EVENT_TYPES = Roles("timestamp", "price", "event_type", ("event_id",), ("feature1",))
ORDERS = Roles("timestamp", "price", None, ("o_orderkey",), ("feature1", "feature2", "feature3"), ("category",))
ORDER_KEYS = ("timestamp", "o_orderkey")

DRIFT_START = "2024-01-16"


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return load_table(spark, f"{sf}/{table}.parquet")


def events_series(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.col("value").alias("price"),
        "user_id",
        "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("feature1"),
    )


EVENTS_SQL = """
SELECT event_id, ts AS timestamp, value AS price, user_id, event_type,
       CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS DOUBLE) AS feature1
FROM events"""


def orders_price(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.col("o_orderdate").alias("timestamp"),
        F.col("o_totalprice").alias("price"),
        F.col("o_orderpriority").alias("category"),
    )


ORDERS_PRICE_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate AS timestamp, o_totalprice AS price, o_orderpriority AS category
FROM orders"""


def orders_series(spark: SparkSession, sf: str) -> DataFrame:
    """Orders with three features from their line items; orders without lines get NULL features."""
    lines = (
        read(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum("l_quantity").alias("feature1"),
            F.avg("l_discount").alias("feature2"),
            F.count(F.lit(1)).cast("double").alias("feature3"),
        )
    )
    return orders_price(spark, sf).join(lines, "o_orderkey", "left")


ORDERS_SQL = f"""
SELECT o.*, f.feature1, f.feature2, f.feature3
FROM ({ORDERS_PRICE_SQL}) o LEFT JOIN (
  SELECT l_orderkey, sum(l_quantity) AS feature1, avg(l_discount) AS feature2,
         CAST(count(*) AS DOUBLE) AS feature3
  FROM lineitem GROUP BY l_orderkey) f ON o.o_orderkey = f.l_orderkey"""


def events_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Lag-1 forecast of each user's value."""
    return naive_forecast(events_series(spark, sf), EVENTS.order, "price", EVENTS.by)


EVENTS_FORECAST_SQL = f"""
SELECT * FROM (
  SELECT s.*, price AS y_true,
         lag(price) OVER (PARTITION BY user_id ORDER BY timestamp, event_id) AS y_pred
  FROM ({EVENTS_SQL}) s) WHERE y_pred IS NOT NULL"""


def orders_forecast(spark: SparkSession, sf: str) -> DataFrame:
    """Lag-1 forecast over the one global order series."""
    return naive_forecast(orders_price(spark, sf), ORDER_KEYS, "price")


ORDERS_FORECAST_SQL = f"""
SELECT * FROM (
  SELECT s.*, price AS y_true, lag(price) OVER (ORDER BY timestamp, o_orderkey) AS y_pred
  FROM ({ORDERS_PRICE_SQL}) s) WHERE y_pred IS NOT NULL"""

BY_CUSTOMER = ("o_custkey",)
