"""Queries: cleaning, validation and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.numeric import currency, percentage, safe_divide
from tidemark.operators import clean as C
from tidemark.operators import profile as P
from tidemark.plans.registry import query
from tidemark.plans.series import ORDERS_SQL, orders_series, read

LINE_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FEATURES = ["price", "feature1", "feature2", "feature3"]


def damaged_orders(spark, sf):
    """The order series with its low-priority label and its smallest prices blanked."""
    s = orders_series(spark, sf)
    return s.withColumn("category", F.nullif("category", F.lit("5-LOW"))).withColumn(
        "price", F.when(F.col("price") >= 5000, F.col("price"))
    )


DAMAGED_SQL = f"""
SELECT o_orderkey, o_custkey, timestamp, CASE WHEN price >= 5000 THEN price END AS price,
       nullif(category, '5-LOW') AS category, feature1, feature2, feature3
FROM ({ORDERS_SQL})"""


@query(
    "clean_orders",
    f"""
WITH s AS (SELECT * FROM ({DAMAGED_SQL}) WHERE price IS NOT NULL),
 m AS (SELECT median(feature1) AS m1, median(feature2) AS m2, median(feature3) AS m3 FROM s),
 c AS (SELECT category AS top FROM s WHERE category IS NOT NULL GROUP BY category
       ORDER BY count(*) DESC, category LIMIT 1)
SELECT o_orderkey, o_custkey, timestamp, price, coalesce(category, top) AS category,
       coalesce(feature1, m1) AS feature1, coalesce(feature2, m2) AS feature2, coalesce(feature3, m3) AS feature3
FROM s, m, c""",
    six=["feature2"],
)
def clean_orders(spark, sf):
    return C.clean(damaged_orders(spark, sf), "timestamp", "price")


def _missing_cell(c: str) -> str:
    return f"SELECT '{c}' AS feature, count(*) - count({c}) AS missing, count(*) AS n FROM s"


@query(
    "missing_profile",
    f"""
WITH s AS ({DAMAGED_SQL})
SELECT feature, missing, 100.0 * missing / n AS missing_pct FROM (
{' UNION ALL '.join(_missing_cell(c) for c in ['o_orderkey', 'o_custkey', 'timestamp', *FEATURES, 'category'])})
WHERE missing > 0""",
    six=["missing_pct"],
)
def missing_profile(spark, sf):
    return P.missing_profile(damaged_orders(spark, sf))


@query(
    "table_profile",
    f"""SELECT count(*) AS rows, CAST(8 AS BIGINT) AS columns, min(timestamp) AS first_time, max(timestamp) AS last_time,
 count(DISTINCT category) AS categories FROM ({ORDERS_SQL})""",
)
def table_profile(spark, sf):
    return P.table_profile(orders_series(spark, sf), "timestamp", "category")


TYPES = {
    "o_orderkey": "bigint", "o_custkey": "bigint", "timestamp": "timestamp_ntz", "price": "double", "category": "string",
    "feature1": "double", "feature2": "double", "feature3": "double",
}


@query(
    "column_types",
    f"""WITH s AS ({DAMAGED_SQL}) {' UNION ALL '.join(
        f"SELECT CAST({i} AS INTEGER) AS position, '{c}' AS feature, '{t}' AS type, count({c}) AS values FROM s"
        for i, (c, t) in enumerate(TYPES.items()))}""",
)
def column_types(spark, sf):
    return P.column_types(damaged_orders(spark, sf))


DUPLICATE_KEYS = "l_quantity, l_discount, l_tax, l_returnflag, l_linestatus"


@query(
    "duplicate_rows",
    f"SELECT CAST(sum(n - 1) AS BIGINT) AS duplicates FROM (SELECT count(*) AS n FROM lineitem GROUP BY {DUPLICATE_KEYS})",
)
def duplicate_rows(spark, sf):
    return P.duplicate_rows(read(spark, sf, "lineitem").select(*DUPLICATE_KEYS.split(", ")))


@query(
    "column_sizes",
    """SELECT 'l_orderkey' AS feature, CAST(8 * count(*) AS BIGINT) AS bytes FROM lineitem
 UNION ALL SELECT 'l_linenumber', 4 * count(*) FROM lineitem
 UNION ALL SELECT 'l_tax', 8 * count(*) FROM lineitem
 UNION ALL SELECT 'l_returnflag', CAST(sum(strlen(l_returnflag)) AS BIGINT) FROM lineitem
 UNION ALL SELECT 'l_shipdate', 8 * count(*) FROM lineitem""",
)
def column_sizes(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_tax", "l_returnflag", "l_shipdate"]
    return P.column_sizes(read(spark, sf, "lineitem").select(*cols))


def _iqr_step(source: str, name: str, column: str, factor: float) -> str:
    return f"""{name} AS (SELECT t.* FROM {source} t, (
  SELECT quantile_cont({column}, 0.25) AS q1, quantile_cont({column}, 0.75) AS q3 FROM {source}) b
  WHERE {column} BETWEEN q1 - {factor} * (q3 - q1) AND q3 + {factor} * (q3 - q1))"""


IQR_COLUMNS, IQR_FACTOR = ["l_extendedprice", "l_quantity", "l_tax"], 0.5


@query(
    "iqr_filter",
    f"""WITH {_iqr_step('lineitem', 'a', IQR_COLUMNS[0], IQR_FACTOR)},
 {_iqr_step('a', 'b', IQR_COLUMNS[1], IQR_FACTOR)}, {_iqr_step('b', 'c', IQR_COLUMNS[2], IQR_FACTOR)}
SELECT l_orderkey, l_linenumber, l_extendedprice, l_quantity, l_tax FROM c""",
)
def iqr_filter(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *IQR_COLUMNS)
    return C.iqr_filter(rows, IQR_COLUMNS, IQR_FACTOR)


@query(
    "iqr_filter_independent",
    f"""SELECT l_orderkey, l_linenumber FROM lineitem, (SELECT
 {', '.join(f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in IQR_COLUMNS)}
 FROM lineitem) WHERE {' AND '.join(
     f"{c} BETWEEN q1_{c} - {IQR_FACTOR} * (q3_{c} - q1_{c}) AND q3_{c} + {IQR_FACTOR} * (q3_{c} - q1_{c})"
     for c in IQR_COLUMNS)}""",
)
def iqr_filter_independent(spark, sf):
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *IQR_COLUMNS)
    return C.iqr_filter(rows, IQR_COLUMNS, IQR_FACTOR, "independent").select("l_orderkey", "l_linenumber")


def _pairs_sql(columns: list[str], table: str) -> str:
    cells = [
        f"SELECT '{a}' AS a, '{b}' AS b, CASE WHEN stddev_pop({a}) = 0 OR stddev_pop({b}) = 0 THEN NULL "
        f"ELSE corr({a}, {b}) END AS corr FROM {table}"
        for i, a in enumerate(columns)
        for b in columns[i + 1 :]
    ]
    return " UNION ALL ".join(cells)


@query(
    "correlation_long",
    f"""WITH p AS ({_pairs_sql(LINE_NUMBERS, 'lineitem')}),
 d AS ({' UNION ALL '.join(f"SELECT '{c}' AS a, '{c}' AS b, CAST(1.0 AS DOUBLE) AS corr" for c in LINE_NUMBERS)})
 SELECT * FROM p UNION ALL SELECT b, a, corr FROM p UNION ALL SELECT * FROM d""",
    six=["corr"],
)
def correlation_long(spark, sf):
    return P.correlation_matrix(read(spark, sf, "lineitem"), LINE_NUMBERS)


@query(
    "correlated_pairs",
    f"""WITH s AS (SELECT l_quantity, l_quantity * 2 + l_tax AS near_copy, l_discount, 1.0 AS fixed FROM lineitem)
 SELECT * FROM ({_pairs_sql(['l_quantity', 'near_copy', 'l_discount', 'fixed'], 's')}) WHERE abs(corr) > 0.95""",
    six=["corr"],
)
def correlated_pairs(spark, sf):
    rows = read(spark, sf, "lineitem").select(
        "l_quantity", (F.col("l_quantity") * 2 + F.col("l_tax")).alias("near_copy"), "l_discount", F.lit(1.0).alias("fixed")
    )
    return P.correlated_pairs(rows, rows.columns)


@query(
    "safe_ratio",
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN -1.0 ELSE l_tax / l_discount END AS ratio
 FROM lineitem""",
    six=["ratio"],
)
def safe_ratio(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", safe_divide(F.col("l_tax"), F.col("l_discount"), -1.0).alias("ratio")
    )


@query(
    "formatted_report",
    """SELECT l_returnflag, '$' || format('{:,.2f}', total) AS usd, format('{:,.2f}', total) || ' EUR' AS eur,
 format('{:.1f}', share) || '%' AS share FROM (
 SELECT l_returnflag, round(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) / 100.0, 2) AS total,
        100.0 * count(*) / sum(count(*)) OVER () AS share FROM lineitem GROUP BY l_returnflag)""",
)
def formatted_report(spark, sf):
    lines = read(spark, sf, "lineitem")
    cents = F.sum(F.round(F.col("l_extendedprice") * 100).cast("long"))
    n = lines.count()
    out = lines.groupBy("l_returnflag").agg((cents / 100.0).alias("total"), (100.0 * F.count(F.lit(1)) / n).alias("share"))
    total = F.col("total")
    return out.select(
        "l_returnflag", currency(total).alias("usd"), currency(total, "EUR").alias("eur"), percentage(F.col("share"), 1).alias("share")
    )


def _profile_sql(columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, avg({c}) AS mean, stddev_pop({c}) AS std, min({c}) AS min, max({c}) AS max FROM s"
        for c in columns
    )


@query(
    "feature_profile",
    f"WITH s AS ({ORDERS_SQL}) {_profile_sql(FEATURES)}",
    digits={"mean": 4, "std": 4, "min": 4, "max": 4},
)
def feature_profile(spark, sf):
    return P.feature_profile(orders_series(spark, sf), FEATURES)


@query(
    "constant_features",
    f"""WITH s AS (SELECT *, 7.0 AS flat FROM ({ORDERS_SQL}))
 SELECT feature FROM ({_profile_sql([*FEATURES, 'flat'])}) WHERE std = 0""",
)
def constant_features(spark, sf):
    return P.constant_features(orders_series(spark, sf).withColumn("flat", F.lit(7.0)), [*FEATURES, "flat"])


@query(
    "bad_values",
    f"""WITH s AS (SELECT feature1, feature2, 1.0 / l AS inverse FROM (SELECT *, o_custkey - 1 AS l FROM ({ORDERS_SQL})))
 {' UNION ALL '.join(f"SELECT '{c}' AS feature, count(*) - count({c}) AS nulls, count(*) FILTER (WHERE isnan({c})) AS nans, "
                     f"count(*) FILTER (WHERE isinf({c})) AS infs FROM s" for c in ['feature1', 'feature2', 'inverse'])}""",
)
def bad_values(spark, sf):
    from tidemark.functions.numeric import ieee_div

    rows = orders_series(spark, sf).withColumn("inverse", ieee_div(F.lit(1.0), F.col("o_custkey") - 1))
    return P.bad_values(rows, ["feature1", "feature2", "inverse"])


@query(
    "schema_check",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE t IS NOT NULL AND try_cast(t AS TIMESTAMP) IS NULL) AS bad_times
 FROM (SELECT CASE WHEN event_type = 'error' THEN 'n/a' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS t FROM events)""",
)
def schema_check(spark, sf):
    events = read(spark, sf, "events")
    text = F.when(F.col("event_type") == "error", "n/a").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    rows = events.select("event_id", text.alias("t"))
    C.require_columns(rows, ["event_id", "t"])
    return C.unparseable_times(rows, "t")

