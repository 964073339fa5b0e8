"""Table and column profiles."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import FLOATS, nan_to_null, pearson
from tidemark.operators.clean import long_form
from tidemark.operators.gram import gram_correlation

# beyond this many column pairs the correlation runs on matrix products
WIDE_PAIRS = 66

# bytes per value of fixed-width types
WIDTHS = {
    "boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8,
    "date": 4, "timestamp": 8, "timestamp_ntz": 8,
}


def _is_missing(df: DataFrame, column: str) -> Column:
    c = F.col(column)
    return c.isNull() | F.isnan(c) if isinstance(df.schema[column].dataType, FLOATS) else c.isNull()


def _per_column(df: DataFrame, stats: dict[str, dict[str, Column]]) -> DataFrame:
    """One aggregation row turned into one row per column: {column: {stat: aggregate}}."""
    columns = list(stats)
    wide = df.agg(*[F.struct(*[e.alias(s) for s, e in stats[c].items()]).alias(f"s{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"s{i}").alias("stat")) for i, c in enumerate(columns)]
    return wide.select(F.inline(F.array(*rows))).select("feature", "stat.*")


def missing_profile(df: DataFrame) -> DataFrame:
    """Missing count and share per column; only columns with gaps."""
    stats = {
        c: {"missing": F.count_if(_is_missing(df, c)), "total": F.count(F.lit(1))} for c in df.columns
    }
    out = _per_column(df, stats).where("missing > 0")
    share = 100.0 * F.col("missing") / F.col("total")
    return out.select("feature", "missing", share.alias("missing_pct")).orderBy(F.desc("missing"), "feature")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Copies beyond the first of each full row.  Copies are counted before the shuffle."""
    copies = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("n"))
    return copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


def table_profile(df: DataFrame, time: str, category: str, approximate: bool = False) -> DataFrame:
    distinct = F.approx_count_distinct(category) if approximate else F.count_distinct(F.col(category))
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.lit(len(df.columns)).cast("long").alias("columns"),
        F.min(time).alias("first_time"),
        F.max(time).alias("last_time"),
        distinct.alias("categories"),
    )


def column_types(df: DataFrame) -> DataFrame:
    """Position, type and number of present values per column."""
    def by_name(values: dict[str, object]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("feature")]

    counts = _per_column(df, {c: {"values": F.count(c)} for c in df.columns})
    return counts.select(
        by_name({c: i for i, c in enumerate(df.columns)}).alias("position"),
        "feature",
        by_name({f.name: f.dataType.simpleString() for f in df.schema}).alias("type"),
        "values",
    )


def column_sizes(df: DataFrame) -> DataFrame:
    """Uncompressed payload bytes per column."""
    def size(f: T.StructField) -> Column:
        width = WIDTHS.get(f.dataType.simpleString())
        if width is not None:
            return F.count(F.lit(1)) * width
        text = F.col(f.name) if isinstance(f.dataType, T.StringType) else F.to_json(F.struct(f.name))
        return F.coalesce(F.sum(F.octet_length(text)), F.lit(0))

    return _per_column(df, {f.name: {"bytes": size(f).cast("long")} for f in df.schema})


def feature_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean, population standard deviation, min and max per column."""
    def stats(c: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        return {"mean": F.avg(x), "std": F.stddev_pop(x), "min": F.min(x), "max": F.max(x)}

    return _per_column(df, {c: stats(c) for c in columns})


def constant_features(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return feature_profile(df, columns).where("std = 0").select("feature")


def bad_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL, NaN and infinity counts per column."""
    def stats(c: str) -> dict[str, Column]:
        x = F.col(c).cast("double")
        return {
            "nulls": F.count_if(x.isNull()),
            "nans": F.count_if(F.isnan(x)),
            "infs": F.count_if(F.abs(x) == float("inf")),
        }

    return _per_column(df, {c: stats(c) for c in columns})


def correlation_pairs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of each unordered column pair, pairwise complete; NULL for a constant, NaN is missing."""
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, corr double")
    if len(pairs) > WIDE_PAIRS:
        return gram_correlation(df, columns)
    rows = df.select(*[nan_to_null(F.col(c).cast("double")).alias(c) for c in columns])
    wide = rows.agg(*[pearson(F.col(a), F.col(b)).alias(f"r{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


def correlation_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The full square matrix in long form, (a, b, corr)."""
    pairs = correlation_pairs(df, columns)
    mirrored = pairs.select(
        F.inline(F.array(F.struct("a", "b", "corr"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "corr")))
    )
    spread = feature_profile(df, columns)
    diagonal = spread.select(
        F.col("feature").alias("a"), F.col("feature").alias("b"), F.when(F.col("std") > 0, F.lit(1.0)).alias("corr")
    )
    return mirrored.unionByName(diagonal)


def correlated_pairs(df: DataFrame, columns: Sequence[str], threshold: float = 0.95) -> DataFrame:
    return correlation_pairs(df, columns).where(F.abs("corr") > threshold)


__all__ = [
    "bad_values", "column_sizes", "column_types", "constant_features", "correlated_pairs", "correlation_matrix",
    "correlation_pairs", "duplicate_rows", "feature_profile", "long_form", "missing_profile", "table_profile",
]
