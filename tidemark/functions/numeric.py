"""Null-, NaN- and zero-aware numeric column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.FloatType, T.DoubleType)
NUMERICS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, NUMERICS)]


def nan_to_null(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.when(~F.isnan(c), c)


def without_nan(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every float column, so both mean "missing"."""
    floats = {f.name for f in df.schema if isinstance(f.dataType, FLOATS)}
    if not floats:
        return df
    return df.select(*[nan_to_null(c).alias(c) if c in floats else F.col(c) for c in df.columns])


def ieee_div(a: Column, b: Column) -> Column:
    """IEEE-754 quotient: x/0 is a signed infinity, 0/0 is NaN, NULL stays NULL."""
    a, b = a.cast("double"), b.cast("double")
    at_zero = (
        F.when((a == 0) | F.isnan(a), F.lit(float("nan")))
        .when(a > 0, F.lit(float("inf")))
        .when(a < 0, F.lit(float("-inf")))
    )
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def is_finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(is_finite(q), q).otherwise(F.lit(float(default)))


def pearson(x: Column, y: Column) -> Column:
    """Aggregate: correlation over rows where both sides are present, NULL if one is constant."""
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_pop(F.when(both, x))
    sy = F.stddev_pop(F.when(both, y))
    return F.try_divide(F.covar_pop(x, y), sx * sy)


def equal_width_bin(x: Column, low: Column, high: Column, bins: int) -> Column:
    """Right-closed equal-width bin 0..bins-1; the lowest edge belongs to bin 0.

    A column with a single value falls into the middle bin.
    """
    width = (high - low) / F.lit(float(bins))
    spread = F.greatest(F.ceil(F.try_divide(x - low, width)) - 1, F.lit(0))
    return (
        F.when(x.isNull() | F.isnan(x), F.lit(None))
        .when(high == low, F.lit((bins - 1) // 2))
        .otherwise(F.least(spread, F.lit(bins - 1)))
        .cast("int")
    )


def currency(x: Column, code: str = "USD") -> Column:
    text = F.format_number(x, 2)
    return F.concat(F.lit("$"), text) if code == "USD" else F.concat(text, F.lit(f" {code}"))


def percentage(x: Column, decimals: int = 2) -> Column:
    """``x`` is already on the 0-100 scale.  No thousands separator."""
    return F.concat(F.translate(F.format_number(x, decimals), ",", ""), F.lit("%"))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
