"""Cleaning: time coercion, missing targets, median / mode fill, IQR filter."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numeric import numeric_columns, without_nan
from tidemark.operators.ordering import VALUES_PER_TASK, GroupShape
from tidemark.operators.quantiles import exact_quantiles

UNKNOWN = "Unknown"


def to_time(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    return c if kind.startswith(("timestamp", "date")) else F.try_to_timestamp(c).cast("timestamp_ntz")


def coerce_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.withColumn(column, to_time(df, column)) if column in df.columns else df


def medians(df: DataFrame, columns: Sequence[str], rows_per_range: int | None = None) -> dict[str, float]:
    """Exact median per column; one number per column comes back to the driver."""
    if not columns:
        return {}
    if df.count() <= (rows_per_range or VALUES_PER_TASK):
        row = df.agg(*[F.median(F.col(c).cast("double")).alias(c) for c in columns]).first()
        return {c: row[c] for c in columns}
    long = long_form(df, columns)
    rows = exact_quantiles(long, "value", [0.5], ["feature"], rows_per_range=rows_per_range).collect()
    return {r["feature"]: r["quantiles"][0] for r in rows}


def long_form(df: DataFrame, columns: Sequence[str], kind: str = "double", keep: Sequence[str] = ()) -> DataFrame:
    """(feature, value) rows, one per listed column."""
    cells = [F.struct(F.lit(c).alias("feature"), F.col(c).cast(kind).alias("value")) for c in columns]
    return df.select(*keep, F.inline(F.array(*cells)))


def modes(df: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent value per column, smallest on ties.  Values are counted before the shuffle."""
    if not columns:
        return {}
    counts = (
        long_form(df, columns, "string").where("value IS NOT NULL").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    best = counts.groupBy("feature").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))
    return {r["feature"]: r["value"] for r in best.collect()}


@dataclass(frozen=True)
class FillValues:
    """Fitted fill values, so that they can come from training rows only."""

    time: str
    target: str
    numeric: dict[str, float] = field(default_factory=dict)
    categorical: dict[str, str] = field(default_factory=dict)

    def apply(self, df: DataFrame) -> DataFrame:
        df = without_nan(coerce_time(df, self.time)).where(F.col(self.target).isNotNull())

        def filled(c: str) -> Column:
            if c in self.categorical:
                return F.coalesce(F.col(c), F.lit(self.categorical[c])).alias(c)
            if self.numeric.get(c) is not None:
                return F.coalesce(F.col(c).cast("double"), F.lit(float(self.numeric[c]))).alias(c)
            return F.col(c)

        return df.select(*[filled(c) for c in df.columns])


def fit_fill(
    df: DataFrame, time: str = "timestamp", target: str = "price", rows_per_range: int | None = None
) -> FillValues:
    """Medians and modes over the rows whose target is present.

    Only columns that hold a missing value are fitted: one pass of null
    counts decides, the others need no fill.
    """
    if target not in df.columns:
        raise KeyError(target)
    rows = without_nan(coerce_time(df, time)).where(F.col(target).isNotNull())
    numeric = [c for c in numeric_columns(rows) if c != target]
    strings = [f.name for f in rows.schema if isinstance(f.dataType, T.StringType) and f.name != time]
    if not numeric and not strings:
        return FillValues(time, target)
    gaps = rows.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in numeric + strings]).first()
    numeric = [c for c in numeric if gaps[c]]
    strings = [c for c in strings if gaps[c]]
    found = modes(rows, strings)
    return FillValues(time, target, medians(rows, numeric, rows_per_range), {c: found.get(c, UNKNOWN) for c in strings})


def clean(df: DataFrame, time: str = "timestamp", target: str = "price", rows_per_range: int | None = None) -> DataFrame:
    return fit_fill(df, time, target, rows_per_range).apply(df)


def require_columns(df: DataFrame, required: Sequence[str]) -> None:
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {missing}")


def unparseable_times(df: DataFrame, time: str) -> DataFrame:
    """One row: how many time values are present but cannot be read as a timestamp."""
    bad = F.col(time).isNotNull() & to_time(df, time).isNull()
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad_times"))


def validate(df: DataFrame, required: Sequence[str], time: str | None = None) -> bool:
    require_columns(df, required)
    if time and time in df.columns:
        bad = unparseable_times(df, time).first()["bad_times"]
        if bad:
            raise ValueError(f"time column {time!r}: {bad} values cannot be read as timestamps")
    return True


def iqr_filter(
    df: DataFrame,
    columns: Sequence[str],
    factor: float = 1.5,
    mode: str = "sequential",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Keep rows inside [q1 - f*iqr, q3 + f*iqr] for every listed column.

    ``sequential`` takes the bounds of a column from the rows that survived
    the columns before it, one pass per column.  ``independent`` takes all
    bounds from the unfiltered rows in one pass; it is another result.
    """
    present = [c for c in columns if c in df.columns]
    n = df.count()  # filters only lower it, so it bounds every later pass
    if mode == "independent":
        bounds = _quartiles(df, present, n, rows_per_range)
        for c in present:
            df = _inside(df, c, bounds.get(c), factor)
        return df
    if mode != "sequential":
        raise ValueError(f"unknown mode {mode!r}")
    for c in present:
        df = _inside(df, c, _quartiles(df, [c], n, rows_per_range).get(c), factor)
    return df


def _quartiles(df: DataFrame, columns: Sequence[str], n: int, rows_per_range: int | None) -> dict[str, list[float]]:
    shape = GroupShape(n * len(columns), len(columns), n)
    q = exact_quantiles(
        long_form(df, columns), "value", [0.25, 0.75], ["feature"], rows_per_range=rows_per_range, shape=shape
    )
    return {r["feature"]: r["quantiles"] for r in q.collect()}


def _inside(df: DataFrame, column: str, quartiles: list[float] | None, factor: float) -> DataFrame:
    if quartiles is None:
        return df.where(F.lit(False))
    q1, q3 = quartiles
    width = factor * (q3 - q1)
    return df.where(F.col(column).between(q1 - width, q3 + width))
