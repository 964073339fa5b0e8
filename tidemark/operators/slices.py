"""Error metrics per slice of the data: time, price tier, category, feature bin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numeric import equal_width_bin
from tidemark.operators.metrics import P, Y, period_metrics
from tidemark.operators.quantiles import exact_quantiles

# fixed values: smallest reported slice, tier labels
MIN_ROWS = 10
PRICE_TIERS = ("Low (0-25%)", "Medium-Low (25-50%)", "Medium-High (50-75%)", "High (75-90%)", "Very High (90-100%)")


def analyze_slices(
    df: DataFrame, keys: dict[str, Column], min_rows: int = MIN_ROWS, rows_per_range: int | None = None
) -> DataFrame:
    """One row per (slice_type, slice_value) with at least ``min_rows`` rows; NULL keys are skipped."""
    cells = [F.struct(F.lit(n).alias("slice_type"), c.cast("string").alias("slice_value")) for n, c in keys.items()]
    rows = df.select(Y, P, F.inline(F.array(*cells))).where("slice_value IS NOT NULL")
    return period_metrics(rows, ["slice_type", "slice_value"], rows_per_range).where(F.col("sample_count") >= min_rows)


def time_keys(time: str) -> dict[str, Column]:
    t = F.col(time)
    return {
        "by_year": F.year(t), "by_quarter": F.quarter(t), "by_month": F.month(t), "by_day_of_week": F.weekday(t),
    }


def time_slices(df: DataFrame, time: str, **kw) -> DataFrame:
    return analyze_slices(df, time_keys(time), **kw)


def category_slices(df: DataFrame, columns: Sequence[str], **kw) -> DataFrame:
    return analyze_slices(df, {f"by_{c}": F.col(c) for c in columns if c in df.columns}, **kw)


def _price_cuts(df: DataFrame, price: str, probs: Sequence[float], rows_per_range: int | None) -> list[float]:
    return exact_quantiles(df, price, probs, rows_per_range=rows_per_range).first()[0]


def price_tier(price: Column, cuts: Sequence[float]) -> Column:
    tier = F.when(price.isNull(), F.lit(None))
    for label, cut in zip(PRICE_TIERS, cuts):
        tier = tier.when(price <= cut, label)
    return tier.otherwise(PRICE_TIERS[-1])


def price_tier_slices(df: DataFrame, price: str = Y, rows_per_range: int | None = None, **kw) -> DataFrame:
    cuts = _price_cuts(df, price, [0.25, 0.5, 0.75, 0.9], rows_per_range)
    keys = {"by_price_tier": price_tier(F.col(price), cuts)}
    return analyze_slices(df, keys, rows_per_range=rows_per_range, **kw)


def price_band(price: Column, cuts: Sequence[float]) -> Column:
    """Label of the half-open band (previous cut, cut]; NULL above the last cut."""
    band, low = None, "0"
    for cut in cuts:
        label = f"{low}-{cut:.1f}"
        band = F.when(price <= cut, label) if band is None else band.when(price <= cut, label)
        low = f"{cut:.1f}"
    return band


def price_band_slices(df: DataFrame, price: str = Y, rows_per_range: int | None = None, **kw) -> DataFrame:
    cuts = _price_cuts(df, price, [0.25, 0.5, 0.75, 0.9, 0.95], rows_per_range)
    keys = {"by_price_percentiles": price_band(F.col(price), cuts)}
    return analyze_slices(df, keys, rows_per_range=rows_per_range, **kw).drop("tail_mae", "std_actual")


def bin_slices(df: DataFrame, columns: Sequence[str], bins: int = 5, **kw) -> DataFrame:
    present = [c for c in columns if c in df.columns]
    edges = df.agg(*[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in present],
                   *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in present]).first()
    keys = {
        f"by_{c}_bins": equal_width_bin(F.col(c).cast("double"), F.lit(edges[f"lo_{c}"]), F.lit(edges[f"hi_{c}"]), bins)
        for c in present
    }
    return analyze_slices(df, keys, **kw)


def slice_summary(slices: DataFrame) -> DataFrame:
    """Best and worst slice by WAPE per slice type; ties go to the smallest value."""
    value = F.col("slice_value")
    return slices.groupBy("slice_type").agg(
        F.min_by(value, F.struct("wape", "slice_value")).alias("best_slice"),
        F.min("wape").alias("best_wape"),
        F.min_by(value, F.struct(-F.col("wape"), value)).alias("worst_slice"),
        F.max("wape").alias("worst_wape"),
        (F.max("wape") - F.min("wape")).alias("wape_range"),
        F.count(F.lit(1)).alias("num_slices"),
    )
