"""Exact linear-interpolation quantiles per group, without one task per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import VALUES_PER_TASK, GroupShape, cumulative_counts, group_shape

def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    name: str = "quantiles",
    rows_per_range: int | None = None,
    shape: GroupShape | None = None,
) -> DataFrame:
    """``by`` columns plus an array of quantiles of ``value`` (NULL and NaN left out).

    Groups that fit one task use the built-in exact ``percentile``.  Larger
    ones read the two order statistics around each rank off the cumulative
    counts.
    """
    rows_per_range = rows_per_range or VALUES_PER_TASK
    present = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    present = present.select(*by, F.col(value).cast("double").alias("__v"))
    shape = shape or group_shape(present, by)
    if shape.largest <= rows_per_range:
        agg = F.percentile("__v", F.array(*[F.lit(float(p)) for p in probs])).alias(name)
        return present.groupBy(*by).agg(agg) if by else present.agg(agg)

    cumulative = cumulative_counts(present, by, "__v", {"n": F.count(F.lit(1))}, rows_per_range)
    def at_rank(rank):
        holds = (F.col("cum_n") - F.col("n") <= rank) & (rank < F.col("cum_n"))
        return F.max(F.when(holds, F.col("__v")))

    def quantile(p: float):
        rank = F.lit(float(p)) * (F.col("total_n") - 1)
        low, high = at_rank(F.floor(rank)), at_rank(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        return low + (high - low) * part

    agg = F.array(*[quantile(p) for p in probs]).alias(name)
    return cumulative.groupBy(*by).agg(agg) if by else cumulative.agg(agg)
