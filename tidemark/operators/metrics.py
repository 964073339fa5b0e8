"""Forecast metric suite per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import errors as E
from tidemark.operators.ordering import ROWS_PER_RANGE, GroupShape, group_shape, join_groups, over_order
from tidemark.operators.quantiles import exact_quantiles
from tidemark.session import materialize

Y, P = "y_true", "y_pred"


def scored(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Rows with both the actual and the prediction present, as doubles ``y_true``, ``y_pred``."""
    rest = [c for c in df.columns if c not in (y, p, Y, P)]
    return df.where(F.col(y).isNotNull() & F.col(p).isNotNull()).select(
        *rest, F.col(y).cast("double").alias(Y), F.col(p).cast("double").alias(P)
    )


def with_cuts(
    df: DataFrame, probs: Sequence[float], by: Sequence[str], shape: GroupShape, rows_per_range: int | None = None
) -> DataFrame:
    """Each row gets its group's quantiles of the actuals as the array ``cuts``."""
    cuts = exact_quantiles(df, Y, probs, by, "cuts", rows_per_range, shape)
    if not by:
        values = (cuts.first() or [None])[0]
        return df.withColumn("cuts", F.lit(values) if values else F.lit(None).cast("array<double>"))
    return join_groups(df, cuts, by, shape.groups)


def tail_cut(i: int) -> Column:
    return F.get(F.col("cuts"), i)


def basic_metrics() -> dict[str, Column]:
    y, p = F.col(Y), F.col(P)
    return {
        "mae": E.mae(y, p),
        "mse": E.mse(y, p),
        "rmse": E.rmse(y, p),
        "wape": E.wape(y, p),
        "mape": E.mape(y, p),
        "smape": E.smape(y, p),
        "hit_rate_5pct": E.hit_rate(y, p, 0.05),
        "hit_rate_10pct": E.hit_rate(y, p, 0.10),
    }


def directional_accuracy(same_direction: Column) -> Column:
    """Share of equal up / not-up steps; 0 for a group without steps."""
    return F.coalesce(F.avg(same_direction.cast("int")) * 100, F.lit(0.0))


def metric_suite(
    df: DataFrame,
    by: Sequence[str] = (),
    order: Sequence[str] = (),
    y: str = Y,
    p: str = P,
    rows_per_range: int | None = None,
) -> DataFrame:
    """The eleven metrics of one forecast per group.

    ``order`` gives the row order for the direction of change; without it
    that metric is left out.
    """
    rows = scored(df, y, p).select(*dict.fromkeys([*by, *order]), Y, P)
    shape = group_shape(rows, by)
    if shape.largest > (rows_per_range or ROWS_PER_RANGE):
        rows = materialize(rows)
    tagged = rows
    metrics = basic_metrics()
    if order:
        def steps(w):
            up = F.col(Y) > F.lag(Y, 1).over(w)
            predicted_up = F.col(P) > F.lag(P, 1).over(w)
            return {"same_step": up == predicted_up}

        tagged = over_order(rows, steps, order=order, by=by, reach=1, rows_per_range=rows_per_range, shape=shape)
        metrics["directional_accuracy"] = directional_accuracy(F.col("same_step"))
    tagged = with_cuts(tagged, [0.90, 0.95], by, shape, rows_per_range)
    yc, pc = F.col(Y), F.col(P)
    metrics["tail_mae_90"] = E.tail_mae(yc, pc, tail_cut(0))
    metrics["tail_mae_95"] = E.tail_mae(yc, pc, tail_cut(1))
    return tagged.groupBy(*by).agg(*[c.alias(n) for n, c in metrics.items()])


def period_metrics(
    df: DataFrame, by: Sequence[str], rows_per_range: int | None = None, shape: GroupShape | None = None
) -> DataFrame:
    """Sample count, WAPE, MAE, R2, tail MAE and moments of the actuals per group."""
    rows = scored(df).select(*by, Y, P)
    shape = shape or group_shape(rows, by)
    y, p = F.col(Y), F.col(P)
    return with_cuts(rows, [0.90], by, shape, rows_per_range).groupBy(*by).agg(
        F.count(F.lit(1)).alias("sample_count"),
        E.wape(y, p).alias("wape"),
        E.mae(y, p).alias("mae"),
        E.r2(y, p).alias("r2"),
        E.tail_mae(y, p, tail_cut(0)).alias("tail_mae"),
        F.avg(y).alias("mean_actual"),
        F.stddev_pop(y).alias("std_actual"),
    )


def quantile_losses(df: DataFrame, by: Sequence[str], quantiles: Sequence[float]) -> DataFrame:
    y, p = F.col(Y), F.col(P)
    losses = [E.pinball(y, p, q).alias(f"pinball_{round(q * 100)}") for q in quantiles]
    return scored(df).groupBy(*by).agg(*losses)


def r2_by_group(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return scored(df).groupBy(*by).agg(E.r2(F.col(Y), F.col(P)).alias("r2"))
