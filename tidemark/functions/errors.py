"""Forecast-error aggregates over (y_true, y_pred).  Percentages are 0-100."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import ieee_div


def mae(y: Column, p: Column) -> Column:
    return F.avg(F.abs(y - p))


def mse(y: Column, p: Column) -> Column:
    return F.avg((y - p) * (y - p))


def rmse(y: Column, p: Column) -> Column:
    return F.sqrt(mse(y, p))


def wape(y: Column, p: Column) -> Column:
    return ieee_div(F.sum(F.abs(y - p)), F.sum(F.abs(y))) * 100


def mape(y: Column, p: Column) -> Column:
    return F.avg(F.abs(ieee_div(y - p, y))) * 100


def smape(y: Column, p: Column) -> Column:
    return F.avg(ieee_div(2 * F.abs(y - p), F.abs(y) + F.abs(p))) * 100


def pinball(y: Column, p: Column, quantile: float = 0.5) -> Column:
    e = y - p
    return F.avg(F.greatest(F.lit(quantile) * e, F.lit(quantile - 1) * e))


def hit_rate(y: Column, p: Column, threshold: float = 0.05) -> Column:
    relative = F.abs(ieee_div(y - p, y))
    hit = F.when(F.isnan(relative), F.lit(0.0)).when(relative <= threshold, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.avg(hit) * 100


def tail_mae(y: Column, p: Column, cut: Column) -> Column:
    return F.coalesce(F.avg(F.when(y >= cut, F.abs(y - p))), F.lit(0.0))


def r2(y: Column, p: Column) -> Column:
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    return 1 - ieee_div(sse, sst)
