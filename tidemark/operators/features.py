"""Calendar, lag, rolling and change features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tidemark.functions.calendar import calendar_columns
from tidemark.functions.numeric import ieee_div
from tidemark.operators.clean import to_time
from tidemark.operators.ordering import GroupShape, over_order
from tidemark.roles import Roles

# fixed values: look-backs in rows
LAGS = (1, 7, 30)
WINDOWS = (7, 30, 90)
PERIODS = (1, 7, 30)


def add_time_features(df: DataFrame, time: str = "timestamp") -> DataFrame:
    if time not in df.columns:
        return df
    made = calendar_columns(to_time(df, time))
    return df.select("*", *[c.alias(n) for n, c in made.items()])


def lag_columns(w: WindowSpec, target: str, lags: Sequence[int] = LAGS) -> dict[str, Column]:
    return {f"{target}_lag_{k}": F.lag(target, k).over(w) for k in lags}


def _summary_names(target: str, k: int) -> list[str]:
    return [f"{target}_rolling_{s}_{k}" for s in ("mean", "std", "min", "max")]


def _chunk_of(k: int, windows: Sequence[int]) -> int | None:
    """The largest other window that divides ``k``."""
    return max((b for b in windows if b < k and k % b == 0), default=None)


def rolling_columns(
    w: WindowSpec, target: str, windows: Sequence[int] = WINDOWS, safe: bool = False
) -> list[dict[str, Column]]:
    """Mean, sample std, min and max of the last k rows, in up to three steps.

    A sliding frame costs k updates per row.  A window that is a multiple of
    a shorter one (90 = 3 x 30) is therefore put together from that one's
    summaries 0, 30 and 60 rows back; counts, means and squared deviations
    merge without cancellation.

    ``safe`` ends the frame one row before the current one, so the target of
    a row never enters its own features.
    """
    direct: dict[str, Column] = {}
    lagged: dict[str, Column] = {}
    merged: dict[str, Column] = {}
    chunks = {k: _chunk_of(k, windows) for k in windows}
    for k in windows:
        if chunks[k] is None:
            over = w.rowsBetween(-k, -1) if safe else w.rowsBetween(-(k - 1), 0)
            parts = [F.avg(target), F.stddev_samp(target), F.min(target), F.max(target)]
            direct |= {n: c.over(over) for n, c in zip(_summary_names(target, k), parts)}
            if k in chunks.values():
                direct[f"__n_{k}"] = F.count(target).over(over)
    for k, b in chunks.items():
        if b is None:
            continue
        base = b
        while chunks[base] is not None:
            base = chunks[base]
        mean, std, low, high = (F.col(n) for n in _summary_names(target, base))
        n = F.col(f"__n_{base}")
        deviation = F.coalesce(std * std * (n - 1), F.lit(0.0))
        chunk = F.struct(n.alias("n"), mean.alias("mean"), deviation.alias("m2"), low.alias("low"), high.alias("high"))
        names = []
        for back in range(0, k, base):
            name = f"__chunk_{base}_{back}"
            lagged[name] = F.lag(chunk, back).over(w) if back else chunk
            names.append(name)
        merged |= dict(zip(_summary_names(target, k), _merge([F.col(c) for c in names])))
    return [step for step in (direct, lagged, merged) if step]


def _merge(chunks: list[Column]) -> list[Column]:
    def total(values: list[Column]) -> Column:
        out = values[0]
        for v in values[1:]:
            out = out + v
        return out

    counts = [F.coalesce(c["n"], F.lit(0)).cast("double") for c in chunks]
    means = [F.coalesce(c["mean"], F.lit(0.0)) for c in chunks]
    n = total(counts)
    mean = F.try_divide(total([k * m for k, m in zip(counts, means)]), n)
    spread = total([F.coalesce(c["m2"], F.lit(0.0)) + k * (m - mean) * (m - mean) for c, k, m in zip(chunks, counts, means)])
    std = F.when(n > 1, F.sqrt(F.try_divide(spread, n - 1)))
    return [mean, std, F.least(*[c["low"] for c in chunks]), F.greatest(*[c["high"] for c in chunks])]


def change_columns(w: WindowSpec, target: str, periods: Sequence[int] = PERIODS, safe: bool = False) -> dict[str, Column]:
    made = {}
    for k in periods:
        now = F.lag(target, 1).over(w) if safe else F.col(target)
        then = F.lag(target, k + 1 if safe else k).over(w)
        made[f"{target}_pct_change_{k}"] = ieee_div(now - then, then)
        made[f"{target}_diff_{k}"] = now - then
    return made


def add_lag_features(df: DataFrame, roles: Roles, lags: Sequence[int] = LAGS, **limits) -> DataFrame:
    return over_order(
        df, lambda w: lag_columns(w, roles.target, lags), order=roles.order, by=roles.by, reach=max(lags), **limits
    )


def add_rolling_features(
    df: DataFrame, roles: Roles, windows: Sequence[int] = WINDOWS, safe: bool = False, **limits
) -> DataFrame:
    return over_order(
        df,
        lambda w: rolling_columns(w, roles.target, windows, safe),
        order=roles.order,
        by=roles.by,
        reach=max(windows),
        **limits,
    )


def add_change_features(
    df: DataFrame, roles: Roles, periods: Sequence[int] = PERIODS, safe: bool = False, **limits
) -> DataFrame:
    return over_order(
        df,
        lambda w: change_columns(w, roles.target, periods, safe),
        order=roles.order,
        by=roles.by,
        reach=max(periods) + 1,
        **limits,
    )


def create_all_features(
    df: DataFrame,
    roles: Roles,
    safe: bool = False,
    rows_per_range: int | None = None,
    shape: GroupShape | None = None,
) -> DataFrame:
    """12 calendar, 3 lag, 12 rolling and 6 change columns in one shuffle and one sort."""

    def columns(w: WindowSpec) -> list[dict[str, Column]]:
        first, *rest = rolling_columns(w, roles.target, safe=safe)
        return [{**lag_columns(w, roles.target), **first, **change_columns(w, roles.target, safe=safe)}, *rest]

    names = [
        *[f"{roles.target}_lag_{k}" for k in LAGS],
        *[n for k in WINDOWS for n in _summary_names(roles.target, k)],
        *[f"{roles.target}_{kind}_{k}" for k in PERIODS for kind in ("pct_change", "diff")],
    ]
    timed = add_time_features(df, roles.time)
    reach = max(*LAGS, *WINDOWS, *PERIODS) + 1
    made = over_order(
        timed, columns, order=roles.order, by=roles.by, reach=reach, rows_per_range=rows_per_range, shape=shape
    )
    return made.select(*timed.columns, *names)
