"""As-of join: for each left row the last right row at or before its time, per key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordering import ROWS_PER_RANGE, RangeCut, ascending, group_shape, range_count

_RANGE = "__range"


def asof_join(
    left: DataFrame,
    right: DataFrame,
    time: str,
    by: Sequence[str],
    take: Sequence[str],
    tie: Sequence[str] = (),
    right_tie: Sequence[str] = (),
    tolerance: str | None = None,
    strict: bool = False,
    suffix: str = "_asof",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Left rows plus ``<time><suffix>`` and ``<column><suffix>`` for every column in ``take``.

    NULL times and keys match nothing, on either side; such left rows stay.
    ``strict`` looks only before the left time; ``tolerance`` is an interval
    such as ``'1 day'``.  Both sides go through one shuffle as one sorted
    stream.  A key too large for one task is cut into ranges, each of which
    starts from the last right row before it.
    """
    payload_type = F.struct(F.col(time).alias("t"), *[F.col(c) for c in take])
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    width = max(len(tie), len(right_tie))
    order = [time, "__side", *[f"__tie{i}" for i in range(width)]]

    kinds = [left.schema[tie[i]].dataType if i < len(tie) else right.schema[right_tie[i]].dataType for i in range(width)]

    def ties(names: Sequence[str]):
        cells = [F.col(names[i]) if i < len(names) else F.lit(None) for i in range(width)]
        return [c.cast(k).alias(f"__tie{i}") for i, (c, k) in enumerate(zip(cells, kinds))]

    right_first = 1 if strict else 0
    l = left.select(*by, time, F.lit(1 - right_first).alias("__side"), *ties(tie), F.struct(*left.columns).alias("__left"))
    known = reduce(and_, [F.col(c).isNotNull() for c in (time, *by)])
    r = right.where(known).select(*by, time, F.lit(right_first).alias("__side"), *ties(right_tie), payload_type.alias("__right"))
    both = l.unionByName(r, allowMissingColumns=True)

    shape = group_shape(both, by)
    cut = None
    if shape.largest > rows_per_range:
        cut, _ = RangeCut.choose(both, by, order, shape.rows, range_count(shape.rows, rows_per_range))
    latest = F.last("__right", ignorenulls=True)
    if cut is None or not cut.points:
        w = Window.partitionBy(*by).orderBy(*ascending(order)) if by else Window.partitionBy(F.lit(0)).orderBy(*ascending(order))
        found = both.withColumn("__found", latest.over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        found = _over_ranges(both, cut, by, order, latest)

    hit = F.col("__found")
    near = reduce(and_, [F.col(f"__left.{c}").isNotNull() for c in (time, *by)])
    if tolerance:
        near = near & (F.col(f"__left.{time}") - hit["t"] <= F.expr(f"INTERVAL {tolerance}"))
    taken = [F.when(near, hit["t"]).alias(f"{time}{suffix}"), *[F.when(near, hit[c]).alias(f"{c}{suffix}") for c in take]]
    return found.where(F.col("__left").isNotNull()).select("__left.*", *taken)


def _over_ranges(both: DataFrame, cut: RangeCut, by, order, latest) -> DataFrame:
    ranged = both.withColumn(_RANGE, cut.range_of())
    runs, run = [], 0
    for i in range(len(cut.points)):
        run += i > 0 and cut.group_of(i) != cut.group_of(i - 1)
        runs.append(run)
    # last right row of each range for the group at its upper end: one row per range
    at = F.col(_RANGE)
    tail = ranged.where(F.col("__right").isNotNull() & cut.same_group(cut.cut(at)))
    last = tail.groupBy(_RANGE).agg(F.max_by("__right", RangeCut.key((), order)).alias("__tail"))
    ends = both.sparkSession.createDataFrame(list(enumerate(runs)), f"{_RANGE} int, __run int")
    carried = F.last("__tail", ignorenulls=True).over(
        Window.partitionBy("__run").orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, 0)
    )
    carry = ends.join(last, _RANGE, "left").select((F.col(_RANGE) + 1).alias("__to"), carried.alias("__carry"))
    w = Window.partitionBy(_RANGE, *by).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    inherits = cut.same_group(cut.cut(at - 1))
    local = ranged.withColumn("__here", latest.over(w)).join(F.broadcast(carry), at == F.col("__to"), "left")
    return local.withColumn("__found", F.coalesce("__here", F.when(inherits, F.col("__carry"))))
