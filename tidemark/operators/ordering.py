"""Total orders on data of any size and any skew.

An ordered window over a whole table, or over one very frequent entity, runs
in a single task.  The operators here cut the order (group, time, tie) into
contiguous *ranges* instead, so a frequent group spreads over many tasks:

1. a sample of the keys gives the cut points, which enter the plan as a
   literal.  The range of a row is then a pure function of the row, and a
   recomputed task always yields the same rows;
2. one aggregation over the key columns gives per-range totals (one row per
   range, never more than ``MAX_RANGES``), from which the carry into each
   range follows;
3. the rows are shuffled once, by range.

Groups that fit a task (their size is counted first) keep the plain window.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.functions.numeric import all_of

# largest group that one task sorts for a window, and whose values one task counts
ROWS_PER_RANGE = 250_000
VALUES_PER_TASK = 1_000_000
MAX_RANGES = 16_384
SAMPLES_PER_RANGE = 20

_RANGE, _OWN = "__range", "__own"
_JSON = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "ignoreNullFields": "false",
}


@dataclass(frozen=True)
class GroupShape:
    """How many rows and groups a table has, and how large its largest group is."""

    rows: int
    groups: int
    largest: int


def group_shape(df: DataFrame, by: Sequence[str] = ()) -> GroupShape:
    if not by:
        n = df.count()
        return GroupShape(n, 1, n)
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n"), F.count(F.lit(1)), F.max("n")).first()
    return GroupShape(row[0] or 0, row[1], row[2] or 0)


def ascending(order: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in order]


def ordered(by: Sequence[str], order: Sequence[str], *more: str) -> WindowSpec:
    keys = [*more, *by]
    base = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    return base.orderBy(*ascending(order))


class RangeCut:
    """Cut points of the order (by, order) as a literal inside the plan."""

    def __init__(self, by: Sequence[str], order: Sequence[str], key_type: T.StructType, points: list[str]):
        self.by, self.order, self.key_type, self.points = tuple(by), tuple(order), key_type, points

    @staticmethod
    def key(by: Sequence[str], order: Sequence[str]) -> Column:
        fields = [F.col(c).alias(f"g{i}") for i, c in enumerate(by)]
        for i, c in enumerate(order):
            fields += [F.col(c).isNull().alias(f"n{i}"), F.col(c).alias(f"k{i}")]
        return F.struct(*fields)

    @classmethod
    def choose(cls, df: DataFrame, by: Sequence[str], order: Sequence[str], rows: int, ranges: int) -> tuple["RangeCut", list[str]]:
        """Cut points plus, per cut, the sample key one step before it."""
        keys = df.select(cls.key(by, order).alias("key"))
        key_type = keys.schema["key"].dataType
        wanted = ranges * SAMPLES_PER_RANGE
        fraction = min(1.0, 1.1 * wanted / max(rows, 1))
        sample = keys if fraction >= 1 else keys.sample(fraction, seed=17)
        texts = [r[0] for r in sample.orderBy("key").select(F.to_json("key", _JSON)).collect()]
        points, before = [], []
        for i in range(1, ranges):
            at = i * len(texts) // ranges
            step = max(1, len(texts) // (ranges * SAMPLES_PER_RANGE))
            if at - step >= 0 and (not points or points[-1] != texts[at]):
                points.append(texts[at])
                before.append(texts[at - step])
        return cls(by, order, key_type, points), before

    def literal(self, texts: list[str | None]) -> Column:
        body = "[" + ",".join("null" if t is None else t for t in texts) + "]"
        return F.from_json(F.lit(body), T.ArrayType(self.key_type), _JSON)

    def range_of(self) -> Column:
        """Number of cut points at or below the row's key, by binary search."""
        n = len(self.points)
        if n == 0:
            return F.lit(0)
        cuts = self.literal(self.points)
        halves = [1 << i for i in reversed(range(n.bit_length()))]
        steps = F.array(*[F.lit(s) for s in halves])

        def search(key: Column) -> Column:
            return F.aggregate(
                steps,
                F.lit(0),
                lambda at, s: at + F.when(F.get(cuts, at + s - 1) <= key, s).otherwise(F.lit(0)),
            )

        return F.get(F.transform(F.array(self.key(self.by, self.order)), search), 0)

    def same_group(self, bound: Column) -> Column:
        if not self.by:
            return bound.isNotNull()
        return bound.isNotNull() & all_of([F.col(c).eqNullSafe(bound[f"g{i}"]) for i, c in enumerate(self.by)])

    def group_of(self, at: int) -> tuple:
        point = json.loads(self.points[at])
        return tuple(json.dumps(point[f"g{i}"]) for i in range(len(self.by)))

    def cut(self, at: Column) -> Column:
        """The cut point number ``at`` (the upper end of range ``at``), NULL past the end."""
        return F.get(self.literal(self.points), at)

    def carries(self, tails: dict[int, tuple], width: int) -> list[list]:
        """Per measure, what each range inherits for the group at its lower end."""
        carry = [[0] * width]
        for i in range(len(self.points)):
            tail = tails.get(i, (0,) * width)
            spans = i > 0 and self.group_of(i - 1) == self.group_of(i)
            carry.append([t + (c if spans else 0) for t, c in zip(tail, carry[-1])])
        return [[row[m] for row in carry] for m in range(width)]


def long_array(values: list[int]) -> Column:
    return F.from_json(F.lit(json.dumps([int(v or 0) for v in values])), T.ArrayType(T.LongType()))


def range_count(rows: int, rows_per_range: int) -> int:
    return max(1, min(MAX_RANGES, math.ceil(rows / rows_per_range)))


def positions(
    df: DataFrame,
    order: Sequence[str],
    by: Sequence[str] = (),
    name: str = "pos",
    rows_per_range: int | None = None,
    shape: GroupShape | None = None,
) -> DataFrame:
    """0-based position of every row in the order, per group if ``by`` is given."""
    rows_per_range = rows_per_range or ROWS_PER_RANGE
    shape = shape or group_shape(df, by)
    if shape.largest <= rows_per_range:
        return df.withColumn(name, F.row_number().over(ordered(by, order)).cast("long") - 1)
    cut, _ = RangeCut.choose(df, by, order, shape.rows, range_count(shape.rows, rows_per_range))
    if not cut.points:
        return df.withColumn(name, F.row_number().over(ordered(by, order)).cast("long") - 1)
    ranged = df.withColumn(_RANGE, cut.range_of())
    tail = F.count(F.when(cut.same_group(cut.cut(F.col(_RANGE))), 1))
    tails = {r[0]: (r[1],) for r in ranged.groupBy(_RANGE).agg(tail.alias("tail")).collect()}
    carry = long_array(cut.carries(tails, 1)[0])
    inherits = cut.same_group(cut.cut(F.col(_RANGE) - 1)) if by else F.lit(True)
    here = F.row_number().over(ordered(by, order, _RANGE)).cast("long") - 1
    return ranged.withColumn(name, here + F.when(inherits, F.get(carry, F.col(_RANGE))).otherwise(F.lit(0))).drop(_RANGE)


def over_order(
    df: DataFrame,
    columns: Callable[[WindowSpec], dict[str, Column] | list[dict[str, Column]]],
    *,
    order: Sequence[str],
    by: Sequence[str] = (),
    reach: int,
    rows_per_range: int | None = None,
    shape: GroupShape | None = None,
) -> DataFrame:
    """Add row-based window columns that look back at most ``reach`` rows.

    ``columns`` may give several steps, where a later step uses columns of an
    earlier one; names starting with ``__`` are dropped at the end.  All steps
    share one shuffle and one sort.

    Beyond ``rows_per_range`` rows per group, each range also receives the
    rows just before it (at least ``reach`` of them, same group), which are
    dropped again after the window.
    """

    rows_per_range = rows_per_range or ROWS_PER_RANGE

    def add(rows: DataFrame, window: WindowSpec) -> DataFrame:
        steps = columns(window)
        names = []
        for made in [steps] if isinstance(steps, dict) else steps:
            names += made
            rows = rows.select("*", *[c.alias(n) for n, c in made.items()])
        return rows.drop(*[n for n in names if n.startswith("__")])

    def plain() -> DataFrame:
        return add(df, ordered(by, order))

    shape = shape or group_shape(df, by)
    if shape.largest <= rows_per_range:
        return plain()
    cut, before = RangeCut.choose(df, by, order, shape.rows, range_count(shape.rows, rows_per_range))
    if not cut.points:
        return plain()
    cut, halo = _with_enough_halo(df, cut, before, reach)
    if not cut.points:
        return plain()
    key = RangeCut.key(by, order)
    home = F.col("__home")
    start = F.get(cut.literal(halo), home)
    lends = cut.same_group(cut.cut(home)) & (start.isNull() | (key >= start))
    spread = df.withColumn("__home", cut.range_of()).withColumn(
        _RANGE, F.explode(F.when(lends, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    out = add(spread.withColumn(_OWN, F.col(_RANGE) == home), ordered(by, order, _RANGE))
    return out.where(_OWN).drop("__home", _RANGE, _OWN)


def _with_enough_halo(df: DataFrame, cut: RangeCut, before: list[str], reach: int) -> tuple[RangeCut, list[str | None]]:
    """Merge ranges shorter than ``reach``; fix the halo start of each remaining cut.

    A NULL start means "the whole range before the cut".
    """
    key = RangeCut.key(cut.by, cut.order)
    at = F.col(_RANGE)
    near = cut.same_group(cut.cut(at)) & (key >= F.get(cut.literal(before), at))
    sizes = {
        r[0]: (r[1], r[2])
        for r in df.withColumn(_RANGE, cut.range_of())
        .groupBy(_RANGE)
        .agg(F.count(F.lit(1)), F.count(F.when(near, 1)))
        .collect()
    }
    points, starts, held = [], [], 0
    for i, point in enumerate(cut.points):
        rows, lent = sizes.get(i, (0, 0))
        held += rows
        if held >= reach:
            points.append(point)
            starts.append(before[i] if lent >= reach else None)
            held = 0
    return RangeCut(cut.by, cut.order, cut.key_type, points), starts


BROADCAST_GROUPS = 50_000


def small_side(df: DataFrame, groups: int) -> DataFrame:
    """Broadcast hint for a per-group table of a counted size; beyond it Spark joins by key."""
    return F.broadcast(df) if groups <= BROADCAST_GROUPS else df


def join_groups(df: DataFrame, per_group: DataFrame, by: Sequence[str], groups: int) -> DataFrame:
    """Add a per-group table's columns to each row; NULL keys match each other."""
    keyed = small_side(per_group.withColumnsRenamed({c: f"__by_{c}" for c in by}), groups)
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    return df.join(keyed, same).drop(*[f"__by_{c}" for c in by])


def cumulative_counts(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    measures: dict[str, Column],
    rows_per_range: int | None = None,
) -> DataFrame:
    """One row per (by, value): each measure's sum, its running sum ``cum_*`` and its group total ``total_*``.

    ``measures`` are aggregate expressions giving integers.  The rows are
    counted per value before any shuffle, so a frequent value costs nothing.
    """
    rows_per_range = rows_per_range or VALUES_PER_TASK
    names = list(measures)
    sums = [c.alias(n) for n, c in measures.items()]

    def running(spec: WindowSpec) -> list[Column]:
        frame = spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return [F.sum(n).over(frame).cast("long").alias(f"cum_{n}") for n in names]

    def plain() -> DataFrame:
        group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
        totals = [F.sum(n).over(group).cast("long").alias(f"total_{n}") for n in names]
        return df.groupBy(*by, value).agg(*sums).select("*", *running(ordered(by, [value])), *totals)

    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(value).alias("values"))
    row = sizes.agg(F.sum("rows"), F.max(F.least("rows", F.col("values") * 1.2)), F.count(F.lit(1))).first()
    if row[0] is None or row[1] <= rows_per_range:
        return plain()
    cut, _ = RangeCut.choose(df, by, [value], row[0], range_count(row[0], rows_per_range))
    if not cut.points:
        return plain()
    ranged = df.withColumn(_RANGE, cut.range_of())
    tail_rows = ranged.where(cut.same_group(cut.cut(F.col(_RANGE))))
    tails = {r[0]: tuple(r[1:]) for r in tail_rows.groupBy(_RANGE).agg(*sums).collect()}
    counts = ranged.groupBy(_RANGE, *by, value).agg(*sums)
    inherits = cut.same_group(cut.cut(F.col(_RANGE) - 1)) if by else F.lit(True)
    local = counts.select("*", *running(ordered(by, [value], _RANGE)))
    for name, carry in zip(names, cut.carries(tails, len(names))):
        add = F.get(long_array(carry), F.col(_RANGE))
        local = local.withColumn(f"cum_{name}", F.col(f"cum_{name}") + F.when(inherits, add).otherwise(F.lit(0)))
    totals = df.groupBy(*by).agg(*[c.cast("long").alias(f"total_{n}") for n, c in measures.items()])
    if by:
        return join_groups(local, totals, by, row[2]).drop(_RANGE)
    whole = totals.first()
    return local.select("*", *[F.lit(whole[f"total_{n}"]).alias(f"total_{n}") for n in names]).drop(_RANGE)
