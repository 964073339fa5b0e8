"""Time-ordered splits as columns or long (row, fold, role) tables.

All of them are arithmetic on the row's position, so no fold is ever
collected and no range join is needed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import GroupShape, positions

RANDOM_SEED = 42


def _positioned(df: DataFrame, order: Sequence[str], rows_per_range: int | None) -> tuple[DataFrame, int]:
    n = df.count()
    return positions(df, order, rows_per_range=rows_per_range, shape=GroupShape(n, 1, n)), n


def ratio_split(
    df: DataFrame, order: Sequence[str], train: float = 0.6, val: float = 0.2, rows_per_range: int | None = None
) -> DataFrame:
    """Column ``split``; what the ratios leave over goes to test."""
    placed, n = _positioned(df, order, rows_per_range)
    train_end, val_end = int(n * train), int(n * (train + val))
    name = F.when(F.col("pos") < train_end, "train").when(F.col("pos") < val_end, "val").otherwise("test")
    return placed.withColumn("split", name)


def date_split(
    df: DataFrame,
    time: str,
    train: tuple[str | None, str | None] = (None, None),
    val: tuple[str | None, str | None] = (None, None),
    test: tuple[str | None, str | None] = (None, None),
) -> DataFrame:
    """One output row per (row, split) for half-open date ranges.

    Train is open where a bound is missing; val and test need both bounds.
    The ranges may overlap.
    """
    c = F.col(time)

    def inside(bounds: tuple[str | None, str | None]) -> Column:
        start, end = bounds
        cond = F.lit(True)
        if start:
            cond = cond & (c >= F.lit(start).cast("timestamp_ntz"))
        if end:
            cond = cond & (c < F.lit(end).cast("timestamp_ntz"))
        return cond

    named = {"train": inside(train)}
    named |= {k: inside(b) for k, b in (("val", val), ("test", test)) if all(b)}
    rows = df
    if any(train):
        # as a plain filter the ranges reach the scan
        kept = reduce(lambda a, b: a | b, named.values())
        rows = df.where(kept)
    tagged = F.array_compact(F.array(*[F.when(cond, F.lit(k)) for k, cond in named.items()]))
    return rows.select("*", F.explode(tagged).alias("split"))


def _long(placed: DataFrame, folds: Column) -> DataFrame:
    return placed.select("*", F.inline(folds))


def fold_bounds(n: int, folds: int, fold: int) -> tuple[int, int]:
    """First and end position of a fold's validation rows; everything before is training."""
    size = n // (folds + 1)
    if size == 0:
        raise ValueError(f"cannot make {folds} folds from {n} rows")
    start = n - folds * size + fold * size
    return start, start + size


def expanding_folds(
    df: DataFrame, order: Sequence[str], folds: int = 5, rows_per_range: int | None = None
) -> DataFrame:
    """Expanding-window CV, long form (row, fold, role)."""
    placed, n = _positioned(df, order, rows_per_range)
    pos = F.col("pos")

    def member(i: int) -> Column:
        start, end = fold_bounds(n, folds, i)
        role = F.when(pos < start, "train").when(pos < end, "val")
        return F.struct(F.lit(i).alias("fold"), role.alias("role"))

    return _long(placed, F.filter(F.array(*[member(i) for i in range(folds)]), lambda m: m["role"].isNotNull()))


def fold_ranges(members: DataFrame, time: str) -> DataFrame:
    return members.groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min(time).alias("first_time"), F.max(time).alias("last_time")
    )


def period_count(n: int, train: int, val: int, step: int) -> int:
    return max(0, (n - train - val) // step + 1)


def walk_forward(
    df: DataFrame,
    order: Sequence[str],
    train: int = 2000,
    val: int = 500,
    step: int = 100,
    roles: Sequence[str] = ("train", "val"),
    rows_per_range: int | None = None,
) -> DataFrame:
    """Sliding windows, long form (row, period, role); periods count from 1.

    A row lies in a run of consecutive periods whose ends follow from its
    position.
    """
    placed, n = _positioned(df, order, rows_per_range)
    periods = period_count(n, train, val, step)
    pos = F.col("pos")

    def run(offset: int, width: int) -> Column:
        first = F.greatest(F.ceil((pos - (offset + width) + 1) / step), F.lit(0)).cast("int")
        last = F.least(F.floor((pos - offset) / step), F.lit(periods - 1)).cast("int")
        return F.when(first <= last, F.sequence(first + 1, last + 1)).otherwise(F.array().cast("array<int>"))

    def tagged(role: str) -> Column:
        span = run(0, train) if role == "train" else run(train, val)
        return F.transform(span, lambda p: F.struct(p.alias("period"), F.lit(role).alias("role")))

    members = [tagged(r) for r in roles]
    return _long(placed, F.concat(*members) if len(members) > 1 else members[0])


def contiguous_folds(
    df: DataFrame, order: Sequence[str], folds: int = 5, rows_per_range: int | None = None
) -> DataFrame:
    """Unshuffled k-fold: column ``fold``; the first n % k folds hold one row more."""
    placed, n = _positioned(df, order, rows_per_range)
    size, larger = divmod(n, folds)
    edge = larger * (size + 1)
    pos = F.col("pos")
    later = F.lit(larger) + F.floor((pos - edge) / max(size, 1))
    return placed.withColumn("fold", F.when(pos < edge, F.floor(pos / (size + 1))).otherwise(later).cast("int"))


def random_split(
    df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = RANDOM_SEED, rows_per_range: int | None = None
) -> DataFrame:
    """Repeatable shuffled split of exact size: rows ordered by the MD5 of their key and the seed, joined by ``|``."""
    told = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    hashed = df.withColumn("__h", F.md5(told.cast("binary")))
    placed, n = _positioned(hashed, ["__h", *key], rows_per_range)
    held_out = -int(-n * test // 1)
    return placed.withColumn("split", F.when(F.col("pos") < held_out, "test").otherwise("train")).drop("__h", "pos")


def first_rows(df: DataFrame, order: Sequence[str], n: int = 100) -> DataFrame:
    return df.orderBy(*[F.col(c).asc_nulls_last() for c in order]).limit(n)
