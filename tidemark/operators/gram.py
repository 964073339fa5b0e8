"""Correlation of many columns by masked matrix products: one pass over the rows, whatever the number of pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_COLUMNS = 512  # columns on each side of one matrix; seven matrices of this size are what a task holds
MERGED_TASKS = 256  # task results that are merged at a time
FLAT = 1e-13  # a spread of this part of the level is rounding
STATS = ("n", "ma", "mb", "aa", "bb", "ab", "wild")
SCHEMA = "task int, a int, b int, " + ", ".join(f"{s} double" for s in STATS)


def _centre(x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Values less the column's median, 0 where not finite; where they are finite, where infinite; the medians."""
    fine, wild = np.isfinite(x), np.isinf(x)
    mid = np.zeros(x.shape[1])
    for j in range(x.shape[1]):
        if fine[:, j].any():
            mid[j] = np.median(x[fine[:, j], j])
    return np.where(fine, x - mid, 0.0), fine.astype(float), wild.astype(float), mid


def _moments(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Counts, means and centred products of each column of ``x`` with each of ``y`` over rows that have both."""
    with np.errstate(invalid="ignore", over="ignore"):
        x, in_x, wild_x, mid_x = _centre(x)
        y, in_y, wild_y, mid_y = _centre(y)
        n = in_x.T @ in_y
        of = np.maximum(n, 1)
        sa, sb = x.T @ in_y, in_x.T @ y
        qa, qb = (x * x).T @ in_y, in_x.T @ (y * y)
        aa, bb = qa - sa * sa / of, qb - sb * sb / of
        return {
            "n": n,
            "ma": mid_x[:, None] + sa / of,
            "mb": mid_y[None, :] + sb / of,
            "aa": np.where(aa > FLAT * qa, aa, 0.0),
            "bb": np.where(bb > FLAT * qb, bb, 0.0),
            "ab": x.T @ y - sa * sb / of,
            "wild": wild_x.T @ (in_y + wild_y) + in_x.T @ wild_y,
        }


def _add(s, t):
    """Moments of two sets of rows from the moments of each."""
    n = s["n"] + t["n"]
    of = np.maximum(n, 1)
    da, db, both = t["ma"] - s["ma"], t["mb"] - s["mb"], s["n"] * t["n"] / of
    return {
        "n": n,
        "ma": s["ma"] + da * t["n"] / of,
        "mb": s["mb"] + db * t["n"] / of,
        "aa": s["aa"] + t["aa"] + da * da * both,
        "bb": s["bb"] + t["bb"] + db * db * both,
        "ab": s["ab"] + t["ab"] + da * db * both,
        "wild": s["wild"] + t["wild"],
    }


def _add_column(s: Column, t: Column) -> Column:
    """The same for two structs."""
    n = s["n"] + t["n"]
    of = F.greatest(n, F.lit(1.0))
    da, db, both = t["ma"] - s["ma"], t["mb"] - s["mb"], s["n"] * t["n"] / of
    return F.struct(
        n.alias("n"),
        (s["ma"] + da * t["n"] / of).alias("ma"),
        (s["mb"] + db * t["n"] / of).alias("mb"),
        (s["aa"] + t["aa"] + da * da * both).alias("aa"),
        (s["bb"] + t["bb"] + db * db * both).alias("bb"),
        (s["ab"] + t["ab"] + da * db * both).alias("ab"),
        (s["wild"] + t["wild"]).alias("wild"),
    )


def _merge(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Moments per ``by``, merged in the order of the tasks so that a repeated job gives the same digits."""
    ordered = F.array_sort(F.collect_list(F.struct("task", F.struct(*STATS).alias("m"))))
    merged = F.aggregate(
        F.slice("parts", F.lit(2), F.greatest(F.size("parts") - 1, F.lit(0))), F.col("parts")[0]["m"], lambda s, t: _add_column(s, t["m"])
    )
    return parts.groupBy(*by).agg(ordered.alias("parts")).select(*by, merged.alias("m")).select(*by, "m.*")


def _block(df: DataFrame, left: Sequence[str], right: Sequence[str], first: int, second: int) -> DataFrame:
    """(a, b, corr) by column number for a < b, of the columns ``left`` numbered from ``first`` and ``right`` from ``second``."""
    own = first == second

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                table = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
                x = table[:, : len(left)]
                now = _moments(x, x if own else table[:, len(left) :])
                total = now if total is None else _add(total, now)
        if total is None:
            return
        a, b = np.indices(total["n"].shape)
        keep = (total["n"] + total["wild"] > 0) & (a + first < b + second)
        stats = {s: total[s][keep] for s in STATS}
        task = np.full(keep.sum(), TaskContext.get().partitionId(), np.int32)
        cells = {"task": task, "a": (a[keep] + first).astype(np.int32), "b": (b[keep] + second).astype(np.int32), **stats}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in cells.items()})

    wanted = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(left if own else [*left, *right])]
    parts = df.select(*wanted).mapInArrow(run, SCHEMA)
    grouped = _merge(parts.withColumn("part", F.expr(f"task div {MERGED_TASKS}")), ["a", "b", "part"])
    m = _merge(grouped.withColumnRenamed("part", "task"), ["a", "b"])

    def flat(square: str, mean: str) -> Column:
        return F.sqrt(F.col(square) / F.col("n")) <= FLAT * F.abs(F.col(mean))

    corr = F.try_divide(F.col("ab"), F.sqrt("aa") * F.sqrt("bb"))
    return m.select(
        "a", "b", F.when(F.col("wild") > 0, F.lit(float("nan"))).when(~flat("aa", "ma") & ~flat("bb", "mb"), corr).alias("corr")
    )


def gram_correlation(df: DataFrame, columns: Sequence[str], block: int = BLOCK_COLUMNS) -> DataFrame:
    """(a, b, corr) for each unordered pair of ``columns``, over the rows where both are present.

    NULL and NaN are missing.  A pair that meets an infinite value has a NaN correlation; a pair without rows, or with a side that is
    constant on them, has NULL.  Each task adds up matrix products of its Arrow batches, centred, and leaves one row per
    pair; these are merged in two levels.  Up to ``block`` columns take one pass over the rows, more take one for each pair
    of blocks, so a task's memory does not grow with the columns.
    """
    spark = df.sparkSession
    names = F.array(*[F.lit(c) for c in columns])
    starts = range(0, len(columns), block)
    found = None
    for i in starts:
        for j in range(i, len(columns), block):
            one = _block(df, columns[i : i + block], columns[j : j + block], i, j)
            found = one if found is None else found.unionByName(one)
    # pairs that share no row are missing above
    k = len(columns)
    pairs = spark.range(k - 1).selectExpr("int(id) as a", f"explode(sequence(int(id) + 1, {k - 1})) as b")
    whole = pairs.join(found, ["a", "b"], "left")
    return whole.select(F.get(names, F.col("a")).alias("a"), F.get(names, F.col("b")).alias("b"), "corr")
