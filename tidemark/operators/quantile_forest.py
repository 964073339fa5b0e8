"""Quantiles from a random forest (Meinshausen, 2006).

The forest is an ordinary one; a scored row's quantile is the weighted
quantile of the training targets that share its leaves.  The targets are cut
in order into cells of bounded size.  A table of the training rows up to each
cell in each leaf goes to the tasks, so a scored row finds the cell that holds
its quantile by bisection where it is read.  Then it meets only the training
rows of that cell, and bisects again.  So what moves is a row per scored row
and quantile and the training rows themselves, never rows x trees x values,
and the result is still exact.

A forest of too many leaves for such a table, and scored rows whose key comes
more than once, select digit by digit instead: the distinct targets are
numbered in order, and every leaf holds its weights by number, for each level
of digits to the base ``CELLS``.  At a level a row adds up at most ``CELLS``
weights of each of its leaves, those below the digits it has chosen so far,
and goes down into the one cell that holds the quantile.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.operators.forest import ForestParams, fit_forest
from tidemark.operators.ordering import GroupShape, cumulative_counts, positions
from tidemark.operators.preprocess import FittedColumns
from tidemark.session import materialize

CELLS = 64
EPSILON = 1e-12
TABLE = 2**22  # entries of the table that goes to the tasks at most
ROWS_PER_CELL = 1_000  # training rows of a cell, where the table has room for so many cells
SCORED_PER_GROUP = 20_000
MIN_CELLS = 16  # a table with fewer is not worth its broadcast


def _leaves(model: PipelineModel, df: DataFrame, keep: Sequence[str]) -> DataFrame:
    """(keep..., tree, leaf), one row per tree."""
    leaf = vector_to_array("leaf")
    return model.transform(df).select(*keep, F.posexplode(leaf).alias("tree", "leaf")).withColumn("leaf", F.col("leaf").cast("int"))


def _leaf_array(model: PipelineModel, df: DataFrame, keep: Sequence[Column]) -> DataFrame:
    """(keep..., leaf): the row's leaf in every tree."""
    return model.transform(df).select(*keep, F.transform(vector_to_array("leaf"), lambda x: x.cast("int")).alias("leaf"))


@dataclass(frozen=True)
class CellTable:
    """The training rows up to each cell in each leaf; leaves are numbered through all trees."""

    upto: np.ndarray  # leaf, cell
    offsets: np.ndarray  # the first leaf of each tree

    @property
    def share(self) -> np.ndarray:
        """The weight of one training row, by leaf."""
        return 1.0 / (np.maximum(self.upto[:, -1], 1).astype(np.float64) * len(self.offsets))


def _matrix(lists: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    flat = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(-1, width).astype(np.int64)


def _reaches(weight: np.ndarray, q: float | np.ndarray) -> np.ndarray:
    return (weight >= q - EPSILON) & (weight > 0)


def _bisect(rows: int, last: int, reached: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """For each row the first of 0 .. last that reaches its quantile."""
    low, high = np.zeros(rows, np.int64), np.full(rows, last, np.int64)
    while (low < high).any():
        middle = (low + high) // 2
        ok = reached(middle)
        low, high = np.where(ok, low, np.minimum(middle + 1, high)), np.where(ok, middle, high)
    return low


def _find_cells(shared: Broadcast, quantiles: Sequence[float]) -> Callable:
    """Adds to (key, leaf) the cell of each quantile and the weight before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        share, width = table.share, table.upto.shape[1]
        flat = table.upto.reshape(-1)
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf = _matrix(batch.column(1), len(table.offsets)) + table.offsets
            weight = [share[leaf[:, t]] for t in range(leaf.shape[1])]

            def below(cell: np.ndarray) -> np.ndarray:
                """The weight of the cells up to this one."""
                total = np.zeros(len(leaf))
                for t, w in enumerate(weight):
                    total += flat[leaf[:, t] * width + cell] * w
                return total

            cells = [_bisect(len(leaf), width - 1, lambda c, q=q: _reaches(below(c), q)) for q in quantiles]
            before = [np.where(c > 0, below(np.maximum(c - 1, 0)), 0.0) for c in cells]
            at = pa.array(np.arange(len(leaf) + 1, dtype=np.int32) * len(quantiles))
            found = (np.stack(cells, 1).astype(np.int32), np.stack(before, 1))
            lists = [pa.ListArray.from_arrays(at, pa.array(x.reshape(-1))) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=["key", "leaf", "cells", "before"])

    return run


def _find_values(shared: Broadcast, schema: pa.Schema) -> Callable:
    """The value of each scored row among the training rows of its cell."""

    def run(scored: pa.Table, trained: pa.Table) -> pa.Table:
        if not scored.num_rows or not trained.num_rows:
            return schema.empty_table()
        values, rank = np.unique(trained["y"].to_numpy(), return_inverse=True)
        chosen = np.zeros(scored.num_rows, np.int64)
        if len(values) > 1:
            table, m = shared.value, len(values)
            trees = len(table.offsets)
            share = table.share
            held = _matrix(trained["leaf"], trees)
            leaf = _matrix(scored["leaf"], trees)
            q, before = (scored[c].to_numpy() for c in ("q", "before"))
            codes = [np.sort(held[:, t] * m + rank) for t in range(trees)]
            first = [np.searchsorted(codes[t], leaf[:, t] * m) for t in range(trees)]
            weight = [share[leaf[:, t] + table.offsets[t]] for t in range(trees)]

            def reached(r: np.ndarray) -> np.ndarray:
                total = before.copy()
                for t in range(trees):
                    total += (np.searchsorted(codes[t], leaf[:, t] * m + r, side="right") - first[t]) * weight[t]
                return _reaches(total, q)

            chosen = _bisect(len(leaf), m - 1, reached)
        return pa.Table.from_arrays([scored["key"], scored["q"], pa.chunked_array([pa.array(values[chosen])])], names=["key", "q", "y"]).cast(schema)

    return run


@dataclass(frozen=True)
class QuantileForest:
    model: PipelineModel
    quantiles: tuple[float, ...]
    trained: DataFrame  # cell, y, leaf: the training rows and their leaf in every tree
    values: DataFrame  # cell, y: the distinct targets; a cell with an odd number has one
    distinct: int  # how many of them
    depth: int
    table: CellTable | None  # none for too many leaves

    def predict(self, df: DataFrame, key: str) -> DataFrame:
        """(key, quantiles) with a map quantile -> value."""
        found = self._values(df, key, self.quantiles)
        entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct("q", "y"))))
        return found.groupBy(key).agg(entries.alias("quantiles"))

    def predict_quantile(self, df: DataFrame, key: str, quantile: float) -> DataFrame:
        if quantile not in self.quantiles:
            raise ValueError(f"quantile {quantile} was not fitted")
        return self._values(df, key, (quantile,)).select(key, F.col("y").alias("y_pred"))

    def candidates(self, leaves: DataFrame, chosen: DataFrame, key: str, level: int) -> DataFrame:
        """The weights that a level looks at: at most ``CELLS`` for each leaf of a row and quantile."""
        return leaves.join(chosen, key).join(self.weights(level), ["tree", "leaf", "parent"])

    @cached_property
    def lowest(self) -> DataFrame:
        """(tree, leaf, cell, y, w): the weight of each numbered target."""
        numbered = positions(self.values.select("y"), ["y"], name="cell", shape=GroupShape(self.distinct, 1, self.distinct))
        rows = self.trained.select("y", F.posexplode("leaf").alias("tree", "leaf"))
        counts = rows.groupBy("tree", "leaf", "y").agg(F.count(F.lit(1)).alias("n"))
        totals = rows.groupBy("tree", "leaf").agg(F.count(F.lit(1)).alias("total"))
        share = F.col("n") / F.col("total") / F.lit(float(self.model.stages[-1].getNumTrees))
        joined = counts.join(totals, ["tree", "leaf"]).join(numbered, "y")
        return materialize(joined.select("tree", "leaf", "cell", "y", share.alias("w")))

    def weights(self, level: int) -> DataFrame:
        """(tree, leaf, parent, cell, y, w): the digits above a level and at it; y is exact at the last."""
        below = CELLS ** (self.depth - 1 - level)  # numbers in a cell of this level
        cell = F.floor(F.col("cell") / F.lit(below)).cast("long")
        one = self.lowest.groupBy("tree", "leaf", cell.alias("cell")).agg(F.min("y").alias("y"), F.sum("w").alias("w"))
        return one.select("tree", "leaf", F.floor(F.col("cell") / F.lit(CELLS)).cast("long").alias("parent"), "cell", "y", "w")

    def choose(self, candidates: DataFrame, key: str) -> DataFrame:
        """(key, q, parent, before, y): the first cell that reaches the quantile, as the parent of the next level."""
        summed = candidates.groupBy(key, "q", "before", "cell").agg(F.sum("w").alias("w"), F.min("y").alias("y"))
        upto = Window.partitionBy(key, "q").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        reached = summed.withColumn("cum", F.col("before") + F.sum("w").over(upto)).where(F.col("cum") >= F.col("q") - EPSILON)
        first = reached.groupBy(key, "q").agg(F.min_by(F.struct("cell", (F.col("cum") - F.col("w")).alias("before"), "y"), "cell").alias("s"))
        return first.select(key, "q", F.col("s.cell").alias("parent"), "s.before", "s.y")

    def _values(self, df: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
        """(key, q, y)"""
        if self.table is None:
            return self._by_digits(materialize(_leaves(self.model, df, [key])), key, quantiles)
        rows = materialize(_leaf_array(self.model, df, [F.col(key)]).where(F.col(key).isNotNull()))
        repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key)
        if repeated.isEmpty():
            return self._by_cells(rows, key, quantiles)
        several = materialize(rows.join(repeated, key, "left_semi").select(key, F.posexplode("leaf").alias("tree", "leaf")))
        once = self._by_cells(rows.join(repeated, key, "left_anti"), key, quantiles)
        return once.unionByName(self._by_digits(several, key, quantiles))

    def _by_digits(self, leaves: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
        qs = F.array(*[F.lit(float(q)) for q in quantiles])
        start = F.lit(0).cast("long").alias("parent"), F.lit(0.0).alias("before")
        chosen = leaves.where("tree = 0").select(key, F.explode(qs).alias("q"), *start)
        for level in range(self.depth):
            chosen = self.choose(self.candidates(leaves, chosen.drop("y"), key, level), key)
        return chosen.select(key, "q", "y")

    def _by_cells(self, rows: DataFrame, key: str, quantiles: Sequence[float]) -> DataFrame:
        spark = rows.sparkSession
        shared = spark.sparkContext.broadcast(self.table)
        kind = rows.schema[key].dataType
        ints, doubles = T.ArrayType(T.IntegerType()), T.ArrayType(T.DoubleType())
        schema = T.StructType().add("key", kind).add("leaf", ints).add("cells", ints).add("before", doubles)
        found = materialize(rows.select(F.col(key).alias("key"), "leaf").mapInArrow(_find_cells(shared, quantiles), schema))
        qs = F.array(*[F.lit(float(q)) for q in quantiles])
        each = found.select("key", "leaf", F.inline(F.arrays_zip(qs.alias("q"), F.col("cells").alias("cell"), F.col("before").alias("before"))))
        hits = each.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()
        parts = [(r["cell"], -(-r["n"] // SCORED_PER_GROUP)) for r in hits]
        # a cell that many rows look into is dealt to several groups, each with the cell's training rows
        dealt = F.broadcast(spark.createDataFrame(parts, "cell int, parts long"))
        scored = each.join(dealt, "cell").withColumn("part", F.pmod(F.xxhash64("key", "q"), "parts")).drop("parts")
        single = self.values.where("cell % 2 = 1").withColumn("leaf", F.lit(None).cast("array<int>"))
        held = self.trained.where("cell % 2 = 0").unionByName(single).join(dealt, "cell")
        held = held.select("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "y", "leaf")
        made = T.StructType().add("key", kind).add("q", T.DoubleType()).add("y", T.DoubleType())
        groups = scored.groupBy("cell", "part").cogroup(held.groupBy("cell", "part"))
        return groups.applyInArrow(_find_values(shared, to_arrow_schema(made)), made).withColumnRenamed("key", key)


def fit_quantile_forest(
    train: DataFrame,
    columns: FittedColumns,
    target: str,
    quantiles: Sequence[float] = (0.1, 0.5, 0.9),
    params: ForestParams = ForestParams(),
) -> QuantileForest:
    model = fit_forest(train, columns, target, params, leaf="leaf")
    rows = train.where(F.col(target).isNotNull()).withColumn("__y", F.col(target).cast("double"))
    leafed = materialize(_leaf_array(model, rows, [F.col("__y").alias("y")]))
    forest = model.stages[-1]
    sizes = [(tree.numNodes + 1) // 2 for tree in forest.trees]
    n, leaves = leafed.count(), sum(sizes)
    cells = min(-(-n // ROWS_PER_CELL), TABLE // (2 * leaves))
    tabled = cells >= min(MIN_CELLS, -(-n // ROWS_PER_CELL))
    # the values that begin in the same block of rows are a cell, but for one that fills a block by itself: its number is odd
    block = -(-n // max(cells, 1))
    counted = cumulative_counts(leafed, [], "y", {"n": F.count(F.lit(1))})
    cell = 2 * F.floor((F.col("cum_n") - F.col("n")) / F.lit(block)) + (F.col("n") >= block).cast("int")
    values = materialize(counted.select(cell.cast("int").alias("cell"), "y"))
    trained = materialize(leafed.join(values, "y").select("cell", "y", "leaf"))
    distinct = values.count()
    depth = 1
    while CELLS**depth < distinct:
        depth += 1
    table = _cell_table(trained, sizes, 2 * -(-n // block), n) if tabled else None
    return QuantileForest(model, tuple(quantiles), trained, values, distinct, depth, table)


def _cell_table(trained: DataFrame, sizes: Sequence[int], cells: int, rows: int) -> CellTable:
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
    exploded = trained.select("cell", F.posexplode("leaf").alias("tree", "leaf"))
    counted = exploded.groupBy("cell", "tree", "leaf").agg(F.count(F.lit(1)).alias("n")).toArrow()
    cell, tree, leaf, n = (counted[c].to_numpy() for c in ("cell", "tree", "leaf", "n"))
    upto = np.zeros((sum(sizes), cells), np.int32 if rows < 2**31 else np.int64)
    upto[leaf + offsets[tree], cell] = n
    np.cumsum(upto, axis=1, out=upto)
    return CellTable(upto, offsets)
