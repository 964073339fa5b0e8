"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.session import materialize


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[dict[str, pa.Array]]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` of a function from a batch to column dictionaries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in fn(batch):
                yield pa.RecordBatch.from_pydict(columns)

    return df.mapInArrow(run, schema)


def sorted_groups(
    df: DataFrame, keys: list[str], fn: Callable[[pa.Table], dict[str, pa.Array] | None], schema: str, order: tuple[str, ...] = ()
) -> DataFrame:
    """Apply ``fn`` to the rows of each key, which the caller keeps few.

    The rows are dealt out by key, sorted, and read as a stream: only one group and one Arrow batch are in memory.
    ``order`` sorts the rows within a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            t = pa.concat_tables([rest, t]).combine_chunks() if rest is not None else t
            change = np.zeros(t.num_rows - 1, bool)
            for k in keys:
                change |= pc.not_equal(t[k][1:], t[k][:-1]).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(change) + 1).tolist()]
            for a, b in zip(cuts[:-1], cuts[1:]):
                out = fn(t.slice(a, b - a))
                if out:
                    yield pa.RecordBatch.from_pydict(out)
            rest = t.slice(cuts[-1])
        if rest is not None and (out := fn(rest)):
            yield pa.RecordBatch.from_pydict(out)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` does not have, near the wanted ones (case is ignored, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names, in any case."""
    drop = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in drop])


HOT_SHARE = 1000  # a key with more than this part of the rows is hot, so there are fewer hot keys than this


def join_hot(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with ``unique``, which has a row per key, without gathering the rows of a hot key.

    Keys are counted with map-side combining.  Those with more than a thousandth of the rows, so fewer than a thousand,
    are broadcast with their row; only the others move.  ``rows`` should be a written table, as it is read three times.
    """
    total = rows.count()
    hot = rows.groupBy(key).agg(F.count("*").alias("_rows")).where(F.col("_rows") * HOT_SHARE > total).select(key)
    hot = materialize(hot.join(unique, key))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti")
    return cold.join(unique, key).unionByName(rows.join(F.broadcast(hot), key))


__all__ = ["arrow_map", "fresh", "join_hot", "materialize", "sorted_groups", "without"]
