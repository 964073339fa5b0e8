"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); the component is the smallest node that can be reached.

    Every step is a join of the edges with the smallest neighbour of each node, found by a pre-aggregated group, so no
    neighbour list is gathered; each step is written to the shared folder.  The number of steps grows with the
    logarithm of the longest path.  Nodes without an edge to another node are not in the result.
    """
    e = edges.where("a is not null and b is not null and a <> b")
    e = materialize(e.select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    mark = _mark(e)
    while mark[0]:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        large = materialize(large)
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        joined = large.join(least, "hi")
        small = joined.select("hi", F.col("m").alias("lo")).union(
            joined.where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        )
        e = materialize(small.distinct())
        last, mark = mark, _mark(e)
        if mark == last:
            break
    return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
        e.select("lo", "lo").distinct()
    )
