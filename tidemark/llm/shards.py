"""Sharding by a two-pass external shuffle: rows are scattered into memory-sized buckets, each bucket is shuffled.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh, materialize, without

BUCKET_BYTES = 16 << 20  # what a bucket should hold; a task shuffles one at a time in memory
BUCKET_ROWS = 20_000
FIXED = 16  # bytes of a record besides its text
GROUP = 1024  # buckets whose row counts are added up before the totals are


def record_size(text: Column) -> Column:
    return (F.octet_length(F.coalesce(text, F.lit(""))) + FIXED).cast("long")


def shard_rows(docs: DataFrame, shards: int, text_col: str = "text", seed: int = 7) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``: a random order of all rows, dealt out in turn.

    The law is "rows": shard sizes differ by one row at most.  Slots count from 0 without gaps in each shard, and are
    the order in which the shard is to be written.  All rows stay, repeated and null ones too.  New names that
    clash get a leading underscore.

    First pass: a seeded hash of the row's place scatters rows evenly over buckets, whatever their keys, so copies and
    hot keys spread.  ``docs`` should be a read table: its places do not change when a task is repeated.
    Second pass: each bucket, sorted first so that its order does not depend on arrival, is shuffled by Spark's
    ``shuffle`` (Fisher-Yates).  A row's place in the total order is its bucket's start, a prefix sum over the buckets'
    counts, plus its place in the bucket; shard and slot are that number modulo and divided by ``shards``.
    """
    names = docs.columns
    place, bucket, row, at, start, shard, slot = fresh(docs, "place", "bucket", "row", "at", "start", "shard", "slot")
    size = docs.agg(F.count("*"), F.sum(record_size(F.col(f"`{text_col}`")))).first()
    n, total = size[0], size[1] or 0
    buckets = max(shards, -(-n // BUCKET_ROWS), -(-total // BUCKET_BYTES))
    numbered = docs.withColumn(place, F.monotonically_increasing_id())
    scattered = numbered.withColumn(bucket, F.pmod(F.xxhash64(F.lit(seed), place), F.lit(buckets)))
    packed = scattered.select(bucket, F.struct(place, *[f"`{c}`" for c in names]).alias(row))
    # the place leads the struct, so sorting never looks at the columns
    lists = packed.groupBy(bucket).agg(F.collect_list(row).alias(row))
    lists = lists.sortWithinPartitions(bucket).withColumn(row, F.shuffle(F.array_sort(row, _by(place)), F.lit(seed)))
    dealt = materialize(lists.select(bucket, F.posexplode(row).alias(at, row)))
    counts = dealt.groupBy(bucket).agg(F.count("*").alias("k")).withColumn("part", F.expr(f"`{bucket}` div {GROUP}"))
    parts = counts.groupBy("part").agg(F.sum("k").alias("k"))
    before = parts.selectExpr("part", "coalesce(sum(k) over (order by part rows between unbounded preceding and 1 preceding), 0) as base")
    inside = f"coalesce(sum(k) over (partition by part order by `{bucket}` rows between unbounded preceding and 1 preceding), 0)"
    starts = counts.selectExpr(f"`{bucket}`", "part", f"{inside} as inside").join(before, "part")
    starts = starts.selectExpr(f"`{bucket}`", f"base + inside as `{start}`")
    joined = dealt.join(starts, bucket)
    order = F.col(f"`{start}`") + F.col(f"`{at}`")
    return joined.select(
        *[F.col(f"`{row}`.`{c}`") for c in names],
        F.pmod(order, F.lit(shards)).cast("int").alias(shard),
        F.floor(order / F.lit(shards)).cast("long").alias(slot),
    )


def _by(place: str):
    return lambda x, y: F.when(x[place] < y[place], -1).when(x[place] > y[place], 1).otherwise(0)


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000, shard: str = "shard", slot: str = "slot") -> None:
    """Write each shard to its own folder, such as ``shard=n``, as files of consecutive slots in order; no task holds a whole shard."""
    (stretch,) = fresh(sharded, "stretch")
    cut = sharded.withColumn(stretch, F.expr(f"`{slot}` div {rows_per_file}"))
    files = cut.select(shard, stretch).distinct().count()
    ordered = cut.repartition(max(1, files), shard, stretch).sortWithinPartitions(shard, slot)
    without(ordered, stretch).write.partitionBy(shard).option("maxRecordsPerFile", rows_per_file).parquet(path)
