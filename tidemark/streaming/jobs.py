"""Structured Streaming jobs: windowed drift, every-N drift, late rows, scoring.

Each job writes one folder per micro-batch (``batch_id=N``, overwritten), so
a batch that is run again after a failure replaces its own output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.drift import WEIGHT, Baseline, feature_counts, ks_from_counts
from tidemark.operators.ordering import GroupShape, positions
from tidemark.operators.preprocess import FittedColumns
from tidemark.operators.scoring import score_table
from tidemark.operators.forest import input_columns


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str = "*.parquet", files_per_batch: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", pattern)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


TESTS = "feature string, ref_rows long, cur_rows long, statistic double, p_value double, is_drift boolean"


def _batch_folder(out: str, batch_id: int) -> str:
    return f"{out}/batch_id={batch_id}"


def _prepare(spark: SparkSession, out: str, schema: str) -> None:
    """An empty batch -1, written only once, so that reading the table never fails."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(_batch_folder(out, -1))


def _previous(spark: SparkSession, out: str, batch_id: int, schema: str) -> DataFrame:
    """Output of the batch before this one, the only earlier one that is read."""
    return spark.read.schema(schema).parquet(_batch_folder(out, batch_id - 1))


def _start(frame: DataFrame, work, checkpoint: str, mode: str, **trigger) -> StreamingQuery:
    writer = frame.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(work)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


_OPEN = "newest timestamp, open array<long>, late long"


def monitor_windows(
    stream: DataFrame,
    baseline: Baseline,
    out: str,
    checkpoint: str,
    time: str = "timestamp",
    window: str = "1 day",
    delay: str = "1 hour",
    threshold: float = 0.05,
    **trigger,
) -> StreamingQuery:
    """KS drift per closed event-time window and feature, in ``{out}/results``.

    Every batch counts its values by window and adds the counts to a log that is partitioned by window; the log is in
    files, so no state store holds values.  A window is tested once, from its part of the log, in the batch whose newest
    time less ``delay`` passes its end.  What a batch needs of earlier ones is the row of the batch before it: the newest
    time and the windows that are open.  Rows of windows that were closed before the batch are late; they are counted in
    ``{out}/windows`` and not tested.  A batch that runs again replaces its part of the log and its results.
    """
    log, results, windows = f"{out}/log", f"{out}/results", f"{out}/windows"
    _prepare(stream.sparkSession, results, f"window_start timestamp, {TESTS}")
    _prepare(stream.sparkSession, windows, _OPEN)
    begin = F.window("__ts", window)["start"]

    def work(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _previous(spark, windows, batch_id, _OPEN).first()
        newest, opened = (before["newest"], before["open"]) if before else (None, [])
        timed = batch.withColumn("__ts", F.col(time).cast("timestamp")).where(F.col("__ts").isNotNull())
        timed = timed.withColumn("__end", F.window("__ts", window)["end"]).persist()
        try:
            last = F.lit(newest).cast("timestamp")
            closed_before = F.coalesce(F.col("__end") <= last - F.expr(f"INTERVAL {delay}"), F.lit(False))
            seen = timed.agg(
                F.greatest(F.max("__ts"), last).alias("newest"),
                F.count_if(closed_before).alias("late"),
                F.collect_set(F.when(~closed_before, F.unix_micros(begin))).alias("windows"),
            ).first()
            counts = feature_counts(baseline, timed.where(~closed_before).withColumn("window_start", F.unix_micros(begin)), ["window_start"])
            logged = counts.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            logged.partitionBy("window_start", "batch_id").parquet(log)
        finally:
            timed.unpersist()
        every = spark.createDataFrame([(w,) for w in sorted({*opened, *seen["windows"]})], "w long")
        ends = F.window(F.timestamp_micros("w"), window)["end"]
        done = F.coalesce(ends <= F.lit(seen["newest"]).cast("timestamp") - F.expr(f"INTERVAL {delay}"), F.lit(False))
        split = [(r["w"], r["done"]) for r in every.select("w", done.alias("done")).collect()]
        over, still = [w for w, d in split if d], [w for w, d in split if not d]
        if over:
            parts = spark.read.schema(f"feature string, value double, {WEIGHT} long, window_start long, batch_id long").option("basePath", log)
            mine = parts.parquet(*[f"{log}/window_start={w}" for w in over]).where(F.col("batch_id") <= batch_id)
            summed = mine.groupBy("window_start", "feature", "value").agg(F.sum(WEIGHT).alias(WEIGHT))
            closed = summed.withColumn("window_start", F.timestamp_micros("window_start"))
            tests = ks_from_counts(baseline, closed, ["window_start"]).withColumn("is_drift", F.col("p_value") < threshold)
        else:
            tests = spark.createDataFrame([], f"window_start timestamp, {TESTS}")
        tests.write.mode("overwrite").parquet(_batch_folder(results, batch_id))
        state = spark.createDataFrame([(seen["newest"], still, seen["late"])], _OPEN)
        state.coalesce(1).write.mode("overwrite").parquet(_batch_folder(windows, batch_id))

    return _start(stream, work, checkpoint, "append", **trigger)


def monitor_every(
    stream: DataFrame,
    baseline: Baseline,
    every: int,
    order: Sequence[str],
    out: str,
    checkpoint: str,
    threshold: float = 0.05,
    **trigger,
) -> StreamingQuery:
    """KS drift of every full group of ``every`` rows, in order of arrival batch, then ``order``.

    The number of groups so far and the rows of the unfinished group are
    written with each batch, so a restart goes on where it stopped.  A batch
    reads those of the batch before it and empties the waiting rows of the
    one before that: what is kept and read has less than ``every`` rows,
    however many batches there were.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    pending, counters, results = f"{out}/pending", f"{out}/counters", f"{out}/results"
    _prepare(stream.sparkSession, pending, fields)
    _prepare(stream.sparkSession, counters, "done long")
    _prepare(stream.sparkSession, results, f"gate long, {TESTS}")

    def check(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            _check(batch, batch_id)
        finally:
            batch.unpersist()

    def _check(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = _previous(spark, counters, batch_id, "done long").first()
        done = before["done"] if before else 0
        waiting = _previous(spark, pending, batch_id, fields)
        rows = waiting.select(F.lit(0).alias("__late"), *stream.columns).unionByName(
            batch.select(F.lit(1).alias("__late"), *stream.columns)
        )
        n = rows.count()
        full = n // every
        placed = positions(rows, ["__late", *order], name="__p", shape=GroupShape(n, 1, n)).drop("__late")
        rest = placed.where(F.col("__p") >= full * every).drop("__p")
        rest.write.mode("overwrite").parquet(_batch_folder(pending, batch_id))
        gated = placed.where(F.col("__p") < full * every).withColumn("gate", F.floor(F.col("__p") / every) + done)
        if full:
            values = feature_counts(baseline, gated, ["gate"])
            tests = ks_from_counts(baseline, values, ["gate"]).withColumn("is_drift", F.col("p_value") < threshold)
            tests.write.mode("overwrite").parquet(_batch_folder(results, batch_id))
        if batch_id > 1:  # batch - 1 stays, so that the table can be read
            spark.createDataFrame([], fields).write.mode("overwrite").parquet(_batch_folder(pending, batch_id - 2))
        spark.createDataFrame([(done + full,)], "done long").coalesce(1).write.mode("overwrite").parquet(
            _batch_folder(counters, batch_id)
        )

    return _start(stream, check, checkpoint, "append", **trigger)


def count_late(
    stream: DataFrame, out: str, checkpoint: str, time: str = "timestamp", delay: str = "1 hour", **trigger
) -> StreamingQuery:
    """Side table of late rows: per batch, the rows older than the newest earlier row minus ``delay``.

    ``newest`` is the newest time up to the batch, so a batch reads the row of the one before it only.
    """
    schema = "rows long, late long, newest timestamp"
    _prepare(stream.sparkSession, out, schema)

    def count(batch: DataFrame, batch_id: int) -> None:
        before = _previous(batch.sparkSession, out, batch_id, schema).first()
        newest = before["newest"] if before else None
        ts = F.col(time).cast("timestamp")
        edge = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        late = F.count_if(ts < edge) if newest is not None else F.lit(0).cast("long")
        row = batch.agg(F.count(F.lit(1)).alias("rows"), late.alias("late"), F.greatest(F.max(ts), F.lit(newest).cast("timestamp")).alias("newest"))
        row.write.mode("overwrite").parquet(_batch_folder(out, batch_id))

    return _start(stream, count, checkpoint, "append", **trigger)


def score_stream(
    stream: DataFrame,
    model: PipelineModel,
    columns: FittedColumns,
    key: Sequence[str],
    out: str,
    checkpoint: str,
    version: str = "unknown",
    **trigger,
) -> StreamingQuery:
    """Predictions appended to a table as rows arrive."""
    scored = score_table(model, stream, key, input_columns(columns), version)
    writer = scored.writeStream.outputMode("append").option("checkpointLocation", checkpoint).format("parquet")
    return writer.option("path", out).trigger(**(trigger or {"availableNow": True})).start()
