"""Monitored batches: gate, drift checks, report, alerts and history of every micro-batch, committed as one record.

A batch leaves one row (one file): the report with all that other tables are read from.  It appears as a whole or not at
all, and a batch that is run again after a failure replaces its own row, so history, alerts and counters never have half
of a batch or two of it.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.drift import RESULT_SCHEMA, Baseline, alerts, batch_report, check_batch, no_result
from tidemark.streaming.jobs import _batch_folder, _prepare, _start

_RESULT = "struct<" + ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in RESULT_SCHEMA.split(", ")) + ">"
_ANY_RESULT = _RESULT[:-1] + ", status: string>"
RECORD = f"""call long, batch_id string, batch_size long, timestamp timestamp, monitoring_enabled boolean, check_skipped boolean,
 drift_detected boolean, overall_drift struct<detected: boolean, results: array<{_RESULT}>>,
 feature_drift struct<detected: boolean, results: map<string, array<{_RESULT}>>>,
 results array<{_ANY_RESULT}>, alerts array<{_ANY_RESULT}>"""


def should_check(call: int, every: int) -> bool:
    """The gate: calls count from 1, and every ``every``-th is checked."""
    return call % every == 0


def run_checks(baseline: Baseline, batch: DataFrame, at: Column, methods: Sequence[str], threshold: float, **options: Any) -> DataFrame:
    """Result rows of each method; one that fails gives a row that says so, and the others go on.

    The rows of a batch are as many as methods times features, so they go through the driver.
    """
    spark, rows = batch.sparkSession, []
    for method in methods:
        try:
            rows += check_batch(baseline, batch, at, [method], threshold, **options).collect()
        except Exception as error:  # whatever it was, the batch is not lost for it
            said = str(error).strip().split("\n")[0]
            rows += no_result(spark, method, threshold, at, f"failed: {type(error).__name__}: {said}").collect()
    return spark.createDataFrame(rows, f"{RESULT_SCHEMA}, status string")


def monitored_batch(
    baseline: Baseline,
    batch: DataFrame,
    batch_id: str,
    call: int = 1,
    every: int = 1,
    methods: Sequence[str] = ("ks",),
    threshold: float = 0.05,
    alert_on_drift: bool = True,
    enabled: bool = True,
    at: Column | None = None,
    **options: Any,
) -> DataFrame:
    """One row of ``RECORD``: the report of a batch, its results with their status, and its alerts.

    A call that the gate does not let through is ``check_skipped`` and has no results.  Without monitoring nothing is
    looked at.  A method that cannot say anything about the batch (too few rows, or a failure) has no verdict; if none
    has one, ``drift_detected`` is null.
    """
    spark = batch.sparkSession
    at = F.current_timestamp() if at is None else at
    checked = enabled and should_check(call, every)
    results = run_checks(baseline, batch, at, methods, threshold, **options) if checked else None
    empty = spark.createDataFrame([], f"{RESULT_SCHEMA}, status string")
    found = results if checked else empty
    said = F.sort_array(F.collect_list(F.struct("method", "feature_name", F.struct(*found.columns).alias("r"))))
    listed = found.agg(F.transform(said, lambda x: x["r"]).alias("results")).first()["results"]
    raised = alerts(found, alert_on_drift).agg(F.transform(said, lambda x: x["r"]).alias("alerts")).first()["alerts"]
    report = batch_report(found, batch_id, batch.count() if enabled else 0)
    verdict = F.col("drift_detected") if checked else F.lit(False)
    lists = spark.createDataFrame([(listed, raised)], f"results array<{_ANY_RESULT}>, alerts array<{_ANY_RESULT}>").first()
    stated = report.select(
        F.lit(call).cast("long").alias("call"), "batch_id", "batch_size", at.alias("timestamp"), F.lit(enabled).alias("monitoring_enabled"),
        F.lit(enabled and not checked).alias("check_skipped"), verdict.alias("drift_detected"), "overall_drift", "feature_drift",
    ).first()
    return spark.createDataFrame([(*stated, *lists)], RECORD)


def commit_batch(baseline: Baseline, batch: DataFrame, batch_id: int, out: str, **options: Any) -> None:
    """Write the record of a micro-batch, over that of an earlier try.

    Batch ids count from 0 without gaps and survive restarts, so they are the gate's counter.
    """
    batch = batch.persist()
    try:
        record = monitored_batch(baseline, batch, str(batch_id), call=batch_id + 1, **options)
        record.coalesce(1).write.mode("overwrite").parquet(_batch_folder(out, batch_id))
    finally:
        batch.unpersist()


def monitor_batches(
    stream: DataFrame,
    baseline: Baseline,
    out: str,
    checkpoint: str,
    every: int = 1,
    methods: Sequence[str] = ("ks",),
    threshold: float = 0.05,
    alert_on_drift: bool = True,
    enabled: bool = True,
    trigger: dict[str, Any] | None = None,
    **options: Any,
) -> StreamingQuery:
    """Monitor every micro-batch of ``stream``; ``options`` go to ``check_batch``."""
    _prepare(stream.sparkSession, out, RECORD)
    fixed = {"every": every, "methods": methods, "threshold": threshold, "alert_on_drift": alert_on_drift, "enabled": enabled, **options}

    def work(batch: DataFrame, batch_id: int) -> None:
        commit_batch(baseline, batch, batch_id, out, **fixed)

    return _start(stream, work, checkpoint, "append", **(trigger or {}))


def monitor_payload(spark: SparkSession, baseline: Baseline, payload: dict[str, Any], schema: str, prediction_id: str = "", **options: Any) -> DataFrame:
    """The record of a single payload, a batch of one row."""
    row = spark.createDataFrame([payload], schema)
    return monitored_batch(baseline, row, prediction_id, **options)


def read_reports(spark: SparkSession, out: str) -> DataFrame:
    """A row per batch."""
    return spark.read.schema(RECORD).parquet(f"{out}/batch_id=*")


def _listed(spark: SparkSession, out: str, column: str) -> DataFrame:
    return read_reports(spark, out).select("batch_id", F.explode(column).alias("r")).select("batch_id", "r.*")


def read_history(spark: SparkSession, out: str) -> DataFrame:
    """All results, as ``drift_summary`` and ``history`` take them."""
    return _listed(spark, out, "results")


def read_alerts(spark: SparkSession, out: str) -> DataFrame:
    return _listed(spark, out, "alerts")


def call_counts(spark: SparkSession, out: str) -> DataFrame:
    """One row: calls, checked ones, skipped ones, and rows seen."""
    return read_reports(spark, out).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(F.col("monitoring_enabled") & ~F.col("check_skipped")).alias("checks"),
        F.count_if("check_skipped").alias("skipped"),
        F.coalesce(F.sum("batch_size"), F.lit(0)).alias("rows"),
    )
