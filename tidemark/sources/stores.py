"""Tables a job keeps: baselines, drift history, run log, models."""

from __future__ import annotations

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.drift import Baseline, drift_summary, known_categories
from tidemark.operators.mmd import FourierMap, FourierSums


VALUE_PARTS = 4  # tasks that share the values of one feature at most


def save_baseline(baseline: Baseline, path: str) -> None:
    spark = baseline.counts.sparkSession
    # sorted by feature, so a reader of some features skips row groups; a folder per feature would not do for many categories
    dealt = baseline.counts.repartition("feature", F.pmod(F.xxhash64("value"), F.lit(VALUE_PARTS)))
    dealt.sortWithinPartitions("feature", "value").write.mode("overwrite").parquet(f"{path}/counts")
    if baseline.rows is not None:
        baseline.rows.write.mode("overwrite").parquet(f"{path}/rows")
    if baseline.fourier is not None:
        _save_sums(spark, baseline.fourier, f"{path}/fourier")
    baseline.known.write.mode("overwrite").parquet(f"{path}/categories")
    rows = [("numeric", c, i, None) for i, c in enumerate(baseline.numeric)]
    rows += [("categorical", c, i, None) for i, c in enumerate(baseline.categorical)]
    rows += [("rows", None, 0, None)] if baseline.rows is not None else []
    rows += [("fourier", None, 0, None)] if baseline.fourier is not None else []
    spark.createDataFrame(rows, "kind string, feature string, position int, value string").coalesce(1).write.mode(
        "overwrite"
    ).parquet(f"{path}/columns")


def load_baseline(spark: SparkSession, path: str) -> Baseline:
    columns = spark.read.parquet(f"{path}/columns").orderBy("kind", "feature", "position").collect()
    numeric = [r["feature"] for r in sorted((r for r in columns if r["kind"] == "numeric"), key=lambda r: r["position"])]
    names = sorted((r["position"], r["feature"]) for r in columns if r["kind"] == "categorical")
    known = spark.read.schema("feature string, value string").parquet(f"{path}/categories")
    counts = spark.read.schema("value double, n long, feature string").parquet(f"{path}/counts").select("feature", "value", "n")
    held = {r["kind"] for r in columns}
    vectors = spark.read.schema("key string, v array<double>").parquet(f"{path}/rows") if "rows" in held else None
    sums = _load_sums(spark, f"{path}/fourier") if "fourier" in held else None
    return known_categories(Baseline(counts, tuple(numeric), None, vectors, sums, tuple(c for _, c in names), known))


_SUMS = "feature int, n long, total double, second array<double>, width int, features int, sigma double, seed long"


def _save_sums(spark: SparkSession, sums: FourierSums, path: str) -> None:
    """A row per feature; each has the few numbers that define the features."""
    m = sums.map
    rows = [
        (i, sums.rows, float(t), second.tolist(), m.width, m.features, float(m.sigma), m.seed)
        for i, (t, second) in enumerate(zip(sums.total, sums.second))
    ]
    spark.createDataFrame(rows, _SUMS).coalesce(1).write.mode("overwrite").parquet(path)


def _load_sums(spark: SparkSession, path: str) -> FourierSums:
    rows = sorted(spark.read.schema(_SUMS).parquet(path).collect(), key=lambda r: r["feature"])
    features = FourierMap(rows[0]["width"], rows[0]["features"], rows[0]["sigma"], rows[0]["seed"])
    return FourierSums(features, rows[0]["n"], np.array([r["total"] for r in rows]), np.array([r["second"] for r in rows]))


def append_results(results: DataFrame, path: str) -> None:
    """Add drift results to the history; earlier rows are not rewritten."""
    results.write.mode("append").partitionBy("method").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_report(results: DataFrame, config: dict[str, str], path: str) -> None:
    """Configuration and summary snapshot as JSON next to the history."""
    pairs = [x for k, v in config.items() for x in (F.lit(k), F.lit(str(v)))]
    snapshot = drift_summary(results).withColumn("config", F.create_map(*pairs) if pairs else F.lit(None))
    snapshot.coalesce(1).write.mode("overwrite").json(path)


def monitoring_status(results: DataFrame, config: dict[str, str], enabled: bool = True, initialised: bool = True) -> DataFrame:
    pairs = [x for k, v in config.items() for x in (F.lit(k), F.lit(str(v)))]
    return drift_summary(results).select(
        F.lit(enabled).alias("monitoring_enabled"), F.lit(initialised).alias("is_initialized"), "*",
        F.create_map(*pairs).alias("config"),
    )


def append_run(spark: SparkSession, path: str, run_id: str, entries: dict[str, dict[str, object]]) -> None:
    """Run log rows (run_id, kind, key, value); ``entries`` maps a kind to its key-value pairs."""
    rows = [(run_id, kind, k, str(v)) for kind, kv in entries.items() for k, v in kv.items()]
    frame = spark.createDataFrame(rows, "run_id string, kind string, key string, value string")
    frame.withColumn("logged_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(path)


def latest_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Metrics of the last logged run."""
    runs = spark.read.parquet(path)
    last = runs.orderBy(F.desc("logged_at"), F.desc("run_id")).select("run_id").limit(1)
    rows = runs.where("kind = 'metric'").join(F.broadcast(last), "run_id")
    return rows.select("run_id", F.col("key").alias("metric"), F.col("value").cast("double").alias("value"), "logged_at")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
