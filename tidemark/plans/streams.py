"""Queries: streaming jobs run over the events file until it is exhausted."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators.drift import fit_baseline
from tidemark.operators.forest import fit_forest
from tidemark.operators.preprocess import fit_columns
from tidemark.plans.drifts import (
    CATEGORICAL, CUT_SQL, EVENT_FEATURES, FOURIER, LONG_SQL, NUMERIC, cut, drift_windows, fourier_sql, gaps_sql, matrix_sql,
)
from tidemark.plans.models import SMALL
from tidemark.plans.registry import query
from tidemark.plans.series import EVENTS_SQL, events_series, read
from tidemark.session import new_folder
from tidemark.streaming import jobs as J
from tidemark.streaming import monitoring as M


def arriving_events(spark, sf):
    schema = read(spark, sf, "events").schema
    return event_fields(J.read_stream(spark, sf, schema, "events.parquet"))


def event_fields(raw):
    return raw.select(
        "event_id", F.col("ts").alias("timestamp"), F.col("value").alias("price"), "user_id", "event_type",
        F.get_json_object("props", "$.k").cast("double").alias("feature1"),
    )


DAYS_SQL = f"""SELECT timestamp, CAST(timestamp AS DATE) AS day, feature, value FROM (
 SELECT timestamp, 'price' AS feature, price AS value FROM s UNION ALL SELECT timestamp, 'feature1', feature1 FROM s)"""


@query(
    "stream_drift",
    f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(DAYS_SQL, 'day')}
 SELECT strftime(day, '%Y-%m-%d') AS day, feature, CAST(any_value(cur_rows) AS BIGINT) AS cur_rows, max(abs(gap)) AS statistic
 FROM g WHERE day + INTERVAL 1 DAY <= (SELECT max(timestamp) - INTERVAL 1 HOUR FROM s) GROUP BY day, feature""",
    digits={"statistic": 9},
)
def stream_drift(spark, sf):
    """Windows the watermark has closed; the last day stays open."""
    reference, _ = drift_windows(spark, sf)
    baseline = fit_baseline(reference, NUMERIC)
    out = new_folder(spark, "stream-drift")
    current = arriving_events(spark, sf).where(F.col("timestamp") >= cut())
    J.monitor_windows(current, baseline, out, f"{out}/checkpoint").awaitTermination()
    results = spark.read.parquet(f"{out}/results")
    return results.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "feature", "cur_rows", "statistic")


EVERY = 500
GATES_SQL = f"""SELECT timestamp, feature, value, CASE WHEN timestamp >= {CUT_SQL} THEN (i - 1) // {EVERY} END AS gate FROM (
 SELECT timestamp, 'price' AS feature, price AS value, i FROM n UNION ALL SELECT timestamp, 'feature1', feature1, i FROM n)"""


@query(
    "stream_every_n",
    f"""WITH n AS (SELECT *, row_number() OVER (PARTITION BY timestamp >= {CUT_SQL} ORDER BY timestamp, event_id) AS i
  FROM ({EVENTS_SQL})), {gaps_sql(GATES_SQL, 'gate')}
 SELECT CAST(gate AS BIGINT) AS gate, feature, CAST(any_value(cur_rows) AS BIGINT) AS cur_rows, max(abs(gap)) AS statistic
 FROM g GROUP BY gate, feature HAVING any_value(cur_rows) = {EVERY}""",
    digits={"statistic": 9},
)
def stream_every_n(spark, sf):
    reference, _ = drift_windows(spark, sf)
    baseline = fit_baseline(reference, NUMERIC)
    out = new_folder(spark, "stream-every")
    current = arriving_events(spark, sf).where(F.col("timestamp") >= cut())
    J.monitor_every(current, baseline, EVERY, ["timestamp", "event_id"], out, f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/results").select("gate", "feature", "cur_rows", "statistic")


@query(
    "stream_late",
    """SELECT count(*) AS rows, count(*) FILTER (WHERE event_id % 2 = 1 AND ts < (
  SELECT max(ts) FROM events WHERE event_id % 2 = 0) - INTERVAL 1 HOUR) AS late FROM events""",
)
def stream_late(spark, sf):
    """Two batches: the events with an even id arrive first, so most of the odd ones are late."""
    out = new_folder(spark, "stream-late")
    events = read(spark, sf, "events").select("event_id", F.col("ts").alias("timestamp"))
    for rest in (0, 1):
        # each arrival is a batch: the job takes what is there and ends
        events.where(F.col("event_id") % 2 == rest).write.mode("append").parquet(f"{out}/arrived")
        stream = spark.readStream.schema(events.schema).parquet(f"{out}/arrived")
        J.count_late(stream, f"{out}/late", f"{out}/checkpoint").awaitTermination()
    late = spark.read.parquet(f"{out}/late")
    return late.agg(F.sum("rows").alias("rows"), F.sum("late").alias("late"))


# Six arrivals: the current events by id, and the one with the largest id alone; every second one is checked.
SLOT_SQL = f"CASE WHEN timestamp >= {CUT_SQL} THEN CASE WHEN event_id = (SELECT max(event_id) FROM s WHERE timestamp >= {CUT_SQL}) THEN 5 ELSE event_id % 5 END END"
SLOTS_SQL = f"SELECT timestamp, {SLOT_SQL} AS slot, feature, value FROM ({LONG_SQL.replace('SELECT timestamp,', 'SELECT timestamp, event_id,')})"


@query(
    "stream_batch_report",
    f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(SLOTS_SQL, 'slot')}, {fourier_sql(matrix_sql(SLOT_SQL), EVENT_FEATURES)},
 b AS (SELECT {SLOT_SQL} AS slot, count(*) AS batch_size FROM s WHERE timestamp >= {CUT_SQL} GROUP BY 1),
 k AS (SELECT slot, feature, max(abs(gap)) AS statistic FROM g WHERE slot % 2 = 1 GROUP BY slot, feature),
 r AS (
  SELECT slot, 'ks' AS method, 'batch' AS scope, max(statistic) AS drift_score, 'ok' AS status FROM k GROUP BY slot
  UNION ALL SELECT slot, 'ks', feature, statistic, 'ok' FROM k WHERE feature IN ('price', 'feature1')
  UNION ALL SELECT slot, 'mmd', 'batch', mmd2, CASE WHEN mmd2 IS NULL THEN 'too few rows' ELSE 'ok' END FROM b LEFT JOIN fourier ON batch = slot WHERE slot % 2 = 1
  UNION ALL SELECT slot, 'nothing', 'batch', NULL, 'unknown method' FROM b WHERE slot % 2 = 1)
 SELECT CAST(slot + 1 AS BIGINT) AS call, batch_size, slot % 2 = 0 AS check_skipped, method, scope, drift_score, status
 FROM b LEFT JOIN r USING (slot)""",
    digits={"drift_score": 9},
)
def stream_batch_report(spark, sf):
    """Reports of arriving batches, one run of the job each, so the counter of the gate outlives the runs."""
    reference, _ = drift_windows(spark, sf)
    baseline = fit_baseline(reference, NUMERIC, CATEGORICAL, fourier_features=FOURIER, sigma=EVENT_FEATURES.sigma)
    events = read(spark, sf, "events")
    last = events.where(F.col("ts") >= cut()).agg(F.max("event_id")).first()[0]
    slot = F.when(F.col("event_id") == last, 5).otherwise(F.col("event_id") % 5)
    out = new_folder(spark, "stream-report")
    for k in range(6):
        events.where((F.col("ts") >= cut()) & (slot == k)).write.mode("append").parquet(f"{out}/arrived")
        arrived = event_fields(J.read_stream(spark, f"{out}/arrived", events.schema))
        methods = ("ks", "mmd", "nothing")
        M.monitor_batches(arrived, baseline, f"{out}/reports", f"{out}/checkpoint", every=2, methods=methods).awaitTermination()
    reports = M.read_reports(spark, f"{out}/reports").select("call", "batch_size", "check_skipped", F.explode_outer("results").alias("r"))
    scope = F.when(F.col("r").isNotNull(), F.coalesce("r.feature_name", F.lit("batch"))).alias("scope")
    return reports.select("call", "batch_size", "check_skipped", "r.method", scope, "r.drift_score", "r.status")


@query("stream_scoring", "SELECT event_id, '1' AS model_version, TRUE AS inside FROM events")
def stream_scoring(spark, sf):
    history = events_series(spark, sf)
    columns = fit_columns(history, ["feature1", "user_id"], ["event_type"])
    model = fit_forest(history, columns, "price", SMALL)
    out = new_folder(spark, "stream-scoring")
    J.score_stream(arriving_events(spark, sf), model, columns, ["event_id"], f"{out}/scores", f"{out}/checkpoint", "1").awaitTermination()
    low, high = history.agg(F.min("price"), F.max("price")).first()
    scores = spark.read.parquet(f"{out}/scores")
    return scores.select("event_id", "model_version", F.col("prediction").between(low - 1e-6, high + 1e-6).alias("inside"))
