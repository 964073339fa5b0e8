"""Queries: drift checks, history, as-of join, bands and scoring inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bands as N
from tidemark.operators import drift as D
from tidemark.operators import mmd as K
from tidemark.operators import scoring as S
from tidemark.operators.asof import asof_join
from tidemark.operators.metrics import period_metrics
from tidemark.operators.splits import ratio_split
from tidemark.plans.metrics import SPLIT_SQL
from tidemark.plans.registry import query
from tidemark.plans.series import (
    DRIFT_START, EVENTS_FORECAST_SQL, EVENTS_SQL, ORDER_KEYS, events_forecast, events_series, orders_forecast, read,
)
from tidemark.session import new_folder
from tidemark.sources.stores import load_baseline, save_baseline

NUMERIC, CATEGORICAL = ["price", "feature1"], ["event_type"]
def cut():
    return F.lit(DRIFT_START).cast("timestamp_ntz")


CUT_SQL = f"TIMESTAMP '{DRIFT_START}'"


def drift_windows(spark, sf):
    events = events_series(spark, sf)
    return events.where(F.col("timestamp") < cut()), events.where(F.col("timestamp") >= cut())


def _baseline(spark, sf, categorical=()):
    reference, current = drift_windows(spark, sf)
    return D.fit_baseline(reference, NUMERIC, categorical), current


KINDS = ["click", "error", "purchase", "signup", "view"]
LONG_SQL = " UNION ALL ".join(
    [f"SELECT timestamp, '{c}' AS feature, {c} AS value FROM s" for c in NUMERIC]
    + [f"SELECT timestamp, 'event_type_{v}', CAST(event_type = '{v}' AS DOUBLE) FROM s" for v in KINDS]
    + ["SELECT timestamp, 'event_type_unknown', CAST(0 AS DOUBLE) FROM s"]
)


def gaps_sql(long: str, window: str = "") -> str:
    """Cumulative shares of the reference and of each current window at every value."""
    key = f"{window}, feature" if window else "feature"
    windows = f"(SELECT DISTINCT {window} FROM l WHERE timestamp >= {CUT_SQL}) w," if window else ""
    pick = f"w.{window}," if window else ""
    cur_key = f"{window}," if window else ""
    return f"""
l AS ({long}),
p AS (SELECT {pick} feature, value, 1 AS r, 0 AS c FROM {windows} l WHERE l.timestamp < {CUT_SQL}
      UNION ALL SELECT {cur_key} feature, value, 0, 1 FROM l WHERE timestamp >= {CUT_SQL}),
v AS (SELECT {key}, value, sum(r) AS r, sum(c) AS c FROM p GROUP BY {key}, value),
g AS (SELECT {key}, value, sum(r) OVER t AS ref_rows, sum(c) OVER t AS cur_rows,
        sum(r) OVER o / sum(r) OVER t - sum(c) OVER o / sum(c) OVER t AS gap,
        lead(value) OVER (PARTITION BY {key} ORDER BY value) AS next_value FROM v
      WINDOW t AS (PARTITION BY {key}), o AS (PARTITION BY {key} ORDER BY value ROWS UNBOUNDED PRECEDING))"""


KS_SQL = f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(LONG_SQL)},
k AS (SELECT feature, CAST(any_value(ref_rows) AS BIGINT) AS ref_rows, CAST(any_value(cur_rows) AS BIGINT) AS cur_rows,
  max(abs(gap)) AS statistic FROM g GROUP BY feature),
x AS (SELECT *, sqrt(ref_rows::DOUBLE * cur_rows / (ref_rows + cur_rows)) * statistic AS z FROM k)
SELECT feature, ref_rows, cur_rows, statistic, CASE WHEN z < 0.2 THEN 1.0 ELSE greatest(least(
 list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2.0 * k * k * z * z))),
 1.0), 0.0) END AS p_value FROM x"""


@query("ks_statistic", f"SELECT feature, ref_rows, cur_rows, statistic FROM ({KS_SQL})", digits={"statistic": 9})
def ks_statistic(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    return D.ks_test(baseline, current).drop("p_value")


@query("ks_pvalue", f"SELECT feature, p_value FROM ({KS_SQL})", six=["p_value"])
def ks_pvalue(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    return D.ks_test(baseline, current).select("feature", "p_value")


@query(
    "ks_one_sided",
    f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(LONG_SQL)},
 k AS (SELECT feature, any_value(ref_rows)::DOUBLE AS n, any_value(cur_rows)::DOUBLE AS m, greatest(max(gap), 0) AS up,
   greatest(max(-gap), 0) AS down FROM g GROUP BY feature)
 SELECT feature, 'greater' AS alternative, up AS statistic, exp(-2 * n * m / (n + m) * up * up) AS p_value FROM k
 UNION ALL SELECT feature, 'less', down, exp(-2 * n * m / (n + m) * down * down) FROM k""",
    six=["statistic", "p_value"],
)
def ks_one_sided(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    sides = [
        D.ks_test(baseline, current, alternative=a).select("feature", F.lit(a).alias("alternative"), "statistic", "p_value")
        for a in ("greater", "less")
    ]
    return sides[0].unionByName(sides[1])


@query(
    "feature_drift",
    f"SELECT feature, statistic, p_value, p_value < 0.05 AS is_drift, p_value < 0.05 / 8 AS is_drift_corrected FROM ({KS_SQL})",
    six=["statistic", "p_value"],
)
def feature_drift(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    tests = D.with_verdict(D.ks_test(baseline, current), baseline.n_features)
    return tests.drop("ref_rows", "cur_rows")


DAILY_LONG_SQL = "SELECT timestamp, CAST(timestamp AS DATE) AS day, feature, value FROM (SELECT timestamp, 'price' AS feature, price AS value FROM s UNION ALL SELECT timestamp, 'feature1', feature1 FROM s)"


@query(
    "ks_by_day",
    f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(DAILY_LONG_SQL, 'day')}
 SELECT strftime(day, '%Y-%m-%d') AS day, feature, CAST(any_value(cur_rows) AS BIGINT) AS cur_rows, max(abs(gap)) AS statistic
 FROM g GROUP BY day, feature""",
    digits={"statistic": 9},
)
def ks_by_day(spark, sf):
    baseline, current = _baseline(spark, sf)
    daily = current.withColumn("day", F.date_format("timestamp", "yyyy-MM-dd"))
    return D.ks_test(baseline, daily, ["day"]).select("day", "feature", "cur_rows", "statistic")


@query(
    "wasserstein",
    f"""WITH s AS ({EVENTS_SQL}), {gaps_sql(LONG_SQL)}
 SELECT feature, coalesce(sum(abs(gap) * (next_value - value)), 0) AS distance FROM g GROUP BY feature""",
    six=["distance"],
)
def wasserstein(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    return D.wasserstein(baseline, current)


@query(
    "baseline_counts",
    f"""WITH s AS ({EVENTS_SQL}), l AS ({LONG_SQL})
 SELECT feature, count(*) AS values, CAST(sum(n) AS BIGINT) AS rows FROM (
  SELECT feature, value, count(*) AS n FROM l WHERE timestamp < {CUT_SQL} GROUP BY feature, value) GROUP BY feature""",
)
def baseline_counts(spark, sf):
    baseline, _ = _baseline(spark, sf, CATEGORICAL)
    return baseline.counts.groupBy("feature").agg(F.count(F.lit(1)).alias("values"), F.sum("n").alias("rows"))


@query(
    "drift_matrix",
    f"""SELECT event_id, price, feature1, {', '.join(
        f"CAST(event_type = '{v}' AS DOUBLE) AS event_type_{v}" for v in KINDS if v != 'error')},
 CAST(event_type = 'error' AS DOUBLE) AS event_type_unknown FROM ({EVENTS_SQL})""",
)
def drift_matrix(spark, sf):
    """The vocabulary is fitted without the error events, which then count as unknown."""
    events = events_series(spark, sf)
    baseline = D.fit_baseline(events.where("event_type <> 'error'"), NUMERIC, CATEGORICAL)
    return baseline.matrix(events, ["event_id"])


def _shift_sql(where: str, by: str = "") -> str:
    return " UNION ALL ".join(
        f"""SELECT {by + ',' if by else ''} '{c}' AS feature, r AS ref_mean, avg({c}) AS cur_mean, abs(r - avg({c})) / r AS shift,
 abs(r - avg({c})) / r > 0.1 AS is_drift FROM s, (SELECT avg({c}) AS r FROM s WHERE timestamp < {CUT_SQL})
 WHERE {where} GROUP BY {by + ',' if by else ''} r"""
        for c in NUMERIC
    )


@query(
    "mean_shift",
    f"WITH s AS ({EVENTS_SQL}) {_shift_sql(f'timestamp >= {CUT_SQL}')}",
    six=["ref_mean", "cur_mean", "shift"],
)
def mean_shift(spark, sf):
    reference, current = drift_windows(spark, sf)
    return D.mean_shift(reference, current, [*NUMERIC, "absent"])


DAILY_SQL = f"""WITH s AS (SELECT *, date_trunc('day', timestamp)::TIMESTAMP AS day FROM ({EVENTS_SQL})),
 h AS (SELECT is_drift, shift AS drift_score, 'mean_shift' AS method, feature AS feature_name,
  CAST(0.1 AS DOUBLE) AS threshold, day AS timestamp FROM ({_shift_sql(f'timestamp >= {CUT_SQL}', 'day')}))"""


def daily_results(spark, sf):
    """Mean-shift results of each day after the reference window."""
    reference, current = drift_windows(spark, sf)
    day = F.date_trunc("day", "timestamp").cast("timestamp_ntz")
    shifts = D.mean_shift(reference, current.withColumn("day", day), NUMERIC, by=["day"])
    return D.mean_shift_results(shifts, "day")


@query(
    "drift_summary",
    f"""{DAILY_SQL},
 t AS (SELECT * FROM h ORDER BY timestamp DESC, method DESC, feature_name DESC LIMIT 10)
 SELECT count(*) AS total_checks, count(*) FILTER (WHERE is_drift) AS drift_detected,
  count(*) FILTER (WHERE is_drift) / count(*) AS drift_rate, 'mean_shift' AS methods, max(timestamp) AS last_check,
  (SELECT count(*) FROM t WHERE is_drift) AS recent_drifts FROM h""",
    six=["drift_rate"],
)
def drift_summary(spark, sf):
    summary = D.drift_summary(daily_results(spark, sf))
    return summary.select(
        "total_checks", "drift_detected", "drift_rate", F.array_join("methods_used", ",").alias("methods"), "last_check",
        F.size("latest_drift").cast("long").alias("recent_drifts"),
    )


@query(
    "drift_history",
    f"{DAILY_SQL} SELECT * FROM h ORDER BY timestamp DESC, method DESC, feature_name DESC LIMIT 7",
    six=["drift_score"],
)
def drift_history(spark, sf):
    return D.history(daily_results(spark, sf), 7).drop("p_value")


@query("drift_alerts", f"{DAILY_SQL} SELECT * FROM h WHERE is_drift", six=["drift_score"])
def drift_alerts(spark, sf):
    return D.alerts(daily_results(spark, sf)).drop("p_value")


@query(
    "batch_report",
    f"""WITH k AS ({KS_SQL}), n AS (SELECT count(*) AS batch_size FROM events WHERE ts >= {CUT_SQL})
 SELECT batch_size, max(statistic) AS overall_score, min(p_value) AS overall_p, min(p_value) < 0.05 / 8 AS overall_drift,
  bool_or(p_value < 0.05) FILTER (WHERE feature IN ('price', 'feature1')) AS feature_drift,
  max(statistic) FILTER (WHERE feature = 'price') AS price_score FROM k, n GROUP BY batch_size""",
    six=["overall_score", "overall_p", "price_score"],
)
def batch_report(spark, sf):
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    results = D.check_batch(baseline, current, F.current_timestamp()).drop("status")
    report = D.batch_report(results, "after-cut", current.count())
    whole = F.col("overall_drift.results")[0]
    return report.select(
        "batch_size",
        whole["drift_score"].alias("overall_score"),
        whole["p_value"].alias("overall_p"),
        F.col("overall_drift.detected").alias("overall_drift"),
        F.col("feature_drift.detected").alias("feature_drift"),
        F.col("feature_drift.results")["price"][0]["drift_score"].alias("price_score"),
    )


def mmd_sql(samples: str) -> str:
    """The blocked statistic of (key, ref, v) rows, dealt as ``mmd.blocked`` deals them."""
    half = K.BLOCK_ROWS // 2
    return f"""e AS (SELECT key, ref, v, row_number() OVER (PARTITION BY ref ORDER BY md5(CAST(key AS VARCHAR)), key) - 1 AS pos,
   greatest(1, count(*) OVER (PARTITION BY ref) // {half}) AS parts FROM ({samples})),
 d AS (SELECT e.*, block FROM e, (SELECT unnest(range(max(parts))) AS block FROM e) WHERE block % parts = pos % parts),
 pairs AS (SELECT a.block, a.ref AS x, b.ref AS y, exp(-power(list_distance(a.v, b.v), 2) / 2.0) AS k
  FROM d a JOIN d b ON a.block = b.block AND (a.key <> b.key OR a.ref <> b.ref)),
 t AS (SELECT block, avg(k) FILTER (WHERE x AND y) + avg(k) FILTER (WHERE NOT x AND NOT y) - 2 * avg(k) FILTER (WHERE x AND NOT y) AS stat
  FROM pairs GROUP BY block),
 mmd AS (SELECT (SELECT count(*) FROM e WHERE ref) AS ref_rows, (SELECT count(*) FROM e WHERE NOT ref) AS cur_rows,
  (SELECT avg(stat) FROM t) AS mmd2)"""


def _vectors_sql(reference: str) -> str:
    return mmd_sql(f"SELECT vec_id AS key, {reference} AS ref, CAST(embedding AS DOUBLE[]) AS v FROM embeddings")


@query("mmd_blocks", f"WITH {_vectors_sql('vec_id % 2 = 0')} SELECT * FROM mmd", digits={"mmd2": 9})
def mmd_blocks(spark, sf):
    vectors = read(spark, sf, "embeddings")
    return K.blocked(vectors, "embedding", F.col("vec_id") % 2 == 0, "vec_id", permutations=0).select("ref_rows", "cur_rows", "mmd2")


@query("mmd_unequal", f"WITH {_vectors_sql('vec_id % 10 <> 0')} SELECT * FROM mmd", digits={"mmd2": 9})
def mmd_unequal(spark, sf):
    """Nine reference rows for each current one: the current rows go round the blocks."""
    vectors = read(spark, sf, "embeddings")
    return K.blocked(vectors, "embedding", F.col("vec_id") % 10 != 0, "vec_id", permutations=0).select("ref_rows", "cur_rows", "mmd2")


@query(
    "mmd_random_features",
    """SELECT count(*) FILTER (WHERE vec_id % 2 = 0) AS ref_rows, count(*) FILTER (WHERE vec_id % 2 <> 0) AS cur_rows,
 TRUE AS p_in_range, TRUE AS verdict_follows_p, TRUE AS is_distance FROM embeddings""",
)
def mmd_random_features(spark, sf):
    """A squared distance of means, and a p-value that decides the verdict."""
    vectors = read(spark, sf, "embeddings")
    found = K.random_features(vectors, "embedding", F.col("vec_id") % 2 == 0, "vec_id")
    return found.select(
        "ref_rows", "cur_rows", F.col("p_value").between(0, 1).alias("p_in_range"),
        (F.col("is_drift") == (F.col("p_value") < 0.05)).alias("verdict_follows_p"), F.col("mmd2").between(0, 4).alias("is_distance"),
    )


@query(
    "mmd_permutation_test",
    f"""WITH {_vectors_sql('label % 2 = 0')}
 SELECT *, TRUE AS p_in_range, TRUE AS verdict_follows_p FROM mmd""",
    digits={"mmd2": 9},
)
def mmd_permutation_test(spark, sf):
    """The statistic, and that its p-value is a share of the relabellings and decides the verdict."""
    vectors = read(spark, sf, "embeddings")
    found = K.blocked(vectors, "embedding", F.col("label") % 2 == 0, "vec_id")
    return found.select(
        "ref_rows", "cur_rows", "mmd2",
        (F.col("p_value").between(0, 1) & (F.abs(F.col("p_value") * 100 - F.round(F.col("p_value") * 100)) < 1e-9)).alias("p_in_range"),
        (F.col("is_drift") == (F.col("p_value") < 0.05)).alias("verdict_follows_p"),
    )


_MATRIX_SQL = f"""SELECT event_id AS key, timestamp < {CUT_SQL} AS ref,
  [price, feature1, {', '.join(f"CAST(event_type = '{v}' AS DOUBLE)" for v in KINDS)}, 0.0::DOUBLE] AS v FROM ({EVENTS_SQL})
  WHERE price IS NOT NULL AND feature1 IS NOT NULL"""


@query(
    "batch_check",
    f"""WITH k AS ({KS_SQL}), {mmd_sql(_MATRIX_SQL)}
 SELECT 'ks' AS method, 'batch' AS scope, max(statistic) AS drift_score, CASE WHEN min(p_value) < 0.05 / 8 THEN 'drift' ELSE 'none' END AS verdict FROM k
 UNION ALL SELECT 'ks', feature, statistic, CASE WHEN p_value < 0.05 THEN 'drift' ELSE 'none' END FROM k WHERE feature IN ('price', 'feature1')
 UNION ALL SELECT 'mmd', 'batch', mmd2, 'by relabelling' FROM mmd""",
    digits={"drift_score": 7},
)
def batch_check(spark, sf):
    """The default methods on one batch; the verdict of MMD rests on random relabellings and is left out."""
    reference, current = drift_windows(spark, sf)
    baseline = D.fit_baseline(reference, NUMERIC, CATEGORICAL, key="event_id")
    found = D.check_batch(baseline, current, F.current_timestamp(), ["ks", "mmd"], key="event_id")
    verdict = F.when(F.col("method") == "mmd", "by relabelling").when(F.col("is_drift"), "drift").otherwise("none")
    return found.select("method", F.coalesce("feature_name", F.lit("batch")).alias("scope"), "drift_score", verdict.alias("verdict"))


FOURIER = 64


def fourier_sql(samples: str, features: K.FourierMap) -> str:
    """The unbiased statistic of (batch, v) rows by random Fourier features; a NULL batch is the reference."""
    weights, phase = features.weights()
    rows = ", ".join(f"({k}, {weights[:, k].tolist()}::DOUBLE[], {float(phase[k])!r}::DOUBLE)" for k in range(features.features))
    return f"""q AS (SELECT batch, row_number() OVER () AS i, v FROM ({samples})),
 f(k, w, b) AS (VALUES {rows}),
 z AS (SELECT batch, k, sqrt(2.0::DOUBLE / {features.features}) * cos(list_dot_product(v, w) + b) AS z FROM q, f),
 m AS (SELECT batch, k, count(*) AS n, sum(z) AS s, sum(z * z) AS q FROM z GROUP BY batch, k),
 fourier AS (SELECT c.batch, CAST(any_value(r.n) AS BIGINT) AS ref_rows, CAST(any_value(c.n) AS BIGINT) AS cur_rows,
   (sum(r.s * r.s) - sum(r.q)) / (any_value(r.n) * (any_value(r.n) - 1)) + (sum(c.s * c.s) - sum(c.q)) / (any_value(c.n) * (any_value(c.n) - 1))
    - 2 * sum(r.s * c.s) / (any_value(r.n) * any_value(c.n)) AS mmd2
  FROM m r JOIN m c ON r.batch IS NULL AND c.batch IS NOT NULL AND r.k = c.k GROUP BY c.batch HAVING any_value(c.n) > 1)"""


def matrix_sql(batch: str) -> str:
    return f"""SELECT {batch} AS batch, [price, feature1, {', '.join(f"CAST(event_type = '{v}' AS DOUBLE)" for v in KINDS)}, 0.0::DOUBLE] AS v
  FROM s WHERE price IS NOT NULL AND feature1 IS NOT NULL"""


EVENT_FEATURES = K.FourierMap(len(NUMERIC) + len(KINDS) + 1, FOURIER, 50.0)


@query(
    "mmd_stored_sums",
    f"""WITH s AS ({EVENTS_SQL}), {fourier_sql(matrix_sql(f"CASE WHEN timestamp >= {CUT_SQL} THEN event_id % 4 END"), EVENT_FEATURES)}
 SELECT CAST(batch AS INTEGER) AS batch, ref_rows, cur_rows, mmd2 FROM fourier""",
    digits={"mmd2": 9},
)
def mmd_stored_sums(spark, sf):
    """Four batches against the stored sums of a reference that is not read again."""
    reference, current = drift_windows(spark, sf)
    folder = new_folder(spark, "baseline")
    save_baseline(D.fit_baseline(reference, NUMERIC, CATEGORICAL, fourier_features=FOURIER, sigma=EVENT_FEATURES.sigma), folder)
    baseline = load_baseline(spark, folder)
    out = None
    for k in range(4):
        batch = baseline.vectors(current.where(F.col("event_id") % 4 == k))
        found = K.fourier_test(baseline.fourier, batch, "v").select(F.lit(k).alias("batch"), "ref_rows", "cur_rows", "mmd2")
        out = found if out is None else out.unionByName(found)
    return out


@query("stored_baseline", f"SELECT feature, ref_rows, cur_rows, statistic FROM ({KS_SQL})", digits={"statistic": 9})
def stored_baseline(spark, sf):
    """A baseline that was saved and loaded tests like the fitted one."""
    baseline, current = _baseline(spark, sf, CATEGORICAL)
    folder = new_folder(spark, "baseline")
    save_baseline(baseline, folder)
    return D.ks_test(load_baseline(spark, folder), current).drop("p_value")


@query(
    "asof_price",
    """WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'),
 r AS (SELECT ts, user_id, value FROM events WHERE event_type = 'view')
 SELECT l.event_id, r.ts AS ts_asof, r.value AS value_asof FROM l ASOF LEFT JOIN r
  ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_price(spark, sf):
    """The last value each user viewed before a purchase."""
    events = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    left = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = events.where("event_type = 'view'").select("event_id", "ts", "user_id", "value")
    out = asof_join(left, right, "ts", ["user_id"], ["value"], ["event_id"], ["event_id"])
    return out.select("event_id", "ts_asof", "value_asof")


@query(
    "asof_nulls",
    """WITH e AS (SELECT event_id, event_type, value, CASE WHEN event_id % 7 <> 0 THEN ts END AS ts,
   CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id FROM events),
 l AS (SELECT event_id, ts, user_id FROM e WHERE event_type = 'purchase'),
 r AS (SELECT ts, user_id, value FROM e WHERE event_type = 'view')
 SELECT l.event_id, r.ts AS ts_asof, r.value AS value_asof FROM l ASOF LEFT JOIN r
  ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_nulls(spark, sf):
    """Rows without a time or a user match nothing."""
    events = read(spark, sf, "events").select(
        "event_id", "event_type", "value", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"),
        F.when(F.col("event_id") % 11 != 0, F.col("user_id")).alias("user_id"),
    )
    left = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = events.where("event_type = 'view'").select("event_id", "ts", "user_id", "value")
    out = asof_join(left, right, "ts", ["user_id"], ["value"], ["event_id"], ["event_id"])
    return out.select("event_id", "ts_asof", "value_asof")


@query(
    "asof_tolerance",
    """WITH l AS (SELECT event_id, ts, user_id FROM events WHERE event_type = 'purchase'),
 r AS (SELECT ts, user_id, value FROM events WHERE event_type = 'view')
 SELECT l.event_id, CASE WHEN l.ts - r.ts <= INTERVAL 12 HOUR THEN r.value END AS value_asof FROM l ASOF LEFT JOIN r
  ON l.user_id = r.user_id AND l.ts >= r.ts""",
)
def asof_tolerance(spark, sf):
    events = read(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
    left = events.where("event_type = 'purchase'").select("event_id", "ts", "user_id")
    right = events.where("event_type = 'view'").select("event_id", "ts", "user_id", "value")
    out = asof_join(left, right, "ts", ["user_id"], ["value"], ["event_id"], ["event_id"], tolerance="12 hours")
    return out.select("event_id", "value_asof")


@query(
    "conformal_band",
    f"""WITH f AS ({SPLIT_SQL}), v AS (SELECT abs(y_true - y_pred) AS r, row_number() OVER (ORDER BY abs(y_true - y_pred)) AS i,
  count(*) OVER () AS n FROM f WHERE split = 'val'),
 q AS (SELECT max(r) AS radius FROM v WHERE i = ceil((n + 1) * 0.9))
 SELECT split, count(*) AS rows, avg(CASE WHEN abs(y_true - y_pred) <= radius THEN 1.0 ELSE 0.0 END) AS coverage,
  2 * any_value(radius) AS width FROM f, q GROUP BY split""",
    six=["coverage"], digits={"width": 3},
)
def conformal_band(spark, sf):
    split = ratio_split(orders_forecast(spark, sf), ORDER_KEYS)
    banded = N.conformal_band(split.where("split = 'val'"), split, 0.1)
    return N.coverage(banded, ["split"])


STATUS_SQL = f"""WITH s AS ({EVENTS_SQL}), f AS ({EVENTS_FORECAST_SQL}),
 w AS (SELECT sum(abs(y_true - y_pred)) FILTER (WHERE timestamp < {CUT_SQL}) / sum(abs(y_true)) FILTER (WHERE timestamp < {CUT_SQL}) AS a,
  sum(abs(y_true - y_pred)) FILTER (WHERE timestamp >= {CUT_SQL}) / sum(abs(y_true)) FILTER (WHERE timestamp >= {CUT_SQL}) AS b FROM f),
 d AS (SELECT count(*) FILTER (WHERE is_drift) AS d FROM ({_shift_sql(f'timestamp >= {CUT_SQL}')})),
 n AS (SELECT count(*) AS n, date_diff('day', {CUT_SQL}, max(timestamp)) AS age FROM s WHERE timestamp >= {CUT_SQL})"""


@query(
    "retrain_triggers",
    f"""{STATUS_SQL}
 SELECT 'wape_increase' AS trigger, (b - a) / a AS value, CAST(0.05 AS DOUBLE) AS threshold, (b - a) / a > 0.05 AS fired FROM w
 UNION ALL SELECT 'drift', CAST(d AS DOUBLE), 0, d > 0 FROM d
 UNION ALL SELECT 'new_rows', CAST(n AS DOUBLE), 1000, n > 1000 FROM n
 UNION ALL SELECT 'age_days', CAST(age AS DOUBLE), 30, age > 30 FROM n""",
    six=["value"],
)
def retrain_triggers(spark, sf):
    reference, current = drift_windows(spark, sf)
    sides = events_forecast(spark, sf).withColumn("side", F.when(F.col("timestamp") < cut(), "old").otherwise("new"))
    wape = {r["side"]: r["wape"] for r in period_metrics(sides, ["side"]).collect()}
    drifted = D.mean_shift(reference, current, NUMERIC).agg(F.count_if("is_drift")).first()[0]
    status = current.agg(
        F.count(F.lit(1)).alias("new_rows"), F.datediff(F.max("timestamp"), cut()).alias("age_days")
    ).select(
        "*", F.lit(wape.get("old")).cast("double").alias("old_wape"), F.lit(wape.get("new")).cast("double").alias("new_wape"),
        F.lit(drifted).alias("drifted"),
    )
    return N.retrain_triggers(status)


def payloads(spark, sf):
    """Scoring requests made of the events; three of the five types are damaged."""
    category = (
        F.when(F.col("event_type") == "click", "category_a")
        .when(F.col("event_type") == "view", "category_b")
        .when(F.col("event_type") == "purchase", "category_c")
        .when(F.col("event_type") == "signup", "invalid_category")
    )
    second = F.when(F.col("price") > 100, "category_a").otherwise(F.col("price").cast("string"))
    return events_series(spark, sf).select(
        "event_id",
        F.create_map(
            F.lit("feature1"), F.col("feature1").cast("string"), F.lit("feature2"), second,
            F.lit("feature3"), F.col("user_id").cast("string"), F.lit("category_feature"), category,
        ).alias("features"),
    )


@query(
    "scoring_validation",
    """SELECT event_id, concat_ws(';', CASE WHEN event_type = 'error' THEN 'missing:category_feature' END,
  CASE WHEN event_type = 'signup' THEN 'category:invalid_category' END,
  CASE WHEN value > 100 THEN 'not_numeric:feature2' END) AS errors,
 event_type NOT IN ('error', 'signup') AND value <= 100 AS valid FROM events""",
)
def scoring_validation(spark, sf):
    checked = S.validate_payloads(payloads(spark, sf))
    return checked.select("event_id", F.array_join("errors", ";").alias("errors"), "valid")


@query(
    "scoring_defaults",
    """SELECT event_id, CASE WHEN event_type = 'view' THEN TIMESTAMP '2024-02-01' ELSE ts END AS timestamp,
 CASE WHEN event_type = 'click' THEN 100.0 ELSE value END AS price FROM events""",
)
def scoring_defaults(spark, sf):
    rows = events_series(spark, sf).select(
        "event_id",
        F.when(F.col("event_type") != "view", F.col("timestamp")).alias("timestamp"),
        F.when(F.col("event_type") != "click", F.col("price")).alias("price"),
    )
    return S.fill_defaults(rows, F.lit("2024-02-01").cast("timestamp_ntz"))


EVERY = 750


@query(
    "gated_batches",
    f"""WITH p AS (SELECT *, row_number() OVER (ORDER BY timestamp, event_id) AS seq FROM ({EVENTS_SQL}))
 SELECT CAST((seq - 1) // {EVERY} AS BIGINT) AS gate, count(*) AS rows, CAST(max(seq) AS BIGINT) AS last_seq,
  bool_or(seq % {EVERY} = 0) AS checked, abs(any_value(m) - avg(price)) / any_value(m) > 0.1 AS drifted
 FROM p, (SELECT avg(price) AS m FROM p WHERE timestamp < {CUT_SQL}) GROUP BY 1""",
)
def gated_batches(spark, sf):
    reference, _ = drift_windows(spark, sf)
    gated = S.gated_groups(events_series(spark, sf).select("event_id", "timestamp", "price"), ["timestamp", "event_id"], EVERY)
    sizes = gated.groupBy("gate").agg(
        F.count(F.lit(1)).alias("rows"), F.max("seq").alias("last_seq"), F.bool_or("check_here").alias("checked")
    )
    shifts = D.mean_shift(reference, gated, ["price"], by=["gate"]).select("gate", F.col("is_drift").alias("drifted"))
    return sizes.join(shifts, "gate")


@query(
    "request_ids",
    "SELECT CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS ids FROM events",
)
def request_ids(spark, sf):
    ids = S.request_id(payloads(spark, sf))
    return ids.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("request_id").alias("ids"))
