"""Two-sample drift checks of a current window against a fitted reference."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import mmd
from tidemark.operators.clean import long_form
from tidemark.operators.ordering import ROWS_PER_RANGE, cumulative_counts, group_shape, over_order
from tidemark.operators.preprocess import MAX_CATEGORIES
from tidemark.session import materialize

KOLMOGOROV_TERMS = 100
WEIGHT = "__weight"
ALTERNATIVES = ("two-sided", "less", "greater")

RESULT_SCHEMA = (
    "is_drift boolean, drift_score double, p_value double, method string, feature_name string, "
    "threshold double, timestamp timestamp"
)


def drift_matrix(df: DataFrame, numeric: Sequence[str], vocabulary: dict[str, list[str]], keep: Sequence[str] = ()) -> DataFrame:
    """Listed numerics plus 0/1 columns of the frozen vocabulary; unseen categories count in ``<c>_unknown``."""
    cells = [F.col(c).cast("double").alias(c) for c in numeric if c in df.columns]
    for c, values in vocabulary.items():
        if c not in df.columns:
            continue
        cells += [F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0)).alias(f"{c}_{v}") for v in values]
        unseen = F.col(c).isNotNull() & ~F.col(c).isin(values) if values else F.col(c).isNotNull()
        cells.append(unseen.cast("double").alias(f"{c}_unknown"))
    return df.select(*keep, *cells)


@dataclass(frozen=True)
class Baseline:
    """What later checks need of the reference: value counts per feature, the known categories, and for MMD its summed
    Fourier features or its rows.
    """

    counts: DataFrame
    numeric: tuple[str, ...]
    vocabulary: dict[str, list[str]] | None  # None for more than ``MAX_CATEGORIES``, which a matrix cannot have
    rows: DataFrame | None = None  # (key, v): the reference rows as vectors, which MMD compares
    fourier: mmd.FourierSums | None = None  # of a fixed size, so that a check reads its batch only
    categorical: tuple[str, ...] = ()
    known: DataFrame | None = None  # (feature, value): the categories of the reference
    n_features: int = 0

    @property
    def features(self) -> list[str]:
        return [*self.numeric, *[f"{c}_{v}" for c, vs in self._vocabulary().items() for v in [*vs, "unknown"]]]

    def _vocabulary(self) -> dict[str, list[str]]:
        if self.vocabulary is None:
            raise ValueError(f"more than {MAX_CATEGORIES} categories have no matrix")
        return self.vocabulary

    def matrix(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        return drift_matrix(df, self.numeric, self._vocabulary(), keep)

    def vectors(self, df: DataFrame, key: str | None = None) -> DataFrame:
        """(key, v) of the rows whose features are all present."""
        matrix = self.matrix(df, [(F.col(key).cast("string") if key else F.lit(None).cast("string")).alias("__key")])
        cells = [c for c in matrix.columns if c != "__key"]
        whole = matrix.select(F.col("__key").alias("key"), F.array(*cells).alias("v"))
        return whole.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x)))

    def moments(self) -> DataFrame:
        n, v = F.col("n"), F.col("value")
        mean = F.sum(n * v) / F.sum(n)
        return self.counts.groupBy("feature").agg(F.sum(n).alias("n"), mean.alias("mean"))


def fit_baseline(
    reference: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] = (),
    key: str | None = None,
    fourier_features: int = 0,
    sigma: float = 1.0,
) -> Baseline:
    """What checks need is computed and written here, so that none of them scans the reference again.

    ``fourier_features`` is the number of random features that MMD checks are to have; their sums have a fixed size.
    ``key`` names a row; with it the baseline also holds the reference rows, for MMD by blocks.
    """
    present = tuple(c for c in categorical if c in reference.columns)
    present_numeric = tuple(c for c in numeric if c in reference.columns)
    by_category = materialize(_category_counts(reference, present))
    known = by_category.where("value IS NOT NULL").select("feature", "value")
    counts = materialize(
        _numeric_counts(reference, present_numeric).unionByName(_indicator_counts(by_category, known)).withColumnRenamed(WEIGHT, "n")
    )
    fitted = known_categories(Baseline(counts, present_numeric, None, categorical=present, known=known))
    if key:
        fitted = replace(fitted, rows=materialize(fitted.vectors(reference, key)))
    if fourier_features:
        features = mmd.FourierMap(fitted.n_features, fourier_features, sigma)
        whole = fitted.rows if key else fitted.vectors(reference)
        fitted = replace(fitted, fourier=mmd.fourier_sums(whole, "v", features))
    return fitted


def kolmogorov_sf(x: Column) -> Column:
    """Survival function of the Kolmogorov distribution by its alternating series."""
    terms = F.transform(
        F.sequence(F.lit(1), F.lit(KOLMOGOROV_TERMS)),
        lambda k: F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(-2.0 * k * k * x * x),
    )
    total = F.aggregate(terms, F.lit(0.0), lambda a, t: a + t)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.least(total, F.lit(1.0)), F.lit(0.0)))


def _distribution_gap(pairs: DataFrame, by: Sequence[str], rows_per_range: int | None) -> DataFrame:
    """Cumulative shares of both samples at each distinct value, with totals per group."""
    measures = {"n_ref": F.sum("w_ref").cast("long"), "n_cur": F.sum("w_cur").cast("long")}
    gaps = cumulative_counts(pairs, by, "value", measures, rows_per_range)
    gaps = gaps.withColumnsRenamed({"total_n_ref": "ref_rows", "total_n_cur": "cur_rows"})
    return gaps.withColumn(
        "gap", F.try_divide(F.col("cum_n_ref"), F.col("ref_rows")) - F.try_divide(F.col("cum_n_cur"), F.col("cur_rows"))
    )


def known_categories(baseline: Baseline) -> Baseline:
    """The baseline with the number of its features, and with its categories as lists where they are few."""
    found = baseline.known.limit(MAX_CATEGORIES + 1).collect()
    n = len(found) if len(found) <= MAX_CATEGORIES else baseline.known.count()
    few = {c: sorted(r["value"] for r in found if r["feature"] == c) for c in baseline.categorical} if n == len(found) else None
    return replace(baseline, vocabulary=few, n_features=len(baseline.numeric) + n + len(baseline.categorical))


def _numeric_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    schema_keys = [*by, "feature", "value"]
    if not columns:
        return long_form(df.limit(0).withColumn("__none", F.lit(0.0)), ["__none"], keep=by).withColumn(WEIGHT, F.lit(0).cast("long"))
    values = long_form(df, columns, keep=by).where("value IS NOT NULL AND NOT isnan(value)")
    return values.groupBy(*schema_keys).agg(F.count(F.lit(1)).alias(WEIGHT))


def _category_counts(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, value, weight): rows by category, NULL among them."""
    if not columns:
        return long_form(df.limit(0).withColumn("__none", F.lit("")), ["__none"], "string", by).withColumn(WEIGHT, F.lit(0).cast("long"))
    return long_form(df, columns, "string", by).groupBy(*by, "feature", "value").agg(F.count(F.lit(1)).alias(WEIGHT))


def _indicator_counts(counts: DataFrame, known: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Value counts of the 0/1 columns of the known categories and of ``<c>_unknown``, from rows by category.

    Of ``rows`` rows ``n`` have the category, so the column is 1 in ``n`` and 0 in the others; the columns are never made.
    """
    keys = [*by, "feature"]
    total = counts.groupBy(*keys).agg(F.sum(WEIGHT).alias("rows"))
    present = counts.where("value IS NOT NULL")
    own = total.join(known, "feature").join(present, [*keys, "value"], "left")
    own = own.select(*by, F.concat_ws("_", "feature", "value").alias("name"), "rows", F.coalesce(WEIGHT, F.lit(0)).alias("n"))
    strange = present.join(known, ["feature", "value"], "left_anti").groupBy(*keys).agg(F.sum(WEIGHT).alias("n"))
    strange = total.join(strange, keys, "left")
    strange = strange.select(*by, F.concat_ws("_", "feature", F.lit("unknown")).alias("name"), "rows", F.coalesce("n", F.lit(0)).alias("n"))
    cells = [F.struct(F.lit(1.0).alias("value"), F.col("n").alias(WEIGHT)), F.struct(F.lit(0.0).alias("value"), (F.col("rows") - F.col("n")).alias(WEIGHT))]
    both = own.unionByName(strange).select(*by, F.col("name").alias("feature"), F.inline(F.array(*cells)))
    return both.where(F.col(WEIGHT) > 0)


def feature_counts(baseline: Baseline, current: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., feature, value, ``WEIGHT``): the drift matrix of ``current`` as value counts.

    Rows are counted by value or category before anything moves; counts of parts of the rows can be added.
    """
    numeric = _numeric_counts(current, [c for c in baseline.numeric if c in current.columns], by)
    present = [c for c in baseline.categorical if c in current.columns]
    return numeric.unionByName(_indicator_counts(_category_counts(current, present, by), baseline.known, by)) if present else numeric


def sample_pairs(baseline: Baseline, current: DataFrame) -> DataFrame:
    """Weighted (feature, value) rows of both samples."""
    zero = F.lit(0).cast("long")
    cur = feature_counts(baseline, current).select("feature", "value", zero.alias("w_ref"), F.col(WEIGHT).alias("w_cur"))
    ref = baseline.counts.select("feature", "value", F.col("n").alias("w_ref"), zero.alias("w_cur"))
    return ref.unionByName(cur)


def _window_gaps(baseline: Baseline, cur: DataFrame, by: Sequence[str], rows_per_range: int | None) -> DataFrame:
    """Gaps of many current windows against one reference.

    Between two values of a window its own distribution is flat, so the gap
    is extreme at a window value or just below one.  The reference share is
    therefore only looked up at the windows' values; the reference is never
    repeated per window.
    """
    keys = [*by, "feature"]
    own = cumulative_counts(cur, keys, "value", {"n_cur": F.sum(WEIGHT).cast("long")}, rows_per_range)
    zero = F.lit(0).cast("long")
    points = baseline.counts.select("feature", "value", F.col("n").alias("w_ref")).unionByName(
        cur.select("feature", "value", zero.alias("w_ref"))
    )
    ref = cumulative_counts(points, ["feature"], "value", {"n_ref": F.sum("w_ref").cast("long")}, rows_per_range)
    own = own.withColumnRenamed("total_n_cur", "cur_rows")
    joined = own.join(ref.withColumnRenamed("total_n_ref", "ref_rows"), ["feature", "value"])
    at = F.col("cum_n_ref") / F.col("ref_rows") - F.col("cum_n_cur") / F.col("cur_rows")
    below = (F.col("cum_n_ref") - F.col("n_ref")) / F.col("ref_rows") - (F.col("cum_n_cur") - F.col("n_cur")) / F.col("cur_rows")
    return joined.select("*", F.explode(F.array(at, below)).alias("gap"))


def ks_test(
    baseline: Baseline,
    current: DataFrame,
    by: Sequence[str] = (),
    alternative: str = "two-sided",
    rows_per_range: int | None = None,
) -> DataFrame:
    """Kolmogorov-Smirnov statistic and asymptotic p-value per feature."""
    if alternative not in ALTERNATIVES:
        raise ValueError(f"alternative must be one of {ALTERNATIVES}")
    keys = [*by, "feature"]
    if by:
        gaps = _window_gaps(baseline, feature_counts(baseline, current, by), by, rows_per_range)
    else:
        gaps = _distribution_gap(sample_pairs(baseline, current), keys, rows_per_range)
    return _ks_result(gaps, keys, alternative)


def ks_from_counts(
    baseline: Baseline, counts: DataFrame, by: Sequence[str], rows_per_range: int | None = None
) -> DataFrame:
    """The two-sided test for windows that are already counted: (by..., feature, value, ``WEIGHT``)."""
    return _ks_result(_window_gaps(baseline, counts, by, rows_per_range), [*by, "feature"], "two-sided")


def _ks_result(gaps: DataFrame, keys: Sequence[str], alternative: str) -> DataFrame:
    gap = F.col("gap")
    statistic = {
        "two-sided": F.max(F.abs(gap)),
        "less": F.greatest(F.max(-gap), F.lit(0.0)),
        "greater": F.greatest(F.max(gap), F.lit(0.0)),
    }[alternative]
    out = gaps.groupBy(*keys).agg(
        F.first("ref_rows").alias("ref_rows"), F.first("cur_rows").alias("cur_rows"), statistic.alias("statistic")
    )
    n, m = F.col("ref_rows").cast("double"), F.col("cur_rows").cast("double")
    effective = F.try_divide(n * m, n + m)
    d = F.col("statistic")
    if alternative == "two-sided":
        p = kolmogorov_sf(F.sqrt(effective) * d)
    else:
        p = F.exp(-2.0 * effective * d * d)
    return out.withColumn("p_value", p)


def wasserstein(baseline: Baseline, current: DataFrame, rows_per_range: int | None = None) -> DataFrame:
    """1-D earth mover's distance per feature: the area between the two distribution functions.

    With the k-th cumulative gap g_k held from value v_k to v_{k+1}, the area
    sum |g_k| (v_{k+1} - v_k) needs the next value of every row, which a
    look-back of one row gives in reversed order.
    """
    gaps = _distribution_gap(sample_pairs(baseline, current), ["feature"], rows_per_range).select(
        "feature", (-F.col("value")).alias("down"), "gap"
    )
    shape = group_shape(gaps, ["feature"])
    if shape.largest > (rows_per_range or ROWS_PER_RANGE):
        gaps = materialize(gaps)
    steps = over_order(
        gaps, lambda w: {"above": F.lag("down", 1).over(w)}, order=["down"], by=["feature"], reach=1,
        rows_per_range=rows_per_range, shape=shape,
    )
    width = F.col("down") - F.col("above")
    return steps.groupBy("feature").agg(F.coalesce(F.sum(F.abs("gap") * width), F.lit(0.0)).alias("distance"))


def with_verdict(tests: DataFrame, features: int, threshold: float = 0.05) -> DataFrame:
    """Raw and Bonferroni-corrected decisions per feature."""
    p = F.col("p_value")
    return tests.withColumn("is_drift", p < threshold).withColumn("is_drift_corrected", p < threshold / max(features, 1))


def check_batch(
    baseline: Baseline,
    current: DataFrame,
    at: Column,
    methods: Sequence[str] = ("ks",),
    threshold: float = 0.05,
    per_feature: bool = True,
    key: str | None = None,
    distance: float = 0.1,
    mmd_options: dict[str, object] | None = None,
    **limits,
) -> DataFrame:
    """Drift result rows of one batch: one row per method for the batch, one per numeric feature.

    ``ks`` tests each feature and corrects the verdict of the batch.  ``mmd`` compares whole rows, with the summed Fourier
    features of the baseline where it has them, else by blocks with its rows and ``key`` for the current ones; fewer than
    two whole rows have no statistic.  ``wasserstein`` gives distances in standard deviations of the reference; a feature
    has drifted when that is above ``distance``.  A method that cannot run gives a row whose ``status`` says why.
    """
    outs = []
    for method in methods:
        by_blocks = baseline.rows is not None and key
        if method == "mmd" and (baseline.fourier or by_blocks):
            try:
                if baseline.fourier:
                    found = mmd.fourier_test(baseline.fourier, baseline.vectors(current), "v", threshold, **(mmd_options or {}))
                else:
                    both = baseline.rows.withColumn("ref", F.lit(True)).unionByName(
                        baseline.vectors(current, key).withColumn("ref", F.lit(False))
                    )
                    found = mmd.blocked(both, "v", F.col("ref"), "key", threshold=threshold, **(mmd_options or {}))
                outs.append(_result(found, "is_drift", "mmd2", "p_value", method, None, threshold, at))
            except mmd.TooFewRows:
                outs.append(no_result(current.sparkSession, method, threshold, at, "too few rows"))
            continue
        if method == "wasserstein":
            spread = baseline.counts.groupBy("feature").agg(
                F.sum("n").alias("w"), F.sum(F.col("n") * F.col("value")).alias("x"),
                F.sum(F.col("n") * F.col("value") * F.col("value")).alias("xx"),
            ).select("feature", F.sqrt(F.greatest(F.col("xx") / F.col("w") - F.pow(F.col("x") / F.col("w"), 2), F.lit(0.0))).alias("std"))
            scaled = wasserstein(baseline, current, **limits).join(F.broadcast(spread), "feature").select(
                "feature", (F.col("distance") / F.when(F.col("std") > 0, F.col("std")).otherwise(1.0)).alias("score"), F.lit(None).cast("double").alias("p")
            )
            worst = scaled.agg(F.max("score").alias("score")).select("score", F.lit(None).cast("double").alias("p"), (F.col("score") > distance).alias("drift"))
            outs.append(_result(worst, "drift", "score", "p", method, None, distance, at))
            if per_feature:
                single = scaled.where(F.col("feature").isin(list(baseline.numeric))).withColumn("drift", F.col("score") > distance)
                outs.append(_result(single, "drift", "score", "p", method, "feature", distance, at))
            continue
        if method != "ks":
            status = "no reference rows" if method == "mmd" else "unknown method"
            outs.append(no_result(current.sparkSession, method, threshold, at, status))
            continue
        tests = ks_test(baseline, current, **limits)
        batch = tests.agg(F.max("statistic").alias("statistic"), F.min("p_value").alias("p_value")).select(
            F.lit(None).cast("string").alias("feature"), "statistic", "p_value",
            F.lit(threshold / max(baseline.n_features, 1)).alias("level"),
        )
        rows = batch
        if per_feature:
            single = tests.where(F.col("feature").isin(list(baseline.numeric)))
            rows = rows.unionByName(single.select("feature", "statistic", "p_value", F.lit(threshold).alias("level")))
        outs.append(
            rows.select(
                (F.col("p_value") < F.col("level")).alias("is_drift"), F.col("statistic").alias("drift_score"), "p_value",
                F.lit(method).alias("method"), F.col("feature").alias("feature_name"), F.lit(threshold).alias("threshold"),
                at.alias("timestamp"), F.lit("ok").alias("status"),
            )
        )
    result = outs[0]
    for o in outs[1:]:
        result = result.unionByName(o)
    return result


def no_result(spark: SparkSession, method: str, threshold: float, at: Column, status: str) -> DataFrame:
    """The row of a method that could not run."""
    return spark.range(1).select(
        F.lit(None).cast("boolean").alias("is_drift"), F.lit(None).cast("double").alias("drift_score"),
        F.lit(None).cast("double").alias("p_value"), F.lit(method).alias("method"),
        F.lit(None).cast("string").alias("feature_name"), F.lit(threshold).alias("threshold"),
        at.alias("timestamp"), F.lit(status).alias("status"),
    )


def _result(
    found: DataFrame, drift: str, score: str, p: str, method: str, feature: str | None, threshold: float, at: Column
) -> DataFrame:
    """Rows of ``RESULT_SCHEMA`` with their status."""
    return found.select(
        F.col(drift).alias("is_drift"), F.col(score).alias("drift_score"), F.col(p).alias("p_value"), F.lit(method).alias("method"),
        (F.col(feature) if feature else F.lit(None).cast("string")).alias("feature_name"), F.lit(threshold).alias("threshold"),
        at.alias("timestamp"), F.lit("ok").alias("status"),
    )


def mean_shift(
    reference: DataFrame, current: DataFrame, columns: Sequence[str], threshold: float = 0.1, mode: str = "signed",
    by: Sequence[str] = (),
) -> DataFrame:
    """Relative shift of column means; ``signed`` divides by the signed reference mean, ``abs`` by its size.

    A zero reference mean means no drift; columns missing on either side are
    skipped.  ``by`` checks several current windows at once.
    """
    if mode not in ("signed", "abs"):
        raise ValueError(f"unknown mode {mode!r}")
    shared = [c for c in columns if c in reference.columns and c in current.columns]
    ref = reference.agg(*[F.avg(c).alias(c) for c in shared]).first()
    cells = [
        F.struct(F.lit(c).alias("feature"), F.lit(ref[c]).cast("double").alias("ref_mean"), F.col(c).cast("double").alias("cur_mean"))
        for c in shared
    ]
    means = current.groupBy(*by).agg(*[F.avg(c).alias(c) for c in shared]).select(*by, F.inline(F.array(*cells)))
    base = F.col("ref_mean") if mode == "signed" else F.abs("ref_mean")
    shift = F.when(F.col("ref_mean") == 0, F.lit(0.0)).otherwise(F.try_divide(F.abs(F.col("ref_mean") - F.col("cur_mean")), base))
    return means.withColumn("shift", shift).withColumn("is_drift", F.coalesce(F.col("shift") > threshold, F.lit(False)))


def mean_shift_results(shifts: DataFrame, at: str, threshold: float = 0.1) -> DataFrame:
    """Mean-shift rows in the drift-history layout."""
    return shifts.select(
        "is_drift", F.col("shift").alias("drift_score"), F.lit(None).cast("double").alias("p_value"),
        F.lit("mean_shift").alias("method"), F.col("feature").alias("feature_name"),
        F.lit(float(threshold)).alias("threshold"), F.col(at).alias("timestamp"),
    )


HISTORY_ORDER = ("timestamp", "method", "feature_name")


def history(results: DataFrame, limit: int | None = None, order: Sequence[str] = HISTORY_ORDER) -> DataFrame:
    """The last ``limit`` results (all for None or 0), oldest first."""
    if limit:
        results = results.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(limit)
    return results.orderBy(*order)


def drift_summary(results: DataFrame, last: int = 10) -> DataFrame:
    """Totals over the history plus the drifted ones among the last ``last`` results, in one row."""
    totals = results.agg(
        F.count(F.lit(1)).alias("total_checks"),
        F.count_if("is_drift").alias("drift_detected"),
        F.sort_array(F.collect_set("method")).alias("methods_used"),
        F.max("timestamp").alias("last_check"),
    )
    recent = history(results, last).where("is_drift")
    latest = recent.agg(F.sort_array(F.collect_list(F.struct(*HISTORY_ORDER, "drift_score", "p_value", "threshold"))).alias("latest_drift"))
    rate = F.coalesce(F.try_divide(F.col("drift_detected"), F.col("total_checks")), F.lit(0.0))
    return _one_row(totals, latest).withColumn("drift_rate", rate)


def _one_row(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two one-row frames side by side."""
    both = a.unionByName(b, allowMissingColumns=True)
    return both.agg(*[F.first(c, ignorenulls=True).alias(c) for c in both.columns])


def alerts(results: DataFrame, enabled: bool = True) -> DataFrame:
    return results.where(F.col("is_drift") & F.lit(enabled))


def batch_report(results: DataFrame, batch_id: str, batch_size: int) -> DataFrame:
    """One nested row: flags, overall results, results per feature."""
    entry = F.struct("is_drift", "drift_score", "p_value", "method", "feature_name", "threshold", "timestamp")
    overall = F.col("feature_name").isNull()
    features = results.where(~overall).groupBy("feature_name").agg(F.collect_list(entry).alias("r"))
    per_feature = features.agg(
        F.map_from_entries(F.collect_list(F.struct("feature_name", "r"))).alias("f_results"),
        F.coalesce(F.max(F.exists("r", lambda x: x["is_drift"])), F.lit(False)).alias("f_detected"),
    )
    whole = results.where(overall).agg(
        F.collect_list(entry).alias("results"),
        # rows of methods that could not run have no verdict, and no verdict at all is not "no drift"
        F.when(F.count(F.lit(1)) == 0, False).otherwise(F.max("is_drift")).alias("detected"),
        F.max("timestamp").alias("timestamp"),
    )
    return _one_row(whole, per_feature).select(
        F.lit(True).alias("monitoring_enabled"),
        (F.col("detected") | F.col("f_detected")).alias("drift_detected"),
        F.lit(batch_id).alias("batch_id"),
        F.lit(batch_size).cast("long").alias("batch_size"),
        "timestamp",
        F.struct(F.col("detected").alias("detected"), F.col("results").alias("results")).alias("overall_drift"),
        F.struct(F.col("f_detected").alias("detected"), F.col("f_results").alias("results")).alias("feature_drift"),
    )
