"""Exact small cases."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import numeric as N
from tidemark.functions.calendar import calendar_columns
from tidemark.operators import clean as C
from tidemark.operators import drift as D
from tidemark.operators import features as X
from tidemark.operators import profile as P
from tidemark.operators import scoring as S
from tidemark.operators import splits as L
from tidemark.operators.preprocess import fit_columns
from tidemark.roles import Roles
from tidemark.sources.tables import PRICE_SCHEMA, load_reference, load_table

TEN = [100, 105, 98, 110, 95, 102, 108, 99, 103, 107]


@pytest.fixture(scope="module")
def prices(spark):
    """100 daily rows from 2023-01-01 with three features and a category."""
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(
        {
            "timestamp": pd.date_range("2023-01-01", periods=100),
            "price": rng.uniform(100, 200, 100),
            "feature1": rng.uniform(0, 10, 100),
            "feature2": rng.uniform(0, 5, 100),
            "feature3": rng.uniform(0, 1, 100),
            "category_feature": rng.choice(["a", "b", "c"], 100),
        }
    )
    return spark.createDataFrame(pdf, PRICE_SCHEMA)


def one(spark, **cells):
    return spark.range(1).select(*[v.alias(k) for k, v in cells.items()]).first()


def test_missing_target_is_dropped(spark, prices):
    third = dt.datetime(2023, 1, 3)
    holed = prices.withColumn("price", F.when(F.col("timestamp") != third, F.col("price")))
    out = C.clean(holed)
    assert out.count() == 99 and out.where("price IS NULL").count() == 0


def test_outlier_is_kept(prices):
    big = prices.withColumn("price", F.when(F.col("timestamp") == dt.datetime(2023, 1, 5), 10000.0).otherwise(F.col("price")))
    assert C.clean(big).count() == 100


def test_empty_frame_fails(spark):
    with pytest.raises(KeyError):
        C.clean(spark.createDataFrame([], "other int"))


def test_fill_rules(spark):
    rows = [(1.0, "b", None, 5.0), (None, "a", None, 6.0), (float("nan"), None, None, 7.0), (4.0, "b", None, 8.0),
            (100.0, "a", None, None), (5.0, "a", None, float("nan"))]
    df = spark.createDataFrame(rows, "x double, c string, e string, price double")
    out = C.clean(df, "timestamp", "price").orderBy("price").collect()
    assert [r.x for r in out] == [1.0, 2.5, 2.5, 4.0]
    # a is seen once and b twice among the rows with a price; an all-null column becomes Unknown
    assert [r.c for r in out] == ["b", "a", "b", "b"]
    assert {r.e for r in out} == {"Unknown"}


def test_mode_tie_takes_the_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert C.modes(df, ["c"]) == {"c": "a"}


def test_medians_agree_beyond_one_task(prices):
    cols = ["feature1", "feature2"]
    a, b = C.medians(prices, cols), C.medians(prices, cols, rows_per_range=10)
    assert all(math.isclose(a[c], b[c]) for c in cols)


def test_validate(spark, prices):
    assert C.validate(prices, ["price"], "timestamp")
    with pytest.raises(ValueError, match="nope"):
        C.validate(prices, ["nope"])
    with pytest.raises(ValueError, match="timestamp"):
        C.validate(spark.createDataFrame([("x",)], "t string"), ["t"], "t")


def test_safe_divide(spark):
    df = spark.createDataFrame([(10.0, 2.0), (20.0, 0.0), (30.0, 5.0)], "a double, b double")
    assert [r[0] for r in df.select(N.safe_divide(F.col("a"), F.col("b"))).collect()] == [5, 0, 6]
    assert [r[0] for r in df.select(N.safe_divide(F.col("a"), F.col("b"), 999)).collect()] == [5, 999, 6]


def test_ieee_div(spark):
    def q(a, b):
        return one(spark, q=N.ieee_div(F.lit(a).cast("double"), F.lit(b).cast("double"))).q

    assert q(1.0, 0.0) == math.inf and q(-1.0, 0.0) == -math.inf and math.isnan(q(0.0, 0.0))
    assert q(None, 0.0) is None and q(1.0, None) is None and q(6.0, 3.0) == 2


def test_iqr(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 4, 5, 100)], "values long")
    assert sorted(r[0] for r in C.iqr_filter(df, ["values", "absent"]).collect()) == [1, 2, 3, 4, 5]
    assert sorted(r[0] for r in C.iqr_filter(df, ["values"], rows_per_range=2).collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        C.iqr_filter(df, ["values"], mode="other")


def test_correlation(spark):
    df = spark.createDataFrame([(i, 2 * i, 7) for i in range(1, 6)], "col1 long, col2 long, flat long")
    m = {(r.a, r.b): r["corr"] for r in P.correlation_matrix(df, ["col1", "col2", "flat"]).collect()}
    assert len(m) == 9 and math.isclose(m["col1", "col2"], 1.0) and m["col1", "flat"] is None and m["flat", "flat"] is None


def test_wide_correlation_agrees(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame(rng.normal(size=(50, 13)), columns=[f"c{i}" for i in range(13)])
    got = P.correlation_pairs(spark.createDataFrame(pdf), list(pdf.columns)).collect()
    want = pdf.corr()
    assert len(got) == 78 and all(math.isclose(r["corr"], want.loc[r.a, r.b], abs_tol=1e-9) for r in got)


def test_formats(spark):
    row = one(
        spark, usd=N.currency(F.lit(1234.56)), eur=N.currency(F.lit(1234.56), "EUR"), neg=N.currency(F.lit(-1234.5)),
        pct=N.percentage(F.lit(0.1234)), big=N.percentage(F.lit(1234.5), 1),
    )
    assert row.asDict() == {"usd": "$1,234.56", "eur": "1,234.56 EUR", "neg": "$-1,234.50", "pct": "0.12%", "big": "1234.5%"}


def test_ten_prices(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(TEN)], "timestamp int, price long")
    roles = Roles()
    lag = [r.price_lag_1 for r in X.add_lag_features(df, roles, [1, 2]).orderBy("timestamp").collect()]
    assert lag == [None, *TEN[:-1]]
    roll = X.add_rolling_features(df, roles, [3]).orderBy("timestamp").collect()
    assert math.isclose(roll[2].price_rolling_mean_3, (100 + 105 + 98) / 3) and roll[0].price_rolling_std_3 is None
    change = X.add_change_features(df, roles, [1]).orderBy("timestamp").collect()
    assert math.isclose(change[1].price_pct_change_1, 0.05) and change[1].price_diff_1 == 5


def test_safe_features_never_see_the_row(spark):
    df = spark.createDataFrame([(i, float(p)) for i, p in enumerate(TEN)], "timestamp int, price double")
    base = X.add_rolling_features(df, Roles(), [3], safe=True)
    changed = X.add_rolling_features(df.withColumn("price", F.when(F.col("timestamp") == 9, -1.0).otherwise(F.col("price"))), Roles(), [3], safe=True)
    cols = [c for c in base.columns if c != "price"]
    assert base.select(cols).orderBy("timestamp").collect() == changed.select(cols).orderBy("timestamp").collect()


def test_all_features_count(prices):
    made = X.create_all_features(prices, Roles())
    assert len(made.columns) - len(prices.columns) == 33


def test_calendar(spark):
    def parts(text):
        return one(spark, **calendar_columns(F.lit(text).cast("timestamp_ntz")))

    assert parts("2024-12-30").week == 1 and parts("2021-01-01").week == 53
    assert parts("2024-01-01").dayofweek == 0 and parts("2024-01-07").dayofweek == 6
    assert parts("1969-12-31 23:59:59.5").timestamp_numeric == -1
    assert parts("2024-01-01 00:00:07.9").timestamp_numeric == 1704067207


def test_no_time_column_is_unchanged(spark):
    df = spark.createDataFrame([(1,)], "x int")
    assert X.add_time_features(df).columns == ["x"]


def test_ratio_split(prices):
    out = L.ratio_split(prices, ["timestamp"])
    g = {r.split: r for r in out.groupBy("split").agg(F.count("*").alias("n"), F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi")).collect()}
    assert (g["train"].n, g["val"].n, g["test"].n) == (60, 20, 20)
    assert g["train"].hi < g["val"].lo <= g["val"].hi < g["test"].lo


def test_date_split(prices):
    out = L.date_split(prices, "timestamp", ("2023-01-01", "2023-02-28"), ("2023-03-01", "2023-03-31"), ("2023-04-01", "2023-04-10"))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 58, "val": 30, "test": 9}
    only = L.date_split(prices, "timestamp", val=("2023-03-01", None))
    assert {r.split: r["count"] for r in only.groupBy("split").count().collect()} == {"train": 100}


def test_folds(prices):
    members = L.expanding_folds(prices, ["timestamp"], 3)
    for f in range(3):
        part = members.where(F.col("fold") == f)
        train, val = (part.where(F.col("role") == r).agg(F.max("pos"), F.min("pos"), F.count("*")).first() for r in ("train", "val"))
        assert train[0] < val[1] and val[2] == 25 and train[2] == 25 * (f + 1)
    with pytest.raises(ValueError):
        L.expanding_folds(prices.limit(2), ["timestamp"], 3)


def test_walk_forward(spark):
    df = spark.range(10_000)
    sizes = L.walk_forward(df, ["id"]).groupBy("period", "role").agg(F.count("*").alias("n"), F.min("pos").alias("lo")).collect()
    assert len(sizes) == 152 and all(r.n == (2000 if r.role == "train" else 500) for r in sizes)
    assert all(r.lo == (r.period - 1) * 100 + (0 if r.role == "train" else 2000) for r in sizes)
    assert L.walk_forward(spark.range(100), ["id"]).count() == 0


def test_one_hot_and_scaling(spark):
    df = spark.createDataFrame([(1.0, 4.0, "A"), (2.0, 5.0, "B"), (3.0, 6.0, "A")], "feature1 double, feature2 double, category string")
    fitted = fit_columns(df, ["feature1", "feature2"], ["category"])
    out = fitted.apply(df).orderBy("num__feature1").collect()
    assert fitted.names == ["num__feature1", "num__feature2", "cat__category_A", "cat__category_B"]
    assert math.isclose(out[0][0], -math.sqrt(1.5)) and [tuple(r)[2:] for r in out] == [(1, 0), (0, 1), (1, 0)]
    unseen = spark.createDataFrame([(1.0, 4.0, "Z"), (1.0, 4.0, None)], df.schema)
    assert [tuple(r)[2:] for r in fitted.apply(unseen).collect()] == [(0, 0), (0, 0)]
    assert [tuple(r)[-2:] for r in fitted.stage().transform(unseen).collect()] == [(0, 0), (0, 0)]
    flat = fit_columns(df.withColumn("k", F.lit(2.0)), ["k"])
    assert flat.moments["k"] == (2.0, 1.0)
    with pytest.raises(ValueError):
        fit_columns(df, [], ["category"], max_categories=1)


def test_drift_small(spark):
    rows = [(float(i + 1), i + 0.5, "AB"[i % 2]) for i in range(5)]
    df = spark.createDataFrame(rows, "feature1 double, feature2 double, category_feature string")
    base = D.fit_baseline(df, ["feature1", "feature2"], ["category_feature"])
    assert base.features == ["feature1", "feature2", "category_feature_A", "category_feature_B", "category_feature_unknown"]
    assert base.matrix(df).columns == base.features


@pytest.mark.parametrize("shift, drifted", [(0.0, False), (5.0, True)])
def test_drift_shift(spark, shift, drifted):
    rng = np.random.default_rng(2)
    ref = spark.createDataFrame(pd.DataFrame({"feature1": rng.normal(0, 1, 100)}))
    cur = spark.createDataFrame(pd.DataFrame({"feature1": rng.normal(shift, 1, 50)}))
    out = D.check_batch(D.fit_baseline(ref, ["feature1"]), cur, F.current_timestamp()).collect()
    assert len(out) == 2 and all(r.is_drift == drifted for r in out)


def test_unknown_method_is_reported(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "x double")
    out = D.check_batch(D.fit_baseline(df, ["x"]), df, F.current_timestamp(), ["ks", "other"]).collect()
    assert {r.status for r in out} == {"ok", "unknown method"}


def test_mean_shift(spark):
    ref = spark.createDataFrame([(float(i), 10.0 * i, -1.0, 0.0) for i in range(1, 6)], "feature1 double, feature2 double, neg double, zero double")
    cur = ref.select(F.col("feature1") + 0.1, F.col("feature2") + 1, F.col("neg") - 1, F.col("zero") + 1).toDF(*ref.columns)
    cols = ["feature1", "feature2", "neg", "zero", "absent"]
    signed = {r.feature: r.is_drift for r in D.mean_shift(ref, cur, cols).collect()}
    assert signed == {"feature1": False, "feature2": False, "neg": False, "zero": False}
    assert {r.feature: r.is_drift for r in D.mean_shift(ref, cur, cols, mode="abs").collect()}["neg"] is True


def test_summary_and_history(spark):
    t = dt.datetime(2024, 1, 1)
    rows = [(d, 0.1, 0.5, m, None, 0.05, t + dt.timedelta(hours=i)) for i, (d, m) in enumerate([(False, "ks"), (True, "mmd"), (False, "ks")])]
    df = spark.createDataFrame(rows, D.RESULT_SCHEMA)
    s = D.drift_summary(df).first()
    assert (s.total_checks, s.drift_detected, s.methods_used) == (3, 1, ["ks", "mmd"]) and math.isclose(s.drift_rate, 1 / 3)
    assert len(s.latest_drift) == 1 and s.last_check == t + dt.timedelta(hours=2)
    empty = D.drift_summary(df.limit(0)).first()
    assert (empty.total_checks, empty.drift_detected, empty.methods_used, empty.latest_drift) == (0, 0, [], [])
    assert [r.timestamp for r in D.history(df, 2).collect()] == [t + dt.timedelta(hours=1), t + dt.timedelta(hours=2)]
    assert D.history(df, 0).count() == D.history(df).count() == 3
    assert D.alerts(df).count() == 1 and D.alerts(df, False).count() == 0


def test_gate(spark):
    out = S.gated_groups(spark.range(7), ["id"], 5).orderBy("id").collect()
    assert [r.check_here for r in out] == [False] * 4 + [True, False, False] and [r.gate for r in out] == [0] * 5 + [1] * 2


def test_payload_cases(spark):
    full = {"feature1": "1.5", "feature2": "2", "feature3": "0.3", "category_feature": "category_a"}
    cases = [
        (1, full),
        (2, {k: v for k, v in full.items() if k != "category_feature"}),
        (3, {**full, "feature2": "category_a"}),
        (4, {**full, "category_feature": "invalid_category"}),
    ]
    df = spark.createDataFrame(cases, "id int, features map<string,string>")
    checked = S.validate_payloads(df)
    got = {r.id: (r.valid, r.errors) for r in checked.collect()}
    assert got == {
        1: (True, []), 2: (False, ["missing:category_feature"]), 3: (False, ["not_numeric:feature2"]),
        4: (False, ["category:invalid_category"]),
    }
    assert S.accepted(checked).count() == 1 and S.rejected(checked).count() == 3
    row = S.payload_columns(S.accepted(checked)).first()
    assert (row.feature1, row.category_feature) == (1.5, "category_a")


def test_equal_width_bins(spark):
    rng = np.random.default_rng(4)
    for values in ([0, 2, 2.1, 10], list(range(51)), list(rng.normal(size=500)), [3.0, 3.0]):
        df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "i int, x double")
        lo, hi = F.lit(float(min(values))), F.lit(float(max(values)))
        got = [r[0] for r in df.orderBy("i").select(N.equal_width_bin(F.col("x"), lo, hi, 5)).collect()]
        assert got == list(pd.cut(pd.Series(values), 5, labels=False))


def test_sources(spark, prices, tmp_path):
    prices.coalesce(1).write.option("header", True).csv(str(tmp_path / "t.csv"))
    prices.coalesce(1).write.parquet(str(tmp_path / "t.parquet"))
    assert load_table(spark, str(tmp_path / "t.parquet")).count() == 100
    csv = load_table(spark, str(tmp_path / "t.csv"), PRICE_SCHEMA)
    assert csv.schema == PRICE_SCHEMA and csv.count() == 100
    assert "price" in load_reference(spark, str(tmp_path / "t.csv")).columns
    with pytest.raises(ValueError):
        load_reference(spark, "t.json")
