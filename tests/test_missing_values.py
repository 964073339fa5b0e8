"""NULL, NaN and infinite values on the way through joins, scaling, splits and reports."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import mmd
from tidemark.operators.asof import asof_join
from tidemark.operators.preprocess import fit_columns
from tidemark.plans.training import feature_matrix, train
from tidemark.roles import Roles
from tidemark.sources.stores import load_baseline, save_baseline

DAY = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("limit", [None, 40])
def test_asof_without_time_or_key(spark, limit):
    def row(i):
        time = None if i % 7 == 0 else DAY + dt.timedelta(hours=i * 37 % 400)
        return i, None if i % 11 == 0 else i % 3, time, float(i)

    rows = [row(i) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, k long, t timestamp, v double")
    left, right = df.where("id % 2 = 0"), df.where("id % 2 = 1")
    got = asof_join(left, right, "t", ["k"], ["v", "id"], ["id"], ["id"], rows_per_range=limit).collect()
    assert len(got) == 150
    for r in got:
        usable = [x for x in rows if x[0] % 2 and x[1] is not None and x[2] is not None and r.k == x[1] and r.t and x[2] <= r.t]
        assert r.v_asof == (max(usable, key=lambda x: (x[2], x[0]))[3] if usable else None)


def test_scaling_over_infinite_values(spark):
    values = [1.0, 3.0, math.inf, -math.inf, math.nan, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double")
    fitted = fit_columns(df, ["x"])
    assert fitted.moments == {"x": (2.0, 1.0)}
    assert [r[1] for r in sorted(fitted.apply(df, ["i"]).collect())] == [-1.0, 1.0, None, None, None, None]
    assert [r.num__x for r in fitted.stage().transform(df).orderBy("i").collect()] == [-1.0, 1.0, 0.0, 0.0, 0.0, 0.0]


def prices(spark, price, n=100):
    rows = [(i, str(DAY + dt.timedelta(days=i)), price(i), float(i % 7), "ab"[i % 2]) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, timestamp string, price double, feature1 double, category string")


ROLES = Roles(entity=None, tie=("row_id",), numeric=("feature1",), categorical=("category",))


def test_targets_that_are_not_numbers_leave_before_the_split(spark):
    made = feature_matrix(prices(spark, lambda i: math.nan if i < 30 else 50.0 + i), ROLES)
    sizes = {r.split: r["count"] for r in made.groupBy("split").count().collect()}
    assert sizes == {"train": 42, "val": 14, "test": 14}


def test_training_over_zero_prices(spark, monkeypatch):
    from tidemark.operators.forest import SearchSpace

    df = prices(spark, lambda i: 0.0 if i == 20 else math.nan if i == 50 else 50.0 + i % 9)
    done = train(df, ROLES, trials=1, space=SearchSpace((3, 3), (2, 2), (2, 2), (1, 1)))
    score = done.test_metrics.first().asDict()
    assert all(math.isfinite(v) for k, v in score.items() if k in ("mae", "rmse", "wape"))


def test_unreadable_times_stop_training(spark):
    bad = prices(spark, lambda i: 1.0 + i).withColumn("timestamp", F.when(F.col("row_id") == 3, "soon").otherwise(F.col("timestamp")))
    with pytest.raises(ValueError, match="1 values"):
        train(bad, ROLES, trials=1)


def test_methods_of_a_batch(spark, tmp_path):
    ref = spark.range(400).selectExpr("id", "cast(id % 20 as double) as x", "if(id % 2 = 0, 'a', 'b') as c")
    cur = spark.range(90).selectExpr("id", "cast(id % 20 + 15 as double) as x", "'a' as c")
    save_baseline(D.fit_baseline(ref, ["x"], ["c"], key="id"), str(tmp_path))
    base = load_baseline(spark, str(tmp_path))
    out = D.check_batch(base, cur, F.current_timestamp(), ["ks", "mmd", "wasserstein", "other"], key="id").collect()
    whole = {r.method: r for r in out if r.feature_name is None}
    assert [whole[m].is_drift for m in ("ks", "mmd", "wasserstein", "other")] == [True, True, True, None]
    assert whole["other"].status == "unknown method"
    same = D.check_batch(base, ref, F.current_timestamp(), ["mmd", "wasserstein"], key="id").collect()
    assert not any(r.is_drift for r in same)
    none = D.check_batch(base, cur, F.current_timestamp(), ["other", "mmd"])
    assert {r.status for r in none.collect()} == {"unknown method", "no reference rows"}
    assert D.batch_report(none.drop("status"), "b", 90).first().overall_drift.detected is None


def test_mmd_is_one_statistic_at_every_size(spark):
    rows = spark.range(700).selectExpr("id", "id % 10 <> 0 as ref", "array(sin(id), cos(3 * id)) as v")
    parts = [mmd.blocked(rows.repartition(k), "v", F.col("ref"), "id", permutations=0).first().mmd2 for k in (1, 5)]
    assert math.isclose(*parts, rel_tol=1e-9)
    few = mmd.blocked(rows.where("ref or id < 20"), "v", F.col("ref"), "id", permutations=20).first()
    assert few.cur_rows == 2 and 0 <= few.p_value <= 1
