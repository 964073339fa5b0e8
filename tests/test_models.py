"""Model operators: invariants and brute-force checks."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import forest as R
from tidemark.operators.preprocess import fit_columns
from tidemark.operators import quantile_forest as Q
from tidemark.operators.quantile_forest import fit_quantile_forest
from tidemark.operators.scoring import score_table
from tidemark.operators.splits import contiguous_folds, fold_bounds
from tidemark.plans.training import train
from tidemark.roles import Roles
from tidemark.sources import stores as S
from tidemark.operators import drift as D

PARAMS = R.ForestParams(n_estimators=8, max_depth=4)
ROLES = Roles("timestamp", "price", None, ("id",), ("a", "b"), ("c",))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(12)
    n = 400
    pdf = pd.DataFrame(
        {"id": np.arange(n), "timestamp": pd.date_range("2023-01-01", periods=n, freq="h"), "a": rng.uniform(0, 10, n),
         "b": rng.normal(size=n), "c": rng.choice(list("xyz"), n)}
    )
    pdf["price"] = 20 + 5 * pdf.a + 3 * (pdf.c == "x") + rng.normal(0, 1, n)
    df = spark.createDataFrame(pdf).cache()
    return df, fit_columns(df, ["a", "b"], ["c"])


def test_fit_predict_save(spark, table, tmp_path):
    df, columns = table
    model = R.fit_forest(df, columns, "price", PARAMS)
    first = R.predict(model, df, ["id"], "price").orderBy("id").toPandas()
    again = R.predict(R.fit_forest(df, columns, "price", PARAMS), df, ["id"]).orderBy("id").toPandas()
    assert (first.y_pred == again.y_pred).all()
    assert first.y_pred.between(first.y_true.min(), first.y_true.max()).all()
    S.save_model(model, str(tmp_path / "m"))
    loaded = score_table(S.load_model(str(tmp_path / "m")), df.select("c", "b", "a", "id"), ["id"], ["a", "b", "c"], "3")
    got = loaded.orderBy("id").toPandas()
    assert np.allclose(got.prediction, first.y_pred) and set(got.model_version) == {"3"} and got.confidence.isna().all()
    with pytest.raises(ValueError, match="b"):
        score_table(model, df.drop("b"), ["id"], ["a", "b", "c"])


def test_importance(spark, table):
    df, columns = table
    imp = R.feature_importance(R.fit_forest(df, columns, "price", PARAMS), columns, spark)
    rows = imp.orderBy("rank").collect()
    assert np.isclose(sum(r.importance for r in rows), 1) and rows[0].feature == "num__a"
    assert np.isclose(R.importance_summary(imp).first()["mean"], 1 / len(rows))


def test_depth_is_capped_and_split_size_accepted():
    assert R.ForestParams(max_depth=50).estimator("y").getMaxDepth() == 30
    assert R.ForestParams(min_samples_split=9).estimator("y").getMaxDepth() == 30


def test_tuning(spark, table):
    df, columns = table
    part = [df.where(c) for c in ("id < 300", "id >= 300")]
    space = R.SearchSpace((3, 6), (2, 4), (2, 3), (1, 3))
    a = R.tune_holdout(*part, columns, "price", "wape", 3, space)
    b = R.tune_holdout(*part, columns, "price", "wape", 3, space, parallelism=1)
    assert [t.score for t in a.trials] == [t.score for t in b.trials]
    assert a.best.score == min(t.score for t in a.trials) and a.table(spark).count() == 3
    c = R.tune_folds(df, ["timestamp", "id"], columns, "price", 3, "tail_mae", 2, space)
    assert len(c.trials) == 2
    with pytest.raises(ValueError):
        R.tune_holdout(*part, columns, "price", "other", 1)


@pytest.fixture
def encoded(monkeypatch):
    """How often rows are scaled and encoded: the frames that the feature stages are asked to transform."""
    seen, plain = [], PipelineModel.transform

    def transform(self, dataset, params=None):
        seen.append(len(self.stages))
        return plain(self, dataset, params) if params else plain(self, dataset)

    monkeypatch.setattr(PipelineModel, "transform", transform)
    return seen


def test_cross_validation_encodes_each_row_once(table, encoded, monkeypatch):
    df, columns = table
    found = sorted(R.cross_validate(df, ["timestamp", "id"], columns, "price", PARAMS, folds=3).collect())
    assert len(encoded) == 1 and [r.fold for r in found] == [0, 1, 2]
    placed = contiguous_folds(df, ["timestamp", "id"], 3).cache()
    for fold, mae in found:
        model = R.fit_forest(placed.where(F.col("fold") != fold), columns, "price", PARAMS)
        assert np.isclose(mae, R.forecast_score(R.predict(model, placed.where(F.col("fold") == fold), [], "price"), "mae"))
    # fits that take turns give the same
    monkeypatch.setattr(R, "ROWS_AT_ONCE", 10)
    assert sorted(R.cross_validate(df, ["timestamp", "id"], columns, "price", PARAMS, folds=3).collect()) == found


def test_evaluation_encodes_each_row_once(table, encoded):
    df, columns = table
    row = R.evaluate_forest(df, ["timestamp", "id"], columns, "price", PARAMS, folds=3).first()
    assert len(encoded) == 1
    model = R.fit_forest(contiguous_folds(df, ["timestamp", "id"], 3), columns, "price", PARAMS)
    assert np.isclose(row.mae, R.forecast_score(R.predict(model, df, [], "price"), "mae"))


def test_search_encodes_each_row_once(table, encoded):
    df, columns = table[0].coalesce(1), table[1]
    part = [df.where(c) for c in ("id < 300", "id >= 300")]
    space = R.SearchSpace((3, 6), (2, 4), (2, 3), (1, 3))
    found = R.tune_holdout(*part, columns, "price", "mae", 3, space)
    assert len(encoded) == 2  # training rows and held-out rows
    model = R.fit_forest(part[0], columns, "price", found.best.params)
    assert np.isclose(found.best.score, R.forecast_score(R.predict(model, part[1], [], "price"), "mae"))


def test_search_over_folds_encodes_each_row_once(table, encoded):
    df, columns = table[0].coalesce(1), table[1]
    found = R.tune_folds(df, ["timestamp", "id"], columns, "price", 2, "mae", 2, R.SearchSpace((3, 6), (2, 4), (2, 3), (1, 3)))
    assert len(encoded) == 1
    scores = []
    for fold in range(2):
        start, end = fold_bounds(400, 2, fold)
        model = R.fit_forest(df.where(F.col("id") < start), columns, "price", found.best.params)
        held = df.where((F.col("id") >= start) & (F.col("id") < end))
        scores.append(R.forecast_score(R.predict(model, held, [], "price"), "mae"))
    assert np.isclose(found.best.score, np.mean(scores))


def test_training_job_encodes_each_row_once(table, encoded):
    df, _ = table
    done = train(df, ROLES, trials=3, space=R.SearchSpace((3, 5), (2, 4), (2, 3), (1, 2)))
    assert len(encoded) == 3  # training, validation and test rows, however many trials
    model = R.fit_forest(done.data.where("split = 'train'"), done.columns, "price", done.search.best.params)
    again = R.predict(model, done.data.where("split = 'test'"), [], "price")
    assert np.isclose(done.test_metrics.first().mae, R.forecast_score(again, "mae"))


def test_cross_validation(table):
    df, columns = table
    row = R.evaluate_forest(df, ["timestamp", "id"], columns, "price", PARAMS, folds=3).first()
    assert row.cv_mae_mean > 0 and row.mae < row.cv_mae_mean + 5 and row.directional_accuracy > 50


def test_forest_backtest(table):
    df, _ = table
    scores, predictions = R.backtest_forest(df, ["timestamp", "id"], ["a", "b"], ["c"], "price", 200, 50, 50, PARAMS)
    rows = scores.orderBy("period").collect()
    assert [r.period for r in rows] == [1, 2, 3, 4] and all(r.val_size == 50 and r.wape < 20 for r in rows)
    spans = predictions.groupBy("period").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).collect()
    assert all((r.lo, r.hi) == (200 + 50 * (r.period - 1), 249 + 50 * (r.period - 1)) for r in spans)


@pytest.mark.parametrize("cells", [64, 4])
def test_quantile_forest_is_the_weighted_quantile(table, monkeypatch, cells):
    """In one or two levels of digits, and in several."""
    monkeypatch.setattr(Q, "CELLS", cells)
    df, columns = table
    qs = (0.1, 0.5, 0.9)
    forest = fit_quantile_forest(df.where("id < 300"), columns, "price", qs, R.ForestParams(6, 4, 2, 5))
    got = {r.id: r.quantiles for r in forest.predict(df.where("id >= 300"), "id").collect()}
    leaves = forest.model.transform(df).select("id", "price", vector_to_array("leaf").alias("leaf")).toPandas()
    fit, score = leaves[leaves.id < 300], leaves[leaves.id >= 300]
    ly, lx = fit.price.to_numpy(), np.stack(fit.leaf.to_numpy())
    order = np.argsort(ly)
    assert len(got) == len(score)
    for _, row in score.iterrows():
        same = lx == np.asarray(row.leaf)[None]
        w = (same / same.sum(0)).mean(1)[order]
        for q in qs:
            want = ly[order][np.argmax(np.cumsum(w) >= q - 1e-12)]
            assert np.isclose(got[row.id][q], want)
    one = forest.predict_quantile(df.where("id = 350"), "id", 0.5).first()
    assert np.isclose(one.y_pred, got[350][0.5])
    with pytest.raises(ValueError):
        forest.predict_quantile(df, "id", 0.3)


def test_quantile_work_does_not_grow_with_the_training_rows(spark):
    """One leaf that holds ten times the rows: a level still looks at CELLS weights for each row, tree and quantile."""
    rng = np.random.default_rng(3)
    scored = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, a double")
    looked = {}
    for n in (2_000, 20_000):
        train = spark.createDataFrame([(i, float(i % 7), float(v)) for i, v in enumerate(rng.normal(size=n))], "id long, a double, y double")
        forest = fit_quantile_forest(train, fit_columns(train, ["a"]), "y", (0.5,), R.ForestParams(2, 1, 2, 5))
        leaves = Q._leaves(forest.model, scored, ["id"])
        chosen = scored.select("id", F.lit(0.5).alias("q"), F.lit(0).cast("long").alias("parent"), F.lit(0.0).alias("before"))
        sizes = []
        for level in range(forest.depth):
            seen = forest.candidates(leaves, chosen.drop("y"), "id", level)
            sizes.append(seen.count())
            chosen = forest.choose(seen, "id")
        looked[n] = sizes
        assert max(sizes) <= 5 * 2 * Q.CELLS
        direct = {r.id: r.quantiles[0.5] for r in forest.predict(scored, "id").collect()}
        assert direct == {r.id: r.y for r in chosen.collect()}
    assert len(looked[2_000]) == 2 and len(looked[20_000]) == 3


def test_quantiles_come_from_the_cells_that_hold_them(spark, monkeypatch):
    """Scored rows meet the training rows of one cell: no join of rows, trees and values; few leaves, many cells, a value that fills several
    blocks, cells dealt to several groups. A forest with too many leaves for the table still selects digit by digit, to the same values."""
    rng = np.random.default_rng(8)
    pdf = pd.DataFrame({"id": np.arange(900), "a": rng.uniform(0, 10, 900)})
    pdf["y"] = np.where(rng.uniform(size=900) < 0.3, 7.0, np.round(pdf.a + rng.normal(0, 2, 900), 2))
    pdf.loc[3, "y"] = None
    df = spark.createDataFrame(pdf).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    fit, score, qs = df.where("id < 600"), df.where("id >= 600"), (0.0, 0.1, 0.5, 1.0)
    monkeypatch.setattr(Q, "ROWS_PER_CELL", 10)
    monkeypatch.setattr(Q, "SCORED_PER_GROUP", 7)
    params, columns = R.ForestParams(5, 3, 2, 5), fit_columns(fit, ["a"])
    digits = Q.QuantileForest.candidates

    def joined(*_):
        raise AssertionError("rows met the values of their leaves")

    monkeypatch.setattr(Q.QuantileForest, "candidates", joined)
    forest = fit_quantile_forest(fit, columns, "y", qs, params)
    assert forest.table.upto.shape[1] > 50 and forest.values.where("cell % 2 = 1").count() == 1
    nameless = score.unionByName(score.limit(1).withColumn("id", F.lit(None).cast("long")))
    got = {r.id: r.quantiles for r in forest.predict(nameless, "id").collect()}
    leaves = forest.model.transform(df).select("id", "y", vector_to_array("leaf").alias("leaf")).toPandas()
    held, asked = leaves[(leaves.id < 600) & leaves.y.notna()].sort_values("y"), leaves[leaves.id >= 600]
    lx = np.stack(held.leaf.to_numpy())
    assert len(got) == len(asked) == 300
    for _, row in asked.iterrows():
        same = lx == np.asarray(row.leaf)[None]
        weight = np.cumsum((same / same.sum(0)).mean(1))
        assert all(got[row.id][q] == held.y.to_numpy()[np.argmax((weight >= q - 1e-12) & (weight > 0))] for q in qs)
    monkeypatch.setattr(Q.QuantileForest, "candidates", digits)
    monkeypatch.setattr(Q, "TABLE", 100)
    many = fit_quantile_forest(fit, columns, "y", qs, params)
    assert many.table is None and {r.id: r.quantiles for r in many.predict(score, "id").collect()} == got


def test_training_job(spark, table, tmp_path):
    df, _ = table
    done = train(
        df, ROLES, trials=2, space=R.SearchSpace((3, 5), (2, 4), (2, 3), (1, 2)), model_path=str(tmp_path / "model"),
        run_log=str(tmp_path / "runs"), run_id="r1",
    )
    logged = {r.metric: r.value for r in S.latest_metrics(spark, str(tmp_path / "runs")).collect()}
    assert len(logged) == 11 and np.isclose(logged["wape"], done.test_metrics.first().wape)
    params = {r.key: r.value for r in spark.read.parquet(str(tmp_path / "runs")).where("kind = 'param'").collect()}
    assert (params["n_train_samples"], params["n_val_samples"], params["n_test_samples"]) == ("240", "80", "80")
    assert params["n_features"] == str(len(done.columns.names))
    S.append_run(spark, str(tmp_path / "runs"), "r2", {"metric": {"wape": 1.0}})
    assert [r.run_id for r in S.latest_metrics(spark, str(tmp_path / "runs")).collect()] == ["r2"]


def test_baseline_and_history_tables(spark, table, tmp_path):
    df, _ = table
    base = D.fit_baseline(df.where("id < 200"), ["b", "a"], ["c"])
    S.save_baseline(base, str(tmp_path / "b"))
    loaded = S.load_baseline(spark, str(tmp_path / "b"))
    assert (loaded.numeric, loaded.vocabulary) == (base.numeric, base.vocabulary)
    cur = df.where("id >= 200")
    assert sorted(D.ks_test(base, cur).collect()) == sorted(D.ks_test(loaded, cur).collect())
    for day in ("2024-01-01", "2024-01-02"):
        results = D.check_batch(loaded, cur, F.lit(day).cast("timestamp")).drop("status")
        S.append_results(results, str(tmp_path / "h"))
    history = S.read_results(spark, str(tmp_path / "h"))
    assert history.count() == 6
    status = S.monitoring_status(history, {"threshold": "0.05"}).first()
    assert status.total_checks == 6 and status.config == {"threshold": "0.05"}
    S.write_report(history, {"threshold": "0.05"}, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first().total_checks == 6
