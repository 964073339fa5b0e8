"""Sparse encoding against the dense one, and with very many categories."""

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidemark.operators.preprocess import fit_columns
from tidemark.operators.sparse import fit_sparse, nonzero, vector_size


def dense(rows, size):
    return {r.id: [dict((c.place, c.value) for c in r.cells).get(i, 0.0) for i in range(size)] for r in rows}


def test_equals_dense(spark):
    data = [(1, 2.0, "b", "x"), (2, 4.0, "a", None), (3, None, None, "y"), (4, float("inf"), "c", "x"), (5, 6.0, "b", "it's")]
    df = spark.createDataFrame(data, "id long, n double, k string, l string")
    fit = df.where("id <> 4")
    sparse, plain = fit_sparse(fit, ["n"], ["k", "l"]), fit_columns(fit, ["n"], ["k", "l"])
    assert sparse.names == plain.names and sparse.starts == {"k": 1, "l": 3}
    made = sparse.apply(df, ["id"]).select("id", nonzero("features").alias("cells"), vector_size("features").alias("size"))
    rows = made.collect()
    assert {r["size"] for r in rows} == {len(sparse.names)}
    want = {r["id"]: [r[n] or 0.0 for n in plain.names] for r in plain.apply(df, ["id"]).collect()}
    got = dense(rows, len(sparse.names))
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert got[4] == [0, 0, 0, 0, 1, 0]  # no finite number, an unknown category, a known one


def test_nothing_to_encode(spark):
    df = spark.createDataFrame([(1, 2.0, None), (2, 2.0, None)], "id long, n double, k string")
    sparse = fit_sparse(df, ["n"], ["k"])
    assert sparse.names == ["num__n"] and sparse.apply(df, ["id"]).count() == 2
    only = fit_sparse(df.withColumn("k", F.lit("a")), [], ["k"])
    assert only.names == ["cat__k_a"]
    cells = only.apply(df.withColumn("k", F.when(F.col("id") == 1, "a").otherwise("b")), ["id"]).select("id", nonzero("features").alias("c"))
    assert {r.id: [(x.place, x.value) for x in r.c] for r in cells.collect()} == {1: [(0, 1.0)], 2: []}
    assert sparse.apply(df.limit(0), ["id"]).count() == 0


def test_many_categories(spark, tmp_path):
    """100,000 categories fit and score, and the model can be saved; a row keeps two non-zero places."""
    n = 100_000
    df = spark.range(n).select("id", (F.col("id") % 97).cast("double").alias("n"), F.concat(F.lit("c"), "id").alias("k"))
    df = df.withColumn("y", F.col("n") * 2 + 1)
    sparse = fit_sparse(df, ["n"], ["k"])
    assert len(sparse.names) == n + 1
    assert sparse.apply(df).agg(F.max(F.size(nonzero("features")))).first()[0] == 2
    line = LinearRegression(labelCol="y", solver="l-bfgs", maxIter=5, regParam=0.01).fit(sparse.model.transform(df))
    PipelineModel([*sparse.model.stages, line]).write().overwrite().save(str(tmp_path / "m"))
    loaded = PipelineModel.load(str(tmp_path / "m"))
    new = spark.createDataFrame([(5.0, "c5"), (5.0, "never seen"), (None, None)], "n double, k string")
    scored = [r.prediction for r in loaded.transform(new).collect()]
    assert len(scored) == 3 and scored[0] == pytest.approx(11.0, abs=5.0) and all(x == x for x in scored)
