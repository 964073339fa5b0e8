"""Range-cut windows, positions and quantiles against pandas on skewed data."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import ordering as O
from tidemark.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; entity 1 holds more than a third, times tie, values repeat."""
    rng = np.random.default_rng(5)
    n = 3000
    entity = np.where(rng.random(n) < 0.4, 1, rng.integers(2, 60, n))
    pdf = pd.DataFrame(
        {
            "entity": entity,
            "t": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 400, n), unit="h"),
            "id": rng.permutation(n),
            "x": np.where(rng.random(n) < 0.35, 7.0, rng.normal(size=n).round(2)),
        }
    )
    return pdf, spark.createDataFrame(pdf)


@pytest.mark.parametrize("rows_per_range", [40, 150, 10**9])
def test_positions(skewed, rows_per_range):
    pdf, df = skewed
    want = pdf.sort_values(["t", "id"]).assign(pos=range(len(pdf))).set_index("id")["pos"].sort_index()
    got = O.positions(df, ["t", "id"], rows_per_range=rows_per_range).toPandas().set_index("id")["pos"].sort_index()
    assert (got == want).all()
    want = pdf.sort_values(["t", "id"]).assign(p=lambda d: d.groupby("entity").cumcount()).set_index("id")["p"].sort_index()
    got = O.positions(df, ["t", "id"], ["entity"], rows_per_range=rows_per_range)
    assert (got.toPandas().set_index("id")["pos"].sort_index() == want).all()


@pytest.mark.parametrize("by", [[], ["entity"]])
@pytest.mark.parametrize("rows_per_range", [25, 150, 10**9])
def test_lookback(skewed, rows_per_range, by):
    pdf, df = skewed

    def columns(w):
        return {
            "lag30": F.lag("x", 30).over(w),
            "mean90": F.avg("x").over(w.rowsBetween(-89, 0)),
            "std90": F.stddev_samp("x").over(w.rowsBetween(-89, 0)),
        }

    got = O.over_order(df, columns, order=["t", "id"], by=by, reach=90, rows_per_range=rows_per_range).toPandas()
    assert len(got) == len(pdf)
    s = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    if by:
        g = s.groupby("entity")["x"]
        s["lag30"] = g.shift(30)
        s["mean90"] = g.transform(lambda v: v.rolling(90, min_periods=1).mean())
        s["std90"] = g.transform(lambda v: v.rolling(90, min_periods=1).std())
    else:
        s["lag30"], r = s["x"].shift(30), s["x"].rolling(90, min_periods=1)
        s["mean90"], s["std90"] = r.mean(), r.std()
    a, b = got.set_index("id").sort_index(), s.set_index("id").sort_index()
    for c in ("lag30", "mean90", "std90"):
        assert np.allclose(a[c], b[c], equal_nan=True), c


def test_no_single_task_window_beyond_the_limit(skewed):
    _, df = skewed
    out = O.over_order(
        df, lambda w: {"l": F.lag("x", 1).over(w)}, order=["t", "id"], reach=1, rows_per_range=100
    )
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", [[], ["entity"]])
@pytest.mark.parametrize("rows_per_range", [60, 10**9])
def test_quantiles(skewed, by, rows_per_range):
    pdf, df = skewed
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, "x", probs, by, rows_per_range=rows_per_range).toPandas()
    if by:
        for _, row in got.iterrows():
            want = np.percentile(pdf.loc[pdf.entity == row.entity, "x"], [100 * p for p in probs])
            assert np.allclose(list(row.quantiles), want)
        assert len(got) == pdf.entity.nunique()
    else:
        assert np.allclose(list(got.quantiles[0]), np.percentile(pdf.x, [100 * p for p in probs]))


@pytest.mark.parametrize("rows_per_range", [60, 10**9])
def test_cumulative_counts(skewed, rows_per_range):
    pdf, df = skewed
    got = O.cumulative_counts(df, ["entity"], "x", {"n": F.count(F.lit(1))}, rows_per_range).toPandas()
    want = pdf.groupby(["entity", "x"]).size().rename("n").reset_index()
    want["cum_n"] = want.groupby("entity")["n"].cumsum()
    m = got.merge(want, on=["entity", "x"], suffixes=("", "_w"))
    assert len(m) == len(got) == len(want)
    assert (m.n == m.n_w).all() and (m.cum_n == m.cum_n_w).all()


def test_nulls_last(spark):
    df = spark.createDataFrame([(None, 1), (3, 2), (1, 3)], "t int, id int")
    for limit in (1, 100):
        got = {r.id: r.pos for r in O.positions(df, ["t", "id"], rows_per_range=limit).collect()}
        assert got == {3: 0, 2: 1, 1: 2}


@pytest.mark.parametrize("safe", [False, True])
@pytest.mark.parametrize("by", [None, "entity"])
@pytest.mark.parametrize("limit", [160, None])
def test_all_features_with_gaps(skewed, spark, by, safe, limit):
    """All rolling columns against pandas, with missing targets, on both paths."""
    from tidemark.operators.features import create_all_features
    from tidemark.roles import Roles

    pdf, _ = skewed
    pdf = pdf.assign(x=pdf.x.where(pdf.id % 9 > 0))
    df = spark.createDataFrame(pdf).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    roles = Roles("t", "x", by, ("id",))
    got = create_all_features(df, roles, safe=safe, rows_per_range=limit).toPandas().set_index("id").sort_index()
    assert not [c for c in got.columns if c.startswith("__")]
    s = pdf.sort_values(["t", "id"]).reset_index(drop=True)
    groups = s.groupby("entity")["x"] if by else [(0, s["x"])]
    for k in (7, 30, 90):
        made = {"mean": [], "std": [], "min": [], "max": []}
        for _, v in groups:
            roll = (v.shift(1) if safe else v).rolling(k, min_periods=1)
            for name in made:
                made[name].append(getattr(roll, name)())
        for name, parts in made.items():
            s[f"x_rolling_{name}_{k}"] = pd.concat(parts)
    s = s.set_index("id").sort_index()
    for c in [c for c in s.columns if "rolling" in c]:
        assert np.allclose(got[c].astype(float), s[c], equal_nan=True, atol=1e-7), c
