"""Correlation by matrix products against pandas and against the aggregate of each pair."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import profile as P
from tidemark.operators.gram import gram_correlation


@pytest.fixture(scope="module")
def wide(spark):
    """2,000 rows in 7 partitions: gaps, large levels, an outlier, constants."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=2000)
    pdf = pd.DataFrame({f"x{i}": base * (i % 3) + rng.normal(size=2000) + 10.0 ** (i % 8) for i in range(14)})
    pdf.loc[5, "x0"] = 1e9
    pdf["flat"] = 0.1
    pdf["late"] = np.where(np.arange(2000) < 1500, np.nan, base)
    pdf["early"] = np.where(np.arange(2000) < 1400, base, np.nan)
    pdf["half"] = np.where(np.arange(2000) < 1000, 0.3, base)
    pdf["first"] = np.where(np.arange(2000) < 900, base, np.nan)
    pdf["none"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(7)


@pytest.mark.parametrize("block", [512, 6])
def test_gram_matches_pandas(wide, block):
    pdf, df = wide
    got = {(r.a, r.b): r["corr"] for r in gram_correlation(df, pdf.columns, block).collect()}
    want = pdf.corr()
    n = len(pdf.columns)
    assert len(got) == n * (n - 1) // 2
    for (a, b), r in got.items():
        if {a, b} & {"flat", "none"} or {a, b} in ({"late", "early"}, {"half", "first"}, {"late", "first"}):
            assert r is None, (a, b)
        else:
            assert abs(r - want.loc[a, b]) < 1e-9, (a, b)


def test_gram_equals_pairs(wide):
    pdf, df = wide
    some = ["x1", "x2", "late", "half", "first", "none"]
    plain = {(r.a, r.b): r["corr"] for r in P.correlation_pairs(df, some).collect()}
    for r in gram_correlation(df, some).collect():
        if plain[r.a, r.b] is None:
            assert r["corr"] is None
        else:
            assert abs(r["corr"] - plain[r.a, r.b]) < 1e-9


def test_infinite_and_empty(spark):
    df = spark.createDataFrame([(1.0, 2.0, None), (float("inf"), 3.0, None), (2.0, 4.0, 1.0), (5.0, 1.0, 2.0)], "a double, `b.c` double, c double")
    got = {(r.a, r.b): r["corr"] for r in gram_correlation(df, df.columns).collect()}
    assert np.isnan(got["a", "b.c"]) and got["a", "c"] == pytest.approx(1.0) and got["b.c", "c"] == pytest.approx(-1.0)
    empty = gram_correlation(df.limit(0), df.columns).collect()
    assert len(empty) == 3 and all(r["corr"] is None for r in empty)
