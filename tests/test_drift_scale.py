"""Drift statistics, as-of join and MMD against NumPy / pandas on both paths."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import drift as D
from tidemark.operators import mmd as K
from tidemark.operators.asof import asof_join


def ks(a, b):
    at = np.union1d(a, b)
    gap = np.searchsorted(np.sort(a), at, "right") / len(a) - np.searchsorted(np.sort(b), at, "right") / len(b)
    return np.abs(gap).max(), gap.max(), -gap.min(), np.sum(np.abs(gap[:-1]) * np.diff(at))


@pytest.fixture(scope="module")
def samples(spark):
    rng = np.random.default_rng(8)

    def frame(n, shift):
        x = np.where(rng.random(n) < 0.35, 1.0, rng.normal(shift, 1, n).round(2))
        return pd.DataFrame({"x": x, "z": rng.gamma(2, 1, n), "w": rng.integers(0, 4, n)})

    ref, cur = frame(600, 0), frame(400, 0.3)
    return ref, cur, spark.createDataFrame(ref), spark.createDataFrame(cur)


@pytest.mark.parametrize("limit", [70, 10**9])
def test_ks_and_wasserstein(samples, limit):
    ref, cur, r, c = samples
    base = D.fit_baseline(r, ["x", "z"])
    for kind, at in (("two-sided", 0), ("greater", 1), ("less", 2)):
        got = {t.feature: t.statistic for t in D.ks_test(base, c, alternative=kind, rows_per_range=limit).collect()}
        for f in ("x", "z"):
            assert np.isclose(got[f], max(ks(ref[f], cur[f])[at], 0)), (kind, f)
    got = {t.feature: t.distance for t in D.wasserstein(base, c, rows_per_range=limit).collect()}
    for f in ("x", "z"):
        assert np.isclose(got[f], ks(ref[f], cur[f])[3])


@pytest.mark.parametrize("limit", [70, 10**9])
def test_ks_per_window(samples, limit):
    ref, cur, r, c = samples
    out = D.ks_test(D.fit_baseline(r, ["x", "z"]), c, ["w"], rows_per_range=limit).collect()
    assert len(out) == 8
    for t in out:
        assert np.isclose(t.statistic, ks(ref[t.feature], cur.loc[cur.w == t.w, t.feature])[0])


def test_kolmogorov_values(spark):
    row = spark.range(1).select(D.kolmogorov_sf(F.lit(1.36)), D.kolmogorov_sf(F.lit(1.63)), D.kolmogorov_sf(F.lit(0.0))).first()
    assert np.allclose(row, [0.0495, 0.00985, 1.0], atol=1e-4)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("limit", [60, 10**9])
def test_asof(spark, limit, strict):
    rng = np.random.default_rng(9)

    def side(n):
        k = np.where(rng.random(n) < 0.5, 1, rng.integers(2, 30, n))
        t = pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 300, n), unit="h")
        return pd.DataFrame({"k": k, "t": t, "id": np.arange(n), "v": rng.normal(size=n)})

    left, right = side(500), side(700).drop_duplicates(["k", "t"])
    out = asof_join(
        spark.createDataFrame(left[["k", "t", "id"]]), spark.createDataFrame(right[["k", "t", "v"]]), "t", ["k"], ["v"],
        ["id"], strict=strict, rows_per_range=limit,
    ).toPandas()
    want = pd.merge_asof(
        left[["k", "t", "id"]].sort_values("t"), right[["k", "t", "v"]].sort_values("t"), on="t", by="k",
        allow_exact_matches=not strict,
    )
    a, b = out.set_index("id")["v_asof"].sort_index(), want.set_index("id")["v"].sort_index()
    assert len(out) == 500 and np.allclose(a, b, equal_nan=True)


def mmd2(x, y):
    def k(a, b):
        return np.exp(-((a[:, None] - b[None]) ** 2).sum(-1) / 2)

    n, m = len(x), len(y)
    return (k(x, x).sum() - n) / (n * (n - 1)) + (k(y, y).sum() - m) / (m * (m - 1)) - 2 * k(x, y).mean()


def vectors(spark, n, m, shift):
    rng = np.random.default_rng(6)
    x, y = rng.normal(0, 1, (n, 3)), rng.normal(shift, 1, (m, 3))
    rows = [(i, True, v.tolist()) for i, v in enumerate(x)] + [(n + i, False, v.tolist()) for i, v in enumerate(y)]
    return x, y, spark.createDataFrame(rows, "id int, ref boolean, v array<double>")


def test_mmd(spark):
    x, y, df = vectors(spark, 90, 60, 0.8)
    exact = K.blocked(df, "v", F.col("ref"), "id").first()
    assert np.isclose(exact.mmd2, mmd2(x, y)) and exact.is_drift and exact.p_value < 0.05
    split = K.blocked(df, "v", F.col("ref"), "id", block_rows=40).first()
    assert abs(split.mmd2 - exact.mmd2) < 0.1 and split.is_drift
    rff = K.random_features(df, "v", F.col("ref"), "id").first()
    assert abs(rff.mmd2 - exact.mmd2) < 0.05 and rff.is_drift
    again = K.random_features(df.repartition(7), "v", F.col("ref"), "id").first()
    assert np.isclose(again.mmd2, rff.mmd2) and again.p_value == rff.p_value


def test_mmd_without_drift(spark):
    _, _, df = vectors(spark, 80, 80, 0.0)
    assert not K.blocked(df, "v", F.col("ref"), "id").first().is_drift
    assert not K.random_features(df, "v", F.col("ref"), "id").first().is_drift
    with pytest.raises(ValueError):
        K.blocked(df.where("ref OR id = 80"), "v", F.col("ref"), "id")


def test_many_categories(spark, tmp_path):
    """Fifty thousand categories, some unknown to the reference and some missing: counts alone decide."""
    from tidemark.sources.stores import load_baseline, save_baseline

    rng = np.random.default_rng(6)
    kinds = 50_000
    ref = np.concatenate([np.arange(kinds), rng.integers(0, 40, 30_000)])
    cur = np.concatenate([rng.integers(0, 60, 20_000), np.arange(kinds, kinds + 500)])
    frame = lambda values: spark.createDataFrame(
        pd.DataFrame({"c": [None if v % 1000 == 999 else f"k{v}" for v in values], "x": 1.0})
    )
    fitted = D.fit_baseline(frame(ref), ["x"], ["c"])
    assert fitted.vocabulary is None and fitted.n_features == 1 + (kinds - 50) + 1
    save_baseline(fitted, str(tmp_path))
    got = {r.feature: r for r in D.ks_test(load_baseline(spark, str(tmp_path)), frame(cur)).collect()}
    assert len(got) == fitted.n_features
    share = lambda values, k: np.mean((values == k) & (values % 1000 != 999))
    for k in [*range(60), 998, 1000, 49_998]:
        assert np.isclose(got[f"c_k{k}"].statistic, abs(share(ref, k) - share(cur, k)))
        assert (got[f"c_k{k}"].ref_rows, got[f"c_k{k}"].cur_rows) == (len(ref), len(cur))
    unknown = np.mean((cur >= kinds) & (cur % 1000 != 999))
    assert np.isclose(got["c_unknown"].statistic, unknown) and unknown > 0
    with pytest.raises(ValueError):
        fitted.matrix(frame(cur))


def test_categories_by_window(spark):
    """Counts by window agree with tests of each window alone, also where a window lacks a category."""
    rng = np.random.default_rng(7)
    make = lambda n, kinds: [(int(rng.integers(0, 4)), str(rng.choice(kinds)), float(rng.normal())) for _ in range(n)]
    base = D.fit_baseline(spark.createDataFrame(make(300, ["a", "b", "z"]), "w int, c string, x double"), ["x"], ["c"])
    cur = spark.createDataFrame(make(200, ["a", "b", "new"]) + [(9, None, 0.5)], "w int, c string, x double")
    by = {(r.w, r.feature): (r.statistic, r.cur_rows) for r in D.ks_test(base, cur, ["w"]).collect()}
    for w in (0, 9):
        for r in D.ks_test(base, cur.where(f"w = {w}")).collect():
            assert np.isclose(by[w, r.feature][0], r.statistic) and by[w, r.feature][1] == r.cur_rows
    assert len(by) == 5 * 5
