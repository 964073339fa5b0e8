"""Maximum mean discrepancy with a Gaussian kernel, in time linear in the rows.

``blocked``: both samples are dealt into blocks of bounded size, the
unbiased statistic of Gretton et al. (2012) is taken inside each block and
averaged (the B-test of Zaremba et al., 2013).

``random_features``: means of random Fourier features (Rahimi and Recht,
2007) per sample, from partial sums per partition.

p-values of these two come from relabelling the rows.

``FourierSums``: the same features summed once over a reference, in a table of
fixed size that can be added to and stored; a later check reads only its batch.
Its p-values come from the reference's covariance of the features.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.ordering import GroupShape, positions

BLOCK_ROWS = 128
FEATURES = 2_048
STORED_FEATURES = 256  # features of a stored baseline: 256 x 256 numbers


class TooFewRows(ValueError):
    """A sample without two rows has no unbiased statistic."""


def _samples(df: DataFrame, vector: str, is_reference: Column, key: str) -> tuple[DataFrame, int, int]:
    rows = df.where(F.col(vector).isNotNull()).select(
        F.col(key).alias("key"), is_reference.alias("ref"), F.col(vector).cast("array<double>").alias("v")
    )
    row = rows.agg(F.count_if("ref"), F.count_if(~F.col("ref"))).first()
    return rows, row[0], row[1]


def _finish(stats: DataFrame, n: int, m: int, threshold: float) -> DataFrame:
    """One row from per-relabelling statistics; number 0 is the true labelling."""
    observed = F.max(F.when(F.col("perm") == 0, F.col("stat")))
    one = stats.agg(observed.alias("mmd2"), F.collect_list(F.when(F.col("perm") > 0, F.col("stat"))).alias("null_stats"))
    above = F.size(F.filter("null_stats", lambda s: s >= F.col("mmd2")))
    p = F.try_divide(above.cast("double"), F.size("null_stats"))
    return one.select(
        F.lit(n).cast("long").alias("ref_rows"), F.lit(m).cast("long").alias("cur_rows"), "mmd2", p.alias("p_value"),
        (p < threshold).alias("is_drift"),
    )


def blocked(
    df: DataFrame,
    vector: str,
    is_reference: Column,
    key: str,
    sigma: float = 1.0,
    permutations: int = 100,
    block_rows: int = BLOCK_ROWS,
    threshold: float = 0.05,
    seed: int = 7,
) -> DataFrame:
    """Unbiased statistic per block, averaged over blocks; the same definition at every size.

    Each sample, in the order of ``md5(key)``, is dealt in turn into parts of ``block_rows / 2`` rows or a little more
    (one part if it has fewer).  There are as many blocks as the larger number of parts; the sample with fewer parts
    goes round again, so unequal samples need no other method and every average stays unbiased.
    """
    rows, n, m = _samples(df, vector, is_reference, key)
    if min(n, m) < 2:
        raise TooFewRows("each sample needs at least two rows")
    half = max(block_rows // 2, 2)
    parts = [max(1, n // half), max(1, m // half)]
    shuffled = rows.withColumn("h", F.md5(F.col("key").cast("string").cast("binary")))
    dealt = positions(shuffled, ["h", "key"], ["ref"], shape=GroupShape(n + m, 2, max(n, m)))
    own = F.when(F.col("ref"), parts[0]).otherwise(parts[1])
    turns = F.sequence((F.col("pos") % own).cast("int"), F.lit(max(parts) - 1), own.cast("int"))
    dealt = dealt.withColumn("block", F.explode(turns))

    def statistic(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("key")
        x = np.stack(block["v"].to_numpy())
        ref = block["ref"].to_numpy().astype(float)
        sq = (x * x).sum(1)
        kernel = np.exp(-np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0) / (2 * sigma**2))
        np.fill_diagonal(kernel, 0.0)
        rng = np.random.default_rng([seed, int(block["block"].iloc[0])])
        a = np.stack([ref, *(rng.permutation(ref) for _ in range(permutations))], axis=1)
        b = 1 - a
        ka = kernel @ a
        na, nb = ref.sum(), len(ref) - ref.sum()
        within_a, cross = (a * ka).sum(0), (b * ka).sum(0)
        within_b = kernel.sum() - within_a - 2 * cross
        stat = within_a / (na * (na - 1)) + within_b / (nb * (nb - 1)) - 2 * cross / (na * nb)
        return pd.DataFrame({"perm": np.arange(permutations + 1), "stat": stat})

    per_block = dealt.select("key", "ref", "v", "block").groupBy("block").applyInPandas(statistic, "perm int, stat double")
    return _finish(per_block.groupBy("perm").agg(F.avg("stat").alias("stat")), n, m, threshold)


def random_features(
    df: DataFrame,
    vector: str,
    is_reference: Column,
    key: str,
    sigma: float = 1.0,
    permutations: int = 100,
    features: int = FEATURES,
    threshold: float = 0.05,
    seed: int = 7,
) -> DataFrame:
    rows, n, m = _samples(df, vector, is_reference, key)
    share = n / (n + m)
    hashed = rows.select(F.xxhash64("key").alias("h"), "ref", "v")

    def relabel(h: np.ndarray, ref: np.ndarray) -> np.ndarray:
        """Row labels per relabelling, a pure function of the row's hash."""
        salts = np.random.default_rng(seed + 1).integers(1, 2**63, permutations, dtype=np.uint64) | np.uint64(1)
        mixed = h.astype(np.uint64)[:, None] * salts[None, :]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
        fake = mixed.astype(np.float64) / 2.0**64 < share
        return np.concatenate([ref.astype(float)[:, None], fake.astype(float)], axis=1)

    def partial_sums(batches):
        """Per relabelling, the sums of the feature vectors of either side of one partition."""
        weights = phase = reference = total = counts = None
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["v"].to_numpy())
            if weights is None:
                rng = np.random.default_rng(seed)
                weights = rng.normal(0, 1 / sigma, (x.shape[1], features))
                phase = rng.uniform(0, 2 * np.pi, features)
                reference = np.zeros((permutations + 1, features))
                total, counts = np.zeros(features), np.zeros(permutations + 1)
            z = np.sqrt(2 / features) * np.cos(x @ weights + phase)
            labels = relabel(batch["h"].to_numpy(), batch["ref"].to_numpy())
            reference += labels.T @ z
            total += z.sum(0)
            counts += labels.sum(0)
        if weights is not None:
            yield pd.DataFrame(
                {"perm": np.arange(permutations + 1), "na": counts, "a": list(reference), "b": list(total - reference)}
            )

    parts = hashed.mapInPandas(partial_sums, "perm int, na double, a array<double>, b array<double>")
    sums = parts.groupBy("perm").agg(
        F.sum("na").alias("na"),
        vector_to_array(Summarizer.sum(array_to_vector("a"))).alias("a"),
        vector_to_array(Summarizer.sum(array_to_vector("b"))).alias("b"),
    )
    na, nb = F.col("na"), F.lit(float(n + m)) - F.col("na")
    gaps = F.zip_with("a", "b", lambda x, y: x / na - y / nb)
    stats = sums.select("perm", F.aggregate(gaps, F.lit(0.0), lambda acc, g: acc + g * g).alias("stat"))
    return _finish(stats, n, m, threshold)


@dataclass(frozen=True)
class FourierMap:
    """Random Fourier features of a Gaussian kernel: a pure function of these four numbers."""

    width: int
    features: int = STORED_FEATURES
    sigma: float = 1.0
    seed: int = 7

    def weights(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        return rng.normal(0, 1 / self.sigma, (self.width, self.features)), rng.uniform(0, 2 * np.pi, self.features)

    def apply(self, x: np.ndarray) -> np.ndarray:
        weights, phase = self.weights()
        return np.sqrt(2 / self.features) * np.cos(x @ weights + phase)


@dataclass(frozen=True)
class FourierSums:
    """What a check needs of a reference: rows, the sum of their features and the sum of the features' products.

    Sums of two parts of a reference can be added.
    """

    map: FourierMap
    rows: int
    total: np.ndarray
    second: np.ndarray

    def __add__(self, other: FourierSums) -> FourierSums:
        if self.map != other.map:
            raise ValueError("sums of different features cannot be added")
        return FourierSums(self.map, self.rows + other.rows, self.total + other.total, self.second + other.second)


def fourier_sums(df: DataFrame, vector: str, map: FourierMap) -> FourierSums:
    """Sum up the vectors of ``df`` in one pass.

    Every partition gives a row per feature, and these are added by feature, so no task gathers the tables of all
    partitions.  The driver gets the added table, whose size depends on the number of features alone.
    """

    def partial(batches):
        total, second, rows = np.zeros(map.features), np.zeros((map.features, map.features)), 0
        for batch in batches:
            if len(batch):
                z = map.apply(np.stack(batch["v"].to_numpy()))
                total += z.sum(0)
                second += z.T @ z
                rows += len(z)
        if rows:
            yield pd.DataFrame({"feature": np.arange(map.features), "n": rows, "total": total, "second": list(second)})

    whole = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = whole.mapInPandas(partial, "feature int, n long, total double, second array<double>")
    added = parts.groupBy("feature").agg(
        F.sum("n").alias("n"), F.sum("total").alias("total"), vector_to_array(Summarizer.sum(array_to_vector("second"))).alias("second")
    )
    found = sorted(added.collect(), key=lambda r: r["feature"])
    if not found:
        return FourierSums(map, 0, np.zeros(map.features), np.zeros((map.features, map.features)))
    return FourierSums(map, found[0]["n"], np.array([r["total"] for r in found]), np.array([r["second"] for r in found]))


def fourier_test(reference: FourierSums, df: DataFrame, vector: str, threshold: float = 0.05, draws: int = 1_000) -> DataFrame:
    """One row (ref_rows, cur_rows, mmd2, p_value, is_drift): a batch against stored sums.

    ``mmd2`` is the unbiased statistic of the kernel that the features define.  If nothing has changed, the difference of
    the means is about normal with the reference's covariance, so the p-value is the share of ``draws`` from there with a
    statistic as large.  The batch is read once and gives a row per partition.
    """
    map = reference.map

    def partial(batches):
        total, square, rows = np.zeros(map.features), 0.0, 0
        for batch in batches:
            if len(batch):
                z = map.apply(np.stack(batch["v"].to_numpy()))
                total += z.sum(0)
                square += float((z * z).sum())
                rows += len(z)
        if rows:
            yield pd.DataFrame({"n": [rows], "square": [square], "total": [total]})

    whole = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"))
    parts = whole.mapInPandas(partial, "n long, square double, total array<double>")
    row = parts.agg(F.sum("n"), F.sum("square"), vector_to_array(Summarizer.sum(array_to_vector("total")))).first()
    n, m = reference.rows, row[0] or 0
    if min(n, m) < 2:
        raise TooFewRows("each sample needs at least two rows")
    a, b = reference.total, np.array(row[2])
    within_a = (a @ a - np.trace(reference.second)) / (n * (n - 1))
    within_b = (b @ b - row[1]) / (m * (m - 1))
    mmd2 = float(within_a + within_b - 2 * (a @ b) / (n * m))
    covariance = reference.second / n - np.outer(a / n, a / n)
    values, vectors = np.linalg.eigh(covariance)
    values = np.maximum(values, 0)
    normal = np.random.default_rng(map.seed + 1).normal(size=(draws, map.features))
    null = (1 / n + 1 / m) * ((normal * normal) @ values - values.sum())
    p = float((null >= mmd2).mean())
    found = [(n, m, mmd2, p, p < threshold)]
    return df.sparkSession.createDataFrame(found, "ref_rows long, cur_rows long, mmd2 double, p_value double, is_drift boolean")
