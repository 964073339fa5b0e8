"""MinHash near-dedup with min-max hashing.

Each of ``PERMUTATIONS`` hash functions gives two values of a shingle set, its smallest and its largest, so a
signature of 2 x ``PERMUTATIONS`` values costs half the evaluations of plain MinHash and both halves are unbiased.
``ROWS`` values make a band; documents that agree on a band are candidates, and a candidate pair becomes a link only
when the full sets confirm it.  A pair at the limit (similarity 0.75) agrees on no band with probability
(1 - 0.75^5)^40 = 2e-5.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.components import components
from tidemark.llm.frames import arrow_map, fresh, materialize, sorted_groups
from tidemark.llm.words import U, mix64, seeded, windows, word_batches

WORDS = 5
PERCENT = 75
PERMUTATIONS = 100
ROWS = 5
BLOCK = 1024  # shingles hashed at once
TILE = 512  # members of a bucket that are compared with each other at once
# standard errors (0.03 at the limit, with 200 values) by which an estimate may fall short of the limit and still be confirmed
MARGIN = 5


def shingle_sets(texts: pa.Array, words: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text, in order.

    A-Z is read as a-z.  A text with fewer words than a shingle has its whole sequence as one; one without words
    (or a null) has none.
    """
    for _, hashes, offsets in word_batches(texts, lower=True):
        shingles = windows(hashes, words)
        for at, end in zip(offsets[:-1], offsets[1:]):
            if end - at >= words:
                yield np.unique(shingles[at : end - words + 1])
            elif end > at:
                # the number of words is part of the hash, so a short text equals only its like
                yield windows(hashes[at:end], int(end - at)) ^ mix64(np.array([end - at], U))
            else:
                yield np.zeros(0, U)


_FACTOR = seeded(PERMUTATIONS, 31) | U(1)
_TERM = seeded(PERMUTATIONS, 37)


def min_max(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest value of a non-empty set under each permutation."""
    low, high = np.full(PERMUTATIONS, ~U(0)), np.zeros(PERMUTATIONS, U)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), BLOCK):
            values = _FACTOR[:, None] * shingles[None, at : at + BLOCK] + _TERM[:, None]
            np.minimum(low, values.min(1), out=low)
            np.maximum(high, values.max(1), out=high)
    return low, high


_WEIGHT = seeded(ROWS, 41) | U(1)
_BAND = seeded(2 * PERMUTATIONS // ROWS, 43)


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """One key per band of ``ROWS`` signature values; the minima fill the first half of the bands, the maxima the rest."""
    rows = np.concatenate([low, high]).reshape(-1, ROWS)
    with np.errstate(over="ignore"):
        return mix64(mix64((mix64(rows) * _WEIGHT).sum(1, dtype=U)) + _BAND).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame) -> DataFrame:
    """(id, n_shingles, digest, bands, sketch) per row of ``docs`` (id, text); null but for the count for an empty set.

    ``sketch`` has a byte of each signature value; two sketches agree on about the similarity of their sets.
    """

    def run(batch: pa.RecordBatch):
        count, digests, bands, sketches = [], [], [], []
        for s in shingle_sets(batch.column(1)):
            count.append(len(s))
            low, high = min_max(s) if len(s) else (None, None)
            digests.append(_digest(s) if len(s) else None)
            bands.append(band_keys(low, high) if len(s) else None)
            sketches.append(mix64(np.concatenate([low, high])).astype(np.uint8).tobytes() if len(s) else None)
        yield {
            "id": batch.column(0),
            "n_shingles": pa.array(count, pa.int64()),
            "digest": pa.array(digests, pa.binary()),
            "bands": pa.array(bands, pa.list_(pa.int64())),
            "sketch": pa.array(sketches, pa.binary()),
        }

    return arrow_map(docs, run, "id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, members) of the full sets of the rows whose (id, digest) is in ``wanted``."""

    def run(batch: pa.RecordBatch):
        found = [
            (i, s.tobytes())
            for i, d, s in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), shingle_sets(batch.column(1)))
            if _digest(s) == d
        ]
        yield {
            "id": pa.array([i for i, _ in found], pa.int64()),
            "members": pa.array([s for _, s in found], pa.binary()),
        }

    return arrow_map(docs.join(wanted, "id").select("id", "text", "digest"), run, "id long, members binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have the similarity."""

    def run(batch: pa.RecordBatch):
        a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        keep = []
        for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
            s, t = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
            both = len(np.intersect1d(s, t, assume_unique=True))
            if 100 * both >= percent * (len(s) + len(t) - both):
                keep.append(i)
        yield {"a": pa.array([a[i] for i in keep], pa.int64()), "b": pa.array([b[i] for i in keep], pa.int64())}

    joined = pairs.join(sets.select(F.col("id").alias("a"), F.col("members").alias("x")), "a")
    joined = joined.join(sets.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")
    return arrow_map(joined.select("a", "b", "x", "y"), run, "a long, b long")


def _possible(percent: int):
    """The set sizes alone allow the similarity."""
    return 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """(id, n_shingles, component_id, kept) for each row of ``docs``.

    Rows with the same id are one document whose texts all count.  Rows without an id link with nothing: their
    component is null and they are kept; the same goes, with their own id as component, for rows without words.
    Of a component the document with the smallest id is kept; repeated rows of it all are.

    Texts with equal sets are one class, represented by its smallest id; only classes are banded.  In every bucket the
    smallest and the largest id are compared with all others (a star each way).  What these links leave apart within a
    bucket is then compared in tiles, so that no bucket hides a link behind its centre.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialize(signatures(rows))
    known = signed.where("id is not null and digest is not null")
    classes = known.groupBy("digest").agg(
        F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    bucket = "partition by band"
    buckets = materialize(
        classes.select("rep", "n", "digest", F.explode("bands").alias("band"))
        .selectExpr("*", f"count(*) over ({bucket}) as size")
        .where("size > 1")
        .selectExpr("band", "rep", "n", "digest")
    )
    stars = []
    for pick in ("min", "max"):
        hub = buckets.selectExpr("*", f"{pick}(struct(rep, n)) over ({bucket}) as hub")
        stars.append(hub.selectExpr("rep as a", "n as n_a", "hub.rep as b", "hub.n as n_b"))
    sets = materialize(_sets(rows, buckets.selectExpr("rep as id", "digest").distinct()))
    links = materialize(_confirm(_ordered(stars[0].union(stars[1]), percent), sets, percent))
    more = _across(buckets, known, components(links), sets, percent)
    # a repeated id ties its classes together
    reps = known.select("id", "digest").join(classes.select("digest", "rep"), "digest")
    several = known.groupBy("id").agg(F.count_distinct("digest").alias("k")).where("k > 1").select("id")
    ties = reps.join(several, "id").selectExpr("id as a", "rep as b")
    label = components(links.union(more).union(ties))
    member = (
        reps.join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .groupBy("id")
        .agg(F.min(F.coalesce("component", "rep")).alias("component_id"))
    )
    return (
        signed.select("id", "n_shingles")
        .join(member, "id", "left")
        .select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.expr("id is null or id = component_id"))
    )


def _across(buckets: DataFrame, known: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of a bucket that ``label`` leaves apart.

    A bucket is cut into blocks of ``TILE`` members and each two blocks meet in a tile, a group of bounded size.  A first
    pass compares sketches and leaves only members with a possible partner; the second has their full sets, and skips
    pairs that the links found before it in the tile already connect.  A pair is looked at in its first common band only.
    """
    bucket = "partition by band"
    apart = (
        buckets.join(label.withColumnRenamed("node", "rep"), "rep", "left")
        .selectExpr("band", "rep", "n", "digest", "coalesce(component, rep) as component")
        .selectExpr("*", f"min(component) over ({bucket}) as low", f"max(component) over ({bucket}) as high")
        .where("low < high")
        .selectExpr(
            "band", "rep", "n", "digest", "component",
            f"cast((row_number() over ({bucket} order by rep, digest) - 1) div {TILE} as int) as block",
            f"cast((count(*) over ({bucket}) - 1) div {TILE} as int) as last",
        )
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
        .selectExpr("band", "least(block, other) as lo", "greatest(block, other) as hi", "block", "rep", "n", "digest", "component")
    )
    values = known.groupBy("digest").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    tiles = materialize(apart.join(values, "digest"))
    near = percent / 100 - MARGIN * (percent / 100 * (1 - percent / 100) / (2 * PERMUTATIONS)) ** 0.5
    fields = "band long, lo int, hi int, block int, rep long, n long, component long, bands array<long>, sketch binary"
    names = [f.split()[0] for f in fields.split(", ")]

    def possible(t: pa.Table) -> dict[str, pa.Array] | None:
        used = np.zeros(t.num_rows, bool)
        for i, js, _ in _tile_pairs(t, near, percent):
            used[i] = True
            used[js] = True
        return {c: t[c].filter(pa.array(used)).combine_chunks() for c in names} if used.any() else None

    def linked(t: pa.Table) -> dict[str, pa.Array] | None:
        members = [np.frombuffer(x.as_buffer(), U) for x in t["members"]]
        rep, root = t["rep"].to_pylist(), {c: c for c in t["component"].to_pylist()}
        component = t["component"].to_pylist()

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        pairs = [(e, i, j) for i, js, es in _tile_pairs(t, near, percent) for j, e in zip(js.tolist(), es.tolist())]
        found = []
        for _, i, j in sorted(pairs, key=lambda p: -p[0]):
            x, y = find(component[i]), find(component[j])
            if x == y:
                continue
            both = len(np.intersect1d(members[i], members[j], assume_unique=True))
            if 100 * both >= percent * (len(members[i]) + len(members[j]) - both):
                root[x] = y
                found.append((rep[i], rep[j]))
        if not found:
            return None
        return {"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())}

    tile = ["band", "lo", "hi"]
    left = materialize(sorted_groups(tiles.select(*names), tile, possible, fields))
    full = left.join(sets.withColumnRenamed("id", "rep"), "rep")
    return materialize(sorted_groups(full, tile, linked, "a long, b long"))


def _tile_pairs(t: pa.Table, near: float, percent: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(i, [j], [estimate]) of a tile's pairs in different components whose sizes and sketches allow the similarity."""
    m = t.num_rows
    n, component = t["n"].to_numpy(), t["component"].to_numpy()
    band, lo, hi = t["band"][0].as_py(), t["lo"][0].as_py(), t["hi"][0].as_py()
    block = t["block"].to_numpy()
    bands = t["bands"].combine_chunks().flatten().to_numpy().reshape(m, -1)
    sketch = np.frombuffer(b"".join(t["sketch"].to_pylist()), np.uint8).reshape(m, -1)
    for i in range(m):
        j = np.flatnonzero((component != component[i]) & (100 * np.minimum(n, n[i]) >= percent * np.maximum(n, n[i])))
        # every pair once: in the tile of its two blocks, from its first member
        j = j[j > i] if lo == hi else j[(block[j] == hi) & (block[i] == lo)]
        if not len(j):
            continue
        same = bands[j] == bands[i]
        j = j[bands[i][same.argmax(1)] == band]
        estimate = (sketch[j] == sketch[i]).mean(1)
        keep = estimate >= near
        if keep.any():
            yield i, j[keep], estimate[keep]


def _ordered(pairs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (smaller id, larger id) whose sizes allow a link."""
    return (
        pairs.where("a <> b").where(_possible(percent)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """``docs`` with one document of each component, all columns; one row of each repeated id stays.

    Of repeated ids the row with the smallest text (null last) stays.  Rows without an id all stay.
    """
    key, copies, rank = fresh(docs, "kept_id", "copies", "copy_rank")
    found = near_duplicates(docs, id_col, text_col, percent).where("id is not null and kept")
    keep = materialize(found.groupBy(F.col("id").alias(key)).agg(F.count("*").alias(copies)))
    joined = docs.join(keep, F.col(f"`{id_col}`").cast("long") == F.col(key), "left")
    joined = joined.where(F.col(f"`{id_col}`").isNull() | F.col(key).isNotNull())
    if keep.where(F.col(copies) > 1).take(1):
        # only repeated ids are sorted
        order = f"row_number() over (partition by `{id_col}` order by `{text_col}` nulls last) as `{rank}`"
        several = joined.where(F.col(copies) > 1).selectExpr("*", order).where(f"`{rank}` = 1").drop(rank)
        joined = joined.where(f"coalesce(`{copies}`, 1) = 1").unionByName(several)
    return joined.drop(key, copies)
