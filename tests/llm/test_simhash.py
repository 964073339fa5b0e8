"""SimHash near-duplicates against plain Python and against Spark's own XXH64."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import simhash
from tidemark.llm.frames import join_hot
from tidemark.llm.simhash import free_bits, hook, lane_pairs, majority, shingle_hashes, simhash_duplicates


def near(rng, x, flips):
    for b in rng.sample(range(64), flips):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 5])
def test_lanes(radius, monkeypatch):
    """All pairs of each bucket within the radius, at bucket sizes around the word of 64 lanes, also in many rounds."""
    monkeypatch.setattr(simhash, "JOBS", 97)
    rng = random.Random(radius)
    sizes = [1, 2, 63, 64, 65, 130, 1, 300]
    lanes, starts = [], []
    for k in sizes:
        centre = rng.getrandbits(64)
        starts.append(len(lanes))
        lanes += [near(rng, centre, rng.randint(0, 4)) for _ in range(k)]
    got = {p for a, b in lane_pairs(np.array(lanes, np.uint64), np.array(starts), list(range(64)), radius) for p in zip(a.tolist(), b.tolist())}
    bucket = np.repeat(range(len(sizes)), sizes)
    want = {
        (i, j) for i in range(len(lanes)) for j in range(i) if bucket[i] == bucket[j] and (lanes[i] ^ lanes[j]).bit_count() <= radius
    }
    assert got == want


def test_tables_cover_the_radius():
    """Whatever two bits differ, some table leaves both free; no key leaves more than 16 bits free."""
    tables = [set(t) for t in free_bits(2)]
    assert len(tables) == 28 and all(len(t) == 16 for t in tables)
    assert all(any({i, j} <= t for t in tables) for i in range(64) for j in range(i))


def test_hook():
    root = hook(np.arange(8), np.array([1, 3, 5, 7, 3]), np.array([0, 2, 4, 6, 1]))
    assert root.tolist() == [0, 0, 0, 0, 4, 4, 6, 6]


def test_hashes_are_those_of_spark(spark):
    texts = ["One two  three four", "a\tB", "", None, " \n", "Ünï Çödé straße ÀÉ Z", "x " * 5000]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").select(
        "text", F.expr("filter(split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n]+'), x -> x <> '')").alias("w")
    )
    shingle = """case when size(w) > 0 then transform(sequence(1, greatest(size(w) - 2, 1)),
        i -> xxhash64(array_join(slice(w, i, 3), ' '))) else array() end"""
    for r in rows.selectExpr("text", f"{shingle} as h").collect():
        assert shingle_hashes(r.text).view(np.int64).tolist() == (r.h or [])


def test_majority():
    assert majority(np.array([0b011, 0b001, 0b101, 0b100], np.uint64)) == 0b001  # half is not a majority
    assert majority(np.zeros(0, np.uint64)) == 0


def brute_components(rows):
    """{id: (fingerprint, component)} by comparing all rows; hashes come from the operator, counts from plain Python."""
    prints = []
    for i, t in rows:
        h = [int(x) for x in shingle_hashes(t)]
        prints.append((i, sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))))
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(prints):
        for j, b in prints[:k]:
            if (a ^ b).bit_count() <= 2:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (a, find(i)) for i, a in prints}


SCHEMA = "doc_id long, text string, fingerprint string, id int, KEPT int, part int, component_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3, 4) for i, t in rows], SCHEMA)


def test_components(spark):
    """Chains of near copies, exact copies, nulls, empty and very long texts, among clashing columns."""
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = [(500, None), (501, ""), (502, " \n"), (503, "one two"), (504, "ONE two"), (505, "w " * 100_000), (506, "x" * 200_000)]
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(100, 900))]
        for i in range(20):
            if rng.random() < 0.7:
                base = list(base)
                base[rng.randrange(len(base))] = rng.choice(vocabulary)
            rows.append((1000 - 20 * k - i, " ".join(base)))
    rng.shuffle(rows)
    want = brute_components(rows)
    got = simhash_duplicates(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id: (r.fingerprint % 2**64, r.component_id) for r in got} == want
    assert all(r.kept == (r.id == r.component_id) for r in got)
    sizes = {}
    for _, c in want.values():
        sizes[c] = sizes.get(c, 0) + 1
    assert max(sizes.values()) > 5 and len(sizes) > 12  # chains link, unrelated texts do not


def test_repeated_and_missing_ids(spark):
    rows = [(7, "a b c d e f"), (7, "p q r s t u"), (3, "p q r s t u"), (9, "a b c d e f"), (None, "a b c d e f"), (None, None), (7, None), (8, "")]
    got = simhash_duplicates(frame(spark, rows)).collect()
    assert sorted((r.id or 0, r.component_id, r.kept) for r in got) == sorted(
        [(7, 3, False)] * 3 + [(3, 3, True), (9, 3, False), (8, 3, False), (0, None, True), (0, None, True)]
    )


def test_empty_table(spark):
    assert simhash_duplicates(frame(spark, [])).count() == 0


def test_one_hot_class(spark, monkeypatch):
    """A class with most rows is joined by broadcast, others by a shuffle, to the same result."""
    rows = spark.createDataFrame([(i, i if i % 3 else 0) for i in range(3000)], "n long, k long")
    unique = rows.select("k").distinct().selectExpr("k", "k * 2 as v")
    got = join_hot(rows, unique, "k").orderBy("n").collect()
    assert [(r.n, r.v) for r in got] == [(i, 2 * i if i % 3 else 0) for i in range(3000)]


def test_query_over_the_table(spark, sf):
    """The registered query against plain Python over the whole table."""
    from tidemark.llm.queries import QUERIES

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = brute_components(rows)
    got = QUERIES["op13_simhash_near_dedup"](spark, sf).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{a:016x}", c) for i, (a, c) in want.items()}
    assert any(r.doc_id != r.component_id for r in got)
