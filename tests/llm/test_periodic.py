"""Periodic runs against a search of every diagonal."""

import hashlib
import random
import time
import zlib

import pyarrow.parquet as pq
import pytest

from tests.llm import brute
from tidemark.llm import periodic, words
from tidemark.llm.periodic import periodic_runs


def collected(spark, rows, **options):
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, RUNS string, start int")
    out = periodic_runs(frame, **options)
    assert out.columns == ["doc_id", "text", "RUNS", "start", "_runs", "collapsed"]
    return out.collect()


def tricky(rng):
    """Word lists whose periods hold repeated words, powers, nested and overlapping runs."""
    kind = rng.randrange(6)
    alphabet = [f"v{i}" for i in range(rng.choice([1, 2, 3, 8]))]
    base = [rng.choice(alphabet) for _ in range(rng.randint(1, 12))]
    if kind == 0:
        out = base * rng.randint(1, 9)
    elif kind == 1:  # a period made of shorter runs
        out = (base[:2] * 5 + base) * rng.randint(3, 6)
    elif kind == 2:  # two runs that meet
        out = base * 5 + base[: len(base) // 2] + base[::-1] * 5
    elif kind == 3:  # Fibonacci words
        a, b = ["a"], ["a", "b"]
        for _ in range(rng.randint(3, 8)):
            a, b = b, b + a
        out = b * rng.randint(1, 4)
    elif kind == 4:
        out = base * rng.randint(4, 8)
        out[rng.randrange(len(out))] = "other"
    else:
        out = [rng.choice("ab") for _ in range(rng.randint(0, 200))]
    return [f"n{i}" for i in range(rng.randint(0, 4))] + out + [rng.choice(alphabet) for _ in range(rng.randint(0, 3))]


@pytest.mark.parametrize(("least", "times"), [(6, 4), (2, 3), (20, 5)])
def test_runs(spark, least, times):
    rng = random.Random(least)
    lists = [tricky(rng) for _ in range(400)]
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(w)) for i, w in enumerate(lists)]
    rows += [(400, None), (401, ""), (402, " \n\t "), (403, "w " * 20_000), (404, "a b " * 9 + "x" * 100_000), (0, rows[0][1])]
    got = collected(spark, rows, least=least, times=times)
    assert len(got) == len(rows)
    for r in got:
        w = brute.words(r.text)
        want = [(0, 20_000, 1)] if r.doc_id == 403 else brute.periodic(w, least, times)
        runs = [(x.start, x.length, x.period) for x in r._runs]
        assert runs == sorted(want, key=lambda x: (x[0], x[2])), (r.doc_id, w)
        assert r.collapsed == brute.without_repeats(w, want)
    assert sum(bool(r._runs) for r in got) > 100


def test_runs_do_not_cross_texts(spark):
    got = collected(spark, [(1, "a a a"), (2, "a a a"), (3, "a a a a a"), (4, "a a a a a a")])
    assert {r.doc_id: len(r._runs) for r in got} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_cut_into_pieces(spark, monkeypatch):
    """Texts hashed in many small pieces give the same runs."""
    monkeypatch.setattr(words, "CHUNK", 64)
    rng = random.Random(3)
    rows = [(i, " ".join(tricky(rng))) for i in range(60)]
    batch = spark.createDataFrame(rows, "doc_id long, text string").toArrow().combine_chunks().to_batches()[0]
    for first, hashes, offsets in words.word_batches(batch.column("text")):
        starts = periodic._repeated(hashes, offsets, 5) if len(hashes) >= 5 else []
        for i in range(len(offsets) - 1):
            own = [s - offsets[i] for s in starts if offsets[i] <= s < offsets[i + 1]]
            got = periodic._runs(hashes[offsets[i] : offsets[i + 1]], periodic.np.array(own), 5, 6, 4) if own else []
            assert [(s, n, p) for s, p, n in got] == brute.periodic(brute.words(rows[first + i][1]))


def test_long_repetitive_texts_take_seconds(spark):
    """A million equal words, and a passage that returns between other words ten thousand times."""
    often = " ".join(f"n{i} a b c d e f g" for i in range(10_000))
    started = time.time()
    got = {r.doc_id: r for r in collected(spark, [(1, "same " * 1_000_000), (2, often)])}
    assert time.time() - started < 60
    assert [tuple(x) for x in got[1]._runs] == [(0, 1_000_000, 1)] and got[1].collapsed == "same"
    assert got[2]._runs == [] and got[2].collapsed == often


def test_empty_table(spark):
    assert collected(spark, []) == []


def test_query_over_the_table(spark, sf):
    """The registered query against plain Python over the whole table, planted periods included."""
    from tidemark.llm.queries import QUERIES

    got = {r.doc_id: r for r in QUERIES["op11_periodic_runs"](spark, sf).collect()}
    source = pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(got) == len(source)
    planted = 0
    for row in source:
        w = brute.words(row["text"])
        h = zlib.crc32(str(row["doc_id"]).encode())
        if h % 10 == 0 and w:
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[a + (i - a) % p] if i >= a else w[i] for i in range(n)]
            planted += 1
        runs = sorted(brute.periodic(w), key=lambda x: (x[0], x[2]))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        r = got[row["doc_id"]]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join("{},{},{}\n".format(*x) for x in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute.without_repeats(w, runs).encode()).hexdigest()
    assert planted > 5 and any(r.n_runs for r in got.values())
