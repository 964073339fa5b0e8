"""Document operators against plain Python, with nulls, empty and long texts, ties, repeats, empty tables, odd columns."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import decontaminate, frames, line_templates, near_dups, quality, repeats, shards
from tidemark.llm.decontaminate import contaminated, drop_contaminated, tile
from tidemark.llm.words import seeded

SCHEMA = "doc_id long, text string, source string, C1 string, kept_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA)


def odd_rows():
    """Rows with nulls, empty texts, repeated ids and rows, and one very long text."""
    return [
        (900, None, "a"), (901, "", None), (902, " \n\t ", "a"), (903, "one two", None), (904, "One TWO", "a"),
        (905, "w " * 200_000, "a"), (903, "one two", None), (906, "x" * 300_000, "b"), (None, "one two", "a"), (None, None, None),
    ]


def edited(rng, vocabulary, base, share):
    return [rng.choice(vocabulary) if rng.random() < share else w for w in base]


@pytest.fixture(scope="module")
def prose():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 120))] for _ in range(25)]
    rows = []
    for i in range(260):
        base = rng.choice(bases)
        w = edited(rng, vocabulary, base, rng.choice([0, 0, 0.01, 0.03, 0.06]))
        rows.append((i, " ".join(w).replace(" ", "\n", 2) if i % 3 else " ".join(w).upper(), f"s{i % 3}"))
    rng.shuffle(rows)
    return rows


def test_near_duplicates(spark, prose):
    rows = prose + [r for r in odd_rows() if r[0] is not None]
    got = near_dups.near_duplicates(frame(spark, rows)).collect()
    want = brute.near_components([(i, t) for i, t, _ in rows])
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got} == want
    sizes = {i: len(brute.shingles(t)) for i, t, _ in rows}
    assert all(r.n_shingles == sizes[r.id] and r.kept == (r.id == r.component_id) for r in got)


def test_near_duplicates_in_tiles(spark, prose, monkeypatch):
    """Small tiles and no stars' help give the same components."""
    monkeypatch.setattr(near_dups, "TILE", 3)
    rows = prose[:150]
    got = {r.id: r.component_id for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == brute.near_components([(i, t) for i, t, _ in rows])


def test_tiles_find_links_that_stars_miss(spark, prose):
    """With no links known, the tiles alone connect what shares a band."""
    rows = spark.createDataFrame([(i, t) for i, t, _ in prose], "id long, text string")
    signed = near_dups.materialize(near_dups.signatures(rows))
    classes = signed.groupBy("digest").agg(F.min("id").alias("rep"), F.min("n_shingles").alias("n"))
    bands = signed.join(classes, "digest").where("id = rep").selectExpr("rep", "n", "digest", "explode(bands) as band")
    buckets = bands.selectExpr("*", "count(*) over (partition by band) as k").where("k > 1").drop("k")
    sets = near_dups._sets(rows, buckets.selectExpr("rep as id", "digest").distinct())
    none = spark.createDataFrame([], "node long, component long")
    links = near_dups._across(buckets, signed, none, sets, 75)
    got = {r.node: r.component for r in near_dups.components(links).collect()}
    reps = {r.rep for r in classes.collect()}
    want = brute.near_components([(i, t) for i, t, _ in prose if i in reps])
    assert {i: got.get(i, i) for i in reps} == want


def test_repeated_id_joins_its_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a, ""), (5, b, ""), (2, a, ""), (9, b, "")]
    got = {r.id: r.component_id for r in near_dups.near_duplicates(frame(spark, rows)).collect()}
    assert got == {5: 2, 2: 2, 9: 2}
    kept = near_dups.drop_near_duplicates(frame(spark, rows + [(2, a, "z"), (None, a, "")]))
    assert sorted((r.doc_id or 0, r.kept_id) for r in kept.collect()) == [(0, 1), (2, 1)]
    assert kept.columns == ["doc_id", "text", "source", "C1", "kept_id"]


def test_empty_tables(spark):
    empty = frame(spark, []).select("doc_id", "text", "source")
    items = spark.createDataFrame([], "item_id long, text string")
    assert near_dups.near_duplicates(empty).count() == 0
    assert near_dups.drop_near_duplicates(empty).count() == 0
    assert line_templates.dedup_lines(empty).count() == 0
    assert quality.quality_rules(empty, cut=True).count() == 0
    assert repeats.repeated_passages(empty).count() == 0
    assert shards.shard_rows(empty, 40).count() == 0
    assert contaminated(empty, items).count() == 0
    assert drop_contaminated(empty, items).count() == 0
    assert contaminated(frame(spark, odd_rows()), items).count() == 0


def test_base_rules(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice("a b c d # x<y | é".split()) for _ in range(rng.randint(0, 90))).replace("d ", "\n") for _ in range(150)]
    texts += ["a b c " * 300, None, "", " \n ", "\t\x0b\x0c a", "a a a", "a b", "ß" * 50_000, "l\nl\n\nl \nm"]
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    for r in quality.base_rules(frame(spark, rows)).collect():
        want = brute.base_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])


def test_line_rules(spark, monkeypatch):
    monkeypatch.setattr(quality, "LINE_LIMIT", 4)
    rng = random.Random(4)
    common = ["Read more 12 here", "read   MORE 7 here", "all rights", "x"]
    rows = []
    for i in range(120):
        own = [" ".join(f"w{rng.randrange(999)}" for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(0, 3))]
        lines = own + [rng.choice(common) for _ in range(rng.randint(0, 4))]
        rows.append((i, "\n".join(lines), rng.choice(["h", "g", None])))
    rows += [(500 + i, "copy of one text\nx", "lone") for i in range(9)]  # copies are one document
    rules = quality.line_rules(frame(spark, rows), limit=4).where("depleted")
    keyed = frame(spark, rows).select("doc_id", *quality.text_keys(frame(spark, rows), "text", "source"))
    got = {r.doc_id for r in keyed.join(rules, ["c1", "c2"], "left_semi").collect()}
    want = {r[0] for r, d in zip(rows, brute.depleted([(h, t) for _, t, h in rows], 4)) if d}
    assert got == want and want


def test_quality_cut(spark):
    letters = [a + b for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(i, "menu home\n" + " ".join(letters[i] + x for x in letters), "h") for i in range(60)] + odd_rows()
    out = quality.quality_rules(frame(spark, rows), cut=True)
    assert out.columns[:5] == ["doc_id", "text", "source", "C1", "kept_id"]
    found = {r.doc_id: r for r in out.where("doc_id < 60").collect()}
    assert all(r.kept and not r.text.startswith("menu") for r in found.values()) and len(found) == 60
    assert out.count() == len(rows) and not out.where("doc_id >= 900 and kept").count()


def test_line_templates(spark):
    rng = random.Random(2)
    variants = "user alice bob logged in from 10.0.0.1 at 12:30 error code x y".split()
    shapes = ["user alice logged in from h port 22", "error code 7 in module main", "a b", ""]

    def line():
        return " ".join(rng.choice(variants) if rng.random() < 0.25 else w for w in rng.choice(shapes).split())

    rows = [(i, "\n".join(line() for _ in range(rng.randint(0, 6))), "s") for i in range(200)] + odd_rows()
    got = line_templates.dedup_lines(frame(spark, rows), min_texts=5)
    assert got.columns == ["doc_id", "text", "source", "C1", "kept_id", "n_lines", "n_dropped"]
    want = [(r[0], *b) for r, b in zip(rows, brute.cut_lines([t for _, t, _ in rows], 5))]
    assert sorted(map(str, [tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_dropped").collect()])) == sorted(map(str, want))
    assert sum(w[3] > 0 for w in want) > 50


def test_tiling():
    rng, codes = random.Random(5), seeded(50, 99)
    for _ in range(400):
        n = rng.choice([3, 6, 20])
        b = [rng.randrange(n) for _ in range(rng.randint(3, 25))]
        cut = rng.randint(0, len(b))
        a = [rng.randrange(n) for _ in range(rng.randint(0, 15))] + b[cut:] + [rng.randrange(n) for _ in range(3)] + b[:cut]
        assert tile(codes[np.array(a)], codes[np.array(b)], 3) == brute.tiles(a, b, 3)


def test_tiling_of_few_words():
    """Two or three different words: runs overlap, and what is left of a covered run can be longer than the next one."""
    rng, codes = np.random.default_rng(8), seeded(5, 99)
    for _ in range(1500):
        n = rng.integers(1, 4)
        a, b = rng.integers(0, n, rng.integers(0, 50)), rng.integers(0, n, rng.integers(1, 25))
        assert tile(codes[a], codes[b], 3) == brute.tiles(a.tolist(), b.tolist(), 3)


def test_tiling_of_one_word():
    """200,000 equal words take a moment."""
    codes = seeded(5, 99)
    assert tile(np.repeat(codes[:1], 200_000), np.repeat(codes[:1], 100)) == [(0, 0, 100)]


CLASHING = (
    "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept counts c1 c2 drop depleted host line shard slot place bucket row at start k"
).split()


def test_clashing_names(spark):
    """Columns of the names that rules and shards use come back as they were."""
    rows = [(i, f"word {i} " * (i % 40), "s", *[f"{c}{i}" for c in CLASHING]) for i in range(60)] + [(60, None, None, *CLASHING)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"{c} string" for c in CLASHING))
    bare = quality.quality_rules(df.select("doc_id", "text", "source")).orderBy("doc_id").collect()
    judged = quality.quality_rules(df).orderBy("doc_id")
    assert judged.columns[-7:] == [*(f"_{c}" for c in quality.COUNTS), "_base_failed", "_kept"]
    for r, want, have in zip(judged.collect(), bare, rows):
        assert tuple(r)[: len(have)] == have and tuple(r)[len(have) :] == tuple(want)[3:]
    dealt = shards.shard_rows(df, 4)
    assert dealt.columns == [*df.columns, "_shard", "_slot"]
    assert sorted(tuple(r)[: len(df.columns)] for r in dealt.collect()) == sorted(rows)


def test_contaminated(spark, monkeypatch):
    rng = random.Random(6)
    vocabulary = [f"v{i}" for i in range(60)]
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([3, 12, 30])))) for k in range(20)] + [(90, None), (91, "")]
    rows = []
    for i in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]
        if i % 3 == 0:
            x = items[rng.randrange(20)][1].split()
            k = len(x) // 2
            part = x[k:] + ["zz"] + x[:k] if i % 2 else edited(rng, vocabulary, x, 0.05)
            w[10:10] = part
        rows.append((i, " ".join(w).upper(), "s"))
    rows += odd_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute.leaks([(i, t) for i, t, _ in rows if i is None or i < 905], items)
    got = {(r.id, r.item_id) for r in contaminated(frame(spark, rows), bench).collect()}
    assert got == want and len(want) > 30
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 300)
    assert {(r.id, r.item_id) for r in contaminated(frame(spark, rows), bench).collect()} == want
    leaked = {i for i, _ in want}
    clean = drop_contaminated(frame(spark, rows + [(None, items[2][1], "s")]), bench)
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(i or -1 for i, _, _ in rows if i not in leaked)


@pytest.mark.parametrize("hot_share", [1000, 1])
def test_repeats(spark, monkeypatch, hot_share):
    """Every key counts as hot, or none does; a third of the texts share one passage, in one context or in different ones."""
    monkeypatch.setattr(frames, "HOT_SHARE", hot_share)
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    passages = [[rng.choice(vocabulary) for _ in range(90)] for _ in range(10)]
    rows = []
    for i in range(200):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        for _ in range(rng.randint(0, 3)):
            at, k = rng.randint(0, 60), rng.randint(0, len(w))
            w[k:k] = rng.choice(passages)[at : at + rng.randint(20, 90)]
        rows.append((i, rng.choice([" ", "\n"]).join(w), "s"))
    common = " ".join(passages[0])
    rows += [(300 + i, f"own{i} {common} end{i}", "s") for i in range(60)] + [(400 + i, f"a b c {common} d", "s") for i in range(40)]
    rows += odd_rows() + [(907, "w " * 60, "a")]
    got = {tuple(r) for r in repeats.repeated_passages(frame(spark, rows)).collect()}
    want = brute.repeats([(i, t) for i, t, _ in rows if i is not None])
    assert got == want and len(want) > 30


def test_cut_repeats(spark):
    shared = " ".join(f"s{i}" for i in range(55))
    rows = [(1, f"a b {shared} c", ""), (2, f"{shared}", ""), (3, "own words", "")]
    got = {r.id: (r.text, r.cut_words) for r in repeats.cut_repeats(frame(spark, rows)).collect()}
    assert got == {1: ("a b c", 55), 2: ("", 55)}


def test_shards(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(shards, "BUCKET_ROWS", 7)
    monkeypatch.setattr(shards, "GROUP", 3)
    rows = [(i % 90, None if i % 11 == 0 else f"t{i % 50}é", "s") for i in range(300)] + odd_rows()
    path = str(tmp_path / "in")
    frame(spark, rows).repartition(5).write.parquet(path)
    out = shards.shard_rows(spark.read.parquet(path), 13).collect()
    assert len(out) == len(rows)
    assert sorted(str((r.doc_id, r.text)) for r in out) == sorted(str((i, t)) for i, t, _ in rows)
    slots = {}
    for r in out:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) == set(range(13))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = shards.shard_rows(spark.read.parquet(path), 13).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))
    shards.write_shards(shards.shard_rows(spark.read.parquet(path), 13), str(tmp_path / "out"), rows_per_file=10)
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(rows)


def test_shard_digests(spark, sf):
    from tidemark.llm.queries import op7_sharding

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_sharding(spark, sf).collect():
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
