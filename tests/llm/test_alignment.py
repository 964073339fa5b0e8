"""Alignment of two tokenizers against plain Python over sets of offsets."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment
from tidemark.llm.alignment import (
    UNIT, ByteTokens, LinkPairs, PieceTokens, align_tokens, aligned_digests, cuts, group_text, id_strings, link_counts, link_pairs, link_scores,
)

MODELS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def pairs():
    return link_pairs(*MODELS)


def test_cuts():
    """Any two rising lists with a common end: stretches of every length, irregular groups at each place."""
    rng = random.Random(2)
    assert [x.tolist() for x in cuts([], [])] == [[], []]
    for k in range(3000):
        n = rng.randint(1, 200)
        share = rng.choice([0.02, 0.3, 0.9])
        a = sorted({*rng.sample(range(1, n + 1), rng.randint(0, n)), n})
        b = sorted({*(x for x in a if rng.random() > share), *(x for x in range(1, n) if rng.random() < share / 4), n})
        both = sorted(set(a) & set(b))
        got = cuts(a, b) if k % 2 else cuts(b, a)[::-1]
        assert tuple(x.tolist() for x in got) == ([a.index(x) + 1 for x in both], [b.index(x) + 1 for x in both])


def test_one_to_one_is_skipped():
    """A stretch of a million equal ends takes a few comparisons of slices."""

    class Counted(list):
        reads = 0

        def __getitem__(self, i):
            Counted.reads += 1
            return super().__getitem__(i)

    ends = list(range(1, 1_000_001))
    a, b = cuts(Counted(ends), ends[:-2] + [1_000_000])
    assert a.tolist() == [*range(1, 999_999), 1_000_000] and b.tolist() == list(range(1, 1_000_000))
    assert Counted.reads < 60


def test_group_text():
    def made(*lists):
        return group_text(*[np.array(x) for x in lists], id_strings(10))

    assert made([1, 2, 3], [4, 5, 6], [2, 3], [1, 3]) == "1,2|4;3|5,6"
    assert made([7], [8], [1], [1]) == "7|8"


def test_pairs_are_suffixes():
    a, b = [b"", b"a", b"ba", b"cba"], [b"a", b"xa", b"ba", b"", b"dcba", b"a"]
    got = LinkPairs(a, b)
    want = sorted((i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x and y and (x.endswith(y) or y.endswith(x)))
    assert list(zip(*(x.tolist() for x in got.ids(np.arange(len(got.keys)))))) == want
    i, j = map(np.array, zip(*want))
    assert got.places(i, j).tolist() == list(range(len(want)))


def test_number_of_pairs_is_bounded_by_the_vocabularies(pairs):
    sizes = [sum(map(len, kind(alignment.load_model(m)).token_bytes)) for kind, m in zip((alignment.ByteTokens, alignment.PieceTokens), MODELS)]
    assert len(pairs.keys) <= 2 * sum(sizes) and len(pairs.keys) < alignment.PAIR_LIMIT


def expected(rows):
    """{id: result} of rows (id, text) from the two libraries, sets of offsets and a counter."""
    byte = Tokenizer.from_file(MODELS[0])
    byte.encode_special_tokens = True
    piece = SentencePieceProcessor(model_file=MODELS[1])
    stands_for = dict(zip(alignment._characters_of_bytes(), range(256)))
    out, count, of_b = {}, Counter(), defaultdict(Counter)
    for i, text in rows:
        out[i] = (0, 0, "", [])
        if not text:
            continue
        a, b = byte.encode(" " + text, add_special_tokens=False).ids, piece.encode(text)
        a_bytes = [bytes(stands_for[c] for c in byte.id_to_token(x)) for x in a]
        b_bytes = [bytes([int(p[1:-1], 16)]) if piece.is_byte(x) else p.replace("▁", " ").encode() for x, p in zip(b, piece.id_to_piece(b))]
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            continue
        a_end, b_end = np.cumsum([*map(len, a_bytes)]).tolist(), np.cumsum([*map(len, b_bytes)]).tolist()
        groups, links, last = [], [], (0, 0)
        for x in sorted(set(a_end) & set(b_end)):
            now = a_end.index(x) + 1, b_end.index(x) + 1
            own = a[last[0] : now[0]], b[last[1] : now[1]]
            groups.append("|".join(",".join(map(str, side)) for side in own))
            links.append((own[0][-1], own[1][-1]))
            last = now
        out[i] = len(a), len(b), hashlib.sha256(";".join(groups).encode()).hexdigest(), links
    for _, _, _, links in out.values():
        count.update(links)
    for (x, y), n in count.items():
        of_b[y][x] = n
    return {
        i: (na, nb, len(links), len(links), sum(count[p] == max(of_b[p[1]].values()) for p in links), sum(count[p] for p in links), digest)
        for i, (na, nb, digest, links) in out.items()
    }, count


TEXTS = [
    None, "", " ", "\n\n  \t", "plain words and more plain words", "plain words", "</s><s><|endoftext|><unk> as text", "a▁b", "▁",
    "naïve café Ünïcödé 日本語のテキスト 🦜🦜 ☃", "\x00\x01\x7f", "tabs\tand\r\nlines\n\n\nend  ", "   lead and trail   ", "'s 're don't 12345 67",
    "x" * 30_000, "word " * 30_000, "日本" * 5_000, "́combining é", "\U0010ffff�​", "<0x41>", "plain words",
]


def test_align(spark, pairs):
    rows = list(enumerate(TEXTS))
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, A_IDS string, links int")
    want, count = expected(rows)
    aligned = align_tokens(frame, *MODELS)
    assert aligned.columns == ["doc_id", "text", "A_IDS", "links", "_a_ids", "b_ids", "a_cuts", "b_cuts"]
    digests = aligned_digests(frame, *MODELS, pairs, ["doc_id"])
    for r in aligned.collect():
        assert [len(x) for x in (r._a_ids, r.b_ids, r.a_cuts)] == [*want[r.doc_id][:3]] and (r.a_cuts or [0])[-1] == len(r._a_ids)
    got = link_scores(digests, pairs).collect()
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    assert {r.doc_id: tuple(r[n] for n in names) for r in got} == want
    assert {(r.a_id, r.b_id): r.n for r in link_counts(digests, pairs).collect()} == dict(count)
    assert want[6][0] > 10 and want[7][0] == want[8][0] == 0 and want[4][0] > 0


@pytest.mark.parametrize("joined", [1, 30, 1 << 14])
def test_units(monkeypatch, joined):
    """Units encoded in joined texts, and forgotten in between, give the ids of the whole text."""
    monkeypatch.setattr(alignment, "MEMORY", 50)
    monkeypatch.setattr(alignment, "JOINED", joined)
    byte, piece = (kind(alignment.load_model(m)) for kind, m in zip((ByteTokens, PieceTokens), MODELS))
    aligner = alignment._Aligner(byte, piece)
    rng = random.Random(5)
    signs = ["a", "Z", "9", "é", "日", "。", ",", "'s", "'", "_", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u3000", "\u2028", "\x1c", "\x85", "🦜", "\u0301", "١"]
    texts = ["".join(rng.choices(signs, k=rng.randint(1, 40))) + rng.choice([*[""] * 9, "▁", "▁ a"]) for _ in range(4000)]
    at = 0
    while at < len(texts):
        part = texts[at : at + rng.choice([1, 7, 300])]
        at += len(part)
        for text, (a, b, *_) in zip(part, aligner.align(part), strict=True):
            if "▁" in text:
                assert not len(a) and not len(b)
            else:
                assert a.tolist() == byte.tokenizer.encode(" " + text, add_special_tokens=False).ids, repr(text)
                assert b.tolist() == piece.tokenizer.encode(text), repr(text)


def test_known_units_are_not_aligned_again(monkeypatch):
    """A unit has the same groups in every text: its third text, in any task of a job, compares no ends."""
    models = tuple(map(alignment.load_model, MODELS))
    compared = []
    ends = alignment.stretches
    monkeypatch.setattr(alignment, "stretches", lambda a, b: compared.append(len(a)) or ends(a, b))
    texts = ["plain words, naïve café 12345 and words", "日本語 words\n\n", None, "a▁b words", "  words 12345 ", "🦜🦜"]
    found, sizes = [], []
    for _ in range(4):
        aligner = alignment._aligner("a job", models, alignment.unit_arrays)
        found.append([[x.tolist() for x in row] for row in aligner.align(texts)])
        sizes.append(sum(compared))
    assert found[0] == found[1] == found[2] == found[3] and not any(map(len, found[0][2] + found[0][3]))
    assert 0 < sizes[0] < sizes[1] == sizes[2] == sizes[3]
    byte, piece = (kind(m) for kind, m in zip((ByteTokens, PieceTokens), models))
    for text, (a, b, a_cuts, b_cuts) in zip(texts, found[0]):
        if a:
            assert a == byte.tokenizer.encode(" " + text, add_special_tokens=False).ids and b == piece.tokenizer.encode(text)
            a_ends, b_ends = (np.cumsum([len(t.token_bytes[x]) for x in ids]).tolist() for t, ids in ((byte, a), (piece, b)))
            assert [a_cuts, b_cuts] == [x.tolist() for x in cuts(a_ends, b_ends)]
    assert alignment._aligner("another", models, alignment.unit_arrays) is not aligner


def test_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(30))})
    parts = list(alignment._slices(batch, np.array([3, 0, 50] * 10), 10))
    assert [x for p in parts for x in p["n"].to_pylist()] == list(range(30)) and max(p.num_rows for p in parts) == 2


def test_empty_table(spark, pairs):
    rows = spark.createDataFrame([], "doc_id long, text string")
    assert align_tokens(rows, *MODELS).count() == 0
    assert link_scores(aligned_digests(rows, *MODELS, pairs, ["doc_id"]), pairs).count() == 0


def test_query_over_the_table(spark, sf):
    """The registered query against the libraries over the whole table."""
    from tidemark.llm.queries import QUERIES

    rows = [(r["doc_id"], r["text"]) for r in pq.read_table(f"{sf}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    names = "n_a n_b n_groups n_links n_best count_sum groups_sha256".split()
    got = {r.doc_id: tuple(r[n] for n in names) for r in QUERIES["op12_token_alignment"](spark, sf).collect()}
    assert got == expected(rows)[0]
