import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from tidemark.llm import pieces
from tidemark.llm.queries import op3_sentencepiece

MODEL = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "the", " ", "  ", "\n", "▁", "é", "日", "語", "🙂", "\t", "ing", "<s>", "</s>", "<0x0A>", "\0", "ß", "23", "def ", "==", " " * 9]


@pytest.fixture(scope="module")
def coder():
    return pieces.PieceCoder(pieces.load_model(MODEL))


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_random_texts(coder, library):
    rng = random.Random(1)
    for _ in range(5000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25)))
        ids = coder.encode(text).tolist()
        assert ids == library.encode(text), repr(text)
        assert coder.decode(ids) == library.decode(ids)


def test_random_ids(coder, library):
    rng = random.Random(2)
    for _ in range(5000):
        ids = [rng.randrange(300) for _ in range(rng.randint(0, 9))]
        assert coder.decode(ids) == library.decode(ids), ids


@pytest.mark.parametrize("text", ["", " " * 5000, "ab" * 30000, "\n" * 999, "thethe" * 9000, "🙂" * 500])
def test_long_runs(coder, library, text):
    assert coder.encode(text).tolist() == library.encode(text)


def test_frames(spark, library):
    rows = [(1, "The cat\nsat.", "x"), (2, None, "y"), (3, "", "z"), (1, "The cat\nsat.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string")
    out = pieces.decode(pieces.encode(df, MODEL), MODEL, "_ids")
    assert out.columns == ["doc_id", "text", "IDS", "_ids", "decoded"]
    got = sorted(map(tuple, out.select("doc_id", "_ids", "decoded").collect()))
    ids = library.encode("The cat\nsat.")
    assert got == [(1, ids, "The cat\nsat."), (1, ids, "The cat\nsat."), (2, [], ""), (3, [], "")]
    assert pieces.encode(df.limit(0), MODEL).count() == 0


def test_whole_table(spark, sf, library):
    got = {r.doc_id: r for r in op3_sentencepiece(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(got) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "")
        assert got[d.doc_id].n_tokens == len(ids)
        assert got[d.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_one_pass(spark, sf):
    """Encoding and decoding in one pass give what the two give; the pipeline's last stage keeps one Python worker a task."""
    import corpus_pipeline

    rows = [(1, "The cat\nsat.", "x"), (2, None, "y"), (3, "", "z"), (1, "The cat\nsat.", "x"), (4, "🙂 ▁日  語\0 </s>" * 70, None)] * 60
    df = spark.createDataFrame(rows, "doc_id long, text string, IDS string").coalesce(1)
    out = pieces.encode_and_decode(df, MODEL)
    assert out.columns == ["doc_id", "text", "IDS", "_ids", "decoded"]
    both = pieces.decode(pieces.encode(df, MODEL), MODEL, "_ids")
    assert out.collect() == both.collect()
    assert pieces.encode_and_decode(df.limit(0), MODEL).count() == 0
    _, stage = corpus_pipeline.STAGES[-1]
    plan = stage(spark, spark.read.parquet(f"{sf}/documents.parquet"), sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
