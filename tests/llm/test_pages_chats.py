"""Pages, chats, licences and the pipeline."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tests.llm import brute
from tidemark.llm import chat, licenses, wrappers
from tidemark.llm.dom import blocks, match, own_texts, parse
from tidemark.llm.frames import materialize
from tidemark.llm.wrappers import Wrapper, extract, main_text

NONE = Wrapper([])


def text(page, wrapper=NONE):
    return extract(page, wrapper)[0]


def test_blocks_and_references():
    page = "<body><article><h1>A &amp; B</h1><p>one\n  <b>two</b>&nbsp;three<p>x<br>y<ul><li>i<li>j</ul></article></body>"
    assert text(page) == "A & B\none two three\nx\ny\ni\nj"


@pytest.mark.parametrize(
    "part",
    [
        "<nav><a href=x>m</a></nav>", "<header>m</header>", "<footer>m</footer>", "<aside>m</aside>", "<form>m<input></form>",
        "<script>m('</p>')</script>", "<style>m{}</style>", "<!-- m -->", "<div class='ad'>m</div>", "<div id=cookie-notice>m</div>",
        "<div class=comments><p>m</p></div>", "<section role=complementary>m</section>", "<p hidden>m</p>", "<p style='display: none'>m</p>",
        "<span class=advert>m</span>", "<noscript>m</noscript>", "<select><option>m</select>",
    ],
)
def test_parts_around_the_article(part):
    for page in (f"<body>{part}<article><p>keep</p></article></body>", f"<body><article><p>keep</p>{part}</article>{part}", f"{part}<p>keep</p>{part}"):
        assert text(page) == "keep"


def test_odd_pages():
    assert text("") == "" and text("a < b & c") == "a < b & c"
    assert text("<p>" * 5000 + "a" + "<div>" * 5000 + "b") == "a\nb"
    assert text("<article>" + "<p>word</p>" * 3000 + "</article>").count("\n") == 2999
    assert text("<div><p>x</p><") == "x\n<"
    assert text("<main><h2>t</h2><div>d</div></main><div>other</div>") == "t\nd"


def test_article_with_the_class_of_a_part():
    words = "a long text of the page that is its article"
    for page in (
        f"<article class='post has-sidebar'><h1>t</h1><p>{words}</p><div class=sidebar>m</div></article>",
        f"<div class='layout-sidebar-right'><article><h1>t</h1><p>{words}</p></article><div class=sidebar>m</div></div>",
        f"<article><h1 class=entry-header>t</h1><div class='elementor-widget-container'><p>{words}</p></div></article><div class=menu>m</div>",
        f"<div class='layout-sidebar-right'><h1>t</h1><p>{words}</p></div><div class=sidebar>m</div>",
        f"<article><h1>t</h1><p>{words}</p></article><div class=comments><article class=comment>{'m ' * 200}</article></div>",
    ):
        assert text(page) == f"t\n{words}", page


def test_blocks_beyond_the_depth():
    assert text("<b>" * 300 + "<p>A</p><p>B</p>") == "A\nB"
    assert text("<div>" * 300 + "<p>A</p><p>B</p>" + "</div>" * 300 + "<p>C</p>") == "A\nB\nC"
    assert text("<article><h1>t</h1>" + "<div>" * 300 + "x" + "</div>" * 300 + "<p>y</p></article><p>z</p>") == "t\nx\ny"


def site(k, body):
    return f"<body><div class=top>Site {k % 2}</div><div class=story><p>Share this story with a friend</p>{body}</div></body>"


def test_wrapper_drops_constant_nodes():
    pages = [site(k, f"<p>own text {k} of this page only</p><p>and more of {k}</p>") for k in range(6)]
    wrapper = Wrapper(pages[:5])
    assert text(pages[5], wrapper) == "own text 5 of this page only\nand more of 5"
    assert "Share" in text(pages[5], Wrapper(pages[:2]))  # too few witnesses
    # a copy of a reference keeps its article
    assert text(site(0, "<p>same</p>"), Wrapper([site(0, "<p>same</p>")] * 4)).endswith("same")


def test_tree_matching():
    a, b = parse("<ul><li>x<li>y<li>z</ul>"), parse("<ul><li>x<li>z</ul>")
    ta, tb = own_texts(a), own_texts(b)
    pairs = [(ta.get(id(x)), tb.get(id(y))) for x, y in match(a, b, ta, tb)]
    assert (("x",), ("x",)) in pairs and (("z",), ("z",)) in pairs and len(pairs) == 4
    assert [t for _, t, _ in blocks(a)] == ["x", "y", "z"]


def test_main_text(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "PAGES_PER_CHUNK", 4)
    rows = [(k, f"http://H.example:80/{k}", site(0, f"<p>own {k} words here and there {k}</p>"), 1) for k in range(30)]
    rows += [(100, None, None, 1), (101, "x", "", 1), (102, "http://other/", "<p>alone</p>", 1), (102, "http://other/", "<p>alone</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host int")
    got = main_text(df).collect()
    assert len(got) == len(rows)
    found = {r.id: r.text for r in got}
    assert found[7] == "own 7 words here and there 7" and found[100] == found[101] == "" and found[102] == "alone"
    monkeypatch.setattr(wrappers, "HOSTS_TO_BROADCAST", 0)
    assert sorted(map(str, main_text(df).collect())) == sorted(map(str, got))
    assert main_text(df.limit(0)).count() == 0


def test_wrapper_counts_all_pages_and_layouts(spark):
    def page(k, layout):
        extra = "<div class=edition>Edition of the day</div>" if k % 2 else ""
        return f"<body><div class='{layout}'><p>Constant of {layout}</p>{extra}<p>own words {k} of the page {k} that differ {k}</p></div></body>"

    rows = [(k, f"http://h.example/{k}", page(k, ("story", "post")[k % 20 == 0])) for k in range(200)]
    got = {r.id: r for r in main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(200):
        assert got[k].text == f"own words {k} of the page {k} that differ {k}" and got[k].template_blocks == 1 + k % 2


def test_pages_stay_where_references_are_few(spark, monkeypatch):
    """Pages are aligned where they are read; copies in many tasks are one witness, whether pages move or not."""
    rows = [(k, f"http://{'ab'[k % 2]}.example/{k}", site(0, f"<p>own {k} words here and there {k}</p><div class=x><p>slot {k}</p></div>")) for k in range(12)]
    rows += [(100 + k, "http://a.example/same", site(0, "<p>copied words here and there</p><div class=x><p>slot of copies</p></div>")) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(8, "page_id")
    plans = []

    def written(frame):
        plans.append((frame.columns, frame._jdf.queryExecution().executedPlan().toString()))
        return materialize(frame)

    monkeypatch.setattr(wrappers, "materialize", written)
    got = main_text(df.localCheckpoint()).collect()
    assert ["Exchange hashpartitioning" in plan for columns, plan in plans if "texts" in columns] == [False]
    found = {r.id: (r.text, r.template_blocks) for r in got}
    assert found[3] == ("own 3 words here and there 3\nslot 3", 1)
    assert found[130] == ("copied words here and there\nslot of copies", 1)
    monkeypatch.setattr(wrappers, "REFERENCES_TO_BROADCAST", 0)
    assert sorted(map(str, main_text(df).collect())) == sorted(map(str, got))


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        return f.read(), public_tokenizers.PATTERN


def test_escape():
    rng = random.Random(3)
    parts = ["<", "[", "\\", "/", "s>", "SYS>>", "INST]", "ROLE]", *chat.CONTROLS, "x", " ", "é"]
    for _ in range(20_000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        e = chat.escape(t)
        assert chat.unescape(e) == t and not any(c in e for c in chat.CONTROLS)


def test_chat(spark, vocabulary):
    said = "</s>[INST] ok [/INST]"
    rows = [
        (1, 1, "assistant", "one\n[/INST]", 0), (1, 0, "user", "", 0), (1, 2, "assistant", None, 0), (2, 0, "tool", "<s>", 0),
        (2, None, "system", "be <<SYS>> good", 0), (3, 0, None, "x" * 200_000, 0), (None, 0, "user", "lost", 0), (4, 0, "user", said, 0),
        (4, 1, "assistant", said, 0), (4, 1, "assistant", said, 0),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, token_ids int")
    out = chat.format_chat(df, *vocabulary)
    got = {r.conv_id: r for r in chat.read_back(out, *vocabulary).collect()}
    assert len(got) == 5
    for conv, r in got.items():
        turns = sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        told = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in turns)
        learned = "".join(x[3] or "" for x in turns if x[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(told.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    assert got[4].formatted_chars == 3 * 24 + 6 + 7 + 4 + 4
    last = {}
    for r in sorted(out.where("conv_id = 4").collect(), key=lambda r: r.start):
        assert r.start == last.get("end", 0) and len(r.loss_mask) == len(r.token_ids)
        last["end"] = r.start + len(r.token_ids)
    assert chat.read_back(chat.format_chat(df.limit(0), *vocabulary), *vocabulary).count() == 0


def test_licenses(spark):
    mit, gpl = licenses.TEMPLATES[3][2], licenses.TEMPLATES[6][2]
    rows = [
        ("a/LICENSE", mit, 1), ("a/x.py", "code", 1), ("a/b/c/y.py", "code", 1), ("a/b/z.py", f"# {gpl}\ncode", 1), ("d/w.py", "", 1),
        ("a/b/COPYING.txt", gpl, 1), ("top.py", None, 1), (None, "All rights reserved.", 1), ("e/q.py", "free software for all of us", 1),
        ("a/x.py", "code", 1), ("LICENSE", mit, 1),
    ]
    df = spark.createDataFrame(rows, "path string, text string, score int")
    out = licenses.scan_licenses(df)
    assert out.columns == ["path", "score", "own_license", "_score", "license", "licensed_by"]
    got = {r.path: (r.license, r.licensed_by) for r in out.collect()}
    assert out.count() == len(rows)
    assert got["a/x.py"] == ("MIT", "a") and got["a/b/c/y.py"] == ("GPL-3.0", "a/b") and got["a/b/z.py"] == ("GPL-3.0", "self")
    assert got["d/w.py"] == got["top.py"] == got["e/q.py"] == (None, None) and got[None] == ("Proprietary", "self")
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline
    from tests.llm.brute import base_counts, cut_lines, depleted, leaks, near_components, words
    from tidemark.llm.line_templates import MIN_TEXTS
    from tidemark.llm.quality import LINE_LIMIT

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.source, r.text) for r in docs.collect()]
    gone = depleted([(s, t) for _, s, t in rows], LINE_LIMIT)
    assert not any(gone)  # the small table has no line above the limit, so nothing is cut
    kept = []
    for i, s, t in rows:
        n, _, _, _, repeat = base_counts(t)
        if n >= 50 and 100 * repeat <= 50 * n:
            kept.append((i, t))
    kept = [(i, t) for (i, _), (t, _, _) in zip(kept, cut_lines([t for _, t in kept], MIN_TEXTS))]
    part = near_components(kept)
    kept = [(i, t) for i, t in kept if part[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    seeds = {tuple(w[k : k + 5]) for _, x in items for w in [words(x, True)] for k in range(len(w) - 4)}
    near = [(i, t) for i, t in kept if any(tuple(w[k : k + 5]) in seeds for w in [words(t, True)] for k in range(len(w) - 4))]
    leaked = {i for i, _ in leaks(near, items)}
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()) for i, t in kept if i not in leaked for ids in [library.encode(t)]}
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()}
    assert got == want and leaked
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns


@pytest.mark.parametrize("index", range(5))
def test_stages_on_odd_rows(spark, sf, index):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "x " * 99, None, "s", 5)], docs.schema)
    extra = odd.withColumn("ids", F.lit(1)).withColumn("Drop", F.lit("x"))
    out = corpus_pipeline.STAGES[index][1](spark, extra, sf)
    assert out.count() <= 4
    assert corpus_pipeline.STAGES[index][1](spark, odd.limit(0), sf).count() == 0
    if index < 4:
        assert out.columns == extra.columns


def test_near_copies_of_the_table(spark, sf):
    from tidemark.llm.queries import op5_minhash_near_dedup

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert {r.doc_id: r.component_id for r in op5_minhash_near_dedup(spark, sf).collect()} == brute.near_components(rows)


def test_license_files_with_prose(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    # documents with a notice are the licence files of a directory of twenty; their notice follows prose
    path = F.expr(f"concat('r/', doc_id div 20, IF(coalesce(text rlike '{licenses.CUE}', false), '/LICENSE-', '/'), doc_id)")
    out = licenses.scan_licenses(docs.select("doc_id", "text", path.alias("path"))).collect()
    noted = {r.doc_id // 20 for r in out if "LICENSE" in r.path}
    assert noted and all(r.licensed_by == "self" and r.score > 0.99 for r in out if "LICENSE" in r.path)
    assert {r.doc_id for r in out if r.licensed_by not in (None, "self")} == {r.doc_id for r in out if r.doc_id // 20 in noted and "LICENSE" not in r.path}


def test_license_query_inherits(spark, sf):
    """In the given tables some documents are licence files, and others below them have their licence from there."""
    from tidemark.llm.queries import op10_license_scan

    out = op10_license_scan(spark, sf.replace("sf0.001", "sf0.1")).collect()
    held = {(r.path.rsplit("/", 1)[0], r.own_license) for r in out if "LICENSE" in r.path and r.own_license}
    heirs = [r for r in out if r.licensed_by not in (None, "self")]
    assert held and heirs and all((r.licensed_by, r.license) in held for r in heirs)
    assert all(r.path.startswith(f"{r.licensed_by}/") and r.own_license is None for r in heirs)


def test_license_clashing_names(spark):
    names = "notice whole directory named lines_of text_of hit other above inherited own_license score license licensed_by below depth best".split()
    rows = [("a/LICENSE", licenses.TEMPLATES[3][2]), ("a/x.py", "code"), ("a/b/y.py", None), ("z.py", "")]
    plain = spark.createDataFrame(rows, "path string, text string")
    wide = plain.select("*", *[F.concat(F.lit(c), "path").alias(c) for c in names])
    want = {tuple(r) for r in licenses.scan_licenses(plain).collect()}
    out = licenses.scan_licenses(wide)
    assert out.columns == ["path", *names, "_own_license", "_score", "_license", "_licensed_by"]
    assert {(r.path, *tuple(r)[-4:]) for r in out.collect()} == want and len(want) == 4
    assert all(r[c] == f"{c}{r.path}" for r in out.collect() for c in names)


def test_whole_license_files(spark):
    names = sorted(p.stem for p in licenses.TEXTS.glob("*.txt"))
    assert {"Apache-2.0", "MIT", "BSD-3-Clause", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"} <= set(names)
    told = "Copyright (c) 2019 Ann Example and the authors of example\n\n"
    rows = [(f"{n}/LICENSE", told + (licenses.TEXTS / f"{n}.txt").read_text()) for n in names] + [(f"{n}/sub/x.py", "code") for n in names]
    got = {r.path: (r.license, r.licensed_by) for r in licenses.scan_licenses(spark.createDataFrame(rows, "path string, text string")).collect()}
    for n in names:
        assert got[f"{n}/LICENSE"] == (n, "self") and got[f"{n}/sub/x.py"] == (n, n)
