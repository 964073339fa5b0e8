"""Main text of web pages by wrapper induction: what pages of a host share is its template, what varies is content.

Each page is aligned with the reference of its host and layout by simple tree matching.  Matched elements are named by
their place in the reference, others by the nearest matched element above and the way down from it, so nothing that the
reference lacks is lost.  Texts are counted by host, layout and place over all pages; a text that most of the pages with
the place have there is constant, and of the other slots those of the article stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.dom import Node, blocks, match, own_texts, parse
from tidemark.llm.frames import materialize

LEAST = 3  # pages that must have a place before its text can be constant
PAGES_PER_CHUNK = 500  # pages of a layout that one stretch of rows holds; a large layout has many
HOSTS_TO_BROADCAST = 50_000  # at most 253 bytes of name each; with more, pages and counts are joined by host
REFERENCES_TO_BROADCAST = 1 << 24  # characters of all references; with more, the pages move to meet theirs
COPY_SHARE = 0.8  # a page with a larger constant share of its article is a copy, and keeps it
# classes of the containers of a page, without digits, make its layout
LAYOUT = r"""(?i)<(?:body|main|article|section|div|table)\b[^>]*?\bclass\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


class Reference:
    """A page that the others of its layout are aligned with."""

    def __init__(self, page: str):
        self.tree = parse(page)
        self.texts = own_texts(self.tree)
        self.places: dict[int, str] = {}
        stack = [self.tree]
        while stack:
            x = stack.pop()
            self.places[id(x)] = str(len(self.places))
            stack.extend(reversed(x.nodes))

    def named(self, page: Node) -> dict[int, tuple[str, tuple[str, ...]]]:
        """(place, own text) of each block element of ``page`` that has text."""
        texts = own_texts(page)
        matched = {id(y): self.places[id(x)] for x, y in match(self.tree, page, self.texts, texts)}
        found = {}
        stack = [(page, matched.get(id(page), ""))]
        while stack:
            x, place = stack.pop()
            if id(x) in texts:
                found[id(x)] = place, texts[id(x)]
            for c in x.nodes:
                stack.append((c, matched.get(id(c)) or f"{place}/{c.key}"))
        return found


class Wrapper:
    """The texts that are constant on some pages of one layout; the first page is the reference."""

    def __init__(self, pages: list[str]):
        self.constant: set[tuple[str, tuple[str, ...]]] = set()
        if len(pages) < LEAST:
            return
        self.reference = Reference(pages[0])
        total, seen = Counter(), Counter()
        for page in pages:
            found = set(self.reference.named(parse(page)).values())
            total.update({place for place, _ in found})
            seen.update(found)
        self.constant = {x for x, k in seen.items() if total[x[0]] >= LEAST and 3 * k >= 2 * total[x[0]]}

    def template(self, page: Node) -> set[int]:
        """The nodes of ``page`` whose text is constant."""
        if not self.constant:
            return set()
        return {node for node, x in self.reference.named(page).items() if x in self.constant}


def _hash(*parts: object) -> int:
    return int.from_bytes(blake2b(repr(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def _article(root: Node) -> Node:
    """The element with the most text among those that name an article; else the page."""
    best, most = None, 0

    def walk(x: Node) -> None:
        nonlocal best, most
        for c in x.nodes:
            if c.chrome:
                continue
            if c.tag == "article":
                size = sum(len(t) for _, t, _ in blocks(c))
                if size > most:
                    best, most = c, size
            else:
                walk(c)

    walk(root)
    if best is None:
        for wanted in (lambda c: c.tag == "main", lambda c: c.content):
            stack = [root]
            while stack and best is None:
                x = stack.pop()
                for c in reversed(x.nodes):
                    if not c.chrome:
                        stack.append(c)
                hits = [c for c in x.nodes if not c.chrome and wanted(c)]
                if hits:
                    best = max(hits, key=lambda c: sum(len(t) for _, t, _ in blocks(c)))
            if best is not None and blocks(best):
                break
            best = None
    return best or root


def _blocks(root: Node) -> list[tuple[Node, str, int]]:
    """The blocks of the article of a page."""
    article = _article(root)
    found = blocks(article)
    if article is root:
        # nothing names the article: blocks that are mostly links are menus
        found = [b for b in found if 2 * b[2] <= len(b[1])]
    return found


def extract(page: str, wrapper: Wrapper) -> tuple[str, int]:
    """The main text of a page, and the number of its blocks that were constant."""
    root = parse(page)
    found = _blocks(root)
    constant = wrapper.template(root) if found else set()
    shared = sum(len(t) for node, t, _ in found if id(node) in constant)
    if shared > COPY_SHARE * sum(len(t) for _, t, _ in found):
        constant = set()
    kept = [t for node, t, _ in found if id(node) not in constant]
    return "\n".join(kept), len(found) - len(kept)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, host, text, template_blocks) for each row of ``pages``.

    A null or empty page has an empty text.  The host is the url's, in lower case, without port; rows without one
    share an empty host.  Repeated rows give repeated results.  Blocks are joined by one newline; white space inside a
    block is one space.

    A layout with fewer than ``LEAST`` different pages joins the largest of its host.  Equal pages count once.  References
    of up to ``REFERENCES_TO_BROADCAST`` counted characters go to all tasks, and pages are aligned where they are read.
    With more, a layout's pages are dealt out in chunks, each with the reference before its pages, so a host with a third
    of all pages is spread over many tasks.  A task has one reference in use and one Arrow batch.
    """
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]{0,253})", 1), F.lit("")))
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit(""))
    classes = F.array_distinct(F.regexp_extract_all(html, F.lit(LAYOUT), F.lit(1)))
    layout = F.xxhash64(F.regexp_replace(F.array_join(F.array_sort(classes), "\n"), "[0-9]+", ""))
    rows = pages.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("html"), host.alias("host"),
        F.xxhash64(html).alias("mark"), layout.alias("own_layout"),
    )
    # counted on hashes alone: one row per layout of a host, and its reference
    filled = F.when(F.col("mark") != F.xxhash64(F.lit("")), F.col("mark"))
    marks = rows.groupBy("host", "own_layout", "mark").agg(F.count("*").alias("n"))
    sizes = materialize(marks.groupBy("host", "own_layout").agg(F.sum("n").alias("n"), F.count(filled).alias("k"), F.min(filled).alias("first")))
    largest = sizes.groupBy("host").agg(F.max_by("own_layout", F.struct("k", "own_layout")).alias("largest"))
    layouts = sizes.join(largest, "host").withColumn("layout", F.when(F.col("k") >= LEAST, F.col("own_layout")).otherwise(F.col("largest")))
    totals = layouts.groupBy("host", "layout").agg(
        F.ceil(F.sum("n") / PAGES_PER_CHUNK).cast("int").alias("chunks"), F.sum("k").alias("k"),
        F.min_by("first", F.struct(F.col("first").isNull(), F.col("own_layout") != F.col("layout"), "first")).alias("first"),
    )
    groups = materialize(layouts.select("host", "own_layout", "layout").join(totals, ["host", "layout"]))
    # with few layouts the pages need not move to meet them
    few = groups.count() <= HOSTS_TO_BROADCAST
    near = F.broadcast if few else lambda df: df
    wanted = groups.where((F.col("k") >= LEAST) & F.col("first").isNotNull()).select("host", "layout", "chunks", F.col("first").alias("mark")).distinct()
    references = rows.select("host", "mark", "html").join(near(wanted), ["host", "mark"]).groupBy("host", "layout", "chunks").agg(F.min("html").alias("html"))
    references = materialize(references)
    stay = few and (references.agg(F.sum(F.length("html"))).first()[0] or 0) <= REFERENCES_TO_BROADCAST
    held_by_all = {(r.host, r.layout): r.html for r in references.select("host", "layout", "html").toLocalIterator()} if stay else {}
    shared = pages.sparkSession.sparkContext.broadcast(held_by_all)
    dealt = rows.join(near(groups.select("host", "own_layout", "layout", "chunks")), ["host", "own_layout"]).select(
        "host", "layout", F.pmod("mark", F.col("chunks")).cast("int").alias("chunk"), F.lit(False).alias("reference"), "html", "mark", "id", "url"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, before, group = None, None, None, 0
        for batch in batches:
            picked, groups_, firsts, texts, saids, places, said = [], [], [], [], [], [], []
            columns = [batch.column(k).to_pylist() for k in range(6)]
            order = range(batch.num_rows)
            if stay:
                # in the order of their layouts, so that a reference is read once a batch
                order = sorted(order, key=lambda i: (columns[0][i], columns[1][i], columns[5][i]))
            for i in order:
                h, layout, _, reference, page, mark = (c[i] for c in columns)
                if (h, layout) != current:
                    current, before, group = (h, layout), None, _hash(h, layout)
                    held = Reference(shared.value[current]) if current in shared.value else None
                if reference:
                    held = held or Reference(page)
                    continue
                root = parse(page)
                found = _blocks(root)
                named = {k: (_hash(x[0]), _hash(x)) for k, x in held.named(root).items()} if held else {}
                pairs = sorted(set(named.values()))
                picked.append(i)
                groups_.append(group)
                texts.append([t for _, t, _ in found])
                saids.append([named[id(x)][1] if id(x) in named else None for x, _, _ in found])
                # a copy of the page before is no witness
                places.append([] if mark == before else [a for a, _ in pairs])
                said.append([] if mark == before else [b for _, b in pairs])
                before = mark
            rest = batch.take(pa.array(picked, pa.int64()))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays(
                [rest.column(6), rest.column(7), rest.column(0), rest.column(2), rest.column(5), pa.array(groups_, pa.int64()),
                 pa.array(texts, pa.list_(pa.string())), pa.array(saids, longs), pa.array(places, longs), pa.array(said, longs)],
                names=["id", "url", "host", "chunk", "mark", "layout", "texts", "saids", "places", "said"],
            )

    kind = dict(rows.dtypes)
    if not stay:
        chunk = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk")
        both = dealt.unionByName(references.select("host", "layout", chunk, F.lit(True).alias("reference"), "html"), allowMissingColumns=True)
        dealt = both.repartition("host", "layout", "chunk").sortWithinPartitions("host", "layout", "chunk", F.col("reference").desc(), "mark")
    aligned = materialize(
        dealt.select("host", "layout", "chunk", "reference", "html", "mark", "id", "url").mapInArrow(
            run,
            f"id {kind['id']}, url {kind['url']}, host string, chunk int, mark long, layout long, texts array<string>, "
            "saids array<long>, places array<long>, said array<long>",
        )
    )
    # sorted pages have their copies beside them; where pages stay, those of other tasks are left out here
    witnesses = aligned.where(F.size("said") > 0).dropDuplicates(["layout", "mark"]) if stay else aligned
    seen = witnesses.select("layout", F.explode(F.arrays_zip("places", "said")).alias("x")).groupBy("layout", "x.places", "x.said").agg(F.count("*").alias("k"))
    total = witnesses.select("layout", F.explode(F.array_distinct("places")).alias("places")).groupBy("layout", "places").agg(F.count("*").alias("total"))
    total = total.where(F.col("total") >= LEAST)
    constant = seen.where(F.col("k") > 1).join(total, ["layout", "places"]).where(3 * F.col("k") >= 2 * F.col("total"))
    constant = materialize(constant.groupBy("layout").agg(F.collect_set("said").alias("constant"), F.count("*").alias("n")))
    if (constant.agg(F.sum("n")).first()[0] or 0) <= HOSTS_TO_BROADCAST:
        joined = aligned.join(F.broadcast(constant), "layout", "left")
    else:
        chunks = aligned.groupBy("layout").agg(F.max("chunk").alias("last"))
        spread = constant.join(chunks, "layout").select("layout", "constant", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("chunk"))
        joined = aligned.join(spread, ["layout", "chunk"], "left")
    at = F.transform("saids", lambda x: F.coalesce(F.array_contains("constant", x), F.lit(False)))
    marked = joined.select("id", "url", "host", F.arrays_zip("texts", at.alias("gone")).alias("b"))

    def chars(column: Column) -> Column:
        return F.aggregate(column, F.lit(0).cast("long"), lambda n, x: n + F.length(x["texts"]))

    gone = F.filter("b", lambda x: x["gone"])
    copy = chars(gone) > COPY_SHARE * chars(F.col("b"))
    kept = F.when(copy, F.col("b")).otherwise(F.filter("b", lambda x: ~x["gone"]))
    return marked.select(
        "id", "url", "host", F.array_join(F.transform(kept, lambda x: x["texts"]), "\n").alias("text"),
        (F.size("b") - F.size(kept)).cast("long").alias("template_blocks"),
    )
