"""Line dedup with a template tree: lines that follow one template in many documents are dropped.

The tree has a fixed depth: the number of words of a line, then its ``DEPTH`` leading words, where words with a digit are a
variable field.  In a leaf, a word that fewer than ``MIN_TEXTS`` texts have at its place is a variable field as well.  Lines
with the same constant words are one template.  DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh, materialize
from tidemark.llm.quality import SEPARATORS, let

DEPTH = 3
MIN_TEXTS = 50
CONSTANT_PERCENT = 60  # share of constant words below which a line has no template but itself
FIELD = "<*>"
_BLANKS = " \t\n\x0b\f\r"


def _words(line: Column) -> Column:
    """Words of a line; none for a line without."""
    bare = F.trim(line, F.lit(_BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATORS))


def _masked(words: Column) -> Column:
    return F.transform(words, lambda w: F.when(w.rlike("[0-9]"), F.lit(FIELD)).otherwise(w))


def _leaf(words: Column) -> Column:
    """The path in the tree; null for a line without words."""
    lead = F.array_join(_masked(F.slice(words, 1, DEPTH)), " ")
    return F.when(F.size(words) > 0, F.concat_ws(" ", F.size(words), lead))


def _keyed(docs: DataFrame, text_col: str) -> list[Column]:
    """Two 64-bit hashes that stand for a text."""
    text = F.col(f"`{text_col}`")
    return [F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(7), text).alias("c2")]


def frequent_lines(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """(c1, c2, drop array<int>): for each text with lines of recurring templates, the places of these lines.

    Copies of a text count once, so a group of exact copies does not drop its own lines.  Leaves are counted on hashes
    alone; only lines in leaves that enough texts reach bring their words, and these are counted per distinct line.
    """
    text = F.col(f"`{text_col}`")
    lines = F.split(text, "\n")
    keyed = docs.where(text.isNotNull()).select(*_keyed(docs, text_col), F.posexplode(F.transform(lines, lambda x: F.xxhash64(_leaf_of(x)))).alias("at", "leaf"))
    paths = keyed.where(F.col("leaf") != F.xxhash64(F.lit(None).cast("string")))
    reached = paths.select("leaf", "c1", "c2").distinct().groupBy("leaf").agg(F.count("*").alias("k")).where(F.col("k") >= min_texts)
    listed = (
        paths.join(reached.select("leaf"), "leaf", "left_semi")
        .groupBy("c1", "c2")
        .agg(F.array_sort(F.collect_set(F.struct("at", "leaf"))).alias("places"))
    )
    whole = docs.where(text.isNotNull()).select(*_keyed(docs, text_col), text.alias("text"))
    held = whole.join(listed, ["c1", "c2"]).select(
        "c1", "c2",
        F.explode(let(F.split("text", "\n"), lambda x: F.transform("places", lambda p: F.struct(
            p["at"].alias("at"), p["leaf"].alias("leaf"), F.array_join(_masked(_words(F.get(x, p["at"]))), " ").alias("line")
        )))).alias("p"),
    )
    found = materialize(held.select("c1", "c2", "p.*").distinct())
    distinct = found.select("leaf", "line", "c1", "c2").distinct().groupBy("leaf", "line").agg(F.count("*").alias("k"))
    cells = distinct.select("leaf", "line", "k", F.posexplode(F.split("line", " ")).alias("place", "word"))
    common = cells.groupBy("leaf", "place", "word").agg(F.sum("k").alias("n")).where(F.col("n") >= min_texts)
    varying = cells.where(F.col("word") == FIELD).unionByName(cells.join(common, ["leaf", "place", "word"], "left_anti"))
    fields = varying.groupBy("leaf", "line").agg(F.collect_set("place").alias("fields"))
    words = F.split("line", " ")
    template = F.transform(words, lambda w, i: F.when(F.array_contains("fields", i), F.lit(FIELD)).otherwise(w))
    few = 100 * (F.size(words) - F.size("fields")) < CONSTANT_PERCENT * F.size(words)
    shape = distinct.join(fields, ["leaf", "line"], "left").select(
        "leaf", "line", F.when(F.col("fields").isNull() | few, F.col("line")).otherwise(F.array_join(template, " ")).alias("template")
    )
    member = found.join(shape, ["leaf", "line"])
    recurring = (
        member.select("leaf", "template", "c1", "c2").distinct().groupBy("leaf", "template").agg(F.count("*").alias("k"))
    ).where(F.col("k") >= min_texts)
    gone = member.join(recurring.select("leaf", "template"), ["leaf", "template"], "left_semi")
    return gone.groupBy("c1", "c2").agg(F.collect_set("at").alias("drop"))


def _leaf_of(line: Column) -> Column:
    return let(_words(line), _leaf)


def dedup_lines(docs: DataFrame, text_col: str = "text", min_texts: int = MIN_TEXTS) -> DataFrame:
    """``docs`` with lines of recurring templates cut from ``text_col``, and ``n_lines`` and ``n_dropped`` (long).

    Lines are what \\n separates.  Lines without a word always stay.  A null text stays null, with no lines; an empty
    text has one.  Every row stays, repeated rows alike, even when all its lines go.  New names that clash get a leading
    underscore.
    """
    c1, c2, drop, lines = fresh(docs, "c1", "c2", "drop", "lines")
    n_lines, n_dropped = fresh(docs, "n_lines", "n_dropped")
    gone = frequent_lines(docs, text_col, min_texts).toDF(c1, c2, drop)
    text = F.col(f"`{text_col}`")
    keys = [k.alias(n) for k, n in zip(_keyed(docs, text_col), (c1, c2))]
    joined = docs.select("*", *keys).join(gone, [c1, c2], "left")
    kept = let(
        F.split(text, "\n"),
        lambda x: F.array_join(F.filter(x, lambda _, i: ~F.array_contains(F.col(drop), i)), "\n"),
    )
    out = {text_col: F.when(F.col(drop).isNull(), text).otherwise(kept)}
    return joined.select(
        *[out[c].alias(c) if c in out else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias(n_lines),
        F.when(F.col(drop).isNull(), 0).otherwise(F.size(drop)).cast("long").alias(n_dropped),
    )
