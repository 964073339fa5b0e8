"""Quality rules: base rules on a document's words, then cross-document line frequency.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh

SEPARATORS = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
MIN_WORDS = 50
REPEAT_PERCENT = 50
LINE_LIMIT = 50  # distinct texts of a host that may share a line
COUNTS = "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"
KEEP_PERCENT = 50  # share of its words that a document must keep


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def normal_line(line: Column) -> Column:
    """A line for comparison: lower case, digits as 0, one space between words."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]+", "0"), SEPARATORS, " "))


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that are found twice or more in the array ``w``, the first find included.

    A window is a long: the upper bits are a hash of its words, the lower ones its place.  Sorting the longs puts equal
    windows side by side; sorted again by place, each found window adds the words the one before did not cover.  Two
    windows that are neighbours by hash count only if their words are equal.
    """
    n = F.size(w)
    bits = F.ceil(F.log2(n + 1)).cast("int")

    def found(keys: Column, b: Column) -> Column:
        def place(key: Column) -> Column:
            return (key.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), b) - 1)).cast("int")

        def same(x: Column, y: Column) -> Column:
            p, q = place(x), place(y)
            return (
                (F.call_function("shiftright", x, b) == F.call_function("shiftright", y, b))
                & (w[p] == w[q])
                & (w[p + 1] == w[q + 1])
                & (w[p + 2] == w[q + 2])
            )

        last = F.size(keys) - 1
        twins = F.filter(
            keys, lambda k, i: ((i > 0) & same(k, F.get(keys, i - 1))) | ((i < last) & same(k, F.get(keys, i + 1)))
        )
        places = F.transform(twins, place)
        return let(
            F.sort_array(places),
            lambda p: F.aggregate(
                F.transform(p, lambda x, i: F.when(i == 0, F.lit(3)).otherwise(F.least(F.lit(3), x - F.get(p, i - 1)))),
                F.lit(0).cast("long"),
                lambda a, x: a + x,
            ),
        )

    keys = F.sort_array(
        F.transform(
            F.sequence(F.lit(0), n - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits) + i,
        )
    )
    return F.when(n < 3, F.lit(0).cast("long")).otherwise(let(bits, lambda b: let(keys, lambda k: found(k, b))))


def base_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text has no words.  A document fails with fewer than 50 words or with more than half of them in repeated
    windows.  New names that clash get a leading underscore.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    counts, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed = fresh(docs, "counts", *COUNTS, "base_failed")
    full = F.filter(F.split(text, "\n"), lambda line: F.trim(line, F.lit(" \t\n\x0b\f\r")) != "")
    # one expression of the text, bound inside: a filter on its fields may be worked out again, but never per word
    value = let(
        words(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias(n_words),
            F.length(F.array_join(w, "")).cast("long").alias(word_chars),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias(n_symbols),
            let(full, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")).alias(n_dup_lines),
            repeated_words(w).alias(n_repeat_words),
        ),
    )
    out = docs.withColumn(counts, value).select(*[f"`{c}`" for c in docs.columns], f"`{counts}`.*")
    failed = (F.col(n_words) < MIN_WORDS) | (100 * F.col(n_repeat_words) > REPEAT_PERCENT * F.col(n_words))
    return out.withColumn(base_failed, failed)


def line_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", limit: int = LINE_LIMIT, keep_percent: int = KEEP_PERCENT
) -> DataFrame:
    """(c1, c2, line_words, frequent_words, drop array<int>, depleted) of each distinct (host, text) that has a frequent line.

    ``c1`` and ``c2`` are the hashes of ``text_keys``.  A normalised line is frequent at a host when more than ``limit``
    different texts of the host have it: copies of one text are one document.  ``drop`` has the places of the frequent
    lines; removing them depletes a document when less than ``keep_percent`` of its words stay.  A null host is a host of
    its own.

    Only hashes move.  Repeats within a text are combined before the shuffle, and so are the counts of a line, so a line
    that a third of all documents share is added up where it lies.
    """
    text = F.col(f"`{text_col}`")
    lines = F.transform(F.split(text, "\n"), normal_line)
    rows = docs.where(text.isNotNull()).select(*text_keys(docs, text_col, host_col), _host(host_col).alias("host"), F.posexplode(lines).alias("at", "line"))
    parts = rows.where("line <> ''").select("c1", "c2", "at", F.xxhash64("host", "line").alias("key"), F.size(F.split("line", " ")).cast("long").alias("n"))
    per_text = parts.groupBy("key", "c1", "c2").agg(F.first("n").alias("n"), F.collect_set("at").alias("at"))
    frequent = per_text.groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") > limit).select("key", F.lit(True).alias("hit"))
    words = F.col("n") * F.size("at")
    return (
        per_text.join(frequent, "key", "left")
        .groupBy("c1", "c2")
        .agg(
            F.sum(words).alias("line_words"),
            F.sum(F.when(F.col("hit"), words)).alias("frequent_words"),
            F.flatten(F.collect_list(F.when(F.col("hit"), F.col("at")))).alias("drop"),
        )
        .where("frequent_words > 0")
        .withColumn("depleted", 100 * (F.col("line_words") - F.col("frequent_words")) < keep_percent * F.col("line_words"))
    )


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col(f"`{host_col}`").cast("string")), F.lit(""))


def text_keys(docs: DataFrame, text_col: str, host_col: str) -> list[Column]:
    """Two 64-bit hashes that stand for a host and a text."""
    text, host = F.col(f"`{text_col}`"), _host(host_col)
    return [F.xxhash64(host, text).alias("c1"), F.xxhash64(F.lit(7), host, text).alias("c2")]


def quality_rules(docs: DataFrame, text_col: str = "text", host_col: str = "source", cut: bool = False) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept``: not failed and not depleted of frequent lines.

    Empty and null texts fail the base rules.  Repeated rows are judged alike.  With ``cut`` the frequent lines are removed
    from the texts, after the counts.  New names that clash get a leading underscore; columns of these names stay as they were.
    """
    based = base_rules(docs, text_col)
    base_failed, kept = fresh(docs, "base_failed", "kept")
    c1, c2, drop, depleted = fresh(based, "c1", "c2", "drop", "depleted")
    rules = line_rules(docs, text_col, host_col).select(
        F.col("c1").alias(c1), F.col("c2").alias(c2), F.col("drop").alias(drop), F.col("depleted").alias(depleted)
    )
    keys = [k.alias(n) for k, n in zip(text_keys(docs, text_col, host_col), (c1, c2))]
    out = based.select("*", *keys).join(rules, [c1, c2], "left")
    out = out.withColumn(kept, ~F.col(base_failed) & ~F.coalesce(F.col(depleted), F.lit(False)))
    if cut:
        text = F.col(f"`{text_col}`")
        left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains(F.col(drop), i)), "\n")
        out = out.withColumn(text_col, F.when(F.col(drop).isNull(), text).otherwise(left))
    return out.drop(c1, c2, drop, depleted)
