"""Passages that repeat across documents, by a sparse suffix array.

Only suffixes that start at a minimiser are kept: of every ``WINDOW`` places in a row, the one whose ``SEED`` words have
the smallest hash.  Every run of ``WINDOW + SEED - 1`` words has one, and equal runs have it at the same place, so two equal
passages of ``min_words`` words share a suffix whose first ``min_words - WINDOW + 1`` words are equal.  Suffixes are sorted
into groups by these words, and the matches of a group's neighbours are extended left and right.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_map, join_hot, materialize
from tidemark.llm.words import U, mix64, running_windows, seeded, windows, word_batches

MIN_WORDS = 50
SEED = 6
WINDOW = 20


def _sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """Smallest or largest of each ``k`` neighbours, by doubling."""
    width = 1
    while 2 * width <= k:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (k - width)], x[k - width :]) if width < k else x


def suffix_starts(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Places of the minimisers of several texts, whose words follow each other."""
    n, reach = len(words), WINDOW + SEED - 1
    if n < reach:
        return np.zeros(0, np.int64)
    seeds = windows(words, SEED)
    least = _sliding(seeds, WINDOW, np.minimum)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    least[text[: len(least)] != text[reach - 1 : reach - 1 + len(least)]] = 0  # a window across two texts picks nothing
    # a place is picked if it holds the minimum of some window around it; minima are never above it
    padded = np.concatenate([np.zeros(WINDOW - 1, U), least, np.zeros(WINDOW - 1, U)])
    return np.flatnonzero((_sliding(padded, WINDOW, np.maximum)[: len(seeds)] == seeds) & (seeds > 0))


def _suffixes(docs: DataFrame, right: int) -> DataFrame:
    """(id, at, key) of the suffixes with at least ``right`` words; the key is the hash of these."""

    def run(batch: pa.RecordBatch):
        for first, words, offsets in word_batches(batch.column(1), lower=True):
            at = suffix_starts(words, offsets)
            row = np.searchsorted(offsets, at, "right") - 1
            keep = at + right <= offsets[row + 1]
            at, row = at[keep], row[keep]
            yield {
                "id": batch.column(0).take(pa.array(row + first)),
                "at": pa.array(at - offsets[row], pa.int32()),
                "key": pa.array(windows(words, right)[at].view(np.int64)),
            }

    return arrow_map(docs, run, "id long, at int, key long")


def _listed(docs: DataFrame, right: int, fn, schema: str) -> DataFrame:
    """Call ``fn`` for runs of texts of ``docs`` (id, text, suffixes array<struct<at, key>>) with the suffixes that they have.

    It gets the ids, the word hashes of the texts, their offsets, and text and place of each listed suffix.
    """

    def run(batch: pa.RecordBatch):
        lists = batch.column(2)
        for first, words, offsets in word_batches(batch.column(1), lower=True):
            part = lists.slice(first, len(offsets) - 1)
            flat = part.flatten()
            row = np.repeat(np.arange(len(part)), part.value_lengths().to_numpy())
            at, key = flat.field(0).to_numpy() + offsets[row], flat.field(1).to_numpy()
            fits = at + right <= offsets[row + 1]  # a repeated id may bring another text
            row, at, key = row[fits], at[fits], key[fits]
            fits = windows(words, right).view(np.int64)[at] == key
            yield from fn(batch.column(0).slice(first, len(part)), words, offsets, row[fits], at[fits], key[fits])

    return arrow_map(docs, run, schema)


def _around(docs: DataFrame, right: int, need: int) -> DataFrame:
    """(key, whole, id, at, fewest, most) of the listed suffixes that some match can lie around.

    ``whole`` is a hash of the ``need`` words before the suffix and of those after its first ``right``, and of where the
    text ends.  A match has at least ``fewest`` and at most ``most`` words to the left of the suffix.
    """
    weight = seeded(2 * need, 53) | U(1)
    step = np.arange(need)

    def rows(ids, words, offsets, row, at, key):
        whole = np.zeros(len(at), U)
        begin, end = offsets[row], offsets[row + 1]
        with np.errstate(over="ignore"):
            for n, places in enumerate([*(at - 1 - k for k in step), *(at + right + k for k in step)]):
                inside = (places >= begin) & (places < end)
                whole += np.where(inside, words[np.where(inside, places, 0)], U(0)) * weight[n] if len(words) else U(0)
        fewest = np.maximum(at + right + need - end, 0)
        most = np.minimum(at - begin, need)
        room = fewest <= most
        yield {
            "key": pa.array(key[room]),
            "whole": pa.array(mix64(whole[room]).view(np.int64)),
            "id": ids.take(pa.array(row[room])),
            "at": pa.array((at - begin)[room], pa.int32()),
            "fewest": pa.array(fewest[room], pa.int32()),
            "most": pa.array(most[room], pa.int32()),
        }

    return _listed(docs, right, rows, "key long, whole long, id long, at int, fewest int, most int")


def _matches_by_window(docs: DataFrame, right: int, need: int) -> DataFrame:
    """(cell, id, start): the hash of each whole match that can lie around the listed suffixes, once per place."""
    size = right + need

    def rows(ids, words, offsets, row, at, key):
        if len(words) < size or not len(at):
            return
        first, last = np.maximum(at - need, offsets[row]), np.minimum(at, offsets[row + 1] - size)
        first, last = first[first <= last], last[first <= last]
        mark = np.zeros(len(words) + 1, np.int64)  # suffixes of a text overlap: each start counts once
        np.add.at(mark, first, 1)
        np.add.at(mark, last + 1, -1)
        start = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
        text = np.searchsorted(offsets, start, "right") - 1
        yield {
            "cell": pa.array(mix64(running_windows(words, size)[start]).view(np.int64)),
            "id": ids.take(pa.array(text)),
            "start": pa.array(start - offsets[text], pa.int32()),
        }

    return _listed(docs, right, rows, "cell long, id long, start int")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, start_word, n_words) of each stretch of a document that repeats in other documents.

    A stretch is a union of matches of ``min_words`` words or more with documents of another id; matches that overlap or
    touch are one stretch.  A-Z is read as a-z.  Null and empty texts and rows without an id have none; rows of one id
    are one document, whose repeats do not count among themselves.  ``min_words`` must leave room for a minimiser.
    Words are compared by 64-bit hashes, runs of words by 64-bit hashes of these.  Other columns play no part.

    The suffixes move once as (id, place, 64-bit key); keys of one document are counted away with map-side combining, and
    only suffixes whose key another document has read the words around them.  Most keys stand in one context everywhere
    (inside copies and passages), and then every match that has room is one.  Where the contexts of a key differ (at the
    ends of passages, next to edits), each whole match around the suffix is counted by its hash.  All counts are
    combined before they move, and results go back without gathering the rows of a hot key.
    """
    right = min_words - WINDOW + 1
    if right < SEED:
        raise ValueError(f"min_words must be at least {WINDOW + SEED - 1}")
    need = WINDOW - 1
    rows = docs.where(F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")
    )

    def with_suffixes(found: DataFrame) -> DataFrame:
        listed = found.groupBy("id").agg(F.collect_set(F.struct("at", "key")).alias("suffixes"))
        return rows.join(listed, "id").select("id", "text", "suffixes")

    between = [F.min("low").alias("low"), F.max("high").alias("high")]
    suffixes = materialize(_suffixes(rows, right))
    shared = suffixes.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("key")
    around = materialize(_around(with_suffixes(join_hot(suffixes, shared, "key")), right, need))
    contexts = around.groupBy("key", "whole").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    keys = contexts.groupBy("key").agg(*between, F.count("*").alias("contexts")).where("low < high")
    known = materialize(join_hot(around, keys.select("key", "contexts"), "key"))
    everywhere = known.where("contexts = 1").selectExpr("id", "at - most as start", f"at - fewest + {min_words} as end")
    cells = materialize(_matches_by_window(with_suffixes(known.where("contexts > 1")), right, need))
    twice = cells.groupBy("cell").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("cell")
    counted = join_hot(cells, twice, "cell").selectExpr("id", "start", f"start + {min_words} as end")
    ordered = "partition by id order by start, end"
    joined = everywhere.union(counted).distinct().selectExpr(
        "*", f"max(end) over ({ordered} rows between unbounded preceding and 1 preceding) as reach"
    )
    numbered = joined.selectExpr("id", "start", "end", f"sum(if(start <= reach, 0, 1)) over ({ordered}) as stretch")
    return numbered.groupBy("id", "stretch").agg(F.min("start").alias("start_word"), F.max("end").alias("end")).selectExpr(
        "id", "start_word", "cast(end - start_word as long) as n_words"
    )


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(id, text, cut_words) of the documents that have repeats, with each repeated stretch cut out.

    Cut texts have one space between words; every other document is as it was and is not in the result.
    """
    spans = repeated_passages(docs, id_col, text_col, min_words)
    lists = spans.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start_word", "n_words"))).alias("spans"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text")).join(lists, "id")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    kept = F.filter(
        words, lambda w, i: ~F.exists("spans", lambda s: (i >= s["start_word"]) & (i < s["start_word"] + s["n_words"]))
    )
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["n_words"])
    return rows.select("id", F.array_join(kept, " ").alias("text"), total.alias("cut_words"))
