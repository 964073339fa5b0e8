"""Periodic runs of words, by an online sparse dynamic program over diagonals.

Diagonal ``p`` of a text's match matrix has a cell for each word that equals the word ``p`` places before; a run of period
``p`` and ``n`` words is a stretch of ``n - p`` such cells.  The program reads the words from left to right and keeps, of
every diagonal that is active, only the match length so far.  It stays sparse because a cell is entered through the
earlier occurrence of the words that end there, not of the one word alone:

* lags are read by scale: at scale ``s`` lie the lags ``s`` to ``2 s - 1``, and a run that repeats ``times`` times has at
  least ``(times - 1) s`` matches in a row there, so the last ``grain = (times - 1) s`` words must have occurred before;
* of their earlier occurrences only the nearest matters.  If it is nearer than the smallest period ``q`` of the run, both
  distances are periods of the words between, which are more than both together, so their greatest common divisor is a
  period of the run and smaller than ``q``.  So a word enters one cell at each scale: the diagonal that is active there
  grows by one, or ends and another begins;
* a place whose last few words occur once in the text is on no run at all, and the stretches between such places are read
  one by one.  Most texts have none that is long enough.

A diagonal that ends with enough matches emits its run at once.  Its ends need no check: the word before its first cell and
the word after its last do not match.  Time is the number of repeated words times the logarithm of the stretch they are in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.frames import arrow_map, fresh
from tidemark.llm.words import U, mix64, running_windows, windows, word_batches

LEAST = 6  # words of a run
TIMES = 4  # how often a run repeats its period


def _repeated(words: np.ndarray, offsets: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` words that occur twice or more in their text, of several texts that follow each other."""
    grams = windows(words, k)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(text[: len(grams)] == text[k - 1 :][: len(grams)])  # not across two texts
    with np.errstate(over="ignore"):
        keys = grams[at] + mix64(text[at].astype(U) + U(1))
    order = np.argsort(keys)
    same = keys[order[1:]] == keys[order[:-1]]
    again = np.zeros(len(at), bool)
    again[order[1:]] = same
    again[order[:-1]] |= same
    return at[again]


class Diagonals:
    """The program over one stretch of words, scale by scale."""

    def __init__(self, least: int, times: int):
        self.least, self.times = least, times
        self.runs: list[tuple[int, int, int]] = []

    def read(self, words: np.ndarray, first: int) -> None:
        """Emit the runs (start, length, period) in ``words``, whose first has the number ``first``."""
        scale = 1
        while self.times * scale <= len(words):
            grain = max((self.times - 1) * scale, self.least - 2 * scale + 1, 1)
            self._scale(running_windows(words, grain).tolist(), scale, grain, first)
            scale *= 2

    def _scale(self, grams: list[int], scale: int, grain: int, first: int) -> None:
        last: dict[int, int] = {}
        active = begun = 0  # lag of the active diagonal (0: none) and the place of its first gram
        for at, gram in enumerate(grams):
            lag = at - last.get(gram, at)
            last[gram] = at
            if not scale <= lag < 2 * scale:
                lag = 0
            if lag != active:
                self._end(active, begun, at, grain, first)
                active, begun = lag, at
        self._end(active, begun, len(grams), grain, first)

    def _end(self, lag: int, begun: int, at: int, grain: int, first: int) -> None:
        length = at - begun + grain - 1 + lag
        if lag and length >= max(self.least, self.times * lag):
            self.runs.append((first + begun - lag, length, lag))


def _runs(words: np.ndarray, starts: np.ndarray, k: int, least: int, times: int) -> list[tuple[int, int, int]]:
    """Runs of one text, by start and period; ``starts`` are the places of its repeated grams of ``k`` words."""
    found = Diagonals(least, times)
    for stretch in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
        a, b = int(stretch[0]), int(stretch[-1]) + k
        if b - a >= least:
            found.read(words[a:b], a)
    return sorted((s, p, n) for s, n, p in found.runs)


def _collapse(text: str, runs: list[tuple[int, int, int]]) -> str:
    """The words of ``text`` outside the repeats of its runs, joined by one space."""
    words = text.encode().split()
    if runs:
        keep = np.ones(len(words), bool)
        for start, period, length in runs:
            keep[start + period : start + length] = False
        words = [words[i] for i in np.flatnonzero(keep).tolist()]
    return b" ".join(words).decode()


def periodic_runs(
    docs: DataFrame, text_col: str = "text", least: int = LEAST, times: int = TIMES, runs: str = "runs", collapsed: str = "collapsed"
) -> DataFrame:
    """``docs`` with ``runs`` array<struct<start, length, period>> and ``collapsed``, the text without repeats, per row.

    Words are runs of other characters than ``\\x20`` and ``\\x09``-``\\x0D``, numbered from 0, and compared by 64-bit hashes.
    A run is a stretch of words with the smallest period ``period`` (words so far apart are equal), of at least ``least``
    words and ``times`` periods, that keeps the period no further in either direction; runs are in order of start, then
    period, and may overlap.  ``collapsed`` drops each word that some run has after its first period and joins the
    others by one space.  Null and empty texts have no runs and collapse to an empty text.  Every row stands for itself, so
    repeated rows stay; all columns stay, and the new names get an underscore where they clash.
    A very long text is read with memory in proportion to its length, the words of a long run at every scale in turn.
    """
    if least < 2 or times < 3:
        raise ValueError("a run must have two words and three periods at least")
    k = _gram(least, times)
    names = fresh(docs, runs, collapsed)
    columns = docs.columns
    at = columns.index(text_col)

    def run(batch: pa.RecordBatch) -> Iterator[dict[str, pa.Array]]:
        texts = batch.column(at)
        for first, words, offsets in word_batches(texts):
            part = batch.slice(first, len(offsets) - 1)
            starts = _repeated(words, offsets, k) if len(words) >= k else np.zeros(0, np.int64)
            cuts = np.searchsorted(starts, offsets)
            found, kept = [], []
            for i, text in enumerate(part.column(at).to_pylist()):
                own = starts[cuts[i] : cuts[i + 1]] - offsets[i]
                found.append(_runs(words[offsets[i] : offsets[i + 1]], own, k, least, times) if len(own) else [])
                kept.append(_collapse(text or "", found[-1]))
            flat = np.array([r for rows in found for r in rows], np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
            structs = pa.StructArray.from_arrays([pa.array(flat[:, c]) for c in (0, 2, 1)], ["start", "length", "period"])
            yield {
                **dict(zip(columns, part.columns)),
                names[0]: pa.ListArray.from_arrays(ends, structs),
                names[1]: pa.array(kept, pa.string()),
            }

    of_run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    made = [T.StructField(names[0], T.ArrayType(of_run)), T.StructField(names[1], T.StringType())]
    return arrow_map(docs, run, T.StructType([*docs.schema.fields, *made]))


def _gram(least: int, times: int) -> int:
    """Words of the longest gram that repeats within the run at each of its places, whatever its period."""
    return min(max(least, times * p) - 2 * p + 1 for p in range(1, least + 1))


def run_digests(df: DataFrame, *keep: str, runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """The columns ``keep`` with the number of runs, the longest one (of equals the first) and digests of runs and text."""
    longest = f"array_min(transform(`{runs}`, r -> struct(-r.length as n, r.start as s, r.period as p))) as longest"
    lines = f"transform(`{runs}`, r -> concat(concat_ws(',', r.start, r.length, r.period), '\\n'))"
    return df.selectExpr(*[f"`{c}`" for c in keep], f"`{runs}`", f"`{collapsed}`", longest).selectExpr(
        *[f"`{c}`" for c in keep],
        f"cast(size(`{runs}`) as long) as n_runs",
        "longest.s as start",
        "-longest.n as length",
        "longest.p as period",
        "(-1000 * longest.n) div longest.p as exponent_milli",
        f"sha2(cast(array_join({lines}, '') as binary), 256) as runs_sha256",
        f"sha2(cast(`{collapsed}` as binary), 256) as collapsed_sha256",
    )
