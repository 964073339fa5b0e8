"""Benchmark decontamination by greedy string tiling.

Words of a document and of a test item that share a seed of ``SEED`` words are tiled: the longest runs common to both that
no tile covers yet are marked, again and again, down to ``SEED`` words.  Runs are found by running Karp-Rabin hashes and
compared word by word.  Tiles may stand in any order, so a reordered passage counts as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import fresh
from tidemark.llm.words import U, running_windows, windows, word_batches

SEED = 5  # words of the shortest tile
PERCENT = 75  # share of a test item's words that tiles must cover
BLOCK_BYTES = 8 << 20  # test text that a task holds at once; a larger benchmark is done in blocks


def tile(a: np.ndarray, b: np.ndarray, shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two word sequences: (place in a, place in b, words) of each tile.

    Each round looks for runs of the search length or longer (half of the last one, or the longest match when that was much longer),
    and marks them from the longest down; of equal ones the first in ``b``, then in ``a``.
    """
    used_a, used_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    tiles: list[tuple[int, int, int]] = []
    length = max(shortest, min(len(a), len(b), 64))
    while True:
        matches = _matches(a, b, used_a, used_b, length)
        longest = max((k for k, _ in matches), default=0)
        if longest > 2 * length:
            length = longest  # a run much longer than the search length: look for those first
            continue
        shortened, level = False, 0
        for k, j in sorted(matches, key=lambda m: (-m[0], m[1])):
            if shortened and k < level:
                break  # what is left of a longer match may be longer than this one
            level = k
            if used_b[j]:
                continue
            starts = matches[k, j].tolist()
            i = None if used_b[j : j + k].any() else next((i for i in starts if not used_a[i : i + k].any()), None)
            if i is None:
                shortened |= any(not used_a[i : i + length].any() for i in starts) and not used_b[j : j + length].any()
                continue
            used_a[i : i + k] = True
            used_b[j : j + k] = True
            tiles.append((i, j, k))
        if not shortened:
            if length == shortest:
                return sorted(tiles)
            length = max(shortest, length // 2)


def _matches(a: np.ndarray, b: np.ndarray, used_a: np.ndarray, used_b: np.ndarray, length: int) -> dict[tuple[int, int], np.ndarray]:
    """{(words, place in b): places in a} of the uncovered common runs of ``length`` words or more.

    Running hashes give the parts of both sides that can match; there, the length of the run from each pair of places follows
    from that of the next pair, a vector over ``a`` for each place in ``b``.  A place in ``b`` is covered once, and what a round
    covers in ``a`` is no longer than ``b``, so of the places in ``a`` with one length and place in ``b`` only the first 5 |b| + 1 can matter:
    a tile of m words blocks at most m + k runs of k words, k is at most twice the search length, and tiles are at least as long.
    """
    free_a, free_b = _free(used_a, length), _free(used_b, length)
    if not free_a.any() or not free_b.any():
        return {}
    ha, hb = running_windows(a, length), running_windows(b, length)
    at_a = _covered(np.flatnonzero(free_a & np.isin(ha, hb[free_b])), length, len(a))
    if not len(at_a):
        return {}
    at_b = _covered(np.flatnonzero(free_b & np.isin(hb, ha[free_a])), length, len(b))
    words, follows = a[at_a], np.append(np.diff(at_a) == 1, False)
    most = 5 * len(b) + 1
    found: dict[tuple[int, int], np.ndarray] = {}
    run, last = np.zeros(len(at_a), np.int64), -1
    for j in at_b[::-1].tolist():
        longer = np.zeros_like(run)
        if j + 1 == last:
            longer[:-1] = run[1:] * follows[:-1]
        run, last = np.where(words == b[j], longer + 1, 0), j
        starts = np.flatnonzero(run >= length)
        if len(starts):
            sizes = run[starts]
            order = np.argsort(sizes, kind="stable")
            kinds, first = np.unique(sizes[order], return_index=True)
            for k, part in zip(kinds.tolist(), np.split(order, first[1:])):
                found[k, j] = at_a[starts[part[:most]]]
    return found


def _covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """The places that lie in a run of ``length`` words from one of ``starts``."""
    edge = np.zeros(size + 1, np.int64)
    edge[starts] += 1
    edge[starts + length] -= 1
    return np.flatnonzero(np.cumsum(edge)[:size] > 0)


def _free(used: np.ndarray, k: int) -> np.ndarray:
    """Whether a run of ``k`` words from each place is uncovered."""
    if len(used) < k:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(used)])
    return total[k:] == total[:-k]


class _Items:
    """A block of test items: word hashes, and the items of each seed."""

    def __init__(self, ids: list, texts: list[str]):
        self.ids, self.words = ids, []
        for _, hashes, offsets in word_batches(pa.array(texts, pa.string()), lower=True):
            self.words += [hashes[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        seeds: dict[int, list[int]] = {}
        for k, w in enumerate(self.words):
            # an item shorter than a seed has itself as one
            for h in np.unique(windows(w, min(SEED, len(w)))).tolist() if len(w) else ():
                seeds.setdefault(h, []).append(k)
        self.seeds = seeds
        self.keys = np.array(sorted(seeds), U)
        self.lengths = sorted({min(SEED, len(w)) for w in self.words if len(w)})

    def found(self, w: np.ndarray) -> set[int]:
        """Items that share a seed with the words of a document."""
        items: set[int] = set()
        for k in self.lengths:
            h = windows(w, k)
            at = np.searchsorted(self.keys, h)
            at[at == len(self.keys)] = 0
            for x in np.unique(h[self.keys[at] == h]).tolist():
                items.update(self.seeds[x])
        return items


def contaminated(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = PERCENT,
) -> DataFrame:
    """(id, item_id, tiled_words, item_words, tiles array<struct<at, item_at, words>>) of each document row and test item
    whose words are covered to ``percent`` or more by tiles.

    A-Z is read as a-z.  Null and empty texts, on either side, match nothing; a null id stays null.  Repeated rows give repeated
    results.  Other columns of either side are not looked at, so their names do not matter.  A document's words are in
    memory as one 64-bit hash each, and a long or repetitive text takes time with its matching words times the item's.
    The test items are cut into blocks of about ``BLOCK_BYTES`` of text; every block is broadcast to one pass over the
    documents, so the memory a task needs does not grow with either side.
    """
    spark = docs.sparkSession
    bench = items.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("text")).where("text is not null")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES)
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kinds = dict(rows.dtypes) | dict(bench.select("item").dtypes)
    schema = f"id {kinds['id']}, item_id {kinds['item']}, tiled_words long, item_words long, tiles array<struct<at:long,item_at:long,words:long>>"
    out = spark.createDataFrame([], schema)
    for k in range(blocks):
        part = bench.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k) if blocks > 1 else bench
        held = part.toArrow()
        shared = spark.sparkContext.broadcast(_Items(held["item"].to_pylist(), held["text"].to_pylist()))
        one = rows.mapInArrow(_pass(shared, percent, held.schema.field("item").type), schema)
        out = one if blocks == 1 else out.unionByName(one)
    return out


def _pass(shared, percent: int, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: _Items = shared.value
        kind = pa.list_(pa.struct([("at", pa.int64()), ("item_at", pa.int64()), ("words", pa.int64())]))
        for batch in batches:
            picked, items, covered, sizes, tiles = [], [], [], [], []
            for first, hashes, offsets in word_batches(batch.column(1), lower=True):
                for r, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
                    w = hashes[a:b]
                    for k in sorted(block.found(w)):
                        item = block.words[k]
                        found = tile(w, item, min(SEED, len(item)))
                        words = sum(t[2] for t in found)
                        if 100 * words >= percent * len(item):
                            picked.append(first + r)
                            items.append(block.ids[k])
                            covered.append(words)
                            sizes.append(len(item))
                            tiles.append([{"at": i, "item_at": j, "words": n} for i, j, n in found])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(picked, pa.int64())),
                    pa.array(items, item_type),
                    pa.array(covered, pa.int64()),
                    pa.array(sizes, pa.int64()),
                    pa.array(tiles, kind),
                ]
                if picked
                else [batch.column(0).slice(0, 0), pa.array([], item_type), pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], kind)],
                names=["id", "item_id", "tiled_words", "item_words", "tiles"],
            )

    return run


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:
    """``docs`` without the rows that hold a test item; rows without an id are judged by their text all the same."""
    found = contaminated(docs.where(F.col(f"`{id_col}`").isNotNull()), items, id_col, text_col, **names)
    (key,) = fresh(docs, "found_id")
    clean = docs.join(found.select(F.col("id").alias(key)).distinct(), F.col(f"`{id_col}`") == F.col(key), "left_anti")
    nameless = docs.where(F.col(f"`{id_col}`").isNull())
    if not nameless.take(1):
        return clean
    marked = contaminated(nameless.select(F.col(f"`{text_col}`").alias("t")).distinct(), items, "t", "t", **names)
    dirty = marked.select(F.col("id").alias(key)).distinct()
    without_id = clean.where(F.col(f"`{id_col}`").isNull()).join(dirty, F.col(f"`{text_col}`") == F.col(key), "left_anti")
    return clean.where(F.col(f"`{id_col}`").isNotNull()).unionByName(without_id)
