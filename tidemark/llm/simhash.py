"""SimHash near-dedup by bit-sliced comparison.

A fingerprint has the majority of each bit over the hashes of a text's shingles.  Two fingerprints that differ in at most
``RADIUS`` bits agree on all but ``RADIUS`` of ``PARTS`` parts, so for each choice of parts left free there is a table keyed
by the other parts.  A bucket of it holds *different* fingerprints of one key: at most 2^16 of them, since two of eight
parts leave 16 bits free.  So no group of copies, however large, makes a bucket that a task cannot hold.

In a task the fingerprints of many buckets stand side by side in lanes, and their bits are stored as planes: word ``w`` of
plane ``b`` has bit ``b`` of 64 lanes.  A fingerprint is compared with 64 lanes at once by carry-save counters over the
planes, and words in which every lane is beyond the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.frames import arrow_map, join_hot, materialize

WORDS = 3
RADIUS = 2
PARTS = 8  # of 8 bits each
SEED = 42
BLOCK = 1 << 16  # hashes whose bits are counted at once
JOBS = 1 << 15  # words of lanes that are compared at once
LANES = 1 << 20  # fingerprints that stand side by side
ALL = ~np.uint64(0)


def shingle_hashes(text: str | None, k: int = WORDS, seed: int = SEED) -> np.ndarray:
    """XXH64 of each run of ``k`` words, repeats included; A-Z is read as a-z.

    A text with fewer words has its whole sequence as one; one without words has none.
    """
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII white spaces separate
    if not words:
        return np.zeros(0, np.uint64)
    joined, n = b" ".join(words), max(len(words) - k + 1, 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, ends = (ends - size)[:n].tolist(), ends[len(words) - n :].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends)), np.uint64, n)


def majority(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the hashes."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), BLOCK):
        count += _bits(hashes[at : at + BLOCK]).sum(0, dtype=np.int64)
    return np.packbits(2 * count > len(hashes), bitorder="little").view(np.uint64)[0]


def _bits(x: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8), axis=1, bitorder="little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(id, fingerprint) per row of ``docs`` (id, text); 64 bits as a signed long, 0 for a text without words."""

    def run(batch: pa.RecordBatch):
        made = np.array([majority(shingle_hashes(t.as_py())) for t in batch.column(1)], np.uint64)
        yield {"id": batch.column(0), "fingerprint": pa.array(made.view(np.int64))}

    return arrow_map(docs, run, "id long, fingerprint long")


def free_bits(radius: int = RADIUS) -> list[list[int]]:
    """For each table the bits that its key leaves free."""
    width = 64 // PARTS
    return [[p * width + i for p in chosen for i in range(width)] for chosen in combinations(range(PARTS), radius)]


class _Counters:
    """A bit-sliced distance per lane: plane ``k`` has bit ``k`` of the distance, ``over`` the lanes that ran out of planes."""

    def __init__(self, over: np.ndarray, radius: int):
        self.radius, self.over = radius, over
        self.planes = [np.zeros_like(over) for _ in range(max(radius.bit_length(), 1))]

    def add(self, x: np.ndarray, k: int = 0) -> None:
        for k in range(k, len(self.planes)):
            carry = self.planes[k] & x
            self.planes[k] ^= x
            x = carry
        self.over |= x

    def add_three(self, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> None:
        """Three differences by one carry-save adder: their sum bit counts one, their carry two."""
        half = x ^ y
        self.add(half ^ z)
        carry = (x & y) | (half & z)
        if len(self.planes) > 1:
            self.add(carry, 1)
        else:
            self.over |= carry

    def beyond(self) -> np.ndarray:
        """The lanes whose distance is above the radius."""
        above, equal = self.over.copy(), np.full_like(self.over, ALL)
        for k in range(len(self.planes) - 1, -1, -1):
            if self.radius >> k & 1:
                equal &= self.planes[k]
            else:
                above |= equal & self.planes[k]
                equal &= ~self.planes[k]
        return above

    def keep(self, alive: np.ndarray) -> None:
        self.over = self.over[alive]
        self.planes = [p[alive] for p in self.planes]


def lane_pairs(lanes: np.ndarray, starts: np.ndarray, bits: list[int], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Yield (lane, earlier lane) of all pairs of a bucket that differ in at most ``radius`` of ``bits``.

    ``lanes`` has the fingerprints of buckets that begin at ``starts``; other bits than ``bits`` are equal in a bucket.
    """
    n = len(lanes)
    width = -(-n // 64)
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, :n] = _bits(lanes).T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    first = np.repeat(starts, np.diff(np.append(starts, n)))
    every = np.arange(n)
    words = np.where(every > first, (every - 1) // 64 - first // 64 + 1, 0)  # words with earlier lanes of the bucket
    ends = np.cumsum(words)
    for at in range(0, int(ends[-1]) if n else 0, JOBS):
        job = np.arange(at, min(at + JOBS, int(ends[-1])))
        q = np.searchsorted(ends, job, "right")
        w = job - (ends[q] - words[q]) + first[q] // 64
        wanted = _below(q - 64 * w) & ~_below(first[q] - 64 * w)
        sums = _Counters(~wanted, radius)
        own = lanes[q]
        for k in range(0, len(bits), 3):
            apart = [planes[b, w] ^ (np.uint64(0) - (own >> np.uint64(b) & np.uint64(1))) for b in bits[k : k + 3]]
            if len(apart) == 3:
                sums.add_three(*apart)
            else:
                for x in apart:
                    sums.add(x)
            beyond = sums.beyond()
            alive = beyond != ALL
            if not alive.any():
                break
            if 4 * np.count_nonzero(alive) < 3 * len(alive):  # abandoned words leave the arrays
                q, w, own = q[alive], w[alive], own[alive]
                sums.keep(alive)
                beyond = beyond[alive]
        else:
            j, bit = np.nonzero(_bits(~beyond))
            yield q[j], w[j] * 64 + bit


def _below(n: np.ndarray) -> np.ndarray:
    """Words whose lowest ``n`` bits are set, ``n`` cut to 0 .. 64."""
    n = np.clip(n, 0, 64).astype(np.uint64)
    return np.where(n == 64, ALL, (np.uint64(1) << (n & np.uint64(63))) - np.uint64(1))


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after the trees of ``a`` and ``b`` are joined pair by pair; a root is the smallest of its tree."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up


def _links(buckets: DataFrame, radius: int) -> DataFrame:
    """(a, b): for each fingerprint of a bucket (bits, members) that others reach, the smallest lane of its component."""
    tables = free_bits(radius)

    def found(members: pa.ListArray, bits: list[int]) -> Iterator[dict[str, pa.Array]]:
        lanes = members.flatten().to_numpy().view(np.uint64)
        sizes = members.value_lengths().to_numpy()
        root = np.arange(len(lanes))
        for a, b in lane_pairs(lanes, np.cumsum(sizes) - sizes, bits, radius):
            root = hook(root, a, b)
        moved = np.flatnonzero(root != np.arange(len(root)))
        yield {"a": pa.array(lanes[moved].view(np.int64)), "b": pa.array(lanes[root[moved]].view(np.int64))}

    def run(batch: pa.RecordBatch):
        which, members = batch.column(0).to_numpy(), batch.column(1)
        for t in np.unique(which):
            own = members.take(pa.array(np.flatnonzero(which == t)))
            ends = np.cumsum(own.value_lengths().to_numpy())
            at = 0
            while at < len(own):
                stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + LANES, "right")), at + 1)
                yield from found(own.slice(at, stop - at), tables[t])
                at = stop

    return arrow_map(buckets, run, "a long, b long")


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fingerprint, component_id, kept) for each row of ``docs``.

    Rows whose fingerprints differ in at most ``radius`` bits (less than ``PARTS``) are linked; a component has the smallest
    id that can be reached.  Null and empty texts, and texts without words, have the fingerprint 0 and link like others.
    Rows with the same id are one document, tied by the id.  Rows without an id link with nothing: their component is null
    and they are kept.  Of a component the smallest id is kept.  Other columns of ``docs`` play no part; repeated rows stay.

    Equal fingerprints are one class, however many rows it has, so tables and links only know classes; the labels go back to
    the rows by a join that does not gather the rows of a hot class.
    """
    if not 0 <= radius < PARTS:
        raise ValueError(f"the radius must be 0 to {PARTS - 1}")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    signed = materialize(fingerprints(rows))
    known = signed.where("id is not null")
    classes = materialize(known.groupBy("fingerprint").agg(F.min("id").alias("rep")))
    keys = [~sum(1 << b for b in bits) & (2**64 - 1) for bits in free_bits(radius)]
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(k - 2**64 if k >= 2**63 else k)) for k in keys])
    tables = classes.select("fingerprint", F.posexplode(keys).alias("bits", "key"))
    buckets = tables.groupBy("bits", "key").agg(F.collect_list("fingerprint").alias("members")).where(F.size("members") > 1)
    # a repeated id ties its fingerprints together
    several = known.groupBy("id").agg(F.min("fingerprint").alias("b"), F.max("fingerprint").alias("c")).where("b < c")
    ties = known.join(several, "id").selectExpr("fingerprint as a", "b").where("a <> b")
    links = _links(buckets.select("bits", "members"), radius).union(ties)
    label = components(links).select(F.col("node").alias("fingerprint"), F.col("component").alias("part"))
    linked = materialize(classes.join(label, "fingerprint"))
    least = linked.groupBy("part").agg(F.min("rep").alias("component_id"))
    member = join_hot(linked, least, "part").select("fingerprint", "component_id")
    single = classes.join(linked, "fingerprint", "left_anti").selectExpr("fingerprint", "rep as component_id")
    labels = materialize(member.union(single))
    out = join_hot(known, labels, "fingerprint").select("id", "fingerprint", "component_id")
    out = out.unionByName(signed.where("id is null").selectExpr("id", "fingerprint", "cast(null as long) as component_id"))
    return out.withColumn("kept", F.expr("id is null or id = component_id"))
