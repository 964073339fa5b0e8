"""Alignment of the tokens of two tokenizers, by diagonal run skipping.

Both token lists of a text cover the same bytes, so they are two rising lists of byte offsets.  Where a token of each ends
at the same offset, the text is cut; between two cuts lies a group of tokens that only correspond as a whole.  Most groups
are one-to-one, and along a stretch of them the places in the two lists differ by a constant shift: the end lists are
compared at that shift over 1, 2, 4 .. places until they differ, and the last probe is halved down to the difference.  What
follows is an irregular group: the list that is behind goes on until both ends agree, which gives the next shift.

Texts consist of units whose ends are always ends of tokens of both, so a unit has the same groups in every text.  New
units are encoded and aligned in joined texts, and what is known of a unit is put together for each text that has it.

Two tokens that end together cover the same last bytes, so one is a suffix of the other: the pairs that can ever be linked
are known from the two vocabularies alone, at most one for each byte of their tokens.  That bounds the table of counts.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import fresh
from tidemark.llm.pieces import SPACE, load_model

TEXT_AT_ONCE = 1 << 18  # characters of the texts that are aligned together
PAIR_LIMIT = 1 << 23  # pairs that a table of counts may have: 16 bytes each


def _characters_of_bytes() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves, the others for the characters from U+0100 on.
    """
    prints = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(others)) for b in range(256)]


#: A text is cut into units before each space that follows a printing ASCII character, a letter or a digit.
UNIT = re.compile(r"(?<=[!-~\w])(?= )")
INNER = re.compile(r"[!-~\w]")  # how a unit that another one follows ends
JOINED = 1 << 14  # characters of units that are encoded as one text
MEMORY = 200_000  # units whose records a worker keeps, in two generations
LONG = 64  # characters; longer units are not kept


class ByteTokens:
    """A byte-level tokenizer, from the bytes of its JSON file.

    Its words never have white space after another character, so a text has the tokens of its units.
    """

    def __init__(self, model: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores at work
        from tokenizers import Tokenizer

        spec = json.loads(model)
        splits = spec.get("pre_tokenizer") or {}
        if splits.get("type") != "ByteLevel" or not splits.get("use_regex") or splits.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("the tokenizer must be byte-level and must not rewrite its input")
        self.tokenizer = Tokenizer.from_str(model.decode())
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte = {c: b for b, c in enumerate(_characters_of_bytes())}
        special = {t["id"] for t in spec.get("added_tokens", [])}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.token_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.token_bytes[i] = token.encode() if i in special else bytes(byte[c] for c in token)

    def encode(self, units: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]


class PieceTokens:
    """A sentencepiece tokenizer that puts a space before a text, from the bytes of its model file.

    No piece has a space after another character, so a text has the tokens of its units.  Texts are encoded without the
    space that they begin with and that the library puts back.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if not norm.add_dummy_prefix or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("the model must put a space first and not rewrite its input otherwise")
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or any(SPACE in p.piece.lstrip(SPACE) for p in spec.pieces):
            raise ValueError("the model must merge pairs and have spaces only at the start of its pieces")
        self.tokenizer = SentencePieceProcessor(model_proto=model)
        self.token_bytes = [self._bytes(i) for i in range(self.tokenizer.get_piece_size())]
        self.space = [self.tokenizer.piece_to_id(SPACE)]

    def _bytes(self, i: int) -> bytes:
        piece = self.tokenizer.id_to_piece(i)
        if self.tokenizer.is_byte(i):
            return bytes([int(piece[1:-1], 16)])
        return piece.replace(SPACE, " ").encode()

    def encode(self, units: list[str]) -> list[list[int]]:
        if not units:
            return []
        found = self.tokenizer.encode([u[1:] for u in units], num_threads=1)
        return [ids or self.space for ids in found]  # the library puts no space before an empty text


def _joined(units: list[str], limit: int) -> list[list[str]]:
    """``units`` in lists that make texts of about ``limit`` characters."""
    ends = np.cumsum([len(u) for u in units])
    parts, at = [], 0
    while at < len(units):
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")), at + 1)
        parts.append(units[at:stop])
        at = stop
    return parts


_NOTHING = (np.zeros(0, np.int32),) * 4


def unit_arrays(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, stops: list[int]) -> list[tuple]:
    """(A ids, B ids, A tokens of each group, B tokens of each group) of each unit, as bytes; unit ``k`` ends with cut ``stops[k] - 1``."""
    raw = [x.astype(np.int32).tobytes() for x in (a_ids, b_ids, np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0))]
    last = np.array(stops) - 1
    ends = [(4 * x).tolist() for x in (a_cuts[last], b_cuts[last], last + 1, last + 1)]
    return list(zip(*([x[i:j] for i, j in zip([0, *e], e)] for x, e in zip(raw, ends))))


class _Aligner:
    """Aligns texts by their units, and keeps what ``records`` gives for the units that it has seen more than once."""

    def __init__(self, a: ByteTokens | PieceTokens, b: ByteTokens | PieceTokens, records: Callable[..., list[tuple]] = unit_arrays):
        self.sides = [(t, t.token_bytes, np.array([len(x) for x in t.token_bytes], np.int64)) for t in (a, b)]
        self.records = records
        # each with the generation before it
        self.known: dict[str, tuple] = {}
        self.known_before: dict[str, tuple] = {}
        self.seen: set[int] = set()
        self.seen_before: set[int] = set()

    def units(self, texts: list[str | None]) -> Iterator[list[tuple]]:
        """The records of the units of each text; none unless both lists of tokens cover a space and the text."""
        split = [UNIT.split(" " + t) if t else [] for t in texts]
        new = set().union(*split).difference(self.known)
        back = new & self.known_before.keys()
        self.known.update((u, self.known_before[u]) for u in back)
        new -= back
        # a unit that none may follow is the last of its text, and encoded alone
        alone = {own[-1] for own in split if own and not INNER.match(own[-1], len(own[-1]) - 1)} & new
        joined = list(new - alone)
        found = dict(zip(joined, self._encoded(_joined(joined, JOINED), JOINED)))
        found.update(zip(alone, self._encoded([[u] for u in alone], JOINED)))
        odd = {u for u, x in found.items() if x is None}
        for u in odd:
            del found[u]
        self.known.update(found)
        record = self.known.__getitem__
        for own in split:
            yield list(map(record, own)) if odd.isdisjoint(own) else []
        self._forget(found)

    def align(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        """(A ids, B ids, A tokens up to each cut, B tokens up to each cut) of each text, with ``unit_arrays`` as records."""
        for own in self.units(texts):
            if own:
                a, b, *sizes = (np.frombuffer(b"".join(x), np.int32) for x in zip(*own))
                yield a, b, *(np.cumsum(x, dtype=np.int32) for x in sizes)
            else:
                yield _NOTHING

    def _encoded(self, parts: list[list[str]], limit: int) -> list[tuple | None]:
        """The record of each unit of ``parts``, whose texts are encoded and aligned as wholes; None where tokens are not a unit's bytes.

        If the tokens of a text are not its bytes, its units are taken in shorter texts, at last one by one.
        """
        texts = ["".join(p) for p in parts]
        out: list[tuple | None] = []
        for part, text, *both in zip(parts, texts, *(tokens.encode(texts) for tokens, _, _ in self.sides)):
            raw = text.encode()
            if all(b"".join(map(token_bytes.__getitem__, ids)) == raw for ids, (_, token_bytes, _) in zip(both, self.sides)):
                a, b = (np.array(ids, np.int32) for ids in both)
                a_ends, b_ends = (np.cumsum(sizes[x]) for x, (_, _, sizes) in zip((a, b), self.sides))
                a_cuts, b_cuts = cuts(a_ends.tolist(), b_ends.tolist())
                ends = np.cumsum([len(u) for u in part] if text.isascii() else [len(u.encode()) for u in part])
                out += self.records(a, b, a_cuts, b_cuts, (np.searchsorted(a_ends[a_cuts - 1], ends) + 1).tolist())
            elif len(part) == 1:
                out.append(None)
            else:
                out += self._encoded(_joined(part, limit // 16), limit // 16)
        return out

    def _forget(self, new: dict[str, tuple]) -> None:
        """Keep of new units those that come a second time; most come once."""
        for u in new:
            h = hash(u)
            if len(u) > LONG or not (h in self.seen or h in self.seen_before):
                del self.known[u]
                self.seen.add(h)
        if 2 * len(self.known) > MEMORY:
            self.known, self.known_before = {}, self.known
        if len(self.seen) > MEMORY:
            self.seen, self.seen_before = set(), self.seen


def stretches(a: list[int], b: list[int]) -> list[tuple[int, int, int]]:
    """The groups of two rising lists of end offsets with the same last one, as runs (first, last + 1, shift) over ``a``.

    The groups of a run end at the places ``first .. last`` of ``a`` and at these plus ``shift`` of ``b``: either a stretch of
    one-to-one groups or a single irregular one.
    """
    out: list[tuple[int, int, int]] = []
    i = j = 0
    n = len(a)
    while i < n:
        if a[i] == b[j]:
            first, shift, step = i, j - i, 1
            i += 1
            # probe twice as far each time, then halve the last probe; slices at the end are equal only if both lists end
            while i < n and a[i : i + step] == b[i + shift : i + shift + step]:
                i += step
                step += step
            while i < n and step > 1:
                step //= 2
                if a[i : i + step] == b[i + shift : i + shift + step]:
                    i += step
            i = min(i, n)
            out.append((first, i, shift))
            if i == n:
                break
            j = i + shift
        x, y = a[i], b[j]
        while x != y:
            if x < y:
                i += 1
                x = a[i]
            else:
                j += 1
                y = b[j]
        out.append((i, i + 1, j - i))
        i += 1
        j += 1
    return out


def cuts(a: list[int], b: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """How many tokens of ``a`` and of ``b`` lie before each offset where both end."""
    runs = np.array(stretches(a, b), np.int32).reshape(-1, 3)
    sizes = runs[:, 1] - runs[:, 0]
    ends = np.cumsum(sizes, dtype=np.int32)
    cut_a = np.arange(1, len(sizes) and ends[-1] + 1, dtype=np.int32) + np.repeat(runs[:, 1] - ends, sizes)
    return cut_a, cut_a + np.repeat(runs[:, 2], sizes)


_loaded: dict[type, tuple[bytes, ByteTokens | PieceTokens]] = {}  # of this worker process, the last model of each kind


def _tokens(kind: type, model: bytes) -> ByteTokens | PieceTokens:
    held = _loaded.get(kind)
    if held is None or held[0] != model:
        held = _loaded[kind] = model, kind(model)
    return held[1]


_aligners: dict[str, _Aligner] = {}  # of this worker process, that of the last job


def _aligner(job: str, models: tuple[bytes, bytes], records: Callable[..., list[tuple]]) -> _Aligner:
    """The aligner of a job, which knows the units of the tasks before."""
    if job not in _aligners:
        _aligners.clear()
        _aligners[job] = _Aligner(_tokens(ByteTokens, models[0]), _tokens(PieceTokens, models[1]), records)
    return _aligners[job]


def _slices(batch: pa.RecordBatch, sizes: np.ndarray, limit: int) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of rows whose sizes add up to about ``limit``; a row is never cut."""
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        stop = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")), at + 1)
        yield batch.slice(at, stop - at)
        at = stop


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([_NOTHING[0], *rows])))


def _mapped(docs: DataFrame, byte_model: str, piece_model: str, text_col: str, keep: list[str], fields: list[T.StructField], make, records: Callable[..., list[tuple]] = unit_arrays) -> DataFrame:
    """Columns ``keep`` of ``docs`` and those that ``make`` gives for an aligner and the texts of a part of a batch."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`"))
    models = docs.sparkSession.sparkContext.broadcast((load_model(byte_model), load_model(piece_model)))
    names = [*keep, *(f.name for f in fields)]
    job = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(job, models.value, records)
        for whole in batches:
            sizes = pc.fill_null(pc.utf8_length(whole.column(len(keep))), 0).to_numpy(zero_copy_only=False)
            for batch in _slices(whole, sizes, TEXT_AT_ONCE):
                made = make(aligner, batch.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *made], names=names)

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields[: len(keep)], *fields]))


ALIGNED = ("a_ids", "b_ids", "a_cuts", "b_cuts")


def align_tokens(docs: DataFrame, byte_model: str, piece_model: str, text_col: str = "text", names: tuple[str, ...] = ALIGNED) -> DataFrame:
    """``docs`` with the token ids of a space and the text by two tokenizers, and the tokens of each before every cut.

    A is the byte-level tokenizer of the file ``byte_model``, B the sentencepiece model ``piece_model``, which adds the space
    itself.  Special tokens are not added, and their strings inside texts are ordinary text.  Group ``g`` has the A tokens
    ``a_cuts[g - 1] .. a_cuts[g] - 1`` and the B tokens ``b_cuts[g - 1] .. b_cuts[g] - 1``, counted from 0.  A text that is
    null or empty, or whose joined A or B tokens are not the space and the text, has four empty lists.  Every row stands for
    itself and repeated rows stay; all columns stay, and names that clash get an underscore.  A text is read as a whole,
    so a very long one needs memory in proportion to its length.
    """
    made = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in fresh(docs, *names)]

    def make(aligner: _Aligner, texts: list[str | None]) -> list[pa.Array]:
        return [_lists(list(x)) for x in zip(*aligner.align(texts))]

    return _mapped(docs, byte_model, piece_model, text_col, docs.columns, made, make)


def id_strings(n: int) -> np.ndarray:
    """The decimal string of each id below ``n`` with the sign that follows it: ``,`` in a group, ``|`` after A, ``;`` after B."""
    return np.array([[f"{i}{c}" for i in range(n)] for c in ",|;"], object)


def _group_strings(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, strings: np.ndarray) -> list[str]:
    """The strings of the ids, group by group."""
    n, m = len(a_ids), len(b_ids)
    a_mark, b_mark = np.zeros(n, np.int8), np.zeros(m, np.int8)
    a_mark[a_cuts - 1] = 1
    b_mark[b_cuts - 1] = 2
    # an A token follows the B tokens of earlier groups, a B token the A tokens up to its own group
    out = np.empty(n + m, object)
    out[np.arange(n) + np.repeat(np.append(0, b_cuts[:-1]), np.diff(a_cuts, prepend=0))] = strings[a_mark, a_ids]
    out[np.arange(m) + np.repeat(a_cuts, np.diff(b_cuts, prepend=0))] = strings[b_mark, b_ids]
    return out.tolist()


def group_text(a_ids: np.ndarray, b_ids: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, strings: np.ndarray) -> str:
    """The groups as ``a1,a2|b1;a3|b2``."""
    return "".join(_group_strings(a_ids, b_ids, a_cuts, b_cuts, strings))[:-1]


class LinkPairs:
    """All (A id, B id) that can end together: one token's bytes are a suffix of the other's.  A pair has a place in the order."""

    def __init__(self, a: list[bytes], b: list[bytes]):
        ids: list[dict[bytes, list[int]]] = []
        for side in (a, b):
            known = defaultdict(list)
            for i, x in enumerate(side):
                if x:
                    known[x].append(i)
            ids.append(known)
        found = [(i, j) for x, left in ids[0].items() for k in range(len(x)) for j in ids[1].get(x[k:], ()) for i in left]
        found += [(i, j) for y, right in ids[1].items() for k in range(1, len(y)) for i in ids[0].get(y[k:], ()) for j in right]
        if len(found) > PAIR_LIMIT:
            raise ValueError(f"the vocabularies allow more than {PAIR_LIMIT} pairs")
        self.width = max(len(b), 1)
        self.ids_below = max(len(a), len(b))
        self.keys = np.unique(np.array([i * self.width + j for i, j in found], np.int64))

    def places(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, a_ids.astype(np.int64) * self.width + b_ids)

    def ids(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.divmod(self.keys[places], self.width)


def link_pairs(byte_model: str, piece_model: str) -> LinkPairs:
    return LinkPairs(ByteTokens(load_model(byte_model)).token_bytes, PieceTokens(load_model(piece_model)).token_bytes)


def aligned_digests(
    docs: DataFrame, byte_model: str, piece_model: str, pairs: LinkPairs, keep: list[str], text_col: str = "text"
) -> DataFrame:
    """(``keep``, n_a, n_b, n_groups, groups_sha256, links) of the rows of ``docs``, aligned as ``align_tokens`` does.

    The digest is of ``group_text``, and an empty text where there are no tokens.  ``links`` has for each cut the place in
    ``pairs`` of the two tokens that end there.  The new names must be none of ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    made = [T.StructField(n, T.LongType()) for n in ("n_a", "n_b", "n_groups")]
    made += [T.StructField("groups_sha256", T.StringType()), T.StructField("links", T.ArrayType(T.IntegerType()))]
    held: list[np.ndarray] = []  # of a worker, once it has begun

    def records(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray, stops: list[int]) -> list[tuple]:
        if not held:
            held.append(id_strings(shared.value.ids_below))
        strings = _group_strings(a, b, a_cuts, b_cuts, held[0])
        links = shared.value.places(a[a_cuts - 1], b[b_cuts - 1]).astype(np.int32).tobytes()
        last = np.array(stops) - 1
        a_ends, b_ends = a_cuts[last], b_cuts[last]
        n_a, n_b = (np.diff(x, prepend=0).tolist() for x in (a_ends, b_ends))
        ends = (a_ends + b_ends).tolist()
        texts = ["".join(strings[i:j]).encode() for i, j in zip([0, *ends], ends)]
        return list(zip(texts, [links[4 * i : 4 * j] for i, j in zip([0, *stops], stops)], n_a, n_b))

    def make(aligner: _Aligner, texts: list[str | None]) -> list[pa.Array]:
        rows = []
        for own in aligner.units(texts):
            groups, links, n_a, n_b = zip(*own) if own else ((),) * 4
            digest = hashlib.sha256(b"".join(groups)[:-1]).hexdigest() if own else ""
            rows.append((sum(n_a), sum(n_b), digest, np.frombuffer(b"".join(links), np.int32)))
        n_a, n_b, digests, links = zip(*rows)
        counts = [pa.array(x, pa.int64()) for x in (n_a, n_b, [len(x) for x in links])]
        return [*counts, pa.array(digests, pa.string()), _lists(list(links))]

    return _mapped(docs, byte_model, piece_model, text_col, keep, made, make, records)


def link_counts(linked: DataFrame, pairs: LinkPairs, links: str = "links") -> DataFrame:
    """(pair, a_id, b_id, n): how many links hold each pair, of those that occur.

    A task counts its rows in an array with a number per pair, so a frequent pair costs as much as a rare one.
    """
    shared = linked.sparkSession.sparkContext.broadcast(pairs)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value.keys), np.int64)
        for batch in batches:
            total += np.bincount(batch.column(0).flatten().to_numpy(), minlength=len(total))
        place = np.flatnonzero(total)
        a, b = shared.value.ids(place)
        columns = [place.astype(np.int32), a.astype(np.int32), b.astype(np.int32), total[place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pair", "a_id", "b_id", "n"])

    part = linked.select(F.col(f"`{links}`")).mapInArrow(count, "pair int, a_id int, b_id int, n long")
    return part.groupBy("pair", "a_id", "b_id").agg(F.sum("n").alias("n"))


def link_scores(linked: DataFrame, pairs: LinkPairs, links: str = "links") -> DataFrame:
    """``linked`` without ``links`` but with n_links, n_best (links whose pair is a most frequent one of its B id) and count_sum.

    ``linked`` should be a written table, as it is read twice.  The counts go through the driver: they have at most a row
    for each pair of ``pairs``, a number that the vocabularies fix and ``PAIR_LIMIT`` bounds, whatever the corpus.
    """
    counts = link_counts(linked, pairs, links).select("pair", "n").toArrow()
    count = np.zeros(len(pairs.keys), np.int64)
    count[counts["pair"].to_numpy()] = counts["n"].to_numpy()
    _, b = pairs.ids(np.arange(len(count)))
    most = np.zeros(pairs.width, np.int64)
    np.maximum.at(most, b, count)
    shared = linked.sparkSession.sparkContext.broadcast((count, count == most[b]))
    at = linked.columns.index(links)
    kept = [f for f in linked.schema.fields if f.name != links]
    made = ["n_links", "n_best", "count_sum"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, best = shared.value
        for batch in batches:
            sizes = batch.column(at).value_lengths().to_numpy()
            ends = np.append(0, np.cumsum(sizes))
            flat = batch.column(at).flatten().to_numpy()
            sums = [np.append(0, np.cumsum(x[flat], dtype=np.int64)) for x in (best, number)]
            columns = [sizes.astype(np.int64), *(s[ends[1:]] - s[ends[:-1]] for s in sums)]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, *map(pa.array, columns)], names=[*(f.name for f in kept), *made])

    return linked.mapInArrow(run, T.StructType([*kept, *[T.StructField(n, T.LongType()) for n in made]]))
