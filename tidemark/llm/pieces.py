"""SentencePiece encoding and decoding for merge-type (BPE) models.

Encoding by backtracking gives exactly what repeated merging gives: a split of a text into pieces is the merge result if
and only if merging each two neighbours again leaves the two as they are.  So the encoder takes the longest piece at each
place, shortens it while it does not go with the piece before, and steps back when nothing fits; a bit for each place
remembers the places from which there is no way on, so a text is read in time linear in its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.frames import fresh

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6  # kinds of pieces in a model file
MODEL_LIMIT = 64 << 20  # bytes of a model file that a task may carry
ROWS_AT_ONCE = 200  # rows of an Arrow batch whose texts and ids are Python objects together
MEMORY = 200_000  # units whose ids, and pairs whose check, a worker keeps: about 70 MB


class PieceDecoder:
    """Decoder of one model, from the bytes of its file."""

    def __init__(self, model: bytes):
        from sentencepiece import sentencepiece_model_pb2 as proto

        spec = proto.ModelProto()
        spec.ParseFromString(model)
        norm = spec.normalizer_spec
        if spec.trainer_spec.model_type != proto.TrainerSpec.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces:
            raise ValueError("the model must be a BPE model that does not rewrite its input")
        if {p.type for p in spec.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.unknown = 0
        self.surface = []  # what an id adds to a decoded text; None for a byte
        for i, p in enumerate(spec.pieces):
            self.surface.append(p.piece.replace(SPACE, " ") if p.type == NORMAL else "")
            if p.type == NORMAL:
                self.score[p.piece], self.ids[p.piece] = p.score, i
            elif p.type == BYTE:
                self.bytes[int(p.piece[3:5], 16)] = i
                self.surface[i] = None
            elif p.type == UNKNOWN:
                self.unknown = i
                self.surface[i] = spec.trainer_spec.unk_surface
        self.byte_of = {i: b for b, i in self.bytes.items()}
        if not spec.trainer_spec.byte_fallback:
            self.bytes = {}

    def decode(self, ids: list[int]) -> str:
        """The text of ids: the space that encoding puts first goes, byte ids form characters, bad bytes give U+FFFD."""
        surface = self.surface
        parts = [surface[i] for i in ids]
        if None in parts:
            parts = list(self._with_bytes(ids, parts))
        text = "".join(parts)
        # the space that encoding puts first is part of the first piece that is not a control id
        first = next((i for i in ids if surface[i] != ""), self.unknown)
        return text[1:] if self.prefix and first != self.unknown and (surface[first] or "")[:1] == " " else text

    def _with_bytes(self, ids: list[int], parts: list) -> Iterator[str]:
        run = bytearray()
        for i, part in zip(ids, parts):
            if part is None:
                run.append(self.byte_of[i])
                continue
            if run:
                yield _characters(run)
                run = bytearray()
            yield part
        yield _characters(run)


class PieceCoder(PieceDecoder):
    """Encoder and decoder of one model."""

    def __init__(self, model: bytes):
        super().__init__(model)
        long = [p for p in self.score if len(p) > 1]
        self.matcher = ahocorasick.Automaton()
        for p in long:
            self.matcher.add_word(p, len(p))
        self.matcher.make_automaton()
        self.shorter = {p: next(p[:k] for k in range(len(p) - 1, 0, -1) if k == 1 or p[:k] in self.score) for p in long}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.histories: dict[str, tuple | None] = {}
        self.place, self.joins = self._joins(long)
        self.width = int(len(self.joins) ** 0.5)
        self.known = _Known(self)

    @staticmethod
    def _joins(long: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The row of each character and whether some piece has two characters next to each other.

        Where no piece has the two neighbours of a place side by side, no merge crosses the place.
        """
        characters = sorted(set("".join(long)))
        place = np.zeros(0x110000, np.int32)  # row 0: in no longer piece
        place[[ord(c) for c in characters]] = np.arange(1, len(characters) + 1)
        joins = np.zeros((len(characters) + 1,) * 2, bool)
        for piece in long:
            rows = place[[ord(c) for c in piece]]
            joins[rows[:-1], rows[1:]] = True
        return place, joins.ravel()

    def parts(self, text: str) -> list[str]:
        """``text`` cut where no merge can cross."""
        rows = self.place.take(np.frombuffer(text.encode("utf-32-le"), np.uint32))
        cuts = (np.flatnonzero(~self.joins.take(rows[:-1] * self.width + rows[1:])) + 1).tolist()
        return [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)])]

    def history(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        """How merging forms a piece: the score of each merge, and the first and last part before each and at the end.

        The pair with the best score merges first, the left one of equals.  None if merging does not form the piece.
        """
        if piece in self.histories:
            return self.histories[piece]
        parts = list(piece)
        scores, firsts, lasts = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            best, at = -np.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1])
                if s is not None and s > best:
                    best, at = s, i
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            firsts.append(parts[0])
            lasts.append(parts[-1])
        found = (scores, firsts, lasts) if len(parts) == 1 else None
        self.histories[piece] = found
        return found

    def compatible(self, a: str, b: str) -> bool:
        """Whether merging ``a`` and ``b`` again leaves the two as they are; an empty ``a`` asks for ``b`` alone.

        The merges inside ``a`` and inside ``b`` are known, so only the pair across their border is looked up anew:
        it must never be the best one left (the left one of equals).
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > MEMORY:
                self.pairs.clear()
            known = self.pairs[a, b] = self._remerged(a, b)
        return known

    def _remerged(self, a: str, b: str) -> bool:
        right = self.history(b)
        if right is None or not a:
            return right is not None
        left = self.history(a)
        if left is None:
            return False
        scores_a, lasts = left[0], left[2]
        scores_b, firsts = right[0], right[1]
        i = j = 0
        while True:
            across = self.score.get(lasts[i] + firsts[j])
            next_a = scores_a[i] if i < len(scores_a) else None
            next_b = scores_b[j] if j < len(scores_b) else None
            if across is not None and (next_a is None or across > next_a) and (next_b is None or across >= next_b):
                return False
            if next_a is not None and (next_b is None or next_a >= next_b):
                i += 1
            elif next_b is not None:
                j += 1
            else:
                return True

    def split(self, text: str) -> list[str]:
        """The pieces of ``text`` by backtracking."""
        n = len(text)
        if n == 1:
            return [text]
        longest = [1] * n
        for end, size in self.matcher.iter(text):
            start = end - size + 1
            if size > longest[start]:
                longest[start] = size
        shorter, pairs = self.shorter, self.pairs
        dead = bytearray(n + 1)
        found: list[str] = []
        at, before = 0, ""
        candidate = text[: longest[0]]
        while at < n:
            while candidate is not None:
                end = at + len(candidate)
                if not dead[end]:
                    # a first piece is checked with its neighbour, unless it is all there is
                    if not before and end < n:
                        break
                    fits = pairs.get((before, candidate))
                    if self.compatible(before, candidate) if fits is None else fits:
                        break
                candidate = shorter.get(candidate)
            if candidate is not None:
                found.append(candidate)
                at, before = end, candidate
                candidate = text[at : at + longest[at]] if at < n else None
            elif found:
                dead[at] = 1
                at -= len(before)
                candidate = shorter.get(found.pop())
                before = found[-1] if found else ""
            else:
                raise ValueError("no split of the text agrees with the model")
        return found

    def unit_ids(self, unit: str) -> list[int]:
        out: list[int] = []
        for piece in self.split(unit):
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out.extend(self.bytes[b] for b in piece.encode())
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text, without begin and end ids."""
        if not text:
            return np.zeros(0, np.int32)
        parts = self.parts(self.prefix + text.replace(" ", SPACE))
        return np.frombuffer(b"".join(map(self.known.__getitem__, parts)), np.int32)


def _characters(run: bytearray) -> str:
    """UTF-8 characters of a run of bytes; each byte that begins none gives one U+FFFD."""
    try:
        return run.decode()
    except UnicodeDecodeError:
        out, at = [], 0
        while at < len(run):
            for size in (1, 2, 3, 4):
                try:
                    out.append(run[at : at + size].decode())
                    break
                except UnicodeDecodeError:
                    continue
            else:
                size = 1
                out.append("�")
            at += size
        return "".join(out)


class _Known(dict):
    """The ids of units as bytes, worked out when first asked for."""

    def __init__(self, coder: PieceCoder):
        super().__init__()
        self.coder = coder

    def __missing__(self, unit: str) -> bytes:
        ids = np.array(self.coder.unit_ids(unit), np.int32).tobytes()
        if len(unit) <= 64:
            if len(self) >= MEMORY:
                self.clear()
            self[unit] = ids
        return ids


_coders: dict[type, tuple[bytes, PieceDecoder]] = {}  # of this worker process, the last model of each kind


def coder_of(kind: type, model: bytes) -> PieceDecoder:
    held = _coders.get(kind)
    if held is None or held[0] != model:
        held = _coders[kind] = model, kind(model)
    return held[1]


def load_model(path: str) -> bytes:
    """The bytes of a model file; they travel with the tasks, so their size is checked."""
    with open(path, "rb") as f:
        model = f.read(MODEL_LIMIT + 1)
    if len(model) > MODEL_LIMIT:
        raise ValueError(f"the model is larger than {MODEL_LIMIT} bytes")
    return model


def _mapped(df: DataFrame, coder: type, model: bytes, column: str, out: dict[str, T.DataType], convert) -> DataFrame:
    """``df`` with the columns ``out`` = ``convert(coder, values of column)``; every other column passes through."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    at = df.columns.index(column)
    schema = T.StructType([*df.schema.fields, *[T.StructField(name, kind) for name, kind in out.items()]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made_by = coder_of(coder, shared.value)
        for whole in batches:
            for first in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(first, ROWS_AT_ONCE)
                made = convert(made_by, batch.column(at))
                names = [*batch.schema.names, *out]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)
        pa.default_memory_pool().release_unused()  # the worker waits for other jobs with what it holds

    return df.mapInArrow(run, schema)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, ids)])
    if ends[-1] >= 1 << 31:
        raise ValueError("more than 2^31 ids in one Arrow batch; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def encode(df: DataFrame, model_path: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``df`` with the ids of each whole text as ``out`` array<int>; a null or empty text has none.

    The clashing name gets a leading underscore.  Repeated rows stay.
    """

    def convert(coder: PieceCoder, texts: pa.Array) -> list[pa.Array]:
        return [_lists([coder.encode(t or "") for t in texts.to_pylist()])]

    (name,) = fresh(df, out)
    return _mapped(df, PieceCoder, load_model(model_path), text_col, {name: T.ArrayType(T.IntegerType())}, convert)


def decode(df: DataFrame, model_path: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of the ids as ``out``; null ids give an empty text."""

    def convert(coder: PieceDecoder, lists: pa.Array) -> list[pa.Array]:
        if lists.null_count:
            lists = pc.fill_null(lists, pa.scalar([], lists.type))
        flat, ends = lists.flatten().to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py()
        return [pa.array([coder.decode(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])], pa.string())]

    (name,) = fresh(df, out)
    return _mapped(df, PieceDecoder, load_model(model_path), ids_col, {name: T.StringType()}, convert)


def encode_and_decode(df: DataFrame, model_path: str, text_col: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with what ``encode`` and then ``decode`` add, in one pass: a task needs one Python worker, not two.

    Clashing names get a leading underscore.  Repeated rows stay.
    """

    def convert(coder: PieceCoder, texts: pa.Array) -> list[pa.Array]:
        found = [coder.encode(t or "") for t in texts.to_pylist()]
        return [_lists(found), pa.array([coder.decode(x.tolist()) for x in found], pa.string())]

    ids, decoded = fresh(df, ids, decoded)
    out = {ids: T.ArrayType(T.IntegerType()), decoded: T.StringType()}
    return _mapped(df, PieceCoder, load_model(model_path), text_col, out, convert)


def digests(df: DataFrame, ids_col: str = "ids", decoded_col: str = "decoded") -> list:
    """Columns that sum up an encoded and decoded text."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return [
        F.size(ids_col).cast("long").alias("n_tokens"),
        F.sha2(joined.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col(decoded_col).cast("binary"), 256).alias("decoded_sha256"),
    ]
