"""Chat formatting on tokens: segments are encoded one by one and reserved ids are spliced between them.

Template: ``[INST]`` user ``[/INST]``; ``<<SYS>>`` system ``<</SYS>>``; assistant ``</s>``; any other role
``[ROLE]`` its name ``[/ROLE]`` its text ``</s>``.  No space is added.  Only reserved ids stand for these strings; where a
text has one, a backslash goes after its first character (one more where there are some), so a text can neither open nor
close a turn and comes back as it was.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ["</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]", "<s>"]
PIECE = 1 << 16  # characters that are encoded at once

_OPEN = re.compile(r"<(\\*)(?=/?s>|</?SYS>>)|\[(\\*)(?=/?(?:INST|ROLE)\])")
_CLOSE = re.compile(r"<\\+(?=/?s>|</?SYS>>)|\[\\+(?=/?(?:INST|ROLE)\])")


def escape(text: str) -> str:
    """``text`` without control strings."""
    return _OPEN.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    """The text that ``escape`` was given."""
    return _CLOSE.sub(lambda m: m[0][:-1], text) if "\\" in text else text


class ChatCoder:
    """Encodes and reads back turns with a byte-level vocabulary; reserved ids follow its last one."""

    def __init__(self, ranks: bytes, pattern: str):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encoding = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        first = max(table.values()) + 1
        self.reserved = {c: first + k for k, c in enumerate(CONTROLS)}
        self.string = {i: c for c, i in self.reserved.items()}
        self.first = first

    def ids(self, text: str) -> list[int]:
        text = escape(text)
        if len(text) <= PIECE:
            return self.encoding.encode_ordinary(text)
        return [i for at in range(0, len(text), PIECE) for i in self.encoding.encode_ordinary(text[at : at + PIECE])]

    def segments(self, role: str | None, text: str) -> list[tuple[list[int], int]]:
        """(ids, 1 if under the loss mask) of a turn's segments."""
        r, body = self.reserved, self.ids(text)
        if role == "user":
            return [([r["[INST]"]], 0), (body, 0), ([r["[/INST]"]], 0)]
        if role == "system":
            return [([r["<<SYS>>"]], 0), (body, 0), ([r["<</SYS>>"]], 0)]
        if role == "assistant":
            return [(body, 1), ([r["</s>"]], 0)]
        return [([r["[ROLE]"]], 0), (self.ids(role or ""), 0), ([r["[/ROLE]"]], 0), (body, 0), ([r["</s>"]], 0)]

    def text(self, ids: list[int]) -> str:
        return self.encoding.decode(ids)

    def render(self, ids: list[int]) -> str:
        """The formatted string of ids."""
        out, run = [], []
        for i in ids:
            if i >= self.first:
                out += [self.text(run), self.string[i]]
                run = []
            else:
                run.append(i)
        return "".join(out) + self.text(run)

    def read(self, ids: list[int]) -> tuple[str, str]:
        """(role, text) of the ids of one turn."""
        at = [k for k, i in enumerate(ids) if i >= self.first]
        opening = self.string.get(ids[0])
        if opening == "[INST]":
            return "user", unescape(self.text(ids[1:-1]))
        if opening == "<<SYS>>":
            return "system", unescape(self.text(ids[1:-1]))
        if opening == "[ROLE]":
            return unescape(self.text(ids[1 : at[1]])), unescape(self.text(ids[at[1] + 1 : -1]))
        return "assistant", unescape(self.text(ids[:-1]))


_coders: dict[str, tuple[bytes, str, ChatCoder]] = {}  # of this worker process, the last vocabulary


def _coder(ranks: bytes, pattern: str) -> ChatCoder:
    held = _coders.get("last")
    if held is None or held[:2] != (ranks, pattern):
        held = _coders["last"] = ranks, pattern, ChatCoder(ranks, pattern)
    return held[2]


def format_chat(turns: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(conv_id, turn, token_ids, loss_mask, start) for each row of ``turns`` (conv_id, turn, role, text).

    Rows of a conversation are ordered by turn (null first), then role and text; repeated rows stay.  A null text is
    empty and a null role has an empty name; a null conv_id is a conversation of its own.  ``start`` is the place of the
    turn's first token in its conversation.  Other columns are left out.

    Turns are encoded before they are dealt out by conversation, so a very long conversation only costs its ordered
    pass one running sum; no conversation is held in memory.
    """
    shared = turns.sparkSession.sparkContext.broadcast(ranks)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        for batch in batches:
            flat: list[int] = []
            ends, change = [0], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for ids, learn in coder.segments(role, text or ""):
                    if learn and ids:
                        change += [(len(flat), 1), (len(flat) + len(ids), -1)]
                    flat += ids
                ends.append(len(flat))
            steps = np.zeros(len(flat) + 1, np.int8)
            for at, step in change:
                steps[at] += step
            mask = np.cumsum(steps[:-1], dtype=np.int8) > 0
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(mask))],
                names=[*batch.schema.names, "token_ids", "loss_mask"],
            )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, total = object(), 0
        for batch in batches:
            starts = []
            for conv, n in zip(batch.column(0).to_pylist(), np.diff(batch.column(2).offsets.to_numpy()).tolist()):
                if conv != current:
                    current, total = conv, 0
                starts.append(total)
                total += n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64())], names=[*batch.schema.names, "start"])

    rows = turns.select("conv_id", "turn", "role", "text")
    kind = dict(rows.dtypes)
    key = f"conv_id {kind['conv_id']}, turn {kind['turn']}"
    encoded = rows.mapInArrow(encode, f"{key}, role string, text string, token_ids array<int>, loss_mask array<boolean>")
    ordered = encoded.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "turn", "token_ids", "loss_mask").mapInArrow(
        place, f"{key}, token_ids array<int>, loss_mask array<boolean>, start long"
    )


def read_back(formatted: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of ``format_chat``'s rows as it returns them.

    The rows of a conversation must follow each other in order, as they do there; digests run along with them.
    """
    shared = formatted.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared.value, pattern)
        state = None

        def closed() -> list:
            conv, n, turns, loss_chars, loss, chars = state
            return [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars]

        schema = None
        for batch in batches:
            schema = schema or _digest_schema(batch.column(0).type)
            done = []
            for conv, ids, mask in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if state is None or conv != state[0]:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = coder.read(ids)
                state[1] += 1
                state[2].update(f"{role}\n{text}\n".encode())
                learned = np.array(ids, np.int64)[np.array(mask.as_py(), bool)].tolist()
                if learned:
                    under = unescape(coder.text(learned))
                    state[3] += len(under)
                    state[4].update(under.encode())
                state[5] += len(coder.render(ids))
            yield _digest_rows(done, schema)
        if state is not None:
            yield _digest_rows([closed()], schema)

    kind = dict(formatted.dtypes)["conv_id"]
    return formatted.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


def _digest_schema(conv: pa.DataType) -> pa.Schema:
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.schema(zip(names, [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]))


def _digest_rows(rows: list[list], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)
