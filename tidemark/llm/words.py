"""Word hashes of text columns: one set of NumPy passes over the bytes of many texts.

Words are runs of bytes other than ``\\x20`` and ``\\x09``-``\\x0D``.  Python code here runs inside Spark tasks on Arrow
batches; a text longer than ``CHUNK`` is cut at separators, so working memory follows ``CHUNK`` and the longest word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 1 << 20
U = np.uint64


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (xor-shift and multiply)."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def seeded(n: int, seed: int) -> np.ndarray:
    """``n`` fixed 64-bit values of a seed."""
    with np.errstate(over="ignore"):
        return mix64((np.arange(n, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + mix64(np.array([seed], dtype=U)))


_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BYTE = seeded(256, 11)
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]
_STEP = 0x5851F42D4C957F2D
_STEP_BACK = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, CHUNK + 1), U(base))
        have[0] = 1
        have = np.multiply.accumulate(have)
        if n <= 4 * CHUNK:
            _powers[base] = have
    return have


def _hashes(data: np.ndarray, text_starts: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and start offsets of the words in ``data``; no word crosses a text start."""
    word = ~_SEPARATOR[data]
    if not word.any():
        return np.zeros(0, U), np.zeros(0, np.int64)
    first = word.copy()
    cut = ~word[:-1]
    cut_at = text_starts[(text_starts > 0) & (text_starts < len(data))] - 1
    cut[cut_at] = True
    first[1:] &= cut
    last = word.copy()
    after = ~word[1:]
    after[cut_at] = True
    last[:-1] &= after
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(len(data) + 1, U)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _power(_STEP, len(data))[: len(data)], out=total[1:])
    raw = (total[ends] - total[starts]) * _power(_STEP_BACK, len(data))[starts]
    return mix64(raw + (ends - starts).astype(U) * U(0xA0761D6478BD642F)), starts


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array and its n + 1 offsets; nulls are empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    body = texts.buffers()[2]
    return (np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)), offsets


def word_batches(texts: pa.Array, lower: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Yield (first row, word hashes, n + 1 word offsets) for runs of about ``CHUNK`` bytes of whole texts."""
    data, offsets = _bytes(texts)
    i, n = 0, len(texts)
    with np.errstate(over="ignore"):
        while i < n:
            j = int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1
            j = min(max(j, i + 1), n)
            part = data[offsets[i] : offsets[j]]
            if j == i + 1 and len(part) > CHUNK:
                hashes = _long_text(part, lower)
                yield i, hashes, np.array([0, len(hashes)])
            else:
                begins = offsets[i : j + 1] - offsets[i]
                hashes, starts = _hashes(part, begins, lower)
                yield i, hashes, np.searchsorted(starts, begins)
            i = j


def _long_text(part: np.ndarray, lower: bool) -> np.ndarray:
    found, at = [], 0
    while at < len(part):
        end = at + CHUNK
        while end < len(part) and not _SEPARATOR[part[end - 1]]:
            stop = np.flatnonzero(_SEPARATOR[part[end : end + CHUNK]])
            end = end + int(stop[0]) + 1 if len(stop) else end + CHUNK
        found.append(_hashes(part[at:end], np.zeros(1, np.int64), lower)[0])
        at = end
    return np.concatenate(found) if found else np.zeros(0, U)


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` words, one per start; the caller drops runs that cross texts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    weight = seeded(k, 23) | U(1)
    with np.errstate(over="ignore"):
        total = words[:n] * weight[0]
        for j in range(1, k):
            total = total + words[j : j + n] * weight[j]
        return mix64(total)


def running_windows(x: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash of each run of ``k`` values: one prefix sum serves every ``k``."""
    if len(x) < k:
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        total = np.zeros(len(x) + 1, U)
        np.cumsum(x * _power(_STEP, len(x))[: len(x)], out=total[1:])
        # brought down to the power 0, so equal runs are equal wherever they stand
        return (total[k:] - total[:-k]) * _power(_STEP_BACK, len(x))[: len(x) - k + 1]
