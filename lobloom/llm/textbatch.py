"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

Texts of one Arrow batch are cut into chunks of about 256 KB (one text at least), laid end to end with a line feed between them, and scanned together.
All results are exact functions of the bytes; nothing is cut off.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 18
CHUNK_ROWS = 256

_BYTE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_BYTE >= 65) & (_BYTE <= 90), _BYTE + 32, _BYTE).astype(np.uint8)
# Bytes of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z.
IS_WORD = ((_BYTE >= 0x30) & (_BYTE <= 0x39)) | ((_BYTE >= 0x61) & (_BYTE <= 0x7A)) | (_BYTE >= 0x80)

_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 1 << 64)


@dataclass
class _Powers:
    up: np.ndarray
    down: np.ndarray

    @staticmethod
    def of(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out, dtype=np.uint64)


_POWERS = _Powers(np.ones(1, np.uint64), np.ones(1, np.uint64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2^64."""
    if n > 4 * CHUNK_BYTES:  # a very long text: not kept
        return _Powers.of(_MUL, n), _Powers.of(_INV, n)
    if len(_POWERS.up) < n:
        size = max(n, CHUNK_BYTES + 1)
        _POWERS.up, _POWERS.down = _Powers.of(_MUL, size), _Powers.of(_INV, size)
    return _POWERS.up[:n], _POWERS.down[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit depends on every bit."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def runs_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], equal for equal runs wherever they stand."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(len(values) + 1)
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64, out=total[1:])
    h = (total[ends] - total[starts]) * down[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))


def binary_list(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def text_chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(first index, texts) of consecutive texts with about ``limit`` bytes together."""
    first, size = 0, 0
    for i, t in enumerate(texts):
        if i > first and size + len(t) > limit:
            yield first, texts[first:i]
            first, size = i, 0
        size += len(t) + 1
    if first < len(texts):
        yield first, texts[first:]


def column_chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """The same over an Arrow column, a few rows at a time; null counts as empty."""
    rows = CHUNK_ROWS * max(1, limit // CHUNK_BYTES)
    for at in range(0, len(column), rows):
        for first, texts in text_chunks(binary_list(column.slice(at, rows)), limit):
            yield at + first, texts


class Words:
    """The words of a chunk of texts: where they start and end, and whose they are."""

    def __init__(self, texts: list[bytes]):
        self.raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.low = LOWER[self.raw]
        inside = IS_WORD[self.low].view(np.int8)
        edge = np.diff(inside, prepend=np.int8(0))
        self.starts = np.flatnonzero(edge == 1)
        self.ends = np.flatnonzero(edge == -1)
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.doc_at = np.concatenate([[0], np.cumsum(sizes)])  # byte where each text begins
        # First word of each text, and one more entry with the number of words.
        self.first = np.searchsorted(self.starts, self.doc_at)
        self.per_doc = np.diff(self.first)
        self._hash: np.ndarray | None = None

    def doc_of(self, word: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, word, side="right") - 1

    @property
    def hashes(self) -> np.ndarray:
        if self._hash is None:
            self._hash = runs_hash(self.low, self.starts, self.ends)
        return self._hash

    def text_of(self, word: int, n: int = 1) -> bytes:
        """n words from ``word`` on, lower-cased, one space between them."""
        low = self.low
        return b" ".join(low[self.starts[i] : self.ends[i]].tobytes() for i in range(word, word + n))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all runs of n words that stay inside a text."""
        count = len(self.starts)
        if count < n:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.arange(count - n + 1)
        stop = self.first[1:][self.doc_of(at)]
        at = at[at + n <= stop]
        return at, runs_hash(self.hashes, at, at + n)


def covered(starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Marks positions in [0, size) that lie in any of the runs [start, end)."""
    step = np.zeros(size + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0
