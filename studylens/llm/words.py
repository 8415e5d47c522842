"""Vectorised word splitting and hashing over Arrow text batches.

Everything here works on numpy arrays inside one task.  Words are runs of bytes
outside ``[\\x20\\x09-\\x0D]``; because those separators are ASCII, splitting the
UTF-8 bytes gives the same words as splitting the characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_GOLDEN = U64(0x9E3779B97F4A7C15)
_BYTE_STEP = 0x9D8F3C2B51A7E6D5  # odd multipliers: invertible modulo 2**64
_WORD_STEP = 0xC2B2AE3D27D4EB4F
#: Bytes of text that a task works on at a time; about 40 bytes of arrays each.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser; turns structured sums into uniform hashes."""
    x = np.asarray(x, dtype=U64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _byte_codes(lower: bool) -> np.ndarray:
    with np.errstate(over="ignore"):
        codes = mix(np.arange(1, 257, dtype=U64) * _GOLDEN)
    if lower:
        codes[65:91] = codes[97:123]
    return codes


_CODES = {False: _byte_codes(False), True: _byte_codes(True)}
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Growing tables of step**i and step**-i modulo 2**64."""

    def __init__(self, step: int):
        self.step, self.inverse = step, pow(step, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (self._table(s, size) for s in (self.step, self.inverse))
        return self.up, self.down

    @staticmethod
    def _table(step: int, n: int) -> np.ndarray:
        out = np.full(n, U64(step), dtype=U64)
        out[0] = 1
        return np.multiply.accumulate(out)


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE_STEP), _Powers(_WORD_STEP)


class Words:
    """Words of consecutive documents: hashes, byte spans and first word of each document."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool):
        """``offsets`` are the documents' byte positions in ``data``, starting at 0."""
        n = len(data)
        self.data, self.offsets = data, offsets
        space = _SPACE[data]
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        first, last = ~space, ~space
        if n:
            first[1:] &= space[:-1] | edge[1:n]
            last[:-1] &= space[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        #: words of document d are first[d] .. first[d + 1]
        self.first = np.searchsorted(self.start, offsets)
        up, down = _BYTE_POWERS.get(n + 1)
        sums = np.zeros(n + 1, dtype=U64)
        np.cumsum(_CODES[lower][data] * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(U64))

    def __len__(self) -> int:
        return len(self.hash)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def prefix(self, salt: int = 0) -> np.ndarray:
        """Sums for ``window_hash``; another salt gives hashes that collide independently."""
        up, _ = _WORD_POWERS.get(len(self.hash) + 1)
        sums = np.zeros(len(self.hash) + 1, dtype=U64)
        code = mix(self.hash + U64(salt)) if salt else self.hash
        np.cumsum(code * up[: len(self.hash)], out=sums[1:])
        return sums

    def window_hash(self, sums: np.ndarray, start: np.ndarray, length) -> np.ndarray:
        """Hash of the word sequences of ``length`` words that begin at ``start``."""
        _, down = _WORD_POWERS.get(len(self.hash) + 1)
        return mix((sums[start + length] - sums[start]) * down[start] + np.asarray(length).astype(U64) * _GOLDEN)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, lower: bool, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) of groups of rows of about ``most`` bytes."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        stop = min(rows, max(stop, row + 1))
        yield row, stop, Words(data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row], lower)
        row = stop


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(U64).view(np.int64)
