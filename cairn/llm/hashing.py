"""Tokens and their 64-bit hashes by array operations over Arrow batches.

A token's hash is a polynomial of random 64-bit values of its bytes modulo 2**64,
then mixed.  It is taken for all tokens at once from prefix sums, so no Python
code runs per word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Tokens are hashed in windows of at most so many bytes; a longer token is hashed by itself.
WINDOW = 1 << 18
#: Batches are cut into runs of rows of about so many bytes (one row at least).
RUN_BYTES = 4 << 20

_rng = np.random.Generator(np.random.PCG64(20240601))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int) -> np.ndarray:
    out = np.ones(WINDOW + 1, np.uint64)
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_POW, _INV = _powers(_BASE), _powers(_INVERSE)

WHITE = bytes([0x20, *range(0x09, 0x0E)])


def word_classes() -> np.ndarray:
    """Words are runs of anything but blanks and \\x09-\\x0D."""
    out = np.ones(256, np.uint8)
    out[list(WHITE)] = 0
    return out


def word_mark_classes() -> np.ndarray:
    """Words are runs of 0-9, A-Z, a-z and non-ASCII bytes; marks are runs of other visible ASCII."""
    out = np.full(256, 2, np.uint8)
    out[:0x21] = 0
    out[0x7F] = 0
    for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
        out[a:b] = 1
    return out


def lower_table() -> np.ndarray:
    low = np.arange(256)
    low[0x41:0x5B] += 0x20
    return _BYTE[low]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs(column: pa.Array):
    """(first row, rows, bytes, offsets) of runs of rows of a binary column; offsets
    (rows + 1 of them) are into the bytes.  Nulls count as empty."""
    n = len(column)
    if not n:
        return
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    row = 0
    while row < n:
        stop = max(row + 1, int(np.searchsorted(offs, offs[row] + RUN_BYTES, "right")) - 1)
        yield row, stop - row, raw[offs[row]:offs[stop]], offs[row:stop + 1] - offs[row]
        row = stop


class Words:
    """Cuts runs of texts into tokens and hashes them, A-Z as a-z."""

    def __init__(self, classes: np.ndarray):
        self.classes, self.values = classes, lower_table()

    def tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens, and the first token of each text (texts + 1 numbers)."""
        kind = self.classes[data]
        if not len(kind):
            return np.empty(0, np.uint64), np.zeros(len(offsets), np.int64)
        change = np.empty(len(kind), bool)
        change[0] = True
        np.not_equal(kind[1:], kind[:-1], out=change[1:])
        inner = offsets[(offsets > 0) & (offsets < len(kind))]
        change[inner] = True
        edges = np.flatnonzero(change)
        stops = np.append(edges[1:], len(kind))
        real = kind[edges] != 0
        start, stop = edges[real], stops[real]
        return self._hash(data, start, stop), np.searchsorted(start, offsets)

    def _hash(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        out = np.empty(len(start), np.uint64)
        i = 0
        while i < len(start):
            j = int(np.searchsorted(stop, start[i] + WINDOW, "right"))
            if j <= i:  # one token longer than a window
                out[i] = xxhash.xxh3_64_intdigest(data[start[i]:stop[i]].tobytes().lower())
                i += 1
                continue
            a, b = start[i], stop[j - 1]
            prefix = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.values[data[a:b]] * _POW[:b - a], out=prefix[1:])
            s = start[i:j] - a
            out[i:j] = (prefix[stop[i:j] - a] - prefix[s]) * _INV[s] + (stop[i:j] - start[i:j]).astype(np.uint64)
            i = j
        return mix(out)
