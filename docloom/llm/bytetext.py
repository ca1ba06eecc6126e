"""Whole texts as byte buffers: word bounds, word hashes and shingle sets, vectorised with numpy.

Every helper works on a slice of an Arrow batch, cut so that a slice holds a bounded number of
bytes (a single longer text makes a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: One odd 64-bit value a byte, and the odd multiplier of the polynomial hash.
_BYTE = (np.random.Generator(np.random.PCG64(20240601)).integers(0, 2**63, 256, dtype=np.uint64) << _U(1)) | _U(1)
_MUL = 0x9E3779B97F4A7C15 | 1
_INV = pow(_MUL, -1, 2**64)
_powers = {_MUL: np.ones(1, _U), _INV: np.ones(1, _U)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        step = _U(pow(base, len(have), 2**64))
        have = np.concatenate([have, have * step])
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow string column -> (bytes, offsets); nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    _, at, data = column.buffers()
    off = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Row ranges of ``batch`` with at most ``most`` bytes of text, or one row."""
    n, col = batch.num_rows, batch.column(batch.schema.get_field_index(column))
    if not n:
        return
    size = np.cumsum(np.diff(utf8(col)[1]))
    at = 0
    while at < n:
        floor = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, floor + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def words(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of every maximal run of bytes other than ASCII white space."""
    n = len(raw)
    if not n:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    gap = SPACE[raw]
    cut = np.zeros(n + 1, bool)
    cut[off] = True
    first, last = ~gap, ~gap
    first[1:] &= gap[:-1] | cut[1:n]
    last[:-1] &= gap[1:] | cut[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(off, start, side="right") - 1


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased."""
    n = len(raw)
    total = np.zeros(n + 1, _U)
    np.cumsum(_BYTE[LOWER[raw]] * _power(_MUL, n), out=total[1:])
    return mix((total[end] - total[start]) * _power(_INV, n + 1)[start] + (end - start).astype(_U))


def shingles(raw: np.ndarray, off: np.ndarray, k: int) -> list[np.ndarray]:
    """A sorted array of distinct k-word shingle hashes for each row.

    A row with fewer words has its whole sequence as one shingle; one without words has none.
    """
    start, end, row = words(raw, off)
    w = word_hashes(raw, start, end)
    bounds = np.searchsorted(row, np.arange(len(off)))
    count = np.diff(bounds)
    chain = w.copy()
    short = {1: chain}
    for j in range(1, k):
        chain = mix(chain[: len(w) - j] * _U(0xD6E8FEB86659FD93) + w[j:]) if len(w) > j else chain[:0]
        short[j + 1] = chain
    out = []
    for i, c in enumerate(count):
        a = bounds[i]
        if c >= k:
            out.append(np.unique(chain[a : a + c - k + 1]))
        elif c:
            out.append(mix(short[c][a : a + 1] + _U(c)))
        else:
            out.append(np.zeros(0, _U))
    return out
