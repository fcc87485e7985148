"""Words and word n-gram hashes of Arrow string columns, without a Python object for any word.

A word's hash is a polynomial over its bytes modulo 2**64, mixed; an n-gram's hash is a polynomial over its words'
hashes, mixed.  Everything is worked out on byte buffers in slices of bounded size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes that separate words: space and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
P = 0x9E3779B97F4A7C15 | 1
P_INVERSE = pow(P, -1, 1 << 64)
#: Bytes hashed at a time (a longer document is a slice of its own).
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits with good avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**0 .. P**(n - 1), and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * SLICE)
        _powers[:] = [
            np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, base, np.uint64))[:-1]])
            for base in (np.uint64(P), np.uint64(P_INVERSE))
        ]
    return _powers[0], _powers[1]


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of each word in the bytes, and the index of each document's first word (one more at the end)."""
    solid = ~IS_SPACE[raw]
    begin, close = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    close[:-1] &= ~solid[1:]
    filled = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first] = solid[first]
    close[last] = solid[last]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(close) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def hashed(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' hashes, slice by slice."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + SLICE, "right")))
        low, high = int(starts[at]), int(ends[stop - 1])
        power, inverse = powers(high - low)
        sums = np.empty(high - low + 1, np.uint64)
        sums[0] = 0
        np.cumsum((raw[low:high].astype(np.uint64) + np.uint64(1)) * power[: high - low], out=sums[1:])
        s, e = starts[at:stop] - low, ends[at:stop] - low
        out[at:stop] = (sums[e] - sums[s]) * inverse[s]
        at = stop
    return mix(out)


def ngrams(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, index of first word) of each run of n words inside one document."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(count, np.uint64)
    for k in range(n):
        total *= np.uint64(P)
        total += words[k : k + count]
    inside = np.ones(count, bool)
    for k in range(1, n):  # runs that would cross into the next document
        cross = first[1:-1] - k
        inside[cross[(cross >= 0) & (cross < count)]] = False
    at = np.flatnonzero(inside)
    return mix(total[at]), at


def slices(batch: pa.RecordBatch, column: str, most: int = 4 << 20):
    """The batch in parts of at most about ``most`` bytes of that column, so that memory stays bounded."""
    _, offsets = buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
