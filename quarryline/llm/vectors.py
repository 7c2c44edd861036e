"""Words of Arrow text columns as 64-bit hashes, whole batches at a time in numpy.

A kind of word is a table of 256 flags over UTF-8 bytes; bytes from 0x80 up always belong to words,
so no code point is split. A-Z are folded to a-z.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into word hashes at a time (a longer text is taken alone).
SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))


def _folded(values: np.ndarray) -> np.ndarray:
    values[65:91] = values[97:123]
    return values


_BYTE = [_folded(_rng.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)) for _ in range(2)]
_BASE = [np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]
_COEFF = [_rng.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1) for _ in range(4)]


def word_bytes(separators: set[int]) -> np.ndarray:
    flags = np.ones(256, dtype=bool)
    flags[list(separators)] = False
    return flags


#: Words between white space, and words of letters and digits (all else below 0x80 separates).
SPACED = word_bytes({0x20, *range(0x09, 0x0E)})
ALNUM = word_bytes({*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)})


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, rows, bytes, row offsets into the bytes) in pieces of about SLICE_BYTES; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, side="right")) - 1)
        last = min(last, n)
        at = offsets[first : last + 1]
        yield first, last - first, data[at[0] : at[-1]], at - at[0]
        first = last


def words(data: np.ndarray, rows: np.ndarray, is_word: np.ndarray, hashes: int = 1) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words (one array for each hash function) and where each row's words begin (rows + 1)."""
    n = len(rows) - 1
    if not len(data):
        return [np.zeros(0, np.uint64) for _ in range(hashes)], np.zeros(n + 1, np.int64)
    inside = is_word[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    cut = rows[:-1][rows[:-1] < len(data)]
    begins[cut] = inside[cut]
    starts = np.flatnonzero(begins)
    at = np.searchsorted(starts, rows, side="left")
    if not len(starts):
        return [np.zeros(0, np.uint64) for _ in range(hashes)], at
    kept = np.flatnonzero(inside)
    first = np.searchsorted(kept, starts)
    lengths = np.diff(np.append(first, len(kept)))
    place = np.arange(len(kept)) - np.repeat(first, lengths)
    longest = int(lengths.max())
    out = []
    raw = data[kept]
    for k in range(hashes):
        powers = np.ones(longest, dtype=np.uint64)
        powers[1:] = _BASE[k]
        powers = np.cumprod(powers, dtype=np.uint64)
        out.append(mix(np.add.reduceat(_BYTE[k][raw] * powers[place], first)))
    return out, at


def grams(word: np.ndarray, size: int, kind: int = 0) -> np.ndarray:
    """Hashes of all runs of size words (len - size + 1 of them; rows are not looked at)."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, np.uint64(size), dtype=np.uint64)
    for j in range(size):
        total += word[j : j + n] * _COEFF[kind][j]
    return mix(total)


def row_of(at: np.ndarray) -> np.ndarray:
    """The row of each word."""
    return np.repeat(np.arange(len(at) - 1), np.diff(at))
