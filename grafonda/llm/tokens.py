"""Vectorised text handling on Arrow's own buffers: words, 64-bit word hashes and n-gram hashes, without Python strings.

Two different words share a hash with a chance of about 2**-60; operators that need more carry the strings too.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 17
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = []


@lru_cache(maxsize=8)
def _letters(seed: int) -> np.ndarray:
    return np.random.default_rng(20240229 + seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)



ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[65:91] += 32
#: Bytes of words of the shingle operators: ASCII letters, digits, "_" and every byte of a non-ASCII character.
WORD = np.zeros(256, dtype=bool)
WORD[48:58] = WORD[65:91] = WORD[97:123] = WORD[95] = WORD[128:] = True
#: Everything but ASCII white space.
INK = np.ones(256, dtype=bool)
INK[[32, 9, 10, 11, 12, 13]] = False


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(n, b, dtype=np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers


def strings(column) -> pa.Array:
    """One contiguous string array; nulls become empty strings."""
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count or pa.types.is_null(column.type):
        column = pc.fill_null(column.cast(pa.string()) if pa.types.is_null(column.type) else column, "")
    return column


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows, end to end, and the n+1 offsets of the rows in them; nothing is copied."""
    column = strings(column)
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def chunks(column: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about `most` bytes; a longer row stands alone."""
    raw, at = bytes_of(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def spans(raw: np.ndarray, at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first) of the maximal runs of bytes with inside[byte] in each row; first[i]: the first run of row i, n+1 long."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    ink = inside[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[at] = True
    begin = ink.copy()
    begin[1:] &= ~ink[:-1] | edge[1:n]
    end = ink.copy()
    end[:-1] &= ~ink[1:] | edge[1:n]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, at)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span. The spans are in order and do not overlap."""
    out, letters = np.empty(len(starts), dtype=np.uint64), _letters(seed)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK, "right")))
        a, b = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(max(BLOCK, b - a))
        total = np.empty(b - a + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(letters[raw[a:b]] * power[: b - a], out=total[1:])
        s = starts[i:j] - a
        out[i:j] = mix((total[ends[i:j] - a] - total[s]) * inverse[s] + (ends[i:j] - starts[i:j]).astype(np.uint64))
        i = j
    return out


def words(raw: np.ndarray, at: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of all rows, first): ASCII capitals are lowered; row i has words first[i] to first[i+1]."""
    low = ASCII_LOWER[raw]
    starts, ends, first = spans(low, at, inside)
    return span_hashes(low, starts, ends), first


def grams(hashes: np.ndarray, first: np.ndarray, n: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the runs of n words within a row, first). short: a row of 1 to n-1 words gives one gram of all its words."""
    count = np.diff(first)
    many = np.maximum(count - n + 1, (count > 0).astype(np.int64) if short else 0)
    where = np.zeros(len(first), np.int64)
    np.cumsum(many, out=where[1:])
    begin = np.repeat(first[:-1], many) + (np.arange(where[-1]) - np.repeat(where[:-1], many))
    out = np.zeros(where[-1], dtype=np.uint64)
    padded = np.concatenate((hashes, np.zeros(n, np.uint64)))
    left = np.repeat(first[1:], many) - begin
    for k in range(n):
        part = padded[begin + k]
        if short:
            part = np.where(k < left, part, np.uint64(k + 1))
        out = mix(out * np.uint64(0xD6E8FEB86659FD93) + part)
    return out, where


def rows_of(first: np.ndarray) -> np.ndarray:
    """The row of each element."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def segment_sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of values[first[i]:first[i+1]]; 0 for empty rows."""
    total = np.zeros(len(values) + 1, dtype=np.float64 if values.dtype.kind == "f" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))
