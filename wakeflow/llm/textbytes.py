"""Whole texts as byte arrays: vectorised words, hashes and chunks for Arrow batches.

Inside a task, a batch's texts are one UTF-8 buffer with document offsets, cut
into chunks of whole documents so that memory follows ``CHUNK_BYTES`` (or the
longest single text), never the batch or the partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 21
#: Odd multiplier of the polynomial hash modulo 2**64 and its inverse.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space is \x20 and \x09-\x0D.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK_BYTES + 64)
        have = np.full(size, base, dtype=np.uint64)
        have[0] = 1
        _powers[base] = have = np.cumprod(have, dtype=np.uint64)
    return have[:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the word."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as (bytes, offsets); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, size: int = CHUNK_BYTES):
    """Yields (first row, end row, bytes, offsets) of runs of whole documents."""
    data, offsets = column_bytes(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + size, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that stay in one document: starts, ends, first run of each document (one more at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]
    end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+``: starts, ends, first word of each document."""
    return spans(data, offsets, ~SPACE[data])


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """Prefix sums from which any substring's hash follows."""
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def slice_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end); equal strings, equal hashes, wherever they stand."""
    raw = (prefix[ends] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def window_hash(data: np.ndarray) -> np.ndarray:
    """As :func:`prefix_hash`, over the 8 bytes from each place, mixed: no structure of a long text cancels out. For slices of 8 bytes or more."""
    n = max(0, len(data) - 7)
    out = np.zeros(n + 1, dtype=np.uint64)
    if n:
        code = np.ndarray((n,), "<u8", np.ascontiguousarray(data), strides=(1,)).astype(np.uint64)
        code ^= code >> np.uint64(29)
        code *= np.uint64(0xBF58476D1CE4E5B9)
        code ^= code >> np.uint64(32)
        np.cumsum(code * powers(BASE, n), out=out[1:])
    return out


def window_slices(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the substrings [start, end) of 8 bytes or more, from :func:`window_hash`."""
    raw = (prefix[ends - 7] - prefix[starts]) * powers(INVERSE, len(prefix))[starts]
    return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def windows(prefix: np.ndarray, size: int) -> np.ndarray:
    """As :func:`window_slices` for all substrings of ``size`` bytes, 8 or more, in order."""
    n = max(0, len(prefix) + 7 - size)
    raw = prefix[size - 7 :] - prefix[:n]
    raw *= powers(INVERSE, n)
    raw += np.uint64(size * 0xD1B54A32D192ED03 % 2**64)
    return mix64(raw)


def rows_of(first: np.ndarray) -> np.ndarray:
    """The document number of each item, from each document's first item."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sum_by(first: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` by document."""
    total = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return total[first[1:]] - total[first[:-1]]


#: Terms are runs of ASCII letters and bytes outside ASCII, with digits or without.
LETTERS = np.arange(256) >= 128
LETTERS[65:91] = LETTERS[97:123] = True
LETTERS_DIGITS = LETTERS.copy()
LETTERS_DIGITS[48:58] = True


def terms(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The runs of bytes of a ``kind`` in order, A-Z lower-cased, as a dictionary array of the very strings, and the first of each document."""
    inside = kind[data]
    starts, ends, first = spans(data, offsets, inside)
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    flat = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(LOWER[data[inside]])])
    return flat.dictionary_encode(), first


def term_counts(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Distinct terms by document: document, code, occurrences; the terms by code; the number of terms of each document."""
    found, first = terms(data, offsets, kind)
    size = max(1, len(found.dictionary))
    key, times = np.unique(rows_of(first) * size + found.indices.to_numpy(), return_counts=True)
    return key // size, key % size, times, found.dictionary, np.diff(first)
