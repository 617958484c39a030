"""Vectorised word and line handling for Arrow batches of text.

A batch's strings are viewed as one byte array with document offsets, so words,
lines, hashes and counts come from whole-array numpy steps instead of a Python
loop over words.  A word is ``[^\\x20\\x09-\\x0D]+``; those six separators are
single bytes in UTF-8, so bytes can be classified without decoding.  Null texts
count as empty.  Work goes in blocks of about ``BLOCK`` bytes; one longer text
makes one longer block, since texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK = 1 << 20

SEPARATOR = np.zeros(256, dtype=bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of the column, and len + 1 offsets into them; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes, a longer document being a range of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, side="right")) - 1)
        yield low, min(high, n)
        low = min(high, n)


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs where ``inside`` holds, never across documents, and each document's first run."""
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    full = offsets[:-1] < offsets[1:]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first], ends[last] = inside[first], inside[last]
    starts = np.flatnonzero(starts)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, offsets)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and the index of each document's first word (one more entry than documents)."""
    return spans(data, offsets, ~SEPARATOR[data])


def lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of non-empty ``\\n``-split lines, and the index of each document's first line."""
    return spans(data, offsets, data != 10)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values so that every output bit depends on every input bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, _UNBASE)):
            table = np.full(max(n, BLOCK + 1), base, np.uint64)
            table[0] = 1
            _powers[k] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, from prefix sums of a polynomial over the block."""
    out = np.empty(len(starts), np.uint64)
    low = 0
    while low < len(starts):
        base = int(starts[low])
        high = max(low + 1, int(np.searchsorted(ends, base + BLOCK, side="right")))
        up, down = _power_tables(int(ends[high - 1]) - base + 1)
        piece = data[base : ends[high - 1]]
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * up[: len(piece)], out=total[1:])
        s, e = starts[low:high] - base, ends[low:high] - base
        out[low:high] = (total[e] - total[s]) * down[s]
        low = high
    return mix(out)


def windows(values: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive values (``len(values) - k + 1`` of them)."""
    n = len(values) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0xD6E8FEB86659FD93) + values[j : j + n]
    return mix(out)


def code_points(data: np.ndarray) -> np.ndarray:
    """True for each byte that begins a code point."""
    return (data & 0xC0) != 0x80


def per_document(counts: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``counts`` over each document's range ``bounds[i]:bounds[i + 1]``."""
    total = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
