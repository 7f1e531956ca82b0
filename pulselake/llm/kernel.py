"""Vectorised helpers on Arrow batches: words and window hashes of many texts at once.

Texts are handled as their UTF-8 bytes, some megabytes at a time, so that the memory of a
task does not depend on the number of rows in a batch.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once.
BLOCK = 1 << 20

ODD = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """The public splitmix64 finaliser, in place: every input bit reaches every output bit."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(separators: bytes) -> np.ndarray:
    """A 64-bit value for each byte; 0 for separators."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    values[list(separators)] = 0
    return values


SPACES = b" \t\n\r\x0b\x0c"


def text_blocks(column: pa.Array):
    """Yield (first row, bytes, offsets) for runs of rows of about BLOCK bytes; null texts are empty."""
    column = (pc.fill_null(column, "") if column.null_count else column).cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + BLOCK, side="right")) - 1)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def lower(data: np.ndarray) -> np.ndarray:
    """Bytes with A-Z in lower case."""
    upper = (data >= 65) & (data <= 90)
    return data + upper.astype(np.uint8) * np.uint8(32)


def words(data: np.ndarray, offsets: np.ndarray, separators: bytes = SPACES):
    """First byte, end byte and row of each word of a block."""
    inside = np.ones(256, bool)
    inside[list(separators)] = False
    inside = inside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, separators: bytes = SPACES) -> np.ndarray:
    """A 64-bit hash of each word, the same in every text and process."""
    values, out = byte_values(separators), np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # runs of words, so that one very long text needs no more memory
        stop = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK, side="right")))
        first, last = int(starts[at]), int(ends[stop - 1])
        begin = starts[at:stop] - first
        place = np.arange(last - first) - np.repeat(begin, np.diff(np.append(begin, last - first)))
        power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(place.max()), np.uint64(0xD6E8FEB86659FD93), np.uint64))))
        out[at:stop] = np.add.reduceat(values[data[first:last]] * power[place], begin)
        at = stop
    out += (ends - starts).astype(np.uint64) * ODD
    return mix(out)


def windows(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of so many words, and the index of their first words; none spans two texts."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out *= np.uint64(0xA0761D6478BD642F)
        out += hashes[k : n + k]
    at = np.flatnonzero(rows[:n] == rows[size - 1 :])
    return mix(out[at]), at


def counts_by_row(rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, minlength=n)[:n]
