"""Counts of 64-bit keys over all data, as bitmaps of bounded size.

Map tasks deal their keys to slices by their top bits, as sorted arrays of the following bits, each
key at most as often as counts are told apart; a reducer for each slice merges these as they come
and gives bits for "seen at least so often". Nothing but the bitmaps, whose width follows the number
of keys up to 2 ** WIDEST bits, reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FLUSH = 1 << 22
#: log2 of the bits of the narrowest and the widest bitmap; beyond it more keys share a bit, and filters by it let more through.
NARROWEST, WIDEST = 18, 30
#: Bytes of text that a word takes, about.
WORD_BYTES = 6


def words_log(docs: DataFrame) -> int:
    """log2 of the number of words of docs, about: the text's bytes are counted without Python."""
    n = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return (n // WORD_BYTES).bit_length() - 1


def clipped(bits: int) -> int:
    return min(WIDEST, max(NARROWEST, bits))


def width(docs: DataFrame) -> int:
    """log2 of the number of words of docs, about, within bounds."""
    return clipped(words_log(docs))


def capped(cells: np.ndarray, most: int) -> np.ndarray:
    """Sorted cells, each at most so often."""
    keep = np.ones(len(cells), bool)
    keep[most:] = cells[most:] != cells[:-most]
    return cells[keep]


def slices(keys: np.ndarray, slice_bits: int, low_bits: int, most: int) -> Iterator[tuple[int, bytes]]:
    """(slice, the next low_bits bits of its keys in order, each at most so often) of 64-bit keys."""
    cells = capped(np.sort(keys >> np.uint64(64 - slice_bits - low_bits)), most)
    cuts = np.searchsorted(cells, np.arange((1 << slice_bits) + 1, dtype=np.uint64) << np.uint64(low_bits))
    low = cells.astype(np.uint16 if low_bits <= 16 else np.uint32)
    if low_bits < 16:
        low &= np.uint16((1 << low_bits) - 1)
    for s in np.flatnonzero(np.diff(cuts)):
        yield int(s), low[cuts[s] : cuts[s + 1]].tobytes()


def slice_rows(arrays: Iterator[np.ndarray], depth: int, slice_bits: int, low_bits: int, most: int, rehash, flush_keys: int = FLUSH) -> Iterator[pa.RecordBatch]:
    """Rows (d, slice, cells) of arrays of keys, flush_keys keys at a time or as many as one array has; rehash(keys, d) gives row d's keys."""
    held: list[np.ndarray] = []

    def flush() -> Iterator[pa.RecordBatch]:
        keys = np.concatenate(held)
        for d in range(depth):
            found = list(slices(rehash(keys, d), slice_bits, low_bits, most))
            yield pa.RecordBatch.from_arrays([pa.array([d] * len(found), pa.int32()), pa.array([s for s, _ in found], pa.int32()), pa.array([c for _, c in found], pa.binary())], names=["d", "slice", "cells"])

    n = 0
    for a in arrays:
        held.append(a)
        n += len(a)
        if n >= flush_keys:
            yield from flush()
            held, n = [], 0
    if n:
        yield from flush()


ROWS = "d int, slice int, cells binary"


def _seen(cells: np.ndarray, low_bits: int, index_bits: int, least: tuple[int, ...]) -> list[bytes]:
    values, n = np.unique(cells, return_counts=True)
    out = []
    for k in least:
        bits = np.zeros(1 << index_bits, bool)
        bits[values[n >= k] >> (low_bits - index_bits)] = True
        out.append(np.packbits(bits).tobytes())
    return out


def bitmaps(rows: DataFrame, depth: int, slice_bits: int, low_bits: int, index_bits: int, least: tuple[int, ...]) -> np.ndarray:
    """uint8[len(least), depth, 2 ** (slice_bits + index_bits - 3)]: packed bits by the keys' top bits.

    A bit is set if a key below it was seen at least so often. Counts add up over all map tasks.
    """
    kind = np.uint16 if low_bits <= 16 else np.uint32

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells: list[np.ndarray] = []
        d = s = None
        n, limit = 0, FLUSH
        for b in batches:
            if b.num_rows:
                d, s = b.column(0)[0].as_py(), b.column(1)[0].as_py()
            for x in b.column(2):
                cells.append(np.frombuffer(x.as_py(), kind))
                n += len(cells[-1])
                if n > limit:
                    cells = [capped(np.sort(np.concatenate(cells)), max(least))]
                    n = len(cells[0])
                    limit = max(FLUSH, 2 * n)
        if d is not None:
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([s], pa.int32()), *(pa.array([x], pa.binary()) for x in _seen(np.concatenate(cells), low_bits, index_bits, least))], names=names)

    names = ["d", "slice", *(f"b{i}" for i in range(len(least)))]
    found = rows.groupBy("d", "slice").applyInArrow(count, "d int, slice int, " + ", ".join(f"{n} binary" for n in names[2:]))
    size = 1 << (index_bits - 3)
    out = np.zeros((len(least), depth, (1 << slice_bits) * size), np.uint8)
    for r in found.toLocalIterator(prefetchPartitions=True):  # as many bytes as bitmaps have
        for i in range(len(least)):
            out[i, r[0], r[1] * size : (r[1] + 1) * size] = np.frombuffer(r[2 + i], np.uint8)
    return out


def lookup(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the bit of each 64-bit key is set in a packed bitmap."""
    bits = int(len(bitmap) * 8).bit_length() - 1
    at = keys >> np.uint64(64 - bits)
    return (bitmap[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
