"""Substring dedup with a count-min prefilter."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import aside, table, with_fields
from .kernel import mix, text_blocks, windows, word_hashes, words
from .sketch import ROWS, bitmaps, lookup, slice_rows, width

#: Words of an anchor, or all of a smaller window: the window's inner run of words with the smallest hash.
ANCHOR = 8
#: The sketch has DEPTH rows of about as many cells as there are words, in slices of 2 ** CELL_BITS.
DEPTH, CELL_BITS = 2, 16


def _row_key(keys: np.ndarray, d: int) -> np.ndarray:
    return mix(keys + np.uint64((0x9E3779B97F4A7C15 * (d + 1)) % 2**64))


def anchors(hashes: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First words and hashes of all windows, and the place and hash of each window's anchor.

    An anchor depends on the window's words only, so equal windows have equal anchors at different
    places, and the count of an anchor is at least that of each window it stands for.
    """
    whole, at = windows(hashes, rows, size)
    anchor = min(ANCHOR, size)
    n = len(hashes) - anchor + 1
    if not len(at):
        return at, whole, at, whole
    inner = np.full(n, anchor, np.uint64)
    for k in range(anchor):
        inner *= np.uint64(0x8EBC6AF09C88C6E3)
        inner += hashes[k : n + k]
    mix(inner)
    span = size - anchor + 1
    low = inner[at].copy()
    for k in range(1, span):
        np.minimum(low, inner[at + k], out=low)
    place = np.full(len(at), -1, np.int64)
    for k in range(span - 1, -1, -1):
        place = np.where(inner[at + k] == low, at + k, place)
    return at, whole, place, low


def runs(starts: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Pairs (first, how many) of runs of consecutive numbers; a run also ends at each of cuts."""
    new = np.diff(starts, prepend=-2) != 1
    new[cuts] = True
    first = np.flatnonzero(new)
    return np.stack((starts[first], np.diff(first, append=len(starts))), axis=1)


def _hashed(batch: pa.RecordBatch):
    for first, data, offsets in text_blocks(batch.column(batch.schema.get_field_index("text"))):
        starts, ends, rows = words(data, offsets)
        hashes = word_hashes(data, starts, ends)
        yield first, hashes, rows, np.searchsorted(rows, np.arange(len(offsets) - 1))


def repeated_windows(docs: DataFrame, size: int = 20) -> DataFrame:
    """Starts of windows that also start earlier: (doc_id, text_id, starts: array of packed int32 pairs, first and how many in a row).

    Pass 1 merges the sketches of all partitions: counts of anchors in DEPTH rows of cells. Pass 2
    takes the windows whose anchor has a count of 2 or more in every row. That overestimates, so no
    repeated window is lost. Of equal ones in a batch only the first goes on, the others are known to
    repeat, and go on as runs of starts; so a passage that a third of all rows holds is dealt as one row
    for each batch. Then
    windows are grouped exactly, by 96 bits of two independent hashes, and all but the first of each
    group repeat. With more data than the sketch tells apart, more windows are grouped; none is lost.
    """

    slice_bits = width(docs) - CELL_BITS

    def count(batches):
        def arrays() -> Iterator[np.ndarray]:
            for b in batches:
                for _, hashes, rows, _ in _hashed(b):
                    _, _, place, low = anchors(hashes, rows, size)
                    new = np.flatnonzero(np.diff(place, prepend=-1))
                    yield low[new]

        yield from slice_rows(arrays(), DEPTH, slice_bits, CELL_BITS, 2, _row_key)

    seen = bitmaps(docs.select("text").mapInArrow(count, ROWS), DEPTH, slice_bits, CELL_BITS, CELL_BITS, (2,))[0]
    sent = docs.sparkSession.sparkContext.broadcast(seen)  # DEPTH * 2 ** (WIDEST - 3) bytes at most

    def find(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ids = pc.rank(b.column(0), sort_keys="ascending", null_placement="at_start", tiebreaker="dense").to_numpy()  # of any type, null first
            texts = b.column(1).fill_null(0).to_numpy()
            found: list[list[np.ndarray]] = [[], [], [], []]
            for first, hashes, rows, base in _hashed(b):
                at, key, _, low = anchors(hashes, rows, size)
                hit = np.ones(len(at), bool)
                for d in range(DEPTH):
                    hit &= lookup(sent.value[d], _row_key(low, d))
                hit = np.flatnonzero(hit)
                at, key = at[hit], key[hit]
                more = np.full(len(at), 1, np.uint64)
                for k in range(size):
                    more = more * np.uint64(0xD1342543DE82EF95) + (hashes[at + k] >> np.uint64(1))
                for x, new in zip(found, (key, mix(more) >> np.uint64(32), rows[at] + first, at - base[rows[at]])):
                    x.append(new)
            if not found[0]:
                continue
            key, more, row, start = map(np.concatenate, found)
            if not len(key):
                continue
            order = np.lexsort((start, texts[row], ids[row], more, key))
            key, more, row, start = key[order], more[order], row[order], start[order]
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (more[1:] != more[:-1])))
            lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            # Rows with equal ids and texts are one document: their windows don't repeat each other.
            same = (start == start[lead]) & (texts[row] == texts[row[lead]]) & (ids[row] == ids[row[lead]])
            go, later = np.flatnonzero(new), np.flatnonzero(~same)
            later = later[np.lexsort((start[later], row[later]))]
            cuts = np.flatnonzero(np.diff(row[later], prepend=-1))
            pairs = runs(start[later], cuts)
            at = np.searchsorted(np.cumsum(pairs[:, 1]) - pairs[:, 1], cuts)  # the first run of each row
            blobs = [x.astype("<i4").tobytes() for x in np.split(pairs, at[1:])] if len(later) else []
            owner = row[later][cuts]
            n, m = len(go), len(blobs)
            take = pa.array(np.concatenate((row[go], owner)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(take), b.column(1).take(take), pa.array(np.concatenate((key[go].view(np.int64), mix(owner.astype(np.uint64) + np.uint64(1)).view(np.int64)))),
                    pa.array(np.concatenate((more[go].astype(np.int64), np.full(m, -1)))), pa.array(np.concatenate((start[go], np.full(m, -1))).astype(np.int32)), pa.array([None] * n + blobs, pa.binary()),
                ],
                names=["doc_id", "text_id", "k", "m", "start", "starts"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_id"), "text").mapInArrow(find, f"doc_id {kind}, text_id long, k long, m long, start int, starts binary")
    earlier = F.rank().over(Window.partitionBy("k", "m").orderBy("doc_id", "text_id", "start"))
    rows = rows.withColumn("r", earlier).filter("starts is not null or r > 1")
    digits = F.lpad(F.hex(F.col("start").cast("long")), 8, "0")
    one = F.coalesce("starts", F.to_binary(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1)), F.lit("01000000")), F.lit("hex")))
    return rows.groupBy("doc_id", "text_id").agg(F.collect_list(one).alias("starts"))


@aside("doc_id", "text")
def remove_substrings(docs: DataFrame, size: int = 20) -> DataFrame:
    """docs with n_words, n_removed and kept: the words outside repeated windows, joined by one space.

    A word goes if a window of size words over it also starts earlier: in a smaller doc_id, or before
    in the same document. Windows are judged on the input. A null doc_id is smaller than all others;
    rows with the same doc_id and text are one document and get the same result; with the same doc_id
    and other texts they are ordered by a 64-bit hash of the text, which also tells them apart. Null texts
    have no words. Any size from 1 on; windows of fewer than 8 words are their own anchors. Columns of
    docs with the names of the result are replaced.
    """
    if size < 1:
        raise ValueError("a window has one word at least")
    docs = docs.drop("n_words", "n_removed", "kept").withColumn("_t", F.xxhash64("text"))
    found = repeated_windows(docs, size).select(F.col("doc_id").alias("_d"), F.col("text_id").alias("_i"), F.col("starts").alias("_starts"))
    joined = docs.join(found, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_t") == F.col("_i")), "left").drop("_d", "_i", "_t")
    schema = with_fields(docs.drop("_t").schema, n_words="long", n_removed="long", kept="string")
    names = schema.names

    def run(batches):
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                out = []
                for text, starts in zip(b.column(b.schema.get_field_index("text")), b.column(b.schema.get_field_index("_starts"))):
                    found = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # of bytes: at ASCII white space
                    n = len(found)
                    if starts.is_valid:
                        cover = np.zeros(n + 1, np.int64)
                        at, k = np.frombuffer(b"".join(starts.as_py()), "<i4").reshape(-1, 2).T
                        if (at + k + size > n + 1).any():
                            raise ValueError("two texts of one doc_id have the same 64-bit hash")  # never mix them up
                        np.add.at(cover, at, 1)
                        np.add.at(cover, at + k + size - 1, -1)
                        gone = np.cumsum(cover[:n]) > 0
                        found = [w for w, g in zip(found, gone) if not g]
                    out.append((n, n - len(found), b" ".join(found)))
                new = [pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in names[:-3]), *new], names=names)

    return joined.mapInArrow(run, schema)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What repeated 20-word windows leave of every row of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
