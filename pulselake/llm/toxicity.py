"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table, with_fields
from .kernel import lower, mix, text_blocks, word_hashes, words

#: log2 of the number of coordinates; weights are at most this many doubles whatever the input.
BITS = 20
#: Labelled rows that training reads at most (in expectation: rows are taken by hash).
MAX_TRAIN_ROWS = 12_000
EPOCHS = 10
ALPHA, BETA, L2 = 1.0, 1.0, 0.1
#: L1 as a multiple of the spread of a label sum over the training rows: below it, a coordinate's
#: gradients look like chance, so most coordinates get weight 0.
L1_SPREAD = 1.0


#: Bytes of the stems of longer words. A stem is a gram of its own: words that share it share what it tells.
STEMS = (4, 6)


def stem_hashes(data: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """A hash of the first size bytes of words that are longer."""
    power = np.cumprod(np.full(size, 0xC2B2AE3D27D4EB4F, np.uint64))
    return mix((data[starts[:, None] + np.arange(size)] + np.uint64(1)) @ power + np.uint64(size))


def features(hashes: np.ndarray, rows: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and rows of the words, their stems, word pairs and pairs that skip one word of a block of texts."""
    found, at = [hashes], [rows]
    for size in STEMS:
        long = np.flatnonzero(ends - starts > size)
        found.append(stem_hashes(data, starts[long], size))
        at.append(rows[long])
    for skip, factor in ((1, 0xA0761D6478BD642F), (2, 0xE7037ED1A0B428DB)):
        same = np.flatnonzero(rows[:-skip] == rows[skip:]) if len(rows) > skip else np.zeros(0, np.int64)
        found.append(mix(hashes[same] * np.uint64(factor) + hashes[same + skip]))
        at.append(rows[same])
    return np.maximum((np.concatenate(found) >> np.uint64(64 - BITS)).astype(np.int64), 1), np.concatenate(at)


#: Separators of words: ASCII characters that are no letters or digits.
MARKS = bytes(c for c in range(128) if not chr(c).isalnum())


def _blocks(column: pa.Array):
    for first, data, offsets in text_blocks(column):
        data = lower(data)
        starts, ends, rows = words(data, offsets, MARKS)
        yield first, len(offsets) - 1, *features(word_hashes(data, starts, ends, MARKS), rows, data, starts, ends)


def distinct_features(docs: DataFrame, *keep: str) -> DataFrame:
    """The columns keep of docs, and x: the distinct coordinates of the text as array<int>."""
    out = with_fields(docs.select(*keep).schema)
    from pyspark.sql.types import ArrayType, IntegerType

    out = out.add("x", ArrayType(IntegerType()))
    names = out.names

    def run(batches):
        for b in batches:
            lists: list = []
            for _, n, found, rows in _blocks(b.column(b.schema.get_field_index("text"))):
                pairs = np.unique((rows << BITS) | found)
                cuts = np.searchsorted(pairs >> BITS, np.arange(n + 1))
                ids = (pairs & ((1 << BITS) - 1)).astype(np.int32)
                lists += [ids[cuts[i] : cuts[i + 1]] for i in range(n)]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(lists, pa.list_(pa.int32()))], names=names)

    return docs.select(*keep, "text").mapInArrow(run, out)


def ftrl(rows: list[tuple[np.ndarray, int]], epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates with a weight that is not 0, and the weights.

    Per coordinate z and n: the step ALPHA / (BETA + sqrt(n)) shrinks with the gradients seen there,
    and a coordinate whose abs(z) stays within L1 has weight 0. Coordinate 0 is the intercept, which
    every row has; it alone isn't held back by L1.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = [(np.append(0, x), y) for x, y in rows]
    rate = sum(y for _, y in rows) / max(1, len(rows))
    l1 = L1_SPREAD * (len(rows) * rate * (1 - rate)) ** 0.5

    def weights(x: np.ndarray) -> np.ndarray:
        zx, hold = z[x], np.where(x == 0, 0.0, l1)
        return np.where(np.abs(zx) <= hold, 0.0, (np.sign(zx) * hold - zx) / ((BETA + np.sqrt(n[x])) / ALPHA + L2))

    for _ in range(epochs):
        for x, y in rows:
            w = weights(x)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            z[x] += g - (np.sqrt(n[x] + g * g) - np.sqrt(n[x])) / ALPHA * w
            n[x] += g * g
    w = weights(np.arange(1 << BITS))
    found = np.flatnonzero(w)
    return found, w[found]


def bucket(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string")) % 4


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAIN_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """(coordinates, weights) learned from labelled rows outside the held-out fold.

    Of more than max_rows labelled rows, those with the smallest hash of doc_id are taken, max_rows in
    expectation, so their ids and features have a fixed bound, and one task trains on all of them in
    hash order: FTRL is sequential, and averaged shards find rare signs less well. A lost task is
    trained again with the same result. Without labelled rows all weights are 0.
    """
    y = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y")).filter(F.col("doc_id").isNotNull() & (bucket() != 2))
    total = y.count()
    order = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    ids = checkpoint(y.filter(order < int(min(1.0, max_rows / max(total, 1)) * (1 << 30))).select("doc_id", "y", order.alias("o")))
    if total == 0:
        return np.zeros(0, np.int64), np.zeros(0)
    sample = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")  # at most some max_rows ids
    x = distinct_features(sample, "doc_id", "y", "o")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["o", "doc_id"])
        found, w = ftrl([(np.asarray(x, np.int64), int(y)) for x, y in zip(group["x"], group["y"])])
        return pd.DataFrame({"i": found, "w": w})

    w = x.groupBy().applyInPandas(fit, "i long, w double").toPandas().sort_values("i")  # at most 2 ** BITS rows
    return w["i"].to_numpy(np.int64), w["w"].to_numpy(np.float64)


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs with score: the probability of label 1 from the distinct coordinates of the whole text.

    Null and empty texts have the intercept only, as have texts without any known sign. A column
    score of docs is replaced.
    """
    docs = docs.drop("score")
    schema = with_fields(docs.schema, score="double")
    names = schema.names
    found, learned = model
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((found, learned))

    def run(batches):
        ids, w = sent.value
        known = np.zeros(1 << BITS)
        known[ids] = w
        signs = known != 0
        for b in batches:
            out = np.zeros(b.num_rows)
            for first, n, x, rows in _blocks(b.column(b.schema.get_field_index("text"))):
                hit = np.flatnonzero(signs[x])
                pairs = np.unique((rows[hit] << BITS) | x[hit])
                total = np.bincount(pairs >> BITS, known[pairs & ((1 << BITS) - 1)], minlength=n) + known[0]
                out[first : first + n] = total
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))], names=names)

    return docs.mapInArrow(run, schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every row of ``documents``, learned from ``labels`` without the held-out fold."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    x = score_toxicity(docs, model)
    return x.select("doc_id", (F.coalesce(bucket(), F.lit(-1)) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
