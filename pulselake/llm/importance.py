"""Resampling of documents by their importance for a target corpus, over inverted postings."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpoint
from .common import aside, numbered, table, with_fields
from .crc import short_crc32

#: Words of UTF-8 bytes with A-Z in lower case: digits, letters and all bytes beyond ASCII.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
BREAK = re.compile(rb"[^0-9a-z\x80-\xff]")
#: Bytes of a text that are cut into words at once, and bytes of texts that make a block of documents.
PART, BLOCK = 1 << 22, 1 << 22
#: Buckets of a slice of postings; a place in a slice is one byte.
SLICE = 250
#: Blocks of documents are dealt to so many groups for each slice, so that no slice is one task's.
SALTS = 64
POSTINGS = "slice int, block long, size int, body binary"
#: The slice of the row that has a block's documents instead of postings.
HEADER = -1
RESULT = ("n_features", "n_words", "weight", "score", "rank")


def _register_table() -> np.ndarray:
    """The public table of CRC-32: what a byte makes of the register, from the CRC of one byte."""
    return np.array([~zlib.crc32(bytes([255 ^ i])) & 0xFFFFFFFF ^ 0x00FFFFFF for i in range(256)], np.uint32)


_TABLE = _register_table()


def spaced(crc: np.ndarray) -> np.ndarray:
    """The CRC-32 of texts with a space behind them, from their own."""
    register = ~crc
    return ~((register >> np.uint32(8)) ^ _TABLE[(register ^ np.uint32(32)) & np.uint32(255)])


def features(text: str | None, longest: int) -> Iterator[np.ndarray]:
    """CRC-32 of all runs of 1 to longest consecutive words, joined by one space: arrays of runs of 1, 2, ... words, part by part of the text.

    A run's CRC goes on from that of the run without its last word, so no run is ever built.
    """
    data = (text or "").encode("utf-8", "surrogatepass").lower()
    at, ended = 0, [np.zeros(0, np.uint32)] * longest  # the run of 1, 2, ... words that the part before ended with
    while at < len(data):
        m = BREAK.search(data, at + PART) if len(data) - at > PART else None
        end = m.start() if m else len(data)
        found = WORDS.findall(data[at:end])
        at = end + 1
        if not found:
            continue
        runs = np.fromiter(map(zlib.crc32, found), np.uint32, len(found))
        yield runs
        for n in range(1, longest):
            before = np.concatenate((ended[n], runs))
            ended[n] = before[-1:]
            words = found[len(found) - len(before) + 1 :] if len(before) else []
            runs = np.fromiter(map(zlib.crc32, words, spaced(before[:-1]).tolist()), np.uint32, len(words))
            yield runs


def counted(text: str | None, longest: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """(words, features, buckets that a text's features fall in, features of each)."""
    n_words = n = waiting = 0
    held: list[np.ndarray] = []
    total = None  # of a very long text, sums by bucket
    for i, crc in enumerate(features(text, longest)):
        n_words += len(crc) if i % longest == 0 else 0
        n, waiting = n + len(crc), waiting + len(crc)
        held.append((crc % np.uint32(buckets)).astype(np.int64))
        if waiting > PART:
            total = np.bincount(np.concatenate(held), minlength=buckets) + (0 if total is None else total)
            held, waiting = [], 0
    if total is not None:
        total += np.bincount(np.concatenate([np.zeros(0, np.int64), *held]), minlength=buckets)
        return n_words, n, (found := np.flatnonzero(total)), total[found]
    return n_words, n, *np.unique(np.concatenate([np.zeros(0, np.int64), *held]), return_counts=True)


def _packed(*parts: np.ndarray) -> tuple[int, bytes]:
    body = b"".join(p.tobytes() for p in parts)
    return len(body), pa.compress(body, codec="zstd", asbytes=True)


def _unpacked(size: int, body: bytes) -> bytes:
    return pa.decompress(body, decompressed_size=size, codec="zstd", asbytes=True)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (("slice", pa.int32()), ("block", pa.int64()), ("size", pa.int32()), ("body", pa.binary()))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(kinds)], names=[n for n, _ in kinds])


def postings(docs: DataFrame, longest: int, buckets: int) -> DataFrame:
    """POSTINGS of the texts of docs, by slices of buckets and blocks of documents.

    A row has the postings (bucket, document, count) of one slice in one block, in the order of documents:
    the number of documents, the counts, how many postings each document has, and the buckets. The row HEADER of a block has the other
    columns of docs as an Arrow stream, and the numbers of features and words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for b in batches:
            column = b.column(b.schema.get_field_index("text"))
            bytes_before = np.concatenate(([0], np.cumsum(pa.compute.fill_null(pa.compute.binary_length(column), 0).to_numpy(zero_copy_only=False))))
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(bytes_before, bytes_before[first] + BLOCK, side="right")) - 1)
                yield _rows(list(_block(b.slice(first, last - first), block, longest, buckets)))
                first, block = last, block + 1

    return docs.mapInArrow(run, POSTINGS)


def _block(b: pa.RecordBatch, block: int, longest: int, buckets: int) -> Iterator[tuple]:
    found = [counted(x.as_py(), longest, buckets) for x in b.column(b.schema.get_field_index("text"))]
    sink = pa.BufferOutputStream()
    rest = b.drop_columns(["text"]).append_column("_features", pa.array([f[1] for f in found], pa.int64())).append_column("_words", pa.array([f[0] for f in found], pa.int64()))
    with pa.ipc.new_stream(sink, rest.schema) as out:
        out.write_batch(rest)
    body = sink.getvalue().to_pybytes()
    yield HEADER, block, len(body), pa.compress(body, codec="zstd", asbytes=True)
    doc = np.repeat(np.arange(b.num_rows), [len(f[2]) for f in found])
    bucket, count = np.concatenate([f[2] for f in found]), np.concatenate([f[3] for f in found])
    part = bucket // SLICE
    order = np.argsort(part, kind="stable")
    doc, bucket, count = doc[order], (bucket % SLICE)[order].astype(np.uint8), count[order].astype("<u4")
    cuts = np.searchsorted(part[order], np.arange(-(-buckets // SLICE) + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        a, z = cuts[s], cuts[s + 1]
        each = np.bincount(doc[a:z], minlength=b.num_rows).astype(np.uint8)  # SLICE at most
        yield int(s), block, *_packed(np.array([b.num_rows], "<u4"), count[a:z], each, bucket[a:z])


def _decoded(size: int, body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(postings of each document, at most SLICE; bucket and count of each posting)."""
    raw = _unpacked(size, body)
    d = int(np.frombuffer(raw, "<u4", 1)[0])
    p = (size - 4 - d) // 5
    return np.frombuffer(raw, np.uint8, d, 4 + 4 * p), np.frombuffer(raw, np.uint8, p, 4 + 4 * p + d), np.frombuffer(raw, "<u4", p, 4)


def bucket_counts(rows: DataFrame, name: str) -> DataFrame:
    """(bucket, name): features in each bucket; a task sends one number for each bucket that it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for s, size, body in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3)):
                _, bucket, count = _decoded(size, body.as_py())
                total[s] = total.get(s, 0) + np.bincount(bucket, weights=count, minlength=SLICE).astype(np.int64)
        for s, t in total.items():
            at = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array((at + s * SLICE).astype(np.int32)), pa.array(t[at])], names=["bucket", name])

    return rows.filter(F.col("slice") != HEADER).mapInArrow(run, f"bucket int, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of the buckets that docs has, from (bucket, s) and (bucket, t)."""
    both = docs.withColumn("t", F.lit(0).cast("long")).unionByName(target.withColumn("s", F.lit(0).cast("long"))).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = checkpoint(both)  # one row a bucket
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    return both.filter("s > 0").crossJoin(F.broadcast(whole)).select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))  # one row


def weigh(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """docs without text, with n_features, n_words and weight: how much likelier their features are in target, in thousandths.

    Features are runs of 1 to longest words, repeats counted; a feature's bucket is the CRC-32 of its
    bytes modulo buckets. Postings of docs are dealt by slices of buckets and kept; a slice's counts
    meet those of the target's postings, which gives the gain of each bucket; then every slice turns its
    postings into one sum for each document, and a block's sums meet in its documents' row. Slices are
    dealt as many rows of bounded size, so a bucket that most texts share splits like any other;
    what is sent to tasks is one gain for each bucket. weight is the floored mean of the gains over a
    document's features, 0 for none.

    Null texts have no features. Repeated rows are documents of their own. Other columns, whatever
    their names and types, ride along; those with names of the result are replaced. An empty table
    gives no rows; an empty target has no feature, and all gains follow from docs alone.
    """
    docs = docs.drop(*RESULT)
    dealt = postings(docs, longest, buckets).repartition("slice", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    dealt = checkpoint(dealt)
    gains = bucket_gains(bucket_counts(dealt, "s"), bucket_counts(postings(target.select("text"), longest, buckets), "t"), buckets)
    gains = gains.groupBy(F.expr(f"bucket div {SLICE}").cast("int").alias("slice")).agg(F.collect_list(F.struct((F.col("bucket") % SLICE).alias("at"), "gain")).alias("gains"))  # SLICE at most

    def contribute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            out = []
            for i, (s, block, size, body) in enumerate(zip(*(b.column(k).to_pylist() for k in range(4)))):
                if s == HEADER:
                    out.append((s, block, size, body))
                    continue
                if s not in known:
                    known[s] = np.zeros(SLICE, np.int64)
                    for g in b.column(4)[i].as_py():
                        known[s][g["at"]] = g["gain"]
                each, bucket, count = _decoded(size, body)
                ends = np.cumsum(np.concatenate(([0], known[s][bucket] * count)))
                stop = np.cumsum(each, dtype=np.int64)
                out.append((s, block, *_packed(ends[stop] - ends[stop - each])))
            yield _rows(out)

    sums = dealt.join(F.broadcast(gains), "slice", "left").select(*dealt.columns, "gains").mapInArrow(contribute, POSTINGS)
    schema = with_fields(docs.drop("text").schema, n_features="long", n_words="long", weight="long")

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, total = None, 0
        for b in batches:
            for s, size, body in zip(*(b.column(k).to_pylist() for k in (0, 2, 3))):
                if s == HEADER:
                    with pa.ipc.open_stream(_unpacked(size, body)) as stream:
                        head = stream.read_next_batch()
                else:
                    total = total + np.frombuffer(_unpacked(size, body), np.int64)
        if head is not None:
            n = head.column(head.num_columns - 2).to_numpy()
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*head.columns, pa.array(weight.astype(np.int64))], names=schema.names)

    return sums.groupBy("block").applyInArrow(reduce, schema)


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10_000, longest: int = 2) -> DataFrame:
    """weigh(docs, target) with score and rank: the documents drawn without replacement in proportion to their importance.

    score is the weight and a Gumbel draw from the digest of seed and doc_id, so that the highest
    scores are such a draw (Gumbel top-k). Of the documents with least_words words or more, percent
    in a hundred are drawn, ranked from 1 by score, ties by doc_id (null first), features and
    weight; the others' rank is null. Ranks come from one range sort over many tasks. To get texts
    back, give them under another name too.
    """
    x = weigh(docs, target, buckets, longest)

    @aside("doc_id", "n_features", "n_words", "weight")
    def ranked(x: DataFrame) -> DataFrame:
        digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
        u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") + F.lit(0.5)) / F.lit(4294967296.0)
        x = x.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")).withColumn("_out", F.col("n_words") < least_words)
        x = numbered(x, ["_out", F.desc("score"), "doc_id", "n_features", "weight"])
        # Numbers of rows that may be drawn come first, so the last of them is their number.
        most = x.agg(F.count_if(~F.col("_out")).alias("_n")).select(F.floor(F.col("_n") * percent / 100).alias("_most"))
        x = x.crossJoin(F.broadcast(most))  # one row
        return x.withColumn("rank", F.when(~F.col("_out") & (F.col("number") < F.col("_most")), F.col("number") + 1)).drop("_out", "number", "_most")

    return ranked(x)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance of every row of ``documents`` for the texts of ``benchmark``, and the rank of those drawn."""
    x = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return x.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS_SQL = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP12_SQL = f"""
WITH x AS (SELECT true AS own, row_number() OVER () AS i, doc_id, coalesce({_WORDS_SQL}, []) AS w FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, coalesce({_WORDS_SQL}, []) FROM benchmark),
f AS (SELECT own, i, unnest(w || list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS f FROM x),
c AS (SELECT own, i, f, count(*) AS n FROM f GROUP BY ALL),
b AS (SELECT f, {short_crc32("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM c)),
p AS (SELECT own, i, bucket, n FROM c JOIN b USING (f)),
k AS (SELECT bucket, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t FROM p GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM k),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM k, a),
v AS (SELECT i, sum(n)::BIGINT AS n, sum(n * gain)::BIGINT AS total FROM p JOIN g USING (bucket) WHERE own GROUP BY i),
d AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight,
  (('0x' || sha256('7:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5) / 4294967296.0::DOUBLE AS u FROM x LEFT JOIN v USING (i) WHERE own),
e AS (SELECT *, weight + floor(-1000 * ln(-ln(u)))::BIGINT AS score FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY n_words < 20 ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight) AS place, count(*) FILTER (n_words >= 20) OVER () AS n_all FROM e)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= floor(25 * n_all / 100) THEN place END AS rank, n_words FROM r
"""
