"""Sharding by rendezvous hashing (native)."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import aside, numbered, table
from .crc import long_crc32

#: Hexadecimal digits of a digest that make a shard's draw: 52 bits, which a double holds with half a step more.
DIGITS = 13


def even(n: int) -> dict[int, float]:
    """Shards 0 to n - 1 of equal weight."""
    return dict.fromkeys(range(n), 1.0)


def shard_of(key: Column, shards: Mapping[int, float], seed: int = 0) -> Column:
    """The shard of a key, by weighted rendezvous hashing.

    Each shard draws u between 0 and 1 from the digest of seed, its own number and the key; the key
    goes where -ln(u) / weight is least. A shard wins with a probability in proportion to its weight.
    Its draw depends on no other shard: a new shard takes keys only into itself, one that goes or
    whose weight falls gives up only keys of its own, and all others stay. A null key is the empty
    one. Weights are positive; shards of weight 0 get nothing. ValueError if no weight is left.
    """
    live = {int(s): float(w) for s, w in shards.items() if w > 0}
    if not live or any(not math.isfinite(w) for w in live.values()) or any(w < 0 for w in shards.values()):
        raise ValueError("shards need weights that are finite and not negative, one of them positive")

    def wait(shard: int, weight: float) -> Column:
        digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(shard)), F.coalesce(key.cast("string"), F.lit(""))))
        u = (F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(16**DIGITS))
        return -F.log(u) / F.lit(weight)

    return F.array_min(F.array(*(F.struct(wait(s, w).alias("wait"), F.lit(s).alias("shard")) for s, w in sorted(live.items()))))["shard"]


def shard_records(docs: DataFrame, shards: Mapping[int, float], key: str = "doc_id", seed: int = 0, more: Mapping[int, float] | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """docs with shard, slot (its place in the shard, gapless from 0), and with ``more`` grown_shard: its shard among these.

    The key and the shards alone decide the shard, so no row is moved to find it. Slots follow the
    key's digest, then the key, then the columns ``order``; rows equal in all of these may change
    places. They come from one range sort, in which the rows of a large shard, key or group of copies
    are dealt over many tasks, and from counts per task. What docs has is sorted and written once, so
    give only the columns that are needed. Rows with equal keys are in one shard, as are all with a
    null key, which is a key like others. An empty table gives no rows. Columns of docs with the names
    of the result are replaced, others keep theirs.
    """

    @aside(key, *order)
    def run(rows: DataFrame) -> DataFrame:
        k = F.col(f"`{key}`")
        out = {"shard": shard_of(k, shards, seed), **({"grown_shard": shard_of(k, more, seed)} if more else {})}
        rows = rows.withColumns({**out, "_digest": F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(k.cast("string"), F.lit(""))))})
        return numbered(rows, ["_digest", *(f"`{c}`" for c in dict.fromkeys((key, *order)))], ["shard"], "slot").drop("_digest")

    return run(docs.drop("shard", "slot", "grown_shard"))


def write_shards(sharded: DataFrame, folder: str) -> None:
    """The rows of shard_records as Parquet, one folder shard=<n> for each shard, in the order of slots within each file."""
    slots = F.floor(F.col("slot") / F.lit(1 << 20))  # a large shard is several files, each a run of slots
    sharded.repartition("shard", slots).sortWithinPartitions("shard", "slot").write.mode("overwrite").partitionBy("shard").parquet(folder)


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard and slot of every row of ``documents`` among eight shards, and its shard among nine.

    The law is ``key``: doc_id and the shards decide, so equal texts with other ids may lie apart.
    """
    docs = table(spark, sf_dir, "documents")
    text = F.coalesce("text", F.lit(""))
    narrow = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    x = shard_records(narrow, even(8), more=even(9), order=("size", "text_crc32"))
    return x.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.col("grown_shard").cast("int").alias("grown_shard"))


OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, text, coalesce(strlen(text), 0) + 1 AS size, coalesce(doc_id::VARCHAR, '') AS k FROM documents),
{long_crc32("d", "i", "text")},
w AS (SELECT i, list_transform(range(9), lambda s: -ln((('0x' || md5('0:' || s || ':' || k)[1:{DIGITS}])::BIGINT + 0.5) / {16**DIGITS}::DOUBLE)) AS w FROM d),
s AS (SELECT doc_id, size::BIGINT AS size, text_crc32, (list_position(w, list_min(w[1:8])) - 1)::INT AS shard, (list_position(w, list_min(w)) - 1)::INT AS grown_shard, md5('0:' || k) AS m
  FROM d JOIN crc USING (i) JOIN w USING (i))
SELECT doc_id, size, text_crc32, 'key' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY m, doc_id NULLS FIRST, size, text_crc32) - 1)::BIGINT AS slot, grown_shard FROM s
"""
