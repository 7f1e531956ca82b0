"""Mixing sources to target weights (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, aside, table


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = 1.5, cap: float = 2.0, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Word budget of each source: (source, source_size, target).

    sizes has a row for each source (source, source_size). Sources weigh ``weights`` in turn by code
    point, null last, and share ``share`` of all words; no target exceeds ``cap`` times its source,
    and what that leaves goes to the others by weight. The level at which no target is above its
    cap is found in closed form: sources in the order of their cap per weight fill up one after
    another. The windows run over one row per source, never over documents.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    fill = Window.orderBy("ratio", F.col("source").isNull(), "source")
    every = Window.partitionBy()
    s = sizes.withColumn("weight", w.cast("long")).withColumn("ratio", F.col("source_size") / F.col("weight"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    s = s.select("source", "source_size", "weight", "ratio", F.sum("source_size").over(every).alias("total"), F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("full"), F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)).alias("open"))
    level = (F.lit(share) * F.col("total") - F.lit(cap) * F.col("full")) / F.col("open")
    s = s.withColumn("level", F.when(level <= F.lit(cap) * F.col("ratio"), F.struct("ratio", "full", "open")))
    s = s.withColumn("level", F.min("level").over(every))
    shared = (F.lit(share) * F.col("total") - F.lit(cap) * F.col("level.full")) * F.col("weight") / F.col("level.open")
    return s.select("source", "source_size", F.when(F.col("level").isNull() | (F.col("ratio") < F.col("level.ratio")), F.lit(cap) * F.col("source_size")).otherwise(shared).alias("target"))


@aside("doc_id", "source", "text")
def mix(docs: DataFrame, share: float = 1.5, cap: int = 2, weights: tuple[int, ...] = (5, 2, 1), seed: int = 0, whole: bool = False, blocks: int = 3) -> DataFrame:
    """docs with size, source_size, target, copies (whole passes over the row) and taken (words).

    Each row gets a hash-random key, an MD5 of the seed and doc_id. Within a source, rows are ordered
    by key, and the words before each row are known from two window sums: one inside a block of
    equal first hexadecimal digits of the key (16 ** blocks of them, so a source with a third of
    all rows is dealt over thousands of groups), and one over the blocks' totals. A source's budget,
    its target rounded, makes whole epochs and a rest; the rest ends inside one row, which gives the
    words that fill the budget exactly. With ``whole``, rows are not cut: a row belongs to the rest
    if the rest covers more than half of it, and taken is copies times size.

    Null texts and empty ones have size 0 and are never taken; a null source is a source; rows with
    the same doc_id are rows of their own, in the order of their sizes. An empty table gives no rows.
    """
    # Narrow rows only are dealt; the texts follow by a join on the row's own identity only if they are asked for.
    d = docs.withColumn("size", n_words(F.col("text")))
    d = d.withColumn("_key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    d = d.withColumn("_block", F.substring("_key", 1, blocks))
    sums = d.groupBy("source", "_block").agg(F.sum("size").alias("_sum"))
    targets = source_targets(sums.groupBy("source").agg(F.sum("_sum").alias("source_size")), share, float(cap), weights)
    earlier = Window.partitionBy("source").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "_block", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_start"))
    starts = starts.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    starts = starts.select(F.col("source").alias("_s"), F.col("_block").alias("_b"), "_start", "source_size", "target")
    inside = Window.partitionBy("source", "_block").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    d = d.join(starts, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_block") == F.col("_b")))
    budget = F.round("target").cast("long")
    d = d.withColumn("_epochs", F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long"))
    d = d.withColumn("_left", F.greatest(F.lit(0), F.least("size", budget - F.col("_epochs") * F.col("source_size") - F.col("_start") - F.col("_in"))))
    d = d.withColumn("copies", (F.col("_epochs") + F.when(F.col("size") < 2 * F.col("_left"), 1).otherwise(0)).cast("int"))
    taken = F.col("copies") * F.col("size") if whole else F.col("_epochs") * F.col("size") + F.col("_left")
    return d.withColumn("taken", taken.cast("long")).drop("_key", "_block", "_in", "_s", "_b", "_start", "_epochs", "_left")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words taken of each document of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    # The size is all that the mix needs of a text: the texts go before the first shuffle.
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken", "copies")


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('0:' || coalesce(doc_id::VARCHAR, '')) AS k FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1]::BIGINT AS weight FROM s),
r AS (SELECT *, source_size / weight AS ratio FROM w),
f AS (SELECT *, sum(source_size) OVER ()::BIGINT AS total,
       coalesce(sum(source_size) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS filled,
       sum(weight) OVER (ORDER BY ratio, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS open_w FROM r),
l AS (SELECT ratio, filled, open_w FROM f WHERE (1.5::DOUBLE * total - 2.0::DOUBLE * filled) / open_w <= 2.0::DOUBLE * ratio ORDER BY ratio, filled, open_w LIMIT 1),
t AS (SELECT f.source, f.source_size,
       CASE WHEN l.ratio IS NULL OR f.ratio < l.ratio THEN 2.0::DOUBLE * f.source_size
            ELSE (1.5::DOUBLE * f.total - 2.0::DOUBLE * l.filled) * f.weight / l.open_w END AS target
       FROM f LEFT JOIN l ON true),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target, round(t.target)::BIGINT AS budget,
       coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS epochs FROM p),
x AS (SELECT *, greatest(0, least(size, budget - epochs * source_size - before)) AS rest FROM e)
SELECT doc_id, size, source_size, target, (epochs * size + rest)::BIGINT AS taken,
       (epochs + CASE WHEN size < 2 * rest THEN 1 ELSE 0 END)::INT AS copies FROM x
"""
