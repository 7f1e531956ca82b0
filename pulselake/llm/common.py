"""Shared Spark plumbing: connected components, shipped code, columns that ride along."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import checkpoint

#: ASCII white space: the separators of words in most operators.
SPACE = "\\x20\\x09-\\x0D"
WORD = f"[^{SPACE}]+"


def ship() -> None:
    """Send this package's functions to the workers by value, so that they need not have it installed."""
    import pulselake

    cloudpickle.register_pickle_by_value(pulselake)


ship()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(schema: StructType, **kinds: str) -> StructType:
    """A new schema with further fields."""
    out = StructType(list(schema.fields))
    for name, kind in kinds.items():
        out = out.add(name, kind)
    return out


def aside(*own: str) -> Callable:
    """For an operator on docs that needs only the columns own: all others ride along, whatever their names are.

    Inside, they have names that no operator uses; afterwards those with the name of a result column
    are replaced by it, and the others have their names again.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(docs: DataFrame, *args, **kw) -> DataFrame:
            inside = {c: c if c in own else f"_own{i}_" for i, c in enumerate(docs.columns)}
            out = operator(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inside.items())), *args, **kw)
            back = {n: c for c, n in inside.items()}
            new = {c for c in out.columns if c not in back}
            return out.select(*(F.col(c).alias(back.get(c, c)) for c in out.columns if back.get(c) not in new))

        return run

    return wrap


#: Rows of links, keys and the like that a task is worth.
TASK_ROWS = 1 << 17


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df in as many partitions as so many narrow rows need, if it has more.

    Small rounds would else leave a file for each of the session's partitions in every shuffle.
    """
    return df.coalesce(max(2, -(-rows // TASK_ROWS)))


def _stars(e: DataFrame) -> bool:
    """Whether the links (u, v) are stars: no node has two links up, none has links up and down. One aggregation, one number to the driver."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(e.select("v", F.lit(0), F.lit(1)))
    bad = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))))
    return not bad.first()[0]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Distributed union-find: (node, root) for every node of the links, root the smallest node reachable.

    Alternating large-star and small-star rounds until all links are stars; a round aggregates minima
    per node and joins them back, so no component is ever gathered in a task, and the number of
    rounds grows with the logarithm of the longest chain. Links are checkpointed between rounds.
    """
    both = lambda e: e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    e = checkpoint(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct())
    n = 2 * e.count()
    e = sized(e, n)
    while not _stars(e):
        # Large star: every larger neighbour of u is linked to the smallest of u and its neighbours.
        near = both(e)
        low = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = sized(near.join(sized(low, n), "u"), n).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = sized(large, n)
        # Small star: u and its smaller neighbours are linked to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sized(low, n), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = checkpoint(sized(sized(small.filter("u > v"), n).distinct(), n))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def numbered(rows: DataFrame, order: list, per: list[str] = [], out: str = "number") -> DataFrame:  # noqa: B006
    """rows with out: their place, from 0 on, within each value of per by order (columns or names).

    One range sort of all rows: rows that tie in everything are dealt by their id, so no value holds a
    task up. The sorted rows are kept, and each task's rows of a value are numbered from the number of
    such rows in the tasks before it, which is one row for each task and value.
    """
    placed = rows.withColumn("_tie", F.monotonically_increasing_id())
    placed = placed.repartitionByRange(*per, *order, "_tie").sortWithinPartitions(*per, *order, "_tie").drop("_tie")
    placed = checkpoint(placed.withColumn("_place", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_place", 33))
    counts = placed.groupBy(*per, "_part").agg(F.count("*").alias("_n"), F.min("_place").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*per).orderBy("_part")) - F.col("_n")
    starts = counts.select(*per, "_part", (before - F.col("_first")).alias("_start"))
    return placed.join(F.broadcast(starts), [*per, "_part"]).withColumn(out, F.col("_place") + F.col("_start")).drop("_part", "_place", "_start")
