"""Ordered operators on series of any length, in two levels: parts of a series, and one row for each part.

A window over a whole series is one task's, however long the series is. Here rows are dealt by parts
of a series, and what a part must know of others is a halo of neighbours, or one summary row for
each part. Keys may be null, which is a series of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..storage import checkpoint

#: Consecutive frames of a block.
BLOCK = 1 << 12
#: Values of a series among which an order statistic is looked up at once, and bins of a counting pass before that.
MOST, BINS = 1 << 14, 1 << 10


def with_facts(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """rows with the other columns of facts, which has one row for each value of on, null included."""
    f = facts.withColumnsRenamed({c: f"_on{i}" for i, c in enumerate(on)})
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_on{i}")) for i, c in enumerate(on)))
    return rows.join(f, same).drop(*(f"_on{i}" for i in range(len(on))))


def ranged(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows dealt by range of (keys, order), sorted and kept, with _part and _at, which grows in that order over all parts.

    Rows that tie are dealt by their place in the input, so neither a key nor a value holds a task up.
    """
    by = [*keys, *order, "_tie"]
    x = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("_tie")
    return checkpoint(x.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))


def numbered(rows: DataFrame, keys: list[str], order: list, out: str = "number") -> DataFrame:
    """Rows with out: their place, from 0 on, within each series by order."""
    x = ranged(rows, keys, order)
    parts = x.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    starts = parts.select(*keys, "_part", (earlier - F.col("_first")).alias("_start"))
    return with_facts(x, starts, [*keys, "_part"]).withColumn(out, F.col("_at") + F.col("_start")).drop("_at", "_part", "_start")


def most_before(x: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """x, from ranged, with out: the largest value of the rows before in the series, null where there is none."""
    return _beside(x, keys, value, out, F.max, F.greatest, (Window.unboundedPreceding, -1))


def least_after(x: DataFrame, keys: list[str], value: Column, out: str) -> DataFrame:
    """x, from ranged, with out: the smallest value of the rows after in the series, null where there is none."""
    return _beside(x, keys, value, out, F.min, F.least, (1, Window.unboundedFollowing))


def _beside(x: DataFrame, keys: list[str], value: Column, out: str, over_rows: Callable, of_two: Callable, reach: tuple[int, int]) -> DataFrame:
    x = x.withColumn("_value", value)
    parts = x.groupBy(*keys, "_part").agg(over_rows("_value").alias("_whole"))
    beyond = over_rows("_whole").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(*reach))
    parts = parts.select(*keys, "_part", beyond.alias("_beyond"))
    inside = over_rows("_value").over(Window.partitionBy(*keys, "_part").orderBy("_at").rowsBetween(*reach))
    return with_facts(x.withColumn("_inside", inside), parts, [*keys, "_part"]).withColumn(out, of_two("_inside", "_beyond")).drop("_value", "_inside", "_beyond")


def over_blocks(rows: DataFrame, keys: list[str], frame: str, halo: int, columns: Callable[[WindowSpec], dict[str, Column]], block: int = BLOCK) -> DataFrame:
    """rows with columns(w), which look at most halo frames to either side of a row by the window w.

    Frames are consecutive. A row also goes to the neighbouring block if it lies within halo of it.
    """
    if not 0 <= halo <= block:
        raise ValueError("a halo is no longer than a block")
    at = lambda f: F.floor(f / block)
    f = F.col(frame)
    x = rows.withColumn("_block", F.explode(F.array_distinct(F.array(at(f), at(f - halo), at(f + halo)))))
    w = Window.partitionBy(*keys, "_block").orderBy(frame)
    return x.withColumns(columns(w)).filter(at(f) == F.col("_block")).drop("_block")


def islands(rows: DataFrame, keys: list[str], position: str, gap: Column | float, order: list[str], block: int) -> DataFrame:
    """Rows with island, as frames.islands, for series that are cut each ``block`` units of position.

    A block numbers its own runs; one row a block says where it begins and ends and how many runs it
    has, from which follow the number of runs before it and whether its first run goes on from them.
    """
    x = rows.withColumn("_block", F.floor(F.col(position) / block))
    w = Window.partitionBy(*keys, "_block").orderBy(*order)
    new = F.coalesce((F.col(position) - F.lag(position).over(w) > gap).cast("long"), F.lit(0))
    x = x.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = x.groupBy(*keys, "_block").agg(F.min(position).alias("_lo"), F.max(position).alias("_hi"), F.max("_run").alias("_runs"))
    by_block = Window.partitionBy(*keys).orderBy("_block")
    s = s.withColumn("_begins", F.coalesce((F.col("_lo") - F.lag("_hi").over(by_block) > gap).cast("long"), F.lit(1)))
    first = F.sum(F.col("_begins") + F.col("_runs")).over(by_block) - F.col("_runs")
    s = s.select(*keys, "_block", first.alias("_base"))
    return with_facts(x, s, [*keys, "_block"]).withColumn("island", F.col("_base") + F.col("_run")).drop("_block", "_new", "_run", "_base")


def quantiles(rows: DataFrame, keys: list[str], value: str, wanted: dict[str, float], most: int = MOST, bins: int = BINS) -> DataFrame:
    """(keys, names of wanted): exact quantiles of finite values, between neighbours by linear interpolation; nulls are left out.

    A quantile lies between two order statistics. The range in which one lies is cut into bins, whose
    counts are combined before they are shuffled, and the bin that holds it is the next range, until it
    has most values or one. Only then values meet, each with its count. So a buffer holds at most bins or most rows.
    """
    x = rows.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    ends = x.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    at = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("_n") - 1) * F.lit(float(q))).alias("at")) for name, q in wanted.items()))
    t = ends.withColumn("_q", F.explode(at)).withColumn("_rank", F.explode(F.array_distinct(F.array(F.floor("_q.at"), F.ceil("_q.at")))))
    t = t.select(*keys, F.col("_q.name").alias("_name"), F.col("_q.at").alias("_target"), F.col("_rank").alias("_sought"), "_rank", "_n", "_lo", "_hi")
    one = [*keys, "_name", "_sought"]
    fixed = [F.first(c).alias(c) for c in ("_target", "_rank")]

    def within(targets: DataFrame, *by: Column) -> DataFrame:
        """Values in the ranges of targets, counted by bin or value, of each target the one with the rank sought."""
        inside = with_facts_of_many(x, targets, keys).filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
        c = inside.groupBy(*one, *by).agg(*fixed, F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        c = c.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*one).orderBy("_by")))
        c = c.filter((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
        return c.withColumn("_rank", F.col("_rank") - F.col("_upto") + F.col("_n")).select(*t.columns)

    wide = (F.col("_n") > most) & (F.col("_lo") < F.col("_hi"))
    while not t.filter(wide).isEmpty():
        cut = F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)).alias("_by")
        t = checkpoint(t.filter(~wide).union(within(t.filter(wide), cut)))
    found = within(t, F.col("_v").alias("_by"))
    share = F.col("_target") - F.floor("_target")
    part = F.when(share == 0, F.col("_lo")).when(F.col("_sought") < F.col("_target"), F.col("_lo") * (1 - share)).otherwise(F.col("_lo") * share)
    return found.groupBy(*keys).agg(*(F.sum(F.when(F.col("_name") == name, part)).alias(name) for name in wanted))


def with_facts_of_many(rows: DataFrame, facts: DataFrame, on: list[str]) -> DataFrame:
    """with_facts for facts that have some rows for each value of on: one array for each, so that rows meet them once."""
    rest = [c for c in facts.columns if c not in on]
    listed = facts.groupBy(*on).agg(F.collect_list(F.struct(*rest)).alias("_facts"))
    return with_facts(rows, listed, on).select(*rows.columns, F.explode("_facts").alias("_f")).select(*rows.columns, "_f.*")
