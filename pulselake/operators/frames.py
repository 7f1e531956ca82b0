"""Operators on frame series: rows of (series keys, frame index, energy).

block says how many consecutive frames a task is given at once; None is for series that a task holds
whole, such as a chunk's frames. Results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKGROUND_MARGIN_DB, CORE_MARGIN_DB, CORE_MAX_THRESHOLD_DB, CORE_THRESHOLD_DB, ENERGY_THRESHOLD_DB, FASTSKIP_FACTOR, FASTSKIP_MARGIN_DB, FASTSKIP_PEAK
from ..functions.scalars import to_db
from . import series


def _ordered(rows: DataFrame, keys: list[str], order: list[str], halo: int, columns: Callable, block: int | None) -> DataFrame:
    """rows with columns(w), which look at most halo rows to either side; by blocks, order is one column that numbers the rows."""
    if block is None:
        return rows.withColumns(columns(Window.partitionBy(*keys).orderBy(*order)))
    (frame,) = order
    return series.over_blocks(rows, keys, frame, halo, columns, block)


def band_power(bins: DataFrame, keys: list[str], low_hz: float, high_hz: float, frame: str = "frame", frequency: str = "hz", power: str = "power") -> DataFrame:
    """Power of a frequency band for each frame."""
    return bins.filter(F.col(frequency).between(low_hz, high_hz)).groupBy(*keys, frame).agg(F.sum(power).alias(power))


def normalise_db(frames: DataFrame, keys: list[str], value: str, out: str = "energy_db", block: int | None = None) -> DataFrame:
    """Decibels below the series' maximum, at most 80 below. By blocks, the maximum is aggregated first and joined."""
    if block is not None:
        tops = frames.groupBy(*keys).agg(F.max(value).alias("_top"))
        return series.with_facts(frames, tops, keys).withColumn(out, to_db(F.col(value), F.col("_top"))).drop("_top")
    top = F.max(value).over(Window.partitionBy(*keys))
    return frames.withColumn(out, to_db(F.col(value), top))


def smooth(frames: DataFrame, keys: list[str], order: list[str], value: str, out: str = "smooth_db", block: int | None = None) -> DataFrame:
    """Sum of five frames over 5, with zeros beyond the ends; series of fewer than 5 stay."""
    def columns(w):
        around = w.rowsBetween(-4, 4)  # a series has five frames if five lie so near
        return {out: F.when(F.count("*").over(around) >= 5, F.sum(value).over(w.rowsBetween(-2, 2)) / 5).otherwise(F.col(value))}

    return _ordered(frames, keys, order, 4, columns, block)


def detection_threshold(value: Column) -> Column:
    """A2 (an aggregate)."""
    return detection_level(F.median(value))


def detection_level(median: Column) -> Column:
    """A2 from the median of a series."""
    return F.greatest(F.lit(ENERGY_THRESHOLD_DB), median + BACKGROUND_MARGIN_DB)


def refine_threshold(value: Column) -> Column:
    """A3 (an aggregate)."""
    return refine_level(F.percentile(value, F.lit(0.2)))


def refine_level(p20: Column) -> Column:
    """A3 from the 20th percentile of a series."""
    return F.least(F.lit(CORE_MAX_THRESHOLD_DB), F.greatest(F.lit(CORE_THRESHOLD_DB), p20 + CORE_MARGIN_DB))


def active(frames: DataFrame, keys: list[str], value: str, threshold=detection_threshold, levels: DataFrame | None = None) -> DataFrame:
    """Frames at or above their series' threshold, with it.

    levels (keys, threshold_db) are thresholds of long series, from series.quantiles; else they are
    aggregated, which holds a series' distinct values in a buffer.
    """
    if levels is None:
        levels = frames.groupBy(*keys).agg(threshold(F.col(value)).alias("threshold_db"))
    return frames.join(levels, keys).filter(F.col(value) >= F.col("threshold_db"))


def islands(rows: DataFrame, keys: list[str], position: str, gap: Column | float, order: list[str] | None = None, block: int | None = None) -> DataFrame:
    """Rows with island: numbers from 1 on of runs whose neighbours lie at most gap apart. block is in units of position."""
    if block is not None:
        return series.islands(rows, keys, position, gap, order or [position], block)
    w = Window.partitionBy(*keys).orderBy(*(order or [position]))
    new = F.coalesce(F.col(position) - F.lag(position).over(w) > gap, F.lit(True))
    return rows.withColumn("_new", new.cast("long")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def merge_gaps(rows: DataFrame, keys: list[str], frame: str, max_gap_frames: int, order: list[str] | None = None, block: int | None = None) -> DataFrame:
    """(keys, island, first_frame, last_frame, n): runs of active frames, joined over at most max_gap_frames missing ones."""
    return islands(rows, keys, frame, F.lit(max_gap_frames + 1), order, block).groupBy(*keys, "island").agg(F.min(frame).alias("first_frame"), F.max(frame).alias("last_frame"), F.count("*").alias("n"))


def island_snr(frames: DataFrame, keys: list[str], value: str, inside: Column) -> DataFrame:
    """A4: median inside less median outside, or less the 20th percentile of all if nothing is outside.

    Values are ranked by a sort, which spills, so no buffer holds those of an island. Nulls are left out;
    inside, where it is null, is neither, and counts among all.
    """
    x = frames.select(*keys, F.col(value).cast("double").alias("_v"), inside.alias("_in"))
    side, every = Window.partitionBy(*keys, "_in"), Window.partitionBy(*keys)
    x = x.withColumns({"_r": F.row_number().over(side.orderBy(F.asc_nulls_last("_v"))) - 1, "_n": F.count("_v").over(side)})
    # All are ranked where an island has nothing outside. There all values but those without a side lie inside.
    x = x.withColumn("_bare", F.count(F.when(~F.col("_in"), F.col("_v"))).over(every) == 0)
    whole = F.when(F.col("_bare") & F.col("_v").isNotNull(), F.lit(1))
    x = x.withColumns({"_all": F.row_number().over(every.orderBy(F.asc_nulls_last("_v"))) - 1, "_m": F.count(whole).over(every)})

    def quantile(q: float, rank: str, n: str, among: Column) -> Column:
        at = (F.col(n) - 1) * F.lit(q)
        low = F.max(F.when(among & (F.col(rank) == F.floor(at)), F.col("_v") * (1 - at + F.floor(at))))
        return low + F.max(F.when(among & (F.col(rank) == F.ceil(at)), F.col("_v") * F.when(at == F.floor(at), 0.0).otherwise(at - F.floor(at))))

    core, around = quantile(0.5, "_r", "_n", F.col("_in")), quantile(0.5, "_r", "_n", ~F.col("_in"))
    return x.groupBy(*keys).agg((core - F.coalesce(around, quantile(0.2, "_all", "_m", F.col("_bare")))).alias("snr_db"))


def global_stats(samples: DataFrame, keys: list[str], block: list[str], value: str) -> DataFrame:
    """Mean, peak, median of the blocks' peaks and number of blocks, by two map-side combined aggregations."""
    blocks = samples.groupBy(*keys, *block).agg(F.sum(value).alias("s"), F.count(value).alias("n"), F.max(F.abs(value)).alias("p"))
    return blocks.groupBy(*keys).agg((F.sum("s") / F.sum("n")).alias("mean"), F.max("p").alias("peak"), F.median("p").alias("block_peak_median"), F.count("*").alias("block_count"))


def may_contain_pulse(peak: Column, median: Column, block_peak_median: Column) -> Column:
    """Whether a chunk's envelope justifies analysis."""
    loud = (peak >= FASTSKIP_PEAK) | (peak >= 10 ** (FASTSKIP_MARGIN_DB / 20) * median) | (peak >= FASTSKIP_FACTOR * block_peak_median)
    return F.coalesce((peak > 0) & loud, F.lit(True))


def weighted_quantiles(bins: DataFrame, keys: list[str], position: str, weight: str, quantiles: dict[str, float]) -> DataFrame:
    """The first position whose cumulative share of weight reaches each quantile. One row per key and position."""
    w = Window.partitionBy(*keys).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    shared = bins.withColumn("share", F.sum(weight).over(w) / F.sum(weight).over(Window.partitionBy(*keys)))
    return shared.groupBy(*keys).agg(*(F.min(F.when(F.col("share") >= q, F.col(position))).alias(name) for name, q in quantiles.items()))


def largest_jump(rows: DataFrame, keys: list[str], order: list[str], value: str, block: int | None = None) -> DataFrame:
    """The largest change between neighbours."""
    jumps = _ordered(rows, keys, order, 1, lambda w: {"jump": F.abs(F.col(value) - F.lag(value).over(w))}, block)
    return jumps.groupBy(*keys).agg(F.max("jump").alias("max_jump"))


def edge_medians(rows: DataFrame, keys: list[str], order: list[str], value: str, n: int = 3) -> DataFrame:
    """Medians of the first and the last n values; each task sends n rows of a series from either end."""
    up, down = top_rows(rows, keys, [F.col(c) for c in order], n, "_n"), top_rows(rows, keys, [F.desc(c) for c in order], n, "_n")
    x = up.select(*keys, F.col(value).alias("_a"), F.lit(None).alias("_z")).union(down.select(*keys, F.lit(None), F.col(value)))
    return x.groupBy(*keys).agg(F.median("_a").alias("start_value"), F.median("_z").alias("end_value"))


def rolling_median(rows: DataFrame, keys: list[str], order: list[str], value: str, width: int, pad: str = "zero", out: str = "rolling", block: int | None = None) -> DataFrame:
    """Median of width values around each; beyond the ends zeros ("zero") or the end's value ("nearest")."""
    half = width // 2

    def columns(w):
        ends = F.first(value).over(w.rowsBetween(-half, 0)), F.last(value).over(w.rowsBetween(0, half))
        fill = {"zero": lambda k: F.lit(0.0), "nearest": lambda k: ends[0] if k > 0 else ends[1]}[pad]
        around = [F.coalesce(F.lag(value, k).over(w), fill(k)) for k in range(half, -half - 1, -1)]
        return {out: F.element_at(F.array_sort(F.array(*around)), half + 1)}

    return _ordered(rows, keys, order, half, columns, block)


def local_maxima(rows: DataFrame, keys: list[str], order: list[str], value: str, block: int | None = None) -> DataFrame:
    """Rows above both neighbours."""
    return _ordered(rows, keys, order, 1, lambda w: {"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}, block).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b"))).drop("_a", "_b")


def top_rows(rows: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each key. Spark prunes each task to k rows a key before the shuffle."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(out) <= k)
