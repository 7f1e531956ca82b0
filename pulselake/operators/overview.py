"""Render-ready tables: pooled spectrograms, waveform traces, envelopes and frequency limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_TIME_BINS


def max_pool(cells: DataFrame, keys: list[str], time: Column, duration: Column, row: str, value: str, bins: int = MAX_TIME_BINS) -> DataFrame:
    """The largest value of each time bin and row; the same if parts of the input come twice."""
    return cells.withColumn("time_bin", F.least(F.lit(bins - 1), F.floor(time / duration * bins).cast("int"))).groupBy(*keys, "time_bin", row).agg(F.max(value).alias("value"))


def minmax_trace(samples: DataFrame, keys: list[str], bucket: Column, order: str, value: str) -> DataFrame:
    """The smallest and the largest sample of each bucket, in the order of their times; one row if they are the same sample."""
    x = samples.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(
        F.min(F.struct(F.col(value).alias("v"), F.col(order).alias("at"))).alias("lo"), F.max(F.struct(F.col(value).alias("v"), (-F.col(order)).alias("at"))).alias("hi")
    )
    ends = F.array_sort(F.array_distinct(F.array(F.struct(F.col("lo.at").alias("at"), F.col("lo.v").alias("value")), F.struct((-F.col("hi.at")).alias("at"), F.col("hi.v").alias("value")))))
    return x.select(*keys, "bucket", F.explode(ends).alias("e")).select(*keys, "bucket", "e.*")


def band_envelope(frames: DataFrame, keys: list[str], frame: str, power: str) -> DataFrame:
    """Summed power of each frame over the largest of its series; 0 where the series' range is under half of that."""
    x = frames.groupBy(*keys, frame).agg(F.sum(power).alias("p"))
    ends = x.groupBy(*keys).agg(F.max("p").alias("hi"), F.min("p").alias("lo"))
    flat = (F.col("hi") <= 0) | ((F.col("hi") - F.col("lo")) / F.col("hi") < 0.5)
    return x.join(ends, keys).select(*keys, frame, F.when(flat, F.lit(0.0)).otherwise(F.col("p") / F.col("hi")).alias("envelope"))


def merged_events(components: DataFrame, event: str, start: str, end: str, label: str, low: str, high: str) -> DataFrame:
    """One row per event over its components: span, labels and frequency range."""
    return components.groupBy(event).agg(F.min(start).alias("start_value"), F.max(end).alias("end_value"), F.array_join(F.array_sort(F.collect_set(label)), ",").alias("labels"), F.min(low).alias("low"), F.max(high).alias("high"), F.count("*").alias("n_components"))


def frequency_limits(low: Column, high: Column, band_low: float = 15_000.0, band_high: float = 120_000.0, pad: float = 8_000.0, least: float = 20_000.0) -> Column:
    """padded limits, at least 20 kHz wide; the whole band if they cover 85 % of it."""
    a, b = F.greatest(F.lit(band_low), low - pad), F.least(F.lit(band_high), high + pad)
    lack = F.greatest(F.lit(0.0), F.lit(least) - (b - a)) / 2
    a, b = F.greatest(F.lit(band_low), a - lack), F.least(F.lit(band_high), b + lack)
    wide = (b - a) >= 0.85 * (band_high - band_low)
    return F.struct(F.when(wide, F.lit(band_low)).otherwise(a).alias("low_hz"), F.when(wide, F.lit(band_high)).otherwise(b).alias("high_hz"))
