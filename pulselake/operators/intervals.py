"""Operators on intervals: chunk grids, ownership, duplicates and nearest intervals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHUNK_SECONDS, OVERLAP_SECONDS, REFINE_OVERLAP, SAME_CENTRE_MS, SAME_OVERLAP
from ..functions.scalars import overlap_ratio
from . import series
from .frames import top_rows


def chunk_grid(recordings: DataFrame, duration: str = "duration_s", chunk_s: float = CHUNK_SECONDS, overlap_s: float = OVERLAP_SECONDS) -> DataFrame:
    """A row for each chunk: coverage, which tiles [0, duration), and the wider range that is read."""
    d = F.col(duration)
    n = F.ceil(d / chunk_s).cast("int")
    x = recordings.filter(d > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0), n - 1)))
    x = x.withColumns({"coverage_start_s": F.col("chunk_index") * chunk_s, "coverage_end_s": F.least((F.col("chunk_index") + 1) * F.lit(chunk_s), d)})
    return x.withColumns({"read_start_s": F.greatest(F.lit(0.0), F.col("coverage_start_s") - overlap_s), "read_end_s": F.least(d, F.col("coverage_end_s") + overlap_s)})


def owned(start: Column, end: Column, coverage_start: Column, coverage_end: Column) -> Column:
    """P5: whether an interval's centre lies in [coverage_start, coverage_end)."""
    centre = (start + end) / 2
    return (centre >= coverage_start) & (centre < coverage_end)


def same_pulse(a: str, b: str) -> Column:
    """Q7: two intervals are one pulse if they share half of the shorter, or their centres lie within 1.5 ms."""
    c = lambda t, n: F.col(f"{t}.{n}")
    centre = lambda t: (c(t, "start_s") + c(t, "end_s")) / 2
    return (overlap_ratio(c(a, "start_s"), c(a, "end_s"), c(b, "start_s"), c(b, "end_s")) >= SAME_OVERLAP) | (F.abs(centre(a) - centre(b)) <= SAME_CENTRE_MS / 1000)


def drop_repeats_across_chunks(pulses: DataFrame, key: str = "recording_key", bucket_s: float = 1.0, tail: int | None = 8, before: DataFrame | None = None) -> DataFrame:
    """Pulses without those that an earlier pulse of the chunk before already shows; the first chunk wins.

    before has pulses (key, chunk_index, start_s, end_s) of earlier chunks that are not among pulses.

    Pulses have start_s, end_s and chunk_index. Only the last ``tail`` pulses of the chunk before
    count (all if None). A range condition alone would pair every pulse with every other; buckets of
    bucket_s seconds, with each pulse of the earlier side in all buckets that it or its neighbourhood
    touches, make it an equi-join.
    """
    reach = SAME_CENTRE_MS / 1000
    bucket = lambda c: F.floor(c / bucket_s)
    earlier = pulses.select(key, "chunk_index", "start_s", "end_s")
    if before is not None:
        earlier = earlier.unionByName(before.select(*earlier.columns))
    if tail is not None:
        earlier = top_rows(earlier, [key, "chunk_index"], [F.desc("start_s"), F.desc("end_s")], tail, "_rank")
    earlier = earlier.select(F.col(key).alias("_key"), (F.col("chunk_index") + 1).alias("_chunk"), "start_s", "end_s", F.explode(F.sequence(bucket(F.col("start_s") - reach), bucket(F.col("end_s") + reach))).alias("_bucket"))
    later = pulses.withColumn("_b", F.explode(F.sequence(bucket(F.col("start_s")), bucket(F.col("end_s"))))).alias("n")
    met = later.join(earlier.alias("p"), (F.col(f"n.{key}") == F.col("p._key")) & (F.col("n.chunk_index") == F.col("p._chunk")) & (F.col("n._b") == F.col("p._bucket")) & same_pulse("p", "n"), "left_semi")
    repeated = met.select(key, "chunk_index", "start_s", "end_s").distinct()
    return pulses.join(repeated, [key, "chunk_index", "start_s", "end_s"], "left_anti")


def greedy_dedup(pulses: DataFrame, keys: list[str], overlap: float = REFINE_OVERLAP, extra: tuple[str, ...] = ()) -> DataFrame:
    """A fold over a group's pulses by start, against the last one kept.

    A pulse that shares ``overlap`` of the shorter with the last kept one replaces it if its SNR is
    higher and is dropped otherwise. Pulses have start_s, end_s, snr_db and the columns extra. Each task
    sorts its groups and steps over them once, holding the last kept pulse alone, however many overlap.
    A pulse without start or end overlaps none; one without SNR replaces none.
    """
    item = ["start_s", "end_s", "snr_db", *extra]
    x = pulses.select(*keys, *item).repartition(*keys).sortWithinPartitions(*keys, *item)
    names, n_keys = x.columns, len(keys)

    def fold(batches):
        last = None  # the one row that may still be replaced
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([b] if last is None else [last, b]).combine_chunks()
            new = np.zeros(rows.num_rows, bool)
            for k in range(n_keys):
                code = pc.fill_null(rows.column(k).combine_chunks().dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
                new[1:] |= code[1:] != code[:-1]
            start, end, snr = (pc.fill_null(rows.column(n_keys + i).cast(pa.float64()), np.nan).to_pylist() for i in range(3))
            kept, at = [], 0
            for i in range(1, len(start)):
                shorter = min(end[at] - start[at], end[i] - start[i])
                if new[i] or not (shorter > 0 and max(0.0, min(end[at], end[i]) - max(start[at], start[i])) / shorter >= overlap):
                    kept.append(at)
                    at = i
                elif snr[i] > snr[at]:
                    at = i
            last = rows.slice(at, 1).to_batches()[0]
            yield from rows.take(pa.array(kept, pa.int64())).to_batches()
        if last is not None:
            yield last

    return x.mapInArrow(fold, x.schema).select(*names)


def nearest_interval(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, start: str, end: str, single: bool = False) -> DataFrame:
    """For each point the interval that contains it, else the one with the nearest end; ties go to the earlier one.

    A sweep: of a key's intervals by start only those count that end after all before them, so that both
    their ends grow. In the order of points and of these ends, the answer is the next interval, or the
    one before if the point lies outside and is nearer to that. single: a key has one point, and is joined with its intervals.
    """
    away = lambda s, e: F.greatest(F.lit(0.0), s - F.col(point), F.col(point) - e).alias("distance")
    if single:
        x = points.join(intervals, keys).withColumn("distance", away(F.col(start), F.col(end)))
        return x.groupBy(*keys, point).agg(F.min(F.struct("distance", start, end)).alias("m")).select(*keys, point, "m.*")
    i = series.most_before(series.ranged(intervals.select(*keys, start, end), keys, [start, end]), keys, F.col(end), "_before")
    i = i.filter(F.coalesce(F.col(end) > F.col("_before"), F.lit(True))).select(*keys, F.col(end).alias(point), F.struct(start, end).alias("_i"))
    x = points.select(*keys, point).distinct().withColumn("_i", F.lit(None)).unionByName(i)
    x = series.ranged(x.withColumn("_kind", F.col("_i").isNotNull()), keys, [point, "_kind"])
    item = F.when(F.col("_kind"), F.struct("_at", "_i"))
    x = series.least_after(series.most_before(x, keys, item, "_l"), keys, item, "_r").filter(~F.col("_kind"))
    of = lambda c: F.when(F.col(c).isNotNull(), F.struct(away(F.col(f"{c}._i")[start], F.col(f"{c}._i")[end]), F.col(f"{c}._i")[start].alias(start), F.col(f"{c}._i")[end].alias(end)))
    return x.withColumn("m", F.least(of("_l"), of("_r"))).filter("m is not null").select(*keys, point, "m.*")
