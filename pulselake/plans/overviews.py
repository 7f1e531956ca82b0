"""Overviews of whole recordings, ready to draw: pooled spectrograms, waveform traces, band envelopes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MAX_TIME_BINS, SAMPLE_RATE
from ..functions import signal
from ..operators import overview
from ..sources.recordings import map_rows, read_piece, spread
from .segments import CHUNK, KEYS

N_FFT = 1024


def time_step(duration_s: Column) -> Column:
    """Samples between the overview's frames: at most about MAX_TIME_BINS for a recording, at least a quarter window."""
    return F.greatest(F.lit(N_FFT // 4), F.ceil(F.greatest(duration_s, F.lit(1e-6)) * SAMPLE_RATE / MAX_TIME_BINS).cast("int"))


def spectrogram(chunks: DataFrame, bins: int = N_FFT // 2 + 1) -> DataFrame:
    """(recording_key, time_bin, bin, value): the largest power of each cell; parts that chunks share may come twice.

    A chunk's task pools its own frames first, so what is shuffled depends on the overview's size, not
    on the samples. Chunks come from segments.chunk_rows.
    """
    x = chunks.withColumn("hop", time_step(F.col("duration_s"))).select(*KEYS, *CHUNK, "hop")

    def pool(row: dict) -> list[dict]:
        y = read_piece(row, row["read_start_s"], row["read_end_s"])
        if len(y) < N_FFT:
            return []
        power = np.abs(signal.stft(y, N_FFT, row["hop"])) ** 2
        at = np.rint((row["read_start_s"] + np.arange(len(power)) * (row["hop"] / SAMPLE_RATE)) * SAMPLE_RATE / row["hop"]).astype(int)
        return [{"recording_key": row["recording_key"], "time_bin": int(t), "powers": power[at == t].max(axis=0)[:bins].tolist()} for t in np.unique(at)]

    cells = map_rows(spread(x, *KEYS), pool, "recording_key string, time_bin int, powers array<double>", 1)
    cells = cells.select("recording_key", "time_bin", F.posexplode("powers").alias("bin", "value"))
    return cells.groupBy("recording_key", "time_bin", "bin").agg(F.max("value").alias("value"))


def band_envelope(cells: DataFrame) -> DataFrame:
    """The band's share of the loudest frame for each time bin of a spectrogram, zero for flat recordings."""
    inside = cells.filter(F.col("bin").isin([int(b) for b in signal.band(N_FFT)]))
    return overview.band_envelope(inside, ["recording_key"], "time_bin", "value")


def waveform(chunks: DataFrame, buckets: int = 24_000) -> DataFrame:
    """(recording_key, bucket, at, value): smallest and largest sample of each bucket in the order of their times.

    Each chunk's task keeps two samples a bucket; buckets that two chunks share are reduced again.
    """
    x = chunks.withColumn("width", F.greatest(F.lit(1), F.ceil(F.col("duration_s") * SAMPLE_RATE / buckets).cast("long"))).select(*KEYS, *CHUNK, "coverage_start_s", "coverage_end_s", "width")

    def ends(row: dict) -> list[dict]:
        y = read_piece(row, row["coverage_start_s"], row["coverage_end_s"])
        first = round(row["coverage_start_s"] * SAMPLE_RATE)
        out = []
        for b in range(first // row["width"], (first + len(y) - 1) // row["width"] + 1 if len(y) else 0):
            lo = max(0, b * row["width"] - first)
            part = y[lo : (b + 1) * row["width"] - first]
            out += [{"recording_key": row["recording_key"], "bucket": b, "at": first + lo + int(i), "value": float(part[i])} for i in sorted({int(part.argmin()), int(part.argmax())})]
        return out

    kept = map_rows(spread(x, *KEYS), ends, "recording_key string, bucket long, at long, value double", 1)
    return overview.minmax_trace(kept.withColumnRenamed("bucket", "_b"), ["recording_key"], F.col("_b"), "at", "value")
