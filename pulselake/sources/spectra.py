"""Cached spectra in .son files: header, frames of 16-bit magnitudes, and a comment at the end."""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The places of the header's fields and the limits of what is accepted.
MAGIC, HEAD_BYTES = b"SONA", 92
RATE_AT, FRAME_S_AT, BIN_HZ_AT, FRAMES_AT, BINS_AT, COMMENT_AT = 4, 8, 12, 24, 28, 88
MAX_FRAMES, MAX_BINS, MAX_COMMENT = 10_000_000, 65_536, 4096
SCHEMA = "path string, sample_rate long, frame_s double, bin_hz double, comment string, frame int, magnitudes array<short>, error string"


def parse(raw: bytes) -> tuple[dict, np.ndarray]:
    """(header with comment, frames x bins). The frames end where the comment begins: at the length that the header tells, or before the text at the end. Raises ValueError."""
    if len(raw) < HEAD_BYTES or raw[:4] != MAGIC:
        raise ValueError("not a SONA file")
    rate, frames, bins, told = (struct.unpack_from("<I", raw, at)[0] for at in (RATE_AT, FRAMES_AT, BINS_AT, COMMENT_AT))
    step, hz = (struct.unpack_from("<f", raw, at)[0] for at in (FRAME_S_AT, BIN_HZ_AT))
    if not (1 <= frames <= MAX_FRAMES and 2 <= bins <= MAX_BINS and rate > 0 and step > 0 and hz > 0):
        raise ValueError("header out of range")
    size = 2 * frames * bins
    tail = raw[max(HEAD_BYTES, len(raw) - MAX_COMMENT) :]
    text = np.isin(np.frombuffer(tail, np.uint8), [9, 10, 13, *range(32, 127)])[::-1]
    seen = min(len(text) if text.all() else int(np.argmin(text)), max(0, len(raw) - size))
    for n in (told, seen):
        start = len(raw) - n - size
        if n > MAX_COMMENT or start < HEAD_BYTES or n == 0 and seen > 0:
            continue
        x = np.frombuffer(raw, "<i2", frames * bins, start)
        if x.min() >= 0:
            return {"sample_rate": rate, "frame_s": float(step), "bin_hz": float(hz), "comment": raw[len(raw) - n :].decode("ascii", "replace").strip()}, x.reshape(frames, bins)
    raise ValueError("the frames are not where they should be")


def read_spectra(spark: SparkSession, path: str) -> DataFrame:
    """One row per frame of each .son file below path; a file that can't be read is one row with its error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.[sS][oO][nN]").load(path).select("path", "content")

    def run(batches):
        for b in batches:
            for p, raw in zip(b.column(0), b.column(1)):
                try:
                    head, x = parse(raw.as_py())
                except ValueError as e:
                    yield pa.RecordBatch.from_pylist([{"path": p.as_py(), "error": str(e)}], arrow)
                    continue
                for first in range(0, len(x), 4096):
                    part = x[first : first + 4096]
                    yield pa.RecordBatch.from_pylist([{"path": p.as_py(), **head, "frame": first + i, "magnitudes": m} for i, m in enumerate(part)], arrow)

    arrow = pa.schema([("path", pa.string()), ("sample_rate", pa.int64()), ("frame_s", pa.float64()), ("bin_hz", pa.float64()), ("comment", pa.string()), ("frame", pa.int32()), ("magnitudes", pa.list_(pa.int16())), ("error", pa.string())])
    return files.mapInArrow(run, SCHEMA)


def spectrum_cells(spectra: DataFrame) -> DataFrame:
    """(path, frame, bin, time_s, hz, power_db): decibels of each cell below the loudest of its file.

    Maxima are taken per frame, then per file, by map-side aggregation; no file's cells meet in one task.
    """
    ok = spectra.filter("error is null")
    top = ok.groupBy("path").agg(F.max(F.array_max("magnitudes")).alias("top"))
    x = ok.join(top, "path").select("path", "frame", "frame_s", "bin_hz", "top", F.posexplode("magnitudes").alias("bin", "m"))
    power = lambda c: F.pow(F.greatest(F.col(c).cast("double"), F.lit(1e-9)), 2)
    return x.select("path", "frame", "bin", (F.col("frame") * F.col("frame_s")).alias("time_s"), (F.col("bin") * F.col("bin_hz")).alias("hz"), (10 * F.log10(power("m") / power("top"))).alias("power_db"))
