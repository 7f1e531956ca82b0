"""Recordings: file scans, header probes, and range reads of pieces as Spark rows.

A recording is never loaded whole. Files are listed by Spark, headers are probed in tasks, and each
piece (a chunk, a block, a pulse with its context) is a small row whose task seeks to its samples.
Tasks seek by open_input: on mounted paths, or on stores that Arrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType, _parse_datatype_string

from ..config import FILTER_MARGIN_SECONDS, SAMPLE_RATE
from ..functions.scalars import IDENTITY_BLOCK, class_from_stem, recording_key
from ..functions.signal import highpass, resample, wav_header, wav_samples

HEAD = 1 << 16
PROBE = "frames bigint, sr int, duration_s double, code int, channels int, align int, bits int, data_start bigint, error string"
#: What a task needs to read a piece.
PLACE = ["path", "code", "channels", "align", "bits", "data_start", "frames", "sr"]


def local(path: str) -> str:
    """The path that open() takes; ValueError for stores that are not mounted."""
    found = urlparse(path)
    if found.scheme not in ("", "file"):
        raise ValueError(f"this needs a mounted file system, not {found.scheme}:")
    return path if not found.scheme else (unquote(found.path) if path.startswith("file:///") else path[len("file:") :])


def open_input(path: str):
    """A file for reading ranges: by the mount of a plain path or file: URI, else by Arrow's file system of the URI (hdfs, s3, gs and others). ValueError if there is none."""
    if urlparse(path).scheme in ("", "file"):
        return open(local(path), "rb")
    from pyarrow import fs

    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def list_recordings(root: str) -> list[tuple[str, int]]:
    """(path, size) of the WAV files below root, or of the one file root is, sorted; paths as root is written. Names and sizes only, on the caller."""
    from pyarrow import fs

    mounted = urlparse(root).scheme in ("", "file")
    store, inner = (fs.LocalFileSystem(), local(root)) if mounted else fs.FileSystem.from_uri(root)
    inner = inner.rstrip("/") or "/"
    info = store.get_file_info(inner)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return sorted((root.rstrip("/") + x.path[len(inner) :], x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(".wav"))


def wav_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of the files named .wav in any case, below root; no rows if root is missing. Contents are not read.

    Spark deals no task an empty file, so empty ones are added from the listing that it has made anyway.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, length bigint")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(root).select("path", "length")
    return with_empty(files)


def with_empty(files: DataFrame) -> DataFrame:
    """(path, length) of the files of a binaryFile scan, empty ones included."""
    listed = files._jdf.inputFiles()
    if len(listed) == files.count():
        return files
    names = files.sparkSession.createDataFrame([(unquote(x),) for x in listed], "path string")
    plain = lambda c: F.regexp_replace(c, r"^file:/+", "/")  # noqa: E731  both file:/a and file:///a are written
    found = files.select(plain(F.col("path")).alias("_path"))
    empty = names.join(found, plain(F.col("path")) == F.col("_path"), "left_anti")
    return files.union(empty.select("path", F.lit(0).cast("bigint").alias("length")))


def map_rows(df: DataFrame, compute: Callable[[dict], list[dict]], schema: StructType | str, batch: int = 16) -> DataFrame:
    """Rows of schema that compute makes of each row of df; few rows, each of which stands for much work."""
    kind = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = kind.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for b in batches:
            for first in range(0, b.num_rows, batch):
                out = [r for row in b.slice(first, batch).to_pylist() for r in compute(row)]
                yield pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in out], arrow)

    return df.mapInArrow(run, kind)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Narrow rows dealt over all cores, several tasks each, as each row will be much work."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *keys)


def recordings(spark: SparkSession, root: str) -> DataFrame:
    """One row per recording: recording_key, segment_id, path, length and PROBE. A file that is no readable WAV has its error set."""

    def probe(row: dict) -> list[dict]:
        try:
            with open_input(row["path"]) as f:
                h = wav_header(f.read(HEAD), row["length"])
        except (ValueError, OSError) as e:
            return [{**row, "error": f"{type(e).__name__}: {e}"}]
        return [{**row, **h, "data_start": h["start"], "duration_s": h["frames"] / h["sr"]}]

    x = spread(wav_files(spark, root).select("path", "length"), "path")
    x = map_rows(x, probe, f"path string, length bigint, {PROBE}")
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+$", "")
    return x.select(recording_key(F.col("path")).alias("recording_key"), stem.alias("segment_id"), "*")


def file_edges(found: DataFrame) -> DataFrame:
    """recording_key, length, and head and tail: the first and, beyond two, the last IDENTITY_BLOCK bytes of each file; null if it cannot be read."""

    def read(row: dict) -> list[dict]:
        try:
            with open_input(row["path"]) as f:
                head, tail = f.read(IDENTITY_BLOCK), b""
                if row["length"] > 2 * IDENTITY_BLOCK:
                    f.seek(-IDENTITY_BLOCK, 2)
                    tail = f.read()
        except OSError:
            head = tail = None
        return [{**row, "head": head, "tail": tail}]

    x = spread(found.select("recording_key", "path", "length"), "path")
    return map_rows(x, read, "recording_key string, length bigint, head binary, tail binary", 1)


def require_recordings(spark: SparkSession, root: str) -> DataFrame:
    """Recordings, or FileNotFoundError if there are none."""
    found = recordings(spark, root)
    if wav_files(spark, root).isEmpty():
        raise FileNotFoundError(f"no WAV files below {root}")
    return found


def read_samples(row: dict, start_s: float, end_s: float) -> np.ndarray:
    """Mono samples of [start_s, end_s) at the recording's own rate."""
    first = max(0, round(start_s * row["sr"]))
    n = min(row["frames"], round(end_s * row["sr"])) - first
    if n <= 0:
        return np.zeros(0)
    with open_input(row["path"]) as f:
        f.seek(row["data_start"] + first * row["align"])
        return wav_samples(f.read(n * row["align"]), row)


def read_piece(row: dict, start_s: float, end_s: float) -> np.ndarray:
    """Read, resampled, less the recording's mean, high-passed, over the recording's peak."""
    y = highpass(resample(read_samples(row, start_s, end_s), row["sr"]) - row["mean"])
    return y / row["peak"] if row["peak"] > 0 else y


def read_clip(row: dict) -> np.ndarray:
    """Samples lo to hi - 1 of a chunk, counted from its read_start_s at SAMPLE_RATE, filtered with a margin inside the chunk."""
    a, b = row["read_start_s"] + row["lo"] / SAMPLE_RATE, row["read_start_s"] + row["hi"] / SAMPLE_RATE
    start = max(row["read_start_s"], a - FILTER_MARGIN_SECONDS)
    y = read_piece(row, start, min(row["read_end_s"], b + FILTER_MARGIN_SECONDS))
    at = round((a - start) * SAMPLE_RATE)
    return y[at : at + row["hi"] - row["lo"]]


def recording_stats(found: DataFrame, block_s: float = 30.0) -> DataFrame:
    """Recordings with mean, peak, block_peak_median and block_count; of those without an error.

    Two passes over blocks of block_s seconds: sums for the mean; then peaks of the filtered blocks
    with a margin, which is left out on both sides of every block (Q19). Blocks are rows, so a long
    recording is read by many tasks; what is shuffled is two numbers a block.
    """
    ok = found.filter("error is null")
    grid = ok.withColumn("_block", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration_s") / block_s).cast("int") - 1)))
    grid = grid.select("recording_key", *PLACE, "duration_s", (F.col("_block") * F.lit(block_s)).alias("start_s"), F.least((F.col("_block") + 1) * F.lit(block_s), "duration_s").alias("end_s"))

    def total(row: dict) -> list[dict]:
        y = resample(read_samples(row, row["start_s"], row["end_s"]), row["sr"])
        return [{"recording_key": row["recording_key"], "s": float(y.sum()), "n": len(y)}]

    def loudest(row: dict) -> list[dict]:
        m = FILTER_MARGIN_SECONDS
        y = read_piece({**row, "peak": 0}, max(0.0, row["start_s"] - m), min(row["duration_s"], row["end_s"] + m))
        k = round(m * SAMPLE_RATE)
        y = y[k : len(y) - k] if len(y) > 2 * k else y
        return [{"recording_key": row["recording_key"], "p": float(np.abs(y).max())}] if len(y) else []

    mean = map_rows(spread(grid, "recording_key", "start_s"), total, "recording_key string, s double, n bigint").groupBy("recording_key").agg((F.sum("s") / F.greatest(F.sum("n"), F.lit(1))).alias("mean"))
    peaks = map_rows(spread(grid.join(mean, "recording_key"), "recording_key", "start_s"), loudest, "recording_key string, p double")
    peaks = peaks.groupBy("recording_key").agg(F.max("p").alias("peak"), F.median("p").alias("block_peak_median"), F.count("*").alias("block_count"))
    x = ok.join(mean, "recording_key").join(peaks, "recording_key", "left")
    return x.withColumns({"peak": F.when(F.col("peak") > 0, F.col("peak")).otherwise(F.lit(1.0)), "block_peak_median": F.coalesce("block_peak_median", F.lit(0.0)), "block_count": F.coalesce("block_count", F.lit(0))})


def whole_recordings(found: DataFrame) -> DataFrame:
    """S3: recordings with samples: whole, at SAMPLE_RATE, without non-finite values and mean, filtered, over their peak.

    For templates: a task holds one file at a time, whatever its length. A file under 64 samples or
    without any signal gets its error set and no samples.
    """

    def load(row: dict) -> list[dict]:
        if row["error"]:
            return [row]
        y = resample(read_samples(row, 0, row["duration_s"]), row["sr"])
        y = y[np.isfinite(y)]
        y = highpass(y - y.mean()) if len(y) >= 64 else y[:0]
        top = float(np.abs(y).max()) if len(y) else 0.0
        return [{**row, "samples": y / top} if top > 0 else {**row, "error": "too short or silent"}]

    return map_rows(spread(found, "recording_key"), load, StructType(list(found.schema.fields)).add("samples", ArrayType(DoubleType())), 1)


def template_groups(found: DataFrame) -> DataFrame:
    """The templates with label (from the file's name) and ord: their place by (label, path), in which ties are broken.

    Places come from one global sort of a library kept by hand, one row per file.
    """
    from pyspark.sql import Window

    x = found.withColumn("label", class_from_stem(F.col("segment_id")))
    return x.withColumn("ord", F.row_number().over(Window.orderBy("label", "path")) - 1)
