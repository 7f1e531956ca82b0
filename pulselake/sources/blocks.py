"""A data source for recordings: blocks of samples as rows, with filters on path and time that decide what is read.

    blocks.register(spark)
    spark.read.format("recordings").option("path", root).load().filter("start_s >= 30 and end_s <= 90")
"""

from __future__ import annotations

import math
import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from ..functions.signal import wav_header, wav_samples
from .recordings import HEAD, list_recordings, open_input

BLOCKS = "path string, block int, start_s double, end_s double, sr int, samples array<float>, error string"
COMPARE = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le}


def register(spark: SparkSession) -> None:
    """Make format("recordings") known to a session, with push-down of filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RecordingBlocks)


@dataclass
class Slice(InputPartition):
    """Bytes first to last - 1 of a file of size bytes."""

    path: str
    size: int
    first: int
    last: int


class RecordingBlocks(DataSource):
    """A row for each block of blockSeconds (30) of each WAV file below path, read by tasks of some sliceBytes (64 MiB) each.

    The path may be of any store that Arrow's file systems or the executors' mounts reach. A file that is
    no readable WAV is one row with its error. Mono samples at the file's own rate.
    """

    @classmethod
    def name(cls) -> str:
        return "recordings"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> "BlockReader":
        return BlockReader(dict(self.options))


class BlockReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        get = {k.lower(): v for k, v in options.items()}.get
        if not get("path"):
            raise ValueError("option path is missing")
        self.root, self.block_s, self.slice_bytes = get("path"), float(get("blockseconds", 30)), int(get("slicebytes", 1 << 26))
        if not self.block_s > 0 or self.slice_bytes < 1:
            raise ValueError("blockSeconds and sliceBytes must be positive")
        self.paths: set[str] | None = None
        self.times: list[tuple[str, type, float]] = []
        self.only_blocks = False

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes equality on path, comparisons of start_s and end_s with numbers, and that they aren't null; gives back all others."""
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("path",) and isinstance(f, (EqualTo, In)):
                asked = set(f.value if isinstance(f, In) else [f.value])
                self.paths = asked if self.paths is None else self.paths & asked
            elif column in (("start_s",), ("end_s",)) and type(f) in COMPARE and isinstance(f.value, (int, float)):
                self.times.append((column[0], type(f), float(f.value)))
                self.only_blocks = True
            elif column in (("path",), ("start_s",), ("end_s",)) and isinstance(f, IsNotNull):
                self.only_blocks |= column != ("path",)  # a file with an error has no times
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        """Slices of the files that the filters leave; the listing of names and sizes is all that the driver reads."""
        out = []
        for path, size in list_recordings(self.root):
            if self.paths is None or path in self.paths:
                out += [Slice(path, size, a, min(size, a + self.slice_bytes)) for a in range(0, max(size, 1), self.slice_bytes)]
        return out or [Slice("", 0, 0, 0)]

    def read(self, part: Slice) -> Iterator[pa.RecordBatch]:
        """The blocks whose first byte lies in the slice and which the filters leave; others' bytes are passed over."""
        if not part.path:
            return
        try:
            with open_input(part.path) as f:
                h = wav_header(f.read(HEAD), part.size)
                duration = h["frames"] / h["sr"]
                for k in range(math.ceil(duration / self.block_s)):
                    a, b = k * self.block_s, min(duration, (k + 1) * self.block_s)
                    first, last = (min(h["frames"], round(s * h["sr"])) for s in (a, b))
                    at = h["start"] + first * h["align"]
                    here = part.first <= at < part.last
                    if here and last > first and all(COMPARE[op]({"start_s": a, "end_s": b}[c], v) for c, op, v in self.times):
                        f.seek(at)
                        y = wav_samples(f.read((last - first) * h["align"]), h)
                        yield _row(part.path, k, a, b, h["sr"], y, None)
        except (ValueError, OSError) as e:
            if part.first == 0 and not self.only_blocks:
                yield _row(part.path, None, None, None, None, None, f"{type(e).__name__}: {e}")


def _row(path, block, start, end, sr, samples, error) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int32(), pa.list_(pa.float32()), pa.string())
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip((path, block, start, end, sr, samples, error), kinds)], names=names)
