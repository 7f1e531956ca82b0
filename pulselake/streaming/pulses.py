"""Pulses as streams: windows, sessions, repeats across chunks, running totals, guarded restarts and idempotent output."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.types import StructType

from ..config import SAME_CENTRE_MS, SAME_OVERLAP, UNKNOWN
from ..operators.reports import fold_label
from ..sources.recordings import local
from ..storage import shared_folder

TAIL = "chunk int, starts array<double>, ends array<double>"
#: Maps of state that recordings are dealt to.
BUCKETS = 1 << 12


def new_recordings(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """S1 as a stream: (path, length) of WAV files as they arrive below root. Contents are not read.

    A file must be whole when it appears (move it in); one that is empty then gives no row.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "*.[wW][aA][vV]").option("maxFilesPerTrigger", files_per_trigger)
    return files.load(root).select("path", "length")


def with_event_time(pulses: DataFrame, seconds: str = "start_s", late: str = "10 minutes") -> DataFrame:
    """Pulses with event_time, a TIMESTAMP, and a watermark that bounds the state."""
    kind = dict(pulses.dtypes)[seconds]
    at = F.col(seconds).cast("timestamp") if kind.startswith("timestamp") else F.timestamp_seconds(seconds)
    return pulses.withColumn("event_time", at).withWatermark("event_time", late)


def windowed_counts(pulses: DataFrame, keys: list[str], length: str = "10 seconds", slide: str | None = None) -> DataFrame:
    """Calls by tumbling windows, or sliding ones with slide."""
    w = F.window("event_time", length, slide) if slide else F.window("event_time", length)
    return pulses.groupBy(*keys, w.alias("w")).agg(F.count("*").alias("n")).select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n")


def sessions(pulses: DataFrame, keys: list[str], gap: str) -> DataFrame:
    """Runs of calls whose neighbours lie at most gap apart: the streaming twin of frames.islands."""
    x = pulses.groupBy(*keys, F.session_window("event_time", gap).alias("w")).agg(F.count("*").alias("n"), F.min("event_time").alias("first_time"), F.max("event_time").alias("last_time"))
    return x.drop("w")


def running_totals(pulses: DataFrame, key: str, label: str, labels: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """One row per recording that is updated with every batch; use output mode "update" or "complete"."""
    folded = fold_label(F.col(label), labels, unknown)
    return pulses.groupBy(key).agg(F.count("*").alias("total_calls"), *(F.count_if(folded == x).alias(x) for x in (*labels, unknown)))


def unrepeated(pulses: DataFrame, key: str = "recording_key", tail: int = 8) -> DataFrame:
    """Pulses without those that the last kept pulses of the chunk before already show.

    State is the tail of one chunk per recording, at most ``tail`` intervals. Chunks of a recording
    come in order, as the analysis writes them; the first chunk wins. A chunk without pulses leaves
    the tail of an older chunk, which then no longer counts. Pulses have chunk_index, start_s, end_s.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    names = pulses.columns

    def run(_, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["chunk_index", "start_s", "end_s"], kind="stable")
        chunk, starts, ends = state.get if state.exists else (-1, [], [])
        for index, part in rows.groupby("chunk_index", sort=True):
            if index == chunk:  # the rest of a chunk that a batch cut
                before, mine = [], list(zip(starts, ends))
            else:
                before, mine = list(zip(starts, ends)) if index == chunk + 1 else [], []
            keep = [not any(same(a, b, s, e) for a, b in before) for s, e in zip(part.start_s, part.end_s)]
            part = part[keep]
            mine = (mine + list(zip(part.start_s.astype(float), part.end_s.astype(float))))[-tail:]
            chunk, starts, ends = int(index), [s for s, _ in mine], [e for _, e in mine]
            if len(part):
                yield part[names]
        state.update((chunk, starts, ends))

    return pulses.groupBy(key).applyInPandasWithState(run, pulses.schema, TAIL, "append", GroupStateTimeout.NoTimeout)


def unrepeated_for(pulses: DataFrame, key: str = "recording_key", tail: int = 8, keep_ms: int | None = 86_400_000) -> DataFrame:
    """T5: as unrepeated, with state that ends: a recording's tail is forgotten keep_ms milliseconds after its last pulse (None: never).

    State is a map from recordings to at most tail intervals each, whose entries have a time to live, in a
    store that keeps it on disk (STATE_STORE set to ROCKSDB), so recordings that are done cost nothing.
    Recordings are dealt to BUCKETS maps, as a call of Python for each recording costs more than its
    pulses do; a call holds a bucket's rows of one batch. With a time to live, use a trigger by processing
    time: Spark looks for what has ended for ever, so a stream that is to end with its source
    (availableNow) needs None.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    names = pulses.columns
    of = StructType([pulses.schema[key]])

    class Repeats(StatefulProcessor):
        def init(self, handle) -> None:
            self.held = handle.getMapState("tail", of, TAIL, ttlDurationMs=keep_ms)

        def handleInputRows(self, _, rows, timer_values):
            x = pd.concat(list(rows), ignore_index=True)
            x = x.iloc[np.lexsort((x["end_s"], x["start_s"], x["chunk_index"]))]
            recording = x.groupby(key, sort=False, dropna=False).ngroup().to_numpy()
            order = np.argsort(recording, kind="stable")
            x, recording = x.iloc[order], recording[order]
            known = self.held.exists()
            starts, ends, chunks = x["start_s"].astype(float).tolist(), x["end_s"].astype(float).tolist(), x["chunk_index"].tolist()
            at = [*np.flatnonzero(np.diff(recording, prepend=-1)).tolist(), len(x)]
            keys = [None if pd.isna(k) else k for k in x[key].iloc[at[:-1]].tolist()]
            keep = np.ones(len(x), bool)
            for k, first, last in zip(keys, at, at[1:]):
                held = self.held.getValue((k,)) if known and self.held.containsKey((k,)) else None
                chunk, before, mine = (held[0], [], list(zip(held[1], held[2]))) if held else (-1, [], [])
                for i in range(first, last):
                    if chunks[i] != chunk:  # else the rest of a chunk, also of one that a batch cut
                        before, mine, chunk = mine[-tail:] if chunks[i] == chunk + 1 else [], [], chunks[i]
                    if any(same(a, b, starts[i], ends[i]) for a, b in before):
                        keep[i] = False
                    else:
                        mine.append((starts[i], ends[i]))
                mine = mine[-tail:]
                if mine:
                    self.held.updateValue((k,), (chunk, [s for s, _ in mine], [e for _, e in mine]))
                elif held:
                    self.held.removeKey((k,))
            if keep.any():
                yield x.loc[keep, names]

        def close(self) -> None:
            pass

    dealt = pulses.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(Repeats(), pulses.schema, "append", "ProcessingTime" if keep_ms is not None else "None")


#: The state store that operators with lists, times to live and timers need.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def same(a: float, b: float, s: float, e: float) -> bool:
    """Q7 for two intervals."""
    shorter = min(b - a, e - s)
    return shorter > 0 and max(0.0, min(b, e) - max(a, s)) / shorter >= SAME_OVERLAP or abs((a + b) / 2 - (s + e) / 2) <= SAME_CENTRE_MS / 1000


def guard_checkpoint(folder: str, config: dict) -> None:
    """A restart must have the configuration that the checkpoint began with; ValueError if not."""
    digest = hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()
    path = Path(local(folder)) / "config.sha256"
    if path.exists():
        if path.read_text() != digest:
            raise ValueError("the checkpoint belongs to another configuration")
        return
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(digest)


def write_batches(stream: DataFrame, table: str, checkpoint: str, config: dict | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, once: bool = True, mode: str = "append") -> StreamingQuery:
    """Each batch is one folder of the table, batch=<id>, written whole: a batch that is run again replaces its folder."""
    guard_checkpoint(checkpoint, config or {})

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        if on_batch:
            on_batch(batch, number)
        batch.unpersist()

    out = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode(mode)
    return (out.trigger(availableNow=True) if once else out).start()


def ran_to_end(stream: DataFrame, root: str, mode: str = "complete") -> None:
    """The stream over all that its source has now: its result in root/rows, in "complete" mode that of the last batch, and its checkpoint with its state in root/state."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/rows" if mode == "complete" else f"{root}/rows/batch={number}")

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", f"{root}/state").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()


def new_root(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4()}"


def completed(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """The result of ran_to_end as a table in the shared folder."""
    root = new_root(stream.sparkSession)
    ran_to_end(stream, root, mode)
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{root}/rows")


def totals_state(spark: SparkSession, checkpoint: str, key: str, labels: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """The state of running_totals in a checkpoint, as a table of the same columns, read by tasks from the state store.

    This is the serialised state: totals can be looked at, moved, or added to the counts of further
    pulses by add_totals without the stream.
    """
    kept = spark.read.format("statestore").load(checkpoint)
    names = ["total_calls", *labels, unknown]
    # The state has one count for each column, in their order and all by one name.
    value = F.col("value").cast("struct<" + ", ".join(f"c{i}: bigint" for i in range(len(names))) + ">")
    return kept.select(F.col(f"key.{key}").alias(key), *(value[f"c{i}"].alias(n) for i, n in enumerate(names)))


def add_totals(state: DataFrame, pulses: DataFrame, key: str, label: str, labels: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """Totals that go on from a saved state with further pulses."""
    more = running_totals(pulses, key, label, labels, unknown)
    return state.unionByName(more).groupBy(key).agg(*(F.sum(c).alias(c) for c in ("total_calls", *labels, unknown)))


class Progress(StreamingQueryListener):
    """Rows and speed of each batch, the newest last; batches are kept up to ``keep``."""

    def __init__(self, keep: int = 1000) -> None:
        self.batches: list[dict] = []
        self.keep = keep

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches = [*self.batches, {"batch": p.batchId, "rows": p.numInputRows, "rows_per_second": p.processedRowsPerSecond}][-self.keep :]

    def onQueryTerminated(self, event) -> None:
        pass
