"""A whole run: recordings below a folder analysed in steps that can be resumed, and the results written.

Below the run's folder, on a file system that the driver and all executors share:
run_state.json (T7), model.json (K4), run_metadata.json (K5), segment_summary.csv and
overall_summary.csv (K1), the tables predictions, chunks, recordings, stats, tails and exports with a
part for each step, the commit list of parts that count, and audio/ with the pulses of the export
budget (K6, K7).
"""

from __future__ import annotations

import dataclasses
import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import EXPORT_BUDGET, FEATURES, SegmentConfig
from ..functions.scalars import fingerprint, safe_component
from ..operators import frames, intervals
from ..operators.matching import template_totals
from ..operators.reports import run_totals
from ..sinks import tables
from ..sources.documents import resumable_runs
from ..sources.recordings import local, recording_stats, require_recordings
from ..storage import checkpoint
from .commits import commit, commits, committed, exists, identities, progress, require_unchanged
from .segments import Analysis, chunk_pulses, chunk_rows, label_names, label_pulses

VERSION = 3
STATS = ("recording_key", "mean", "peak", "block_peak_median", "block_count")
TAIL = ("recording_key", "chunk_index", "start_s", "end_s")


def run_digest(templates: DataFrame, config: SegmentConfig) -> str:
    """Digest of the configuration and of every template."""
    one = templates.select(fingerprint("label", "file", *FEATURES).alias("f")).agg(F.array_join(F.array_sort(F.collect_list("f")), "").alias("f")).first()[0]  # a library kept by hand
    return hashlib.sha256((json.dumps(dataclasses.asdict(config), sort_keys=True) + one).encode()).hexdigest()


def _state(spark: SparkSession, out: str, status: str, digest: str) -> None:
    seconds = commits(spark, out).agg(F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("processed_until_s"))
    tables.write_document(seconds.select(F.lit(VERSION).alias("version"), F.lit(status).alias("status"), F.lit(digest).alias("digest"), "processed_until_s"), f"{local(out)}/run_state.json")


def _left(found: DataFrame, done: DataFrame, config: SegmentConfig, step_chunks: int) -> DataFrame:
    """What is not committed yet: found with first and end (the next range of chunks), n_chunks, and ranges: how many are left. A recording without chunks has one empty range."""
    n = F.when(F.col("error").isNull() & (F.col("duration_s") > 0), F.ceil(F.col("duration_s") / config.chunk_seconds)).otherwise(F.lit(0)).cast("int")
    x = found.withColumn("n_chunks", n).join(done.select("recording_key", "done"), "recording_key", "left").filter("done is null or done < n_chunks")
    x = x.withColumn("first", F.coalesce("done", F.lit(0))).drop("done")
    return x.withColumns({"end": F.least("n_chunks", F.col("first") + step_chunks), "ranges": F.greatest(F.lit(1), F.ceil((F.col("n_chunks") - F.col("first")) / step_chunks).cast("int"))})


def _steps(left: DataFrame, step_files: int) -> list[int]:
    """Steps of each round of ranges, from the number of recordings by ranges left: one number for each."""
    by = {r[0]: r[1] for r in left.groupBy("ranges").count().collect()}
    return [-(-sum(n for k, n in by.items() if k > i) // step_files) for i in range(max(by, default=0))]


def _step(spark: SparkSession, out: str, part: DataFrame, done: DataFrame, templates: DataFrame, config: SegmentConfig, with_audio: bool) -> None:
    """Analyse the next range of chunks of some recordings, and commit it as one part."""
    name = str(uuid.uuid4())
    put = lambda rows, table: tables.write_table(rows, f"{out}/{table}/part={name}")
    new = part.filter("first = 0")
    put(new.drop("first", "end", "ranges", "n_chunks"), "recordings")
    put(recording_stats(new).select(*STATS), "stats")
    stats, earlier, tails = spark.read.parquet(f"{out}/stats/part={name}"), committed(spark, out, "stats"), committed(spark, out, "tails")
    stats = stats if earlier is None else stats.unionByName(earlier)
    ranges = part.select("recording_key", "first", "end")
    chunks = chunk_rows(part.filter("error is null").join(stats, "recording_key"), config).filter("chunk_index >= first and chunk_index < end")
    pulses, metrics = chunk_pulses(chunks, config, with_audio)
    put(metrics, "chunks")
    last = pulses.join(ranges.withColumn("chunk_index", F.col("end") - 1).drop("first", "end"), ["recording_key", "chunk_index"], "left_semi")
    put(frames.top_rows(last.select(*TAIL), ["recording_key", "chunk_index"], [F.desc("start_s"), F.desc("end_s")], 8), "tails")
    if tails is not None:
        tails = tails.select(*TAIL).join(ranges.withColumn("chunk_index", F.col("first") - 1).drop("first", "end"), ["recording_key", "chunk_index"], "left_semi")
    used = done.select("recording_key", F.col("n_pulses").alias("n"))
    labelled = label_pulses(intervals.drop_repeats_across_chunks(pulses, bucket_s=1.0, before=tails), templates, config, used)
    if with_audio:
        labelled = labelled.persist()
        file = F.concat(safe_component(F.col("segment_id")), F.lit("_"), F.col("pulse_key"), F.lit(".wav"))
        put(tables.write_pulse_audio(tables.within_budget(labelled, EXPORT_BUDGET, used=used), f"{out}/audio", file), "exports")
    put(labelled.drop("pcm"), "predictions")
    labelled.unpersist()
    counted = spark.read.parquet(f"{out}/predictions/part={name}").groupBy("recording_key").agg(F.count("*").alias("n_pulses"))
    seconds = F.greatest(F.lit(0.0), F.least(F.coalesce("duration_s", F.lit(0.0)), F.col("end") * config.chunk_seconds) - F.col("first") * config.chunk_seconds)
    rows = part.join(identities(part), "recording_key").join(counted, "recording_key", "left")
    commit(rows.select("recording_key", F.col("first").alias("first_chunk"), F.col("end").alias("end_chunk"), F.coalesce("n_pulses", F.lit(0)).alias("n_pulses"), seconds.alias("seconds"), "identity"), out, name)


def run(
    spark: SparkSession, root: str, templates: DataFrame, out: str, config: SegmentConfig = SegmentConfig(), step_files: int = 500, with_audio: bool = True,
    should_stop: Callable[[], bool] = lambda: False, on_step: Callable[[int, int], None] = lambda done, all: None, step_chunks: int = 360,
) -> str:
    """Analyse the recordings below root and write the results below out; the status: completed or cancelled.

    A step takes the next step_chunks chunks of some step_files recordings, dealt by hash; a long
    recording takes several, one after another, with its statistics and the last pulses of the chunk
    before read from what is committed. A step's tables count from its commit on (T7, T9, T13); what one
    that broke off has left is never read. Between steps should_stop is asked and on_step told (T10,
    T11, X1). Started again in the same folder, a run goes on in each recording after its last
    committed chunk; with another configuration or library, or if the size or the first or last block
    of a file with results has changed, it is a ValueError. Reports cover failed files too.
    """
    found = checkpoint(require_recordings(spark, root))
    digest = run_digest(templates, config)
    state = spark.read.schema("version int, status string, digest string, processed_until_s double").option("multiLine", True).json(f"{out}/run_state.json").collect() if exists(spark, f"{out}/run_state.json") else []
    if state and (state[0].version, state[0].digest) != (VERSION, digest):
        raise ValueError("the folder holds a run of another version, configuration or library")
    require_unchanged(found, progress(commits(spark, out)))
    tables.write_document(_model(templates).withColumn("digest", F.lit(digest)), f"{local(out)}/model.json")
    _state(spark, out, "running", digest)
    rounds = _steps(_left(found, progress(commits(spark, out)), config, step_chunks), step_files)
    at = 0
    for steps in rounds:
        done = checkpoint(progress(commits(spark, out)))
        left = checkpoint(_left(found, done, config, step_chunks))
        for step in range(steps):
            part = left.filter(F.pmod(F.xxhash64("recording_key"), F.lit(steps)) == step)
            if not part.isEmpty():
                _step(spark, out, part, done, templates, config, with_audio)
                _state(spark, out, "running", digest)
            at += 1
            on_step(at, sum(rounds))
            if at < sum(rounds) and should_stop():
                _state(spark, out, "cancelled", digest)
                return "cancelled"
    reports(spark, out, templates, config)
    _state(spark, out, "completed", digest)
    return "completed"


def _model(templates: DataFrame) -> DataFrame:
    """K4: totals of the library and its templates, as one row."""
    rows = templates.agg(F.array_sort(F.collect_list(F.struct("label", "file", *FEATURES))).alias("templates"))
    return template_totals(templates).crossJoin(rows)  # one row each


def whole(spark: SparkSession, out: str, templates: DataFrame, config: SegmentConfig) -> Analysis:
    """The analysis that the committed parts of a run's tables hold."""
    return Analysis(*(committed(spark, out, name) for name in ("recordings", "chunks", "predictions")), label_names(templates), config)


def reports(spark: SparkSession, out: str, templates: DataFrame, config: SegmentConfig) -> None:
    """K1, K3, K5: the reports of a run from its tables."""
    a = whole(spark, out, templates, config)
    summary = a.summary().persist()
    tables.write_report_csv(summary.orderBy("segment_path"), f"{local(out)}/segment_summary.csv")
    tables.write_report_csv(a.overall(), f"{local(out)}/overall_summary.csv")
    about = run_totals(summary).withColumns({"version": F.lit(VERSION), "labels": F.array(*(F.lit(x) for x in (*a.labels, config.unknown_label))), "config": F.lit(json.dumps(dataclasses.asdict(config), sort_keys=True))})
    tables.write_document(about, f"{local(out)}/run_metadata.json")
    summary.unpersist()


def unfinished(spark: SparkSession, root: str) -> DataFrame:
    """Runs below root that can be resumed."""
    return resumable_runs(spark, root, VERSION)
