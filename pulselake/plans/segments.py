"""Segment analysis: recordings to labelled pulses to reports.

Audio is read in rows whose tasks seek to what they need: blocks for statistics, chunks for frame
energies, candidates for their core, pulses for sources and features. Everything between is
DataFrame operators on narrow rows, keyed by recording and chunk, so a recording of any length is
spread over the cluster, and no task holds more than one chunk's samples. What a read gives is
checkpointed, since several operators use it and audio is the costly part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import CORE_CONTEXT_MS, CORE_GAP_MS, CORE_PADDING_MS, FEATURES, MERGE_GAP_MS, PADDING_MS, PULSE_MS, SAMPLE_RATE, SegmentConfig
from ..functions import descriptors, signal, tracks
from ..functions.scalars import event_id, relative_snr, separation_window, stft_size
from ..operators import frames, intervals, matching, reports, separation
from ..sources.recordings import PLACE, map_rows, read_clip, read_piece, recording_stats, recordings, require_recordings, spread, template_groups, whole_recordings
from ..storage import checkpoint

KEYS = ["recording_key", "chunk_index"]
DETECT_FFT, DETECT_HOP = 1024, 256
CHUNK = [*PLACE, "mean", "peak", "read_start_s", "read_end_s"]
SHAPE = ", ".join(f"{f} double" for f in (*FEATURES[1:], "rms"))
PULSE = (
    "component_start bigint, component_end bigint, component_id int, component_count int, separation_applied boolean, separation_confidence double, track_median_freq_khz double, "
    "track_relative_db double, harmonic_group_size int, harmonic_frequencies_khz array<double>, harmonic_evidence string, track array<double>, pcm binary, " + SHAPE
)


def chunk_rows(stats: DataFrame, config: SegmentConfig = SegmentConfig()) -> DataFrame:
    """A row for each chunk with the place of its samples and its recording's statistics. Filters on time prune chunks before anything is read."""
    return intervals.chunk_grid(stats, chunk_s=config.chunk_seconds, overlap_s=config.overlap_seconds)


def chunk_energies(chunks: DataFrame, fast_skip: bool = True) -> DataFrame:
    """KEYS, n_samples, skipped, and powers: the band's power in each frame; none of skipped chunks."""

    def energy(row: dict) -> list[dict]:
        y = read_piece(row, row["read_start_s"], row["read_end_s"])
        skip = not len(y) or fast_skip and not signal.worth_reading(signal.envelope(y), row["block_peak_median"])
        return [{**row, "n_samples": len(y), "skipped": bool(skip), "powers": None if skip else signal.band_power(y, DETECT_FFT, DETECT_HOP)}]

    x = spread(chunks.select(*KEYS, *CHUNK, "block_peak_median"), *KEYS)
    return checkpoint(map_rows(x, energy, "recording_key string, chunk_index int, n_samples bigint, skipped boolean, powers array<double>", 1))


def _series(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The powers of each row as frames with energy_db."""
    x = rows.filter("powers is not null").select("*", F.posexplode("powers").alias("frame", "power")).drop("powers")
    return frames.normalise_db(x, keys, "power")


def detect(energies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates, metrics): KEYS, start_s, end_s from the chunk's first sample; and a row per chunk with its threshold and number of candidates."""
    frame_ms = DETECT_HOP / SAMPLE_RATE * 1000
    x = frames.smooth(_series(energies, KEYS), KEYS, ["frame"], "energy_db", "x")
    lit = frames.active(x.select(*KEYS, "n_samples", "frame", "x"), KEYS, "x")
    runs = frames.islands(lit, KEYS, "frame", F.lit(max(1, round(MERGE_GAP_MS / frame_ms)) + 1))
    runs = runs.groupBy(*KEYS, "island", "n_samples", "threshold_db").agg(F.min("frame").alias("a"), F.max("frame").alias("z"))
    second = lambda c: F.col(c) * F.lit(DETECT_HOP) / F.lit(SAMPLE_RATE)
    start = F.greatest(F.lit(0.0), second("a") - PADDING_MS / 1000)
    end = F.least(F.col("n_samples") / F.lit(SAMPLE_RATE), second("z") + (frame_ms + PADDING_MS) / 1000)
    c = runs.select(*KEYS, "n_samples", "threshold_db", start.alias("start_s"), end.alias("end_s")).filter(((F.col("end_s") - F.col("start_s")) * 1000).between(*PULSE_MS))
    c = checkpoint(c)
    found = c.groupBy(*KEYS).agg(F.count("*").alias("raw_candidate_count"), F.first("threshold_db").alias("threshold_db"))
    metrics = energies.select(*KEYS, "skipped").join(found, KEYS, "left").withColumn("raw_candidate_count", F.coalesce("raw_candidate_count", F.lit(0)))
    return c.drop("threshold_db"), metrics


def _at(seconds: Column) -> Column:
    return F.bround(seconds * SAMPLE_RATE).cast("long")


def refine(candidates: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cores of candidates: KEYS, start_s, end_s, snr_db, candidate_start_s, candidate_end_s, core_threshold_db, n_samples."""
    context = round(CORE_CONTEXT_MS / 1000 * SAMPLE_RATE)
    c = candidates.withColumns({"lo": F.greatest(F.lit(0), _at(F.col("start_s")) - context), "hi": F.least("n_samples", _at(F.col("end_s")) + context)}).filter("hi - lo >= 64")
    c = c.withColumn("size", stft_size(F.col("hi") - F.col("lo"), 256, 64, 4)).select("*", F.col("size.n_fft").alias("n_fft"), F.col("size.hop").alias("hop")).drop("size")

    def energy(row: dict) -> list[dict]:
        power = signal.band_power(read_clip(row), row["n_fft"], row["hop"])
        return [{**row, "powers": power if len(power) and max(power) > 0 else None}]

    place = "recording_key string, chunk_index int, start_s double, end_s double, n_samples bigint, lo bigint, hi bigint, n_fft int, hop int"
    x = c.join(chunks.select(*KEYS, *CHUNK), KEYS)
    e = checkpoint(map_rows(spread(x, *KEYS, "start_s"), energy, place + ", powers array<double>"))
    keys = [*KEYS, "lo", "hi"]
    e = _series(e.withColumns({"candidate_start_s": F.col("start_s"), "candidate_end_s": F.col("end_s")}).drop("start_s", "end_s"), keys)
    gap = F.greatest(F.lit(1), F.bround(F.lit(CORE_GAP_MS) / (F.col("hop") / F.lit(SAMPLE_RATE) * 1000)).cast("int")) + 1
    lit = frames.active(e, keys, "energy_db", frames.refine_threshold)
    runs = frames.islands(lit, keys, "frame", gap).groupBy(*keys, "island").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.first("threshold_db").alias("core_threshold_db"))
    loudest = e.groupBy(*keys).agg(F.min_by("frame", F.struct(-F.col("power"), "frame")).alias("peak_frame"))
    core = intervals.nearest_interval(loudest, runs.select(*keys, "first_frame", "last_frame"), keys, "peak_frame", "first_frame", "last_frame", single=True).select(*keys, "first_frame", "last_frame")
    core = core.join(runs.select(*keys, "first_frame", "core_threshold_db"), [*keys, "first_frame"])
    inside = F.col("frame").between(F.col("first_frame"), F.col("last_frame"))
    fixed = ["n_samples", "n_fft", "hop", "candidate_start_s", "candidate_end_s", "first_frame", "last_frame", "core_threshold_db"]
    p = frames.island_snr(e.join(core, keys), [*keys, *fixed], "energy_db", inside)
    half, pad = F.col("n_fft") / 2, round(CORE_PADDING_MS / 1000 * SAMPLE_RATE)
    start = F.greatest(F.lit(0), F.col("lo") + F.greatest(F.lit(0), F.col("first_frame") * F.col("hop") - half) - pad)
    end = F.least("n_samples", F.col("lo") + F.least(F.col("hi") - F.col("lo"), F.col("last_frame") * F.col("hop") + half) + pad)
    p = p.withColumns({"start_s": start / SAMPLE_RATE, "end_s": end / SAMPLE_RATE}).filter(((F.col("end_s") - F.col("start_s")) * 1000).between(*PULSE_MS))
    return intervals.greedy_dedup(p, KEYS, extra=("candidate_start_s", "candidate_end_s", "core_threshold_db", "n_samples"))


def components(pulses: DataFrame, chunks: DataFrame, config: SegmentConfig = SegmentConfig(), with_audio: bool = False) -> DataFrame:
    """A row for each source of each pulse, with PULSE; times are those of the recording.

    First pass: tracks of each pulse. Pulses with several tracks go through the joins of
    operators.separation; the others, most of them, pass by. Second pass: the pulse is read again
    with the tracks of its sources, split by soft masks if there are several, and described. Only
    with with_audio do the samples, as a PCM-16 WAV, leave the task.
    """
    p = pulses.withColumns({"lo": _at(F.col("start_s")), "hi": F.least("n_samples", _at(F.col("end_s")))})
    p = p.withColumn("window", separation_window(F.col("hi") - F.col("lo"), config.window_mode))
    p = p.join(chunks.select(*KEYS, *CHUNK, "coverage_start_s", "coverage_end_s", "segment_id"), KEYS)
    shift = F.col("read_start_s")
    p = p.filter(intervals.owned(F.col("start_s") + shift, F.col("end_s") + shift, F.col("coverage_start_s"), F.col("coverage_end_s")))
    p = checkpoint(p.withColumn("candidate_id", F.row_number().over(Window.partitionBy(*KEYS).orderBy("start_s", "end_s"))))
    keys = [*KEYS, "candidate_id"]

    def find(row: dict) -> list[dict]:
        y = read_clip(row)
        found = tracks.link_peaks(tracks.spectral_peaks(y, row["window"])) if len(y) >= 64 else []
        return [{**row, "track": i, **t} for i, t in enumerate(found)]

    t = map_rows(spread(p.select(*keys, *CHUNK, "lo", "hi", "window"), *keys), find, "recording_key string, chunk_index int, candidate_id int, track int, frames array<int>, hz array<double>, power array<double>")
    t = checkpoint(t)
    chosen = checkpoint(separation.sources(t, keys, config.harmonic_mode))
    member = chosen.select(*keys, "component_id", F.explode("members").alias("track")).join(t, [*keys, "track"])
    member = member.groupBy(*keys, "component_id").agg(F.sort_array(F.collect_list(F.struct("track", "frames", "hz", "power"))).alias("tracks"))
    s = chosen.join(member, [*keys, "component_id"], "left").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("component_id", "component_count", "track_median_freq_khz", "track_relative_db", "separation_confidence", "evidence", "tracks"))).alias("sources"))
    s = p.join(s, keys, "left")
    least, pad = max(32, round(PULSE_MS[0] / 1000 * SAMPLE_RATE)), round(CORE_PADDING_MS / 1000 * SAMPLE_RATE)

    def describe(row: dict) -> list[dict]:
        y = read_clip(row)
        parts = row["sources"] or [{"component_id": 1, "component_count": 1, "track_median_freq_khz": float("nan"), "track_relative_db": 0.0, "separation_confidence": 1.0, "evidence": "[]", "tracks": None}]
        cuts = [(0, len(y), y)]
        if len(parts) > 1:
            window = row["window"]
            z = signal.stft(y, tracks.N_FFT, tracks.HOP, window)
            cuts = []
            for part, mask in zip(parts, tracks.source_masks(z.shape, [c["tracks"] for c in parts])):
                at = [f for m in part["tracks"] for f in m["frames"]]
                a, b = max(0, min(at) * tracks.HOP - window // 2 - pad), min(len(y), max(at) * tracks.HOP + window // 2 + pad)
                if b - a < least:
                    a = max(0, a - (least - b + a) // 2)
                    b = min(len(y), a + least)
                    a = max(0, b - least)
                cuts.append((a, b, signal.istft(z * mask, tracks.N_FFT, tracks.HOP, window, len(y))[a:b]))
        out = []
        for part, (a, b, x) in zip(parts, cuts):
            features = descriptors.pulse_features(x)
            if features is None:
                continue
            members = part["tracks"] or []
            track = descriptors.frequency_track(x)
            out.append({
                **row, **part, **features, "component_start": row["lo"] + a, "component_end": row["lo"] + b, "separation_applied": len(parts) > 1, "harmonic_group_size": max(1, len(members)),
                "harmonic_frequencies_khz": [float(np.median(m["hz"])) / 1000 for m in members], "harmonic_evidence": part["evidence"], "track": None if track is None else track.tolist(), "pcm": signal.wav_bytes(x) if with_audio else None,
            })
        return out

    place = "recording_key string, chunk_index int, candidate_id int, segment_id string, path string, read_start_s double, candidate_start_s double, candidate_end_s double, snr_db double, core_threshold_db double"
    x = checkpoint(map_rows(spread(s, *keys), describe, f"{place}, {PULSE}"))
    x = x.withColumns({
        "candidate_start_s": F.col("candidate_start_s") + shift, "candidate_end_s": F.col("candidate_end_s") + shift, "start_s": F.col("component_start") / SAMPLE_RATE + shift, "end_s": F.col("component_end") / SAMPLE_RATE + shift,
        "duration_ms": (F.col("component_end") - F.col("component_start")) / SAMPLE_RATE * 1000, "snr_db": relative_snr(F.col("snr_db"), F.col("track_relative_db")), "event_id": event_id(F.col("recording_key"), F.col("chunk_index"), F.col("candidate_id")),
    })
    return x.drop("component_start", "component_end", "read_start_s")


def template_table(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(templates, errors) of the WAV files below root.

    A template's best pulse is searched as in a recording, between 50 ms of silence; if none is
    found, the whole file is the pulse. Labels that the engine keeps for itself, and files without a
    clear track, are errors; ValueError if a class is left with no template or there is none at all.
    """
    found = whole_recordings(template_groups(recordings(spark, root)))

    def describe(row: dict) -> list[dict]:
        if row["error"]:
            return [row]
        if row["label"] in ("unknown", "noise"):
            return [{**row, "error": "reserved label"}]
        d = descriptors.template_descriptor(best_pulse(np.asarray(row["samples"])))
        return [{**row, **d} if d and all(np.isfinite(d[f]) for f in FEATURES) else {**row, "error": "no clear track in the band"}]

    x = map_rows(found, describe, "path string, label string, ord int, error string, track array<double>, " + ", ".join(f"{f} double" for f in FEATURES), 1).persist()
    good = x.filter("error is null").drop("error").withColumn("file", F.col("path"))
    lost = x.groupBy("label").agg(F.count_if(F.col("error").isNull()).alias("n")).filter("n = 0")
    if good.isEmpty() or not lost.isEmpty():
        raise ValueError("no usable template" if good.isEmpty() else f"no usable template of {[r[0] for r in lost.limit(5).collect()]}")
    return good, x.filter("error is not null").select("path", "label", "error")


def best_pulse(y: np.ndarray) -> np.ndarray:
    """The part of a template from its first to its last frame near the loudest, or all of it.

    Between silence, a pulse's frames stand out by their level alone.
    """
    edge = round(0.05 * SAMPLE_RATE)
    padded = np.pad(y, edge)
    power = np.array(signal.band_power(padded, 256, 16))
    if not power.max() > 0:
        return y
    db = 10 * np.log10(np.maximum(power / power.max(), 1e-8))
    level = min(-10.0, max(-24.0, float(np.percentile(db, 20)) + 6))
    lit = np.flatnonzero(db >= level)
    cuts = np.flatnonzero(np.diff(lit) > max(1, round(CORE_GAP_MS / (16 / SAMPLE_RATE * 1000))) + 1)
    runs = list(zip(lit[np.concatenate(([0], cuts + 1))], lit[np.concatenate((cuts, [len(lit) - 1]))]))
    a, b = next(r for r in runs if r[0] <= power.argmax() <= r[1])
    pad = round(CORE_PADDING_MS / 1000 * SAMPLE_RATE)
    start, end = max(0, a * 16 - 128 - pad), min(len(padded), b * 16 + 128 + pad)
    return padded[start:end] if end - start >= 32 else y


@dataclass(frozen=True)
class Analysis:
    """Results of one run; pulses feeds every report and the low-similarity scan."""

    recordings: DataFrame
    metrics: DataFrame
    pulses: DataFrame
    labels: list[str]
    config: SegmentConfig

    def summary(self) -> DataFrame:
        """One row per recording, failed ones too, with a column for each label."""
        unknown = self.config.unknown_label
        counts = reports.accumulate(self.pulses, "recording_key", "predicted_label", self.labels, "confidence", unknown)
        chunks = self.metrics.groupBy("recording_key").agg(F.sum("raw_candidate_count").alias("raw_candidate_count"), F.count_if(~F.col("skipped")).alias("processed_chunk_count"), F.count_if("skipped").alias("fast_skipped_chunk_count"))
        major = reports.majority(reports.label_counts(self.pulses, "recording_key", "predicted_label", self.labels, unknown), "recording_key", unknown, self.config.mixed_purity).drop("classified")
        x = self.recordings.select("recording_key", "segment_id", F.col("path").alias("segment_path"), F.coalesce("duration_s", F.lit(0.0)).alias("duration_s"), "error")
        x = x.join(chunks, "recording_key", "left").join(counts, "recording_key", "left").join(major, "recording_key", "left")
        numbers = ["raw_candidate_count", "processed_chunk_count", "fast_skipped_chunk_count", "total_calls", "uncertain_count", "classified_call_count", *(f"n_{x}" for x in (*self.labels, unknown))]
        x = x.na.fill(0, numbers).na.fill({"purity": 0.0, "major_label": "", "consistency_note": ""})
        failed = F.col("error").isNotNull()
        return x.withColumns({
            "calls_per_second": reports.call_rate(F.col("total_calls"), F.col("duration_s")), "candidate_call_count": F.col("total_calls"), "valid_call_count": F.col("total_calls"), "noise_count": F.lit(0).cast("long"),
            "valid_monitoring_duration_s": F.when(failed, 0.0).otherwise(F.col("duration_s")), "failed_duration_s": F.when(failed, F.col("duration_s")).otherwise(0.0),
            "processing_status": F.when(failed, "failed").otherwise("success"), "error_message": F.coalesce("error", F.lit("")),
        }).drop("error").withColumnsRenamed({f"n_{x}": x for x in (*self.labels, unknown)})

    def overall(self) -> DataFrame:
        """A14."""
        counts = reports.label_counts(self.pulses, "recording_key", "predicted_label", self.labels, self.config.unknown_label)
        return reports.overall_by_label(counts).withColumnRenamed("label", "species")

    def totals(self) -> DataFrame:
        """A15, A31."""
        return reports.run_totals(self.summary())


def chunk_pulses(chunks: DataFrame, config: SegmentConfig = SegmentConfig(), with_audio: bool = False) -> tuple[DataFrame, DataFrame]:
    """(pulses, metrics) of chunks: detection, refinement, ownership, separation and features. Repeats across chunks are still there."""
    chunks = checkpoint(chunks)
    candidates, metrics = detect(chunk_energies(chunks, config.fast_skip))
    return components(refine(candidates, chunks), chunks, config, with_audio), metrics


def label_pulses(pulses: DataFrame, templates: DataFrame, config: SegmentConfig = SegmentConfig(), used: DataFrame | None = None) -> DataFrame:
    """Numbered pulses with their best template; used (recording_key, n) says how many pulses a recording has already."""
    pulses = reports.number_pulses(pulses, "recording_key", ["start_s", "chunk_index", "candidate_id", "component_id"], used)
    pulses = pulses.withColumn("pulse_key", F.concat_ws("_", "recording_key", "pulse_id"))
    return matching.best_matches(pulses, templates, track="track", min_score=config.min_confidence, unknown=config.unknown_label)


def label_names(templates: DataFrame) -> list[str]:
    """The classes of a library kept by hand, one name each to the driver."""
    return sorted(r[0] for r in templates.select("label").distinct().collect())


def analyze(spark: SparkSession, root: str, templates: DataFrame, config: SegmentConfig = SegmentConfig(), with_audio: bool = False) -> Analysis:
    """The whole analysis of the recordings below root, or of the one file root is; FileNotFoundError if there are none."""
    return analyze_found(require_recordings(spark, root), templates, config, with_audio)


def analyze_found(found: DataFrame, templates: DataFrame, config: SegmentConfig = SegmentConfig(), with_audio: bool = False) -> Analysis:
    """The analysis of some rows of recordings()."""
    pulses, metrics = chunk_pulses(chunk_rows(recording_stats(found), config), config, with_audio)
    pulses = intervals.drop_repeats_across_chunks(pulses, bucket_s=1.0)
    return Analysis(found, metrics, label_pulses(pulses, templates, config), label_names(templates), config)
