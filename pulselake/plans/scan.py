"""Low-similarity scan: the pulses of an analysis that no template resembles, numbered and exported for review."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import SCAN_THRESHOLD, SegmentConfig
from ..operators import matching, reports
from .segments import Analysis, analyze

#: The columns of the scan's table, in order (fixed values).
COLUMNS = (
    "pulse_key", "segment_id", "segment_file", "source_path", "pulse_id", "event_id", "start_s", "end_s", "duration_ms", "confidence", "confidence_kind", "template_match_score", "template_label", "template_file",
    "predicted_label", "template_filename", "snr_db", "peak_freq_khz", "start_freq_khz", "end_freq_khz", "component_id", "component_count", "separation_applied", "harmonic_group_size", "harmonic_frequencies_khz",
    "pulse_file", "pulse_spectrogram_file", "pulse_spectrogram_status", "audio_export_error",
)


def check_threshold(value: float) -> float:
    """ValueError unless 0 <= value <= 1."""
    value = float(value)
    if not 0 <= value <= 1:  # nan too
        raise ValueError("the threshold must lie between 0 and 1")
    return value


def select_low(analysis: Analysis, threshold: float = SCAN_THRESHOLD) -> DataFrame:
    """Pulses below the threshold with COLUMNS (empty if the analysis has none) and pcm if it kept that, numbered by recording, chunk and time."""
    x = matching.low_similarity(analysis.pulses, ["path", "chunk_index", "start_s", "component_id"], check_threshold(threshold))
    x = x.withColumns({
        "segment_id": F.concat_ws("__", "segment_id", "recording_key"), "segment_file": F.element_at(F.split("path", "/"), -1), "source_path": F.col("path"), "confidence_kind": F.lit("template_similarity"),
        "template_match_score": F.col("confidence"), "template_filename": F.col("pulse_file"), "harmonic_frequencies_khz": F.to_json("harmonic_frequencies_khz"),
        "pulse_file": F.concat(F.lit("templates/"), "pulse_file"), "pulse_spectrogram_file": F.lit(""), "pulse_spectrogram_status": F.lit("not_rendered"), "audio_export_error": F.lit(""),
    })
    return x.select(*(F.col(c) if c in x.columns else F.lit("").alias(c) for c in COLUMNS), *(["pcm"] if "pcm" in x.columns else []))


def scan(spark: SparkSession, root: str, templates: DataFrame, threshold: float = SCAN_THRESHOLD, config: SegmentConfig | None = None, with_audio: bool = True) -> tuple[DataFrame, DataFrame]:
    """(low pulses, totals) of the recordings below root. The same analysis with adaptive windows and enhanced harmonics, and a filter."""
    check_threshold(threshold)
    a = analyze(spark, root, templates, config or SegmentConfig(window_mode="adaptive", harmonic_mode="enhanced"), with_audio)
    low = select_low(a, threshold)
    totals = reports.run_totals(a.summary()).withColumn("threshold", F.lit(threshold)).crossJoin(low.agg(F.count("*").alias("selected_pulse_count")))  # one row each
    return low, totals
