"""Constants of the analysis, and the checked run configuration."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields

# Results depend on them.
SAMPLE_RATE = 250_000
BAND_HZ = (15_000.0, 120_000.0)
ENERGY_THRESHOLD_DB = -28.0
BACKGROUND_MARGIN_DB = 10.0
PULSE_MS = (0.8, 40.0)
MERGE_GAP_MS = 1.5
PADDING_MS = 0.4
CORE_THRESHOLD_DB, CORE_MARGIN_DB, CORE_MAX_THRESHOLD_DB = -24.0, 6.0, -10.0
CORE_CONTEXT_MS, CORE_PADDING_MS, CORE_GAP_MS = 2.0, 0.20, 0.35
CONTOUR_MIN_DB = -35.0
FEATURE_FLOORS = {
    "duration_ms": 2.0,
    "peak_freq_khz": 4.0,
    "start_freq_khz": 6.0,
    "end_freq_khz": 6.0,
    "frequency_drop_khz": 5.0,
    "f05_khz": 5.0,
    "f95_khz": 5.0,
    "bandwidth_90_khz": 5.0,
    "slope_khz_per_ms": 4.0,
    "track_coverage": 0.15,
    "max_track_jump_khz": 5.0,
}
FEATURE_WEIGHTS = {
    "duration_ms": 1.0,
    "peak_freq_khz": 1.5,
    "start_freq_khz": 1.25,
    "end_freq_khz": 1.25,
    "frequency_drop_khz": 1.25,
    "f05_khz": 1.0,
    "f95_khz": 1.0,
    "bandwidth_90_khz": 0.75,
    "slope_khz_per_ms": 1.25,
    "track_coverage": 0.5,
    "max_track_jump_khz": 0.5,
}
FEATURES = tuple(FEATURE_FLOORS)
TRACK_POINTS = 32
DTW_RADIUS, DTW_SCALE = 4, 6.0
CHUNK_SECONDS, OVERLAP_SECONDS = 10.0, 0.5
FILTER_MARGIN_SECONDS = 0.25
FASTSKIP_MARGIN_DB, FASTSKIP_PEAK, FASTSKIP_FACTOR = 6.0, 0.02, 2.5
MIN_CONFIDENCE, MIXED_PURITY = 0.60, 0.5
SCAN_THRESHOLD = 0.2
UNKNOWN, NOISE = "unknown", "noise"
SAME_OVERLAP, SAME_CENTRE_MS, REFINE_OVERLAP = 0.50, 1.5, 0.60
EXPORT_BUDGET = 5000
MAX_TIME_BINS = 4000


def minimum_overlap_seconds() -> float:
    """The least overlap of chunks that holds a longest pulse with its context on either side."""
    return (PULSE_MS[1] + PULSE_MS[0] + 2 * CORE_CONTEXT_MS + 2 * CORE_PADDING_MS + CORE_GAP_MS + MERGE_GAP_MS) / 1000 + FILTER_MARGIN_SECONDS


@dataclass(frozen=True)
class SegmentConfig:
    """Parameters of a segment analysis. Raises ValueError on a value out of range."""

    min_confidence: float = MIN_CONFIDENCE
    mixed_purity: float = MIXED_PURITY
    unknown_label: str = UNKNOWN
    window_mode: str = "fixed"
    harmonic_mode: str = "enhanced"
    spectrogram_mode: str = "merged"
    context_ms: float = 0.0
    chunk_seconds: float = CHUNK_SECONDS
    overlap_seconds: float = OVERLAP_SECONDS
    fast_skip: bool = True

    def __post_init__(self) -> None:
        for name, allowed in (("window_mode", ("fixed", "adaptive")), ("harmonic_mode", ("basic", "enhanced")), ("spectrogram_mode", ("merged", "separate"))):
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        for name in ("min_confidence", "mixed_purity"):
            if not 0.0 <= getattr(self, name) <= 1.0:
                raise ValueError(f"{name} must lie between 0 and 1")
        if not self.unknown_label.strip() or self.context_ms < 0:
            raise ValueError("unknown_label must not be blank, context_ms not negative")
        if self.overlap_seconds < minimum_overlap_seconds() or self.chunk_seconds <= self.overlap_seconds:
            raise ValueError(f"overlap_seconds must be at least {minimum_overlap_seconds():.5f} and less than chunk_seconds")


def save_config(config: SegmentConfig, path: str) -> None:
    """The configuration as a JSON file, put in place whole."""
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(asdict(config), f, indent=2, sort_keys=True)
    os.replace(part, path)


def load_config(path: str) -> SegmentConfig:
    """A saved configuration, checked; defaults for what the file lacks or if there is none. Names that are not known are ignored."""
    if not os.path.exists(path):
        return SegmentConfig()
    with open(path, encoding="utf-8-sig") as f:
        found = json.load(f)
    if not isinstance(found, dict):
        raise ValueError("the configuration must be a JSON object")
    return SegmentConfig(**{k: v for k, v in found.items() if k in {x.name for x in fields(SegmentConfig)}})
