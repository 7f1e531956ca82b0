"""Column functions: names, ids, decibels, intervals and scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FEATURE_WEIGHTS

#: Class names that a file's name alone gives (fixed values).
NOISE_PULSE, SUSPICIOUS = "noise pulse", "可疑声波"


def class_from_stem(stem: Column) -> Column:
    """class of a template from its file's stem: the stem without the number of the sample."""
    numbered = F.regexp_extract(stem, r"^(.+\d(?:\.\d+)?[kK])[_-]?(\d+)$", 1)
    return (
        F.when(stem.rlike(r"(?i)^npulse\d+$"), F.lit(NOISE_PULSE)).when(stem.rlike(r"(?i)^(pulse|p)\d+$"), F.lit(SUSPICIOUS)).when(numbered != "", numbered).otherwise(stem)
    )


def safe_component(name: Column, fallback: str = "unnamed") -> Column:
    """a name that is safe as part of a path."""
    out = F.trim(F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1F]', "_"), F.lit(" ."))
    return F.when(out.isNull() | (out == ""), F.lit(fallback)).otherwise(out)


def candidate_name(name: Column) -> Column:
    """npulseN.wav becomes pulseN.wav."""
    return F.regexp_replace(name, r"(?i)^npulse(\d+)(\.\w+)$", "pulse$1$2")


def recording_key(path: Column) -> Column:
    """12 digits that stand for a recording's path."""
    return F.substring(F.sha2(path, 256), 1, 12)


def event_id(key: Column, chunk: Column, candidate: Column) -> Column:
    """id of a detected event."""
    return F.format_string("%s_chunk%06d_candidate%06d", key, chunk, candidate)


#: Bytes of a file's first and last block that its identity is taken from.
IDENTITY_BLOCK = 1 << 20


def content_digest(head: Column, tail: Column) -> Column:
    """digest of a file's first block and of its last one, which is empty up to two blocks."""
    return F.sha2(F.concat(head, tail), 256)


def identity(length: Column, head: Column, tail: Column) -> Column:
    """A file's size and digest; null if it could not be read."""
    return F.concat_ws(":", length, content_digest(head, tail))


def file_identity(content: Column, block: int = IDENTITY_BLOCK) -> Column:
    """the digest of a file's content."""
    n = F.octet_length(content)
    tail = F.when(n > 2 * block, F.substr(content, n - block + 1, F.lit(block))).otherwise(F.lit("").cast("binary"))
    return content_digest(F.substr(content, F.lit(1), F.lit(block)), tail)


def fingerprint(*columns: Column) -> Column:
    """digest of the canonical JSON of columns."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def time_name(at: Column) -> Column:
    """a time as part of a file's name, such as 20240131_235959."""
    return F.date_format(at, "yyyyMMdd_HHmmss")


def iso_time(at: Column) -> Column:
    """ISO 8601 to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")


def to_db(power: Column, reference: Column, floor: float = 1e-10, top: float | None = 80.0) -> Column:
    """Decibels below a reference, power at least floor, clipped at top below the reference."""
    db = 10 * F.log10(F.greatest(power, F.lit(floor))) - 10 * F.log10(F.greatest(reference, F.lit(floor)))
    return db if top is None else F.greatest(db, F.lit(-top))


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Overlap of two intervals as a share of the shorter; 0 without overlap or for an empty one."""
    shared = F.greatest(F.lit(0.0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    shorter = F.least(a_end - a_start, b_end - b_start)
    return F.when(shorter > 0, shared / shorter).otherwise(F.lit(0.0))


def stft_size(samples: Column, largest: int, smallest: int, least_hop: int) -> Column:
    """(n_fft, hop) for a piece of so many samples."""
    power = F.pow(F.lit(2), F.floor(F.log2(F.greatest(samples, F.lit(1))))).cast("int")
    n = F.greatest(F.lit(smallest), F.least(F.lit(largest), power))
    return F.struct(n.alias("n_fft"), F.greatest(F.lit(least_hop), F.floor(n / 16).cast("int")).alias("hop"))


def separation_window(samples: Column, mode: str = "fixed", smallest: int = 256, largest: int = 1024) -> Column:
    """window of a pulse's spectrum: smallest, or with "adaptive" the power of two under a third of the samples; never longer than the pulse."""
    power = F.pow(F.lit(2), F.floor(F.log2(F.greatest(samples / 3, F.lit(1.0))))).cast("int")
    window = F.greatest(F.lit(smallest), F.least(F.lit(largest), power)) if mode == "adaptive" else F.lit(smallest)
    return F.least(samples, window).cast("int")


def feature_similarity(value: dict[str, Column], template: dict[str, Column], scale: dict[str, Column]) -> Column:
    """exp(-root of the weighted mean square of scaled differences)."""
    terms = [F.lit(w) * F.pow((value[f] - template[f]) / scale[f], 2) for f, w in FEATURE_WEIGHTS.items() if f in value]
    weight = sum(w for f, w in FEATURE_WEIGHTS.items() if f in value)
    return F.exp(-F.sqrt(reduce(lambda a, b: a + b, terms) / weight))


def combined_score(feature: Column, dtw: Column | None) -> Column:
    """F16: with a track, half the feature similarity and half exp(-dtw / 6)."""
    return feature if dtw is None else F.when(dtw.isNull(), feature).otherwise(0.5 * feature + 0.5 * F.exp(-dtw / 6))


def match_distance(score: Column) -> Column:
    return -F.log(F.greatest(score, F.lit(1e-12)))


def relative_snr(snr: Column, relative_db: Column) -> Column:
    """F21."""
    return F.greatest(F.lit(0.0), snr + relative_db)


def is_harmonic(ratio: Column, tolerance: float = 0.06) -> Column:
    """a frequency ratio within the tolerance of 2 or 3."""
    r = F.greatest(ratio, 1 / ratio)
    return (F.abs(r - 2) / 2 <= tolerance) | (F.abs(r - 3) / 3 <= tolerance)


def separation_confidence(overlap: Column, gap_khz: Column, relative_db: Column, gap_full: float = 3.0, db_range: float = 18.0) -> Column:
    """overlap, frequency gap and energy of a second source, weighed and clipped to 0 to 1."""
    unit = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return unit(0.45 * unit(overlap) + 0.35 * unit(gap_khz / gap_full) + 0.20 * unit(1 + relative_db / db_range))


def pixel_to_hz(y: Column, top: Column, height: Column, low_hz: Column, high_hz: Column) -> Column:
    """frequency at a row of an image."""
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (y - top) / height))
    return high_hz - share * (high_hz - low_hz)


def pulse_number(name: Column) -> Column:
    """the number in a pulse's name, null if there is none."""
    return F.regexp_replace(name, r"\D", "").try_cast("long")


def is_finite(c: Column) -> Column:
    """P6."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))


def pearson(a: str, b: str) -> Column:
    """A22 (an aggregate): correlation, null without variance, where the built-in raises an error in ANSI mode."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))
