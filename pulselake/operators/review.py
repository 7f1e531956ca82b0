"""Review of scan results: an append-only table of decisions, and views over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import candidate_name, pulse_number


def latest_decisions(decisions: DataFrame, key: str = "pulse_key", at: str = "decided_at") -> DataFrame:
    """The last decision on each key."""
    return decisions.groupBy(key).agg(F.max_by("status", F.struct(at, "status")).alias("review_status"))


def review_view(pulses: DataFrame, decisions: DataFrame, key: str = "pulse_key", file: str = "pulse_file") -> DataFrame:
    """Pulses with review_status and the file name that it implies; undecided ones are unselected."""
    x = pulses.join(latest_decisions(decisions, key), key, "left").withColumn("review_status", F.coalesce("review_status", F.lit("unselected")))
    return x.withColumn(file, F.when(F.col("review_status") == "candidate", candidate_name(F.col(file))).otherwise(F.col(file)))


def unknown_keys(requested: DataFrame, pulses: DataFrame, key: str = "pulse_key") -> DataFrame:
    """U4: requested keys that no pulse has; a request is valid if there are none."""
    return requested.select(key).distinct().join(pulses, key, "left_anti")


def move_to_candidates(requested: DataFrame, pulses: DataFrame, decisions: DataFrame, at, key: str = "pulse_key") -> DataFrame:
    """Decisions to append: requested keys that are not candidates yet.

    Appending them is one atomic write, so nothing has to be rolled back and file names stay a view.
    """
    if not unknown_keys(requested, pulses, key).isEmpty():
        raise ValueError("requested keys that no pulse has")
    done = latest_decisions(decisions, key).filter("review_status = 'candidate'")
    return requested.select(key).distinct().join(done, key, "left_anti").withColumns({"status": F.lit("candidate"), "decided_at": F.lit(at)})


def without_replayed(rows: DataFrame, seen: DataFrame, keys: list[str], times: list[str], digits: int = 3) -> DataFrame:
    """Rows whose rounded times were not written before."""
    rounded = {f"_{c}": F.bround(F.col(c), digits) for c in times}
    on = [*keys, *rounded]
    return rows.withColumns(rounded).join(seen.withColumns(rounded).select(*on).distinct(), on, "left_anti").drop(*rounded)


def first_paths(paths: DataFrame, path: str, order: list[str]) -> DataFrame:
    """Each path once, at its first place."""
    return paths.groupBy(path).agg(F.min(F.struct(*order)).alias("first"))


def gallery(figures: DataFrame, files: DataFrame, label: str | None = None, segment: str | None = None) -> DataFrame:
    """Figures of a label and a segment (all if None) whose file is there, by segment, number and path."""
    x = figures
    if label is not None:
        x = x.filter(F.col("label") == label)
    if segment is not None:
        x = x.filter(F.col("segment_id") == segment)
    return x.join(files.select("path"), "path", "left_semi").orderBy("segment_id", pulse_number(F.element_at(F.split("path", "/"), -1)), "path")


def label_list(given: list[str], seen: DataFrame, label: str = "label", unknown: str = "unknown") -> list[str]:
    """The labels to offer: those given, then unknown, then others that were seen, each once. One per class to the driver."""
    others = seen.select(label).filter(F.col(label).isNotNull() & ~F.col(label).isin([*given, unknown])).distinct().orderBy(label)
    return list(dict.fromkeys([*given, unknown, *(r[0] for r in others.collect())]))
