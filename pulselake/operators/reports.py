"""Reports over labelled pulses: counts per recording and class, rates and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import MIXED_PURITY, NOISE, UNKNOWN
from . import series


def fold_label(label: Column, labels: list[str], unknown: str = UNKNOWN) -> Column:
    """Q24: a label outside the list counts as unknown, so that totals hold."""
    return F.when(label.isin(labels), label).otherwise(F.lit(unknown))


def label_counts(pulses: DataFrame, key: str, label: str, labels: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """(key, label, n) with a row for each label of each recording, zeros too. labels is the template list, known beforehand."""
    every = [*labels, unknown]
    counted = pulses.groupBy(key).agg(*(F.count_if(fold_label(F.col(label), labels, unknown) == x).alias(f"_{i}") for i, x in enumerate(every)))
    return counted.select(key, F.explode(F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(x).alias("label"), F.col(f"_{i}").alias("n")) for i, x in enumerate(every)))).alias("c")).select(key, "c.*")


def accumulate(pulses: DataFrame, key: str, label: str, labels: list[str], confidence: str, unknown: str = UNKNOWN) -> DataFrame:
    """One row per recording: counts by label, uncertain, classified and detected calls, mean confidence of the classified."""
    sure = F.col(label).isin(labels)
    counts = [F.count_if(F.col(label) == x).alias(f"n_{x}") for x in labels]
    out = pulses.filter(F.col(label) != NOISE).groupBy(key).agg(
        *counts, F.count_if(~sure).alias("uncertain_count"), F.count_if(sure).alias("classified_call_count"), F.count("*").alias("total_calls"), F.avg(F.when(sure, F.col(confidence))).alias("prediction_confidence")
    )
    return out.withColumn(f"n_{unknown}", F.col("uncertain_count"))


def majority(counts: DataFrame, key: str, unknown: str = UNKNOWN, mixed: float = MIXED_PURITY) -> DataFrame:
    """The label with the most calls (ties by list order, '' without calls), its share, and a note if that is low."""
    known = counts.filter(F.col("label") != unknown)
    m = known.groupBy(key).agg(F.min_by(F.struct("label", "n"), F.struct(-F.col("n"), F.col("ord"))).alias("m"), F.sum("n").alias("classified"))
    purity = F.when(F.col("classified") > 0, F.col("m.n") / F.col("classified")).otherwise(F.lit(0.0))
    x = m.select(key, F.when(F.col("m.n") > 0, F.col("m.label")).otherwise(F.lit("")).alias("major_label"), "classified", purity.alias("purity"))
    return x.withColumn("consistency_note", F.when((F.col("classified") > 0) & (F.col("purity") < mixed), F.lit("mixed")).otherwise(F.lit("")))


def call_rate(calls: Column, duration_s: Column) -> Column:
    """Calls per second of the whole recording."""
    return F.when(duration_s > 0, calls / duration_s).otherwise(F.lit(0.0))


def segment_summary(pulses: DataFrame, key: str, label: str, labels: list[str], unknown: str = UNKNOWN) -> DataFrame:
    """One row per recording, one column per label. The labels come from the templates, so one job does it."""
    return pulses.withColumn("_l", fold_label(F.col(label), labels, unknown)).groupBy(key).pivot("_l", [*labels, unknown]).agg(F.count(F.lit(1))).na.fill(0)


def overall_by_label(counts: DataFrame) -> DataFrame:
    """Calls and recordings with calls for each label, zeros too."""
    return counts.groupBy("label").agg(F.count_if(F.col("n") >= 1).alias("segment_count"), F.sum("n").alias("call_count"))


def run_totals(results: DataFrame, status: str = "processing_status", calls: str = "total_calls", duration: str = "duration_s") -> DataFrame:
    """Totals of a run and its status."""
    x = results.agg(
        F.count_if(F.col(status) == "success").alias("success_count"), F.count_if(F.col(status) != "success").alias("failed_count"), F.count_if(F.col(status) == "cancelled").alias("cancelled_count"),
        F.coalesce(F.sum(calls), F.lit(0)).alias("total_calls"), F.round(F.coalesce(F.sum(duration), F.lit(0.0)), 3).alias("total_duration_s"),
    )
    return x.withColumn("status", F.when(F.col("cancelled_count") > 0, "cancelled").when(F.col("failed_count") > 0, "partial_failure").otherwise("success"))


def rollup_counts(pulses: DataFrame, key: str, label: str) -> DataFrame:
    """A13 and A14 in one pass: counts by recording and label, recording, and all."""
    return pulses.rollup(key, label).agg(F.count("*").alias("n"))


def number_pulses(pulses: DataFrame, key: str, order: list[str], used: DataFrame | None = None) -> DataFrame:
    """Ids p001, p002, ... within each recording, after those that used (key, n) says it has already. Rows are kept once, in order."""
    x = series.numbered(pulses, [key], order, "_n").withColumn("_n", F.col("_n") + 1)
    if used is None:
        return x.withColumn("pulse_id", F.format_string("p%03d", "_n")).drop("_n")
    x = x.join(used.select(key, F.col("n").alias("_used")), key, "left")
    return x.withColumn("pulse_id", F.format_string("p%03d", F.col("_n") + F.coalesce("_used", F.lit(0)))).drop("_n", "_used")
