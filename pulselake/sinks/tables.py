"""Sinks of a run: tables, reports for people, documents, audio files and render-ready rows.

Tables are Parquet with Spark's commit protocol, so a retried or repeated write leaves no partial
rows (K2, K3, Q10). Single files for people are made of reports with one row per recording or class.
"""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import EXPORT_BUDGET
from ..operators.overview import frequency_limits, merged_events
from ..sources.recordings import local


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    """K1: a Parquet table."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """K1, Q9: a folder of CSV files with one header each and a fixed column order. Nested columns become JSON."""
    flat = [F.to_json(f.name).alias(f.name) if f.dataType.typeName() in ("array", "struct", "map") else F.col(f.name) for f in df.schema if f.dataType.typeName() != "binary"]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def write_report_csv(report: DataFrame, path: str, most_rows: int | None = None) -> int:
    """K1, K3: a report as one CSV file with a byte order mark, put in place whole. Rows come one partition at a time; ValueError beyond most_rows, if that is given."""
    rows, target = 0, Path(path)
    part = target.with_name(target.name + ".part")
    target.parent.mkdir(parents=True, exist_ok=True)
    import csv

    with part.open("w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(report.columns)
        for r in report.toLocalIterator():
            rows += 1
            if most_rows is not None and rows > most_rows:
                raise ValueError(f"more than {most_rows} rows: use write_csv")
            out.writerow(["" if v is None else v for v in r])
    os.replace(part, target)
    return rows


def write_document(row: DataFrame, path: str) -> dict:
    """K3 to K5: the one row of a frame as a JSON file, put in place whole."""
    found = [json.loads(r[0]) for r in row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).take(2)]
    if len(found) != 1:
        raise ValueError("a document is one row")
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(target.name + ".part")
    part.write_text(json.dumps(found[0], ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(part, target)
    return found[0]


def within_budget(pulses: DataFrame, budget: int = EXPORT_BUDGET, key: str = "recording_key", order: tuple[str, ...] = ("start_s", "component_id"), used: DataFrame | None = None) -> DataFrame:
    """The first pulses of each recording; for export only, counts never see it. Spark keeps at most budget rows a key before the shuffle.

    used (key, n) says how many pulses before these each recording has already.
    """
    x = pulses.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= budget)
    if used is not None:
        x = x.join(used.select(key, F.col("n").alias("_used")), key, "left").filter(F.col("_n") + F.coalesce("_used", F.lit(0)) <= budget).drop("_used")
    return x.drop("_n")


def write_pulse_audio(pulses: DataFrame, folder: str, name: Column, pcm: str = "pcm", least_bytes: int = 44 + 2 * 32) -> DataFrame:
    """K6, K8, Q25: writes each pulse's WAV bytes to folder/name and returns pulses without them, with pulse_file and audio_export_error.

    Files are put in place whole, so a retried task writes the same file again. The folder must be one
    that all executors share. Pulses under 32 samples or without audio are not written.
    """
    x = pulses.withColumn("_name", name).withColumnsRenamed({pcm: "_pcm"}).drop("pulse_file", "audio_export_error")
    kept = [c for c in x.columns if c not in ("_pcm", "_name")]
    from pyspark.sql.types import StructType

    schema = StructType([*x.select(*kept).schema.fields]).add("pulse_file", "string").add("audio_export_error", "string")
    root = local(folder)

    def run(batches):
        for b in batches:
            files, errors = [], []
            for n, data in zip(b.column(b.schema.get_field_index("_name")), b.column(b.schema.get_field_index("_pcm"))):
                n, data = n.as_py(), data.as_py()
                error = ""
                if not data or len(data) < least_bytes:
                    error = "too short"
                else:
                    try:
                        target = contained(root, n)
                        target.parent.mkdir(parents=True, exist_ok=True)
                        part = target.with_name(f"{target.name}.{os.getpid()}.part")
                        part.write_bytes(data)
                        os.replace(part, target)
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                files.append("" if error else n)
                errors.append(error)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in kept), pa.array(files, pa.string()), pa.array(errors, pa.string())], names=schema.names)

    return x.mapInArrow(run, schema)


def copy_files(files: DataFrame, folder: str, path: str = "path", name: str = "name") -> DataFrame:
    """Copies each file to folder/name, both on file systems that all executors share: files with copy_error, empty where the copy is there.

    A copy is put in place whole, so a retried task copies again; a name that leaves the folder is an error of its row.
    """
    from pyspark.sql.types import StructType

    schema = StructType([*files.schema.fields]).add("copy_error", "string")
    root = local(folder)

    def run(batches):
        for b in batches:
            errors = []
            for a, n in zip(b.column(b.schema.get_field_index(path)), b.column(b.schema.get_field_index(name))):
                try:
                    target = contained(root, n.as_py())
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f"{target.name}.{os.getpid()}.part")
                    shutil.copyfile(local(a.as_py()), part)
                    os.replace(part, target)
                    errors.append("")
                except (OSError, ValueError) as e:
                    errors.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(errors, pa.string())], names=schema.names)

    return files.mapInArrow(run, schema)


def contained(root: str, relative: str) -> Path:
    """The path of relative below root; ValueError if it leaves root."""
    path = (Path(root) / relative).resolve()
    if not path.is_relative_to(Path(root).resolve()):
        raise ValueError("the path leaves the folder")
    return path


def render_specs(pulses: DataFrame, mode: str = "merged", context_ms: float = 0.0) -> DataFrame:
    """One row per figure: what to draw, from when to when, and its frequency limits.

    "merged" draws an event with all its sources, "separate" each source.
    """
    if mode not in ("merged", "separate"):
        raise ValueError("mode is merged or separate")
    group = "event_id" if mode == "merged" else "pulse_key"
    x = pulses.withColumns({"low": F.least("start_freq_khz", "end_freq_khz", "f05_khz") * 1000, "high": F.greatest("start_freq_khz", "end_freq_khz", "f95_khz") * 1000})
    m = merged_events(x, group, "start_s", "end_s", "predicted_label", "low", "high")
    limits = frequency_limits(F.col("low"), F.col("high"))
    context = context_ms / 1000
    return m.select(
        group, F.greatest(F.lit(0.0), F.col("start_value") - context).alias("start_s"), (F.col("end_value") + context).alias("end_s"), "labels", limits["low_hz"].alias("low_hz"), limits["high_hz"].alias("high_hz"), "n_components"
    )
