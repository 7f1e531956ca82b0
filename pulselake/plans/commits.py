"""The commit list of a run: which parts of its tables count, how far each recording is done, and what from.

Every step writes its tables to folders of its own, part=<id>, and last one row for each recording to
commits/part=<id>, as one file that is put in place whole. Readers take only parts that the list
names, so what a step that broke off has left is never read, and the step is done again under another
id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import identity
from ..sinks.tables import write_table
from ..sources.recordings import file_edges

#: Chunks from first_chunk to end_chunk - 1 of a recording are in the part; identity is that of the file they were read from.
COMMIT = "recording_key string, first_chunk int, end_chunk int, n_pulses long, seconds double, identity string, part string"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def commit(rows: DataFrame, out: str, part: str) -> None:
    """Make a part count: rows of COMMIT without part, few and narrow."""
    write_table(rows.withColumn("part", F.lit(part)).select(*(c.split()[0] for c in COMMIT.split(", "))).coalesce(1), f"{out}/commits/part_id={part}")


def commits(spark: SparkSession, out: str) -> DataFrame:
    """The commit list below out; no rows if there is none."""
    if not exists(spark, f"{out}/commits"):
        return spark.createDataFrame([], COMMIT)
    return spark.read.schema(COMMIT).parquet(f"{out}/commits/part_id=*")


def committed(spark: SparkSession, out: str, name: str) -> DataFrame | None:
    """The rows of a table in all parts that count; None without any. The driver sees one name for each step."""
    parts = sorted(r[0] for r in commits(spark, out).select("part").distinct().collect())
    return spark.read.parquet(*(f"{out}/{name}/part={p}" for p in parts)) if parts else None


def progress(commits: DataFrame) -> DataFrame:
    """The watermark of each recording: done (chunks), n_pulses, and the identity that they were read under. Ranges follow each other, so the last one tells."""
    return commits.groupBy("recording_key").agg(F.max("end_chunk").alias("done"), F.sum("n_pulses").alias("n_pulses"), F.max_by("identity", "end_chunk").alias("identity"))


def identities(found: DataFrame) -> DataFrame:
    """(recording_key, identity) of the files of found, whose first and last block are read by tasks."""
    return file_edges(found).select("recording_key", identity(F.col("length"), F.col("head"), F.col("tail")).alias("identity"))


def require_unchanged(found: DataFrame, done: DataFrame) -> None:
    """ValueError if a file that has results is another one by now, by its size or by what its first and last block hold."""
    now = identities(found.join(done.select("recording_key"), "recording_key", "left_semi"))
    changed = now.join(done.select("recording_key", F.col("identity").alias("before")), "recording_key").filter("identity != before").select("recording_key").take(3)
    if changed:
        raise ValueError(f"recordings have changed since the run began: {[r[0] for r in changed]}")
