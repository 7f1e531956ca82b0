"""Where intermediate rows are kept between stages of a plan."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which all executors see.

    Where the session names none, a temporary folder is taken on a local master, as in tests; on a
    cluster that would be a folder that each machine has for itself, so it is a RuntimeError.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-")


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, without its lineage, so that a lost executor costs no earlier stage."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
