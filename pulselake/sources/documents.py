"""Text sources of a run: CSV with a byte order mark, JSON documents, checkpoints that can be resumed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_csv(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """CSV files with a header, in UTF-8 with or without a byte order mark, in the types of schema; cells that don't fit are null.

    Each file's columns are matched by the names of its own header, so files whose columns stand in
    another order, or that lack or add some, read right; of equal names the last counts. A cell may
    hold line breaks, so one task reads a file. A header is one row per file, sent to all tasks.
    """
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0)
    lines = lines.select(F.col("_metadata.file_path").alias("path"), "value", F.monotonically_increasing_id().alias("at")).groupBy("path").agg(F.min_by("value", "at").alias("value"))
    width = lines.agg(F.max(F.regexp_count("value", F.lit(",")))).first()[0]  # one number: no header has more columns
    if width is None:
        return spark.createDataFrame([], schema)
    cells = StructType([StructField(f"c{i}", StringType()) for i in range(width + 1)])
    raw = spark.read.schema(cells).option("multiLine", True).option("enforceSchema", True).csv(path)
    raw = raw.select(F.array(*cells.names).alias("cells"), F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("at"))
    heads = raw.groupBy("path").agg(F.min("at").alias("first"), F.min_by("cells", "at").alias("names"))
    # A cell's place is the last of its name in the header; beyond the header there is none.
    name = lambda x: F.trim(F.regexp_replace(x, "^\\uFEFF", ""), F.lit('"'))  # noqa: E731  Spark leaves a quoted first name as it is behind a byte order mark
    heads = heads.select("path", "first", F.transform("names", name).alias("names"))
    for f in schema:
        heads = heads.withColumn(f"p_{f.name}", F.array_size("names") + 1 - F.array_position(F.reverse(F.transform("names", lambda x: F.coalesce(x, F.lit("")))), f.name))
    x = raw.join(F.broadcast(heads), "path").filter(F.col("at") != F.col("first"))
    cell = lambda f: F.when(F.col(f"p_{f.name}") <= F.array_size("names"), F.get("cells", (F.col(f"p_{f.name}") - 1).cast("int")))
    return x.select(*(cell(f).try_cast(f.dataType).alias(f.name) for f in schema))


def read_documents(spark: SparkSession, path: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """One row per JSON file below path, with its path; _corrupt is the text of a file that is no JSON object of the schema."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path, wholetext=True)
    doc = F.from_json("value", schema)
    x = files.select(F.input_file_name().alias("path"), doc.alias("d"), "value")
    names = schema.names if isinstance(schema, StructType) else StructType.fromDDL(schema).names
    empty = F.lit(True)
    for n in names:
        empty = empty & F.col(f"d.{n}").isNull()
    return x.select("path", "d.*", F.when(empty, F.col("value")).alias("_corrupt"))


def resumable_runs(spark: SparkSession, root: str, version: int = 3) -> DataFrame:
    """The unfinished states below root that this version can resume: path and status, newest version first."""
    x = read_documents(spark, root, "version int, status string, processed_until_s double", "run_state.json")
    return x.filter((F.col("version") == version) & F.col("status").isin("running", "cancelled")).select("path", "status", "processed_until_s")


def companions(spectra: DataFrame, recordings: DataFrame) -> DataFrame:
    """Spectra with the path of the recording beside them that has the same name, null if there is none."""
    stem = lambda c: F.regexp_replace(F.col(c), r"\.[^./]+$", "")
    r = recordings.groupBy(stem("path").alias("_stem")).agg(F.min("path").alias("companion"))
    return spectra.withColumn("_stem", stem("path")).join(r, "_stem", "left").drop("_stem")
