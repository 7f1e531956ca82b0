"""From documents to packed training sequences: quality, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one takes as docs. All
but the last return the columns of docs. Columns of docs beyond doc_id, text, lang and source ride
along, whatever their names; n_chars, if there is one, follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulselake.llm.common import checkpoint, table
from pulselake.llm.lines import dedup_lines
from pulselake.llm.mixing import mix
from pulselake.llm.ngram_join import ngram_groups
from pulselake.llm.packing import pack
from pulselake.llm.quality import quality_rules

OWN = ("doc_id", "text", "lang", "source")


def _aside(docs: DataFrame) -> DataFrame:
    """docs with its further columns under names that no operator uses."""
    return docs.withColumnsRenamed({c: f"_own_{c}" for c in docs.columns if c not in OWN})


def _back(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs, in order, from a result over _aside(docs)."""
    found = [F.col(c if c in OWN else f"_own_{c}").alias(c) for c in docs.columns]
    out = result.select(*found)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the base rules nor a risk-controlled cutoff of their language rejects."""
    return _back(quality_rules(_aside(docs), table(spark, sf_dir, "labels")).filter("kept"), docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that resemble an earlier line of any document.

    A document that has no words left by this is a copy of others and goes; documents that had none stay.
    """
    x = dedup_lines(_aside(docs))
    return _back(x.filter((F.col("n_removed") == 0) | F.col("text").rlike(r"\S")), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts: the one with the smallest doc_id.

    Groups are five-word shingles at a similarity of 0.8 or more. Texts without words are in no group
    and stay. Rows with the same doc_id and the same words are one document, of which one row stays.
    """
    g = ngram_groups(docs, size=5, percent=80)
    stay = g.filter(F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias("_d")).distinct()
    d = _aside(docs).join(stay, F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi")
    empty = F.coalesce(~F.col("text").rlike(r"\S"), F.lit(True))
    once = F.when(empty, F.monotonically_increasing_id()).otherwise(F.lit(-1))
    d = d.withColumns({"_once": once, "_hash": F.xxhash64("text")})
    return _back(d.dropDuplicates(["doc_id", "_hash", "_once"]), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them."""
    x = mix(_aside(docs), whole=True).filter("copies > 0")
    return _back(x.withColumn("_copy", F.explode(F.sequence(F.lit(1), "copies"))), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return pack(docs.select("doc_id", "text")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("ngram_join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The cutoffs of the first stage and MinHash in the second can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = checkpoint(docs)
    return docs
