"""Folders of text logs (A-20)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens.functions.ranking import at_least_one

FILE_BITS = 40


def list_text_logs(spark: SparkSession, path: str, *, glob: str = "*.txt", recursive: bool = True) -> DataFrame:
    """(file): every file that matches. Contents are not read."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower()).load(path)
        .select(F.col("path").alias("file"))
    )


def scan_text_logs(
    spark: SparkSession, path: str, *, glob: str = "*.txt", recursive: bool = True, max_files: int | None = None
) -> DataFrame:
    """(seq, file, line_no, value): the lines of all files, or of the first max_files with lines in path order.

    Big files are read in splits. Inside a split lines have consecutive running ids, so a line's number is its
    id less the split's first, plus the line counts of the splits before: lines meet only a table of
    splits and are not shuffled to be numbered.
    """
    lines = (
        spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", str(recursive).lower())
        .text(path)
        .select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("at"),
            "value",
        )
    )
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    # a row per split, a file's number is its rank among them
    numbered = splits.select(
        "file", "split", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"),
        F.dense_rank().over(W.orderBy("file")).cast("long").alias("file_no"),
    )
    if at_least_one(max_files) is not None:
        numbered = numbered.filter(F.col("file_no") <= max_files)
    out = lines.join(numbered, ["file", "split"])
    line_no = F.col("offset") + F.col("at") - F.col("first") + 1
    return out.select(
        (F.shiftleft(F.col("file_no"), FILE_BITS) + line_no).alias("seq"),
        "file", line_no.alias("line_no"), "value",
    )
