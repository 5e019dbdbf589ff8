"""Removal of lines that an earlier document holds, as compressed keep bitmaps.

A line's key is the line without SPACE at both ends and with A-Z lower-cased. Keys of at least
`min_chars` code points that at least two documents hold lose all their lines except those in the
document of the smallest doc_id. Only key hashes travel: they are range-partitioned, sorted by
document and position, and first occurrences are read off the sorted stream. A key that very many
documents hold is split into slices of its documents first; what is left of a key after that is one
document per slice, and those are compared in a second, small round. The result is the dropped part
of each document's keep bitmap in run-length form, never text.

Hashes are 128 bits (MD5). A null or empty text is one empty line. A null doc_id ranks after all others.
Rows with the same doc_id are one document when holders are counted; each row gets the bitmap of its own
text. Keys repeated inside one document only are left alone. Other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.llm.common import ascii_lower, shuffle_partitions, strip, whole
from opslens.session import stage

SLICES = 64


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def text_key(text: Column) -> Column:
    """Tells rows of the same doc_id apart."""
    return F.xxhash64(whole(text))


def occurrences(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, row, pos, hash of every line whose key is long enough."""
    lines = docs.select("doc_id", text_key(F.col("text")).alias("row"), F.posexplode(lines_of(F.col("text"))).alias("pos", "line"))
    key = strip(F.col("line"))
    return lines.filter(F.char_length(key) >= min_chars).select(
        "doc_id", "row", "pos", F.unhex(F.md5(ascii_lower(key).cast("binary"))).alias("hash")
    )


def _marked(rows: DataFrame, *group: str) -> DataFrame:
    """Adds later: whether another document precedes this row's in the sorted group."""
    seen = W.partitionBy(*group).orderBy(F.col("doc_id").asc_nulls_last(), "row", "pos").rowsBetween(
        W.unboundedPreceding, W.currentRow
    )
    head = F.first(F.struct("doc_id")).over(seen)["doc_id"]
    return rows.withColumn("later", ~F.col("doc_id").eqNullSafe(head))


def dropped_lines(docs: DataFrame, min_chars: int = 10, slices: int = SLICES) -> DataFrame:
    """doc_id, row, pos of every line to drop."""
    spark = docs.sparkSession
    found = stage(occurrences(docs, min_chars), "line-hashes").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id"), F.lit(slices)).cast("int")
    )
    ranged = found.repartitionByRange(shuffle_partitions(spark), "hash", "slice").sortWithinPartitions(
        "hash", "slice", F.col("doc_id").asc_nulls_last(), "row", "pos"
    )
    first = _marked(ranged, "hash", "slice")
    second = _marked(first.filter(~F.col("later")).drop("later"), "hash")
    return union_all(*(x.filter("later").select("doc_id", "row", "pos") for x in (first, second)))


def keep_bitmaps(docs: DataFrame, min_chars: int = 10, slices: int = SLICES) -> DataFrame:
    """doc_id, row, dropped: runs (start, length) of dropped lines; documents that lose none have no row."""
    per_doc = dropped_lines(docs, min_chars, slices).groupBy("doc_id", "row").agg(
        F.sort_array(F.collect_set("pos")).alias("at")
    )
    at = F.col("at")
    starts = F.filter(at, lambda x, i: F.coalesce(F.get(at, i - 1) != x - 1, F.lit(True)))
    ends = F.filter(at, lambda x, i: F.coalesce(F.get(at, i + 1) != x + 1, F.lit(True)))
    runs = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a + 1).alias("length")))
    return per_doc.select("doc_id", "row", runs.alias("dropped"))


def _keep_flags(runs: Column, n_lines: Column) -> Column:
    """One boolean per line, from the runs."""
    end = lambda r: r["start"] + r["length"]
    parts = F.transform(runs, lambda r, i: F.concat(
        F.array_repeat(F.lit(True), r["start"] - F.coalesce(end(F.get(runs, i - 1)), F.lit(0))),
        F.array_repeat(F.lit(False), r["length"]),
    ))
    return F.concat(F.flatten(parts), F.array_repeat(F.lit(True), n_lines - end(F.element_at(runs, -1))))


def with_kept(docs: DataFrame, min_chars: int = 10, slices: int = SLICES) -> DataFrame:
    """The documents with n_lines, n_dropped and kept_text."""
    maps = keep_bitmaps(docs, min_chars, slices).withColumnRenamed("doc_id", "_doc").withColumnRenamed("row", "_row")
    keyed = docs.withColumn("_key", text_key(F.col("text")))
    joined = keyed.join(maps, (F.col("_key") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_doc")), "left")
    lines, runs = lines_of(F.col("text")), F.col("dropped")
    n_lines = F.size(lines)
    cut = F.array_join(
        F.transform(
            F.filter(F.arrays_zip(lines.alias("line"), _keep_flags(runs, n_lines).alias("keep")), lambda x: x["keep"]),
            lambda x: x["line"],
        ), "\n")
    return joined.select(
        *docs.columns,
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.aggregate(runs, F.lit(0).cast("long"), lambda a, r: a + r["length"]), F.lit(0)).alias("n_dropped"),
        F.when(runs.isNull(), whole(F.col("text"))).otherwise(cut).alias("kept_text"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its lines, how many go, and the SHA-256 of the lines that stay."""
    return with_kept(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    )


def apply(docs: DataFrame) -> DataFrame:
    """The documents with their kept lines as text; all rows stay."""
    kept = with_kept(docs)
    new = {"text": F.when(F.col("n_dropped") > 0, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.char_length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumns(new).select(*docs.columns)
