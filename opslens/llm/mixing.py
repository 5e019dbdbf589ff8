"""Mixing of sources to target weights, in words.

A source's target is its share of the whole budget by weight; a target stops at `cap` times the source's size,
and what it gives up goes to the others by weight until none is above. (That is the level at
which budget = sum of min(cap * size, level * weight); it is found from the sources' sorted ratios.) Each
document has a hash-random key. Documents of a source are range-sorted by it, and word counts are summed
up along that order in blocks of the key range, so a source of any size is spread over its blocks. The source is
read through as often as the target holds whole epochs, and the last epoch is cut exactly where the
budget ends. What has to be known of a source is then one row: its epochs and the key and words at the cut.

The size of a document is its number of words; a null or blank text has none and is never taken. A null
source is a source and ranks last. Rows with one doc_id share a key; those at the cut share what is left in
proportion to their sizes. The table of sources (a row each) passes through one task. An empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import words
from opslens.session import stage

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
BLOCK_DIGITS = 3  # hexadecimal digits of the key: 4096 blocks a source


def source_name(source: Column) -> Column:
    """A join key that holds null apart from every name."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def random_key(doc_id: Column) -> Column:
    return F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and the source's name and the row's key."""
    return docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"),
        source_name(F.col("source")).alias("_src"), random_key(F.col("doc_id")).alias("_key"),
    )


def targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """_src, source_size, target: one row per source."""
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    sums = rows.groupBy("source", "_src").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    weighed = sums.withColumn("_w", F.get(cycle, (rank - 1) % len(weights))).withColumn("_cap", F.col("source_size") * cap)
    every = W.partitionBy()
    by_ratio = W.orderBy(F.col("_cap") / F.col("_w"), "_src")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    left = lambda c: F.sum(c).over(every) - F.coalesce(F.sum(c).over(before), F.lit(0.0))
    budget = F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    level = budget / left("_w")
    levels = weighed.withColumn("_level", level).withColumn("_full", level * F.col("_w") >= F.col("_cap"))
    common = F.first(F.when(~F.col("_full"), F.col("_level")), ignorenulls=True).over(
        by_ratio.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    return levels.withColumn("_common", common).select(
        "_src", "source_size",
        F.coalesce(F.least(F.col("_cap"), F.col("_common") * F.col("_w")), F.col("_cap")).alias("target"))


def cuts(rows: DataFrame, goal: DataFrame) -> DataFrame:
    """Per source: source_size, target, _epochs whole readings, and _at, _left, _group: the cut's key, words left there, words of that key."""
    whole = goal.withColumn("_budget", F.floor("target")).withColumn(
        "_epochs", F.when(F.col("source_size") > 0, F.floor(F.col("_budget") / F.col("source_size"))).otherwise(F.lit(0))
    ).withColumn("_rest", F.col("_budget") - F.col("_epochs") * F.col("source_size"))
    block = F.substring("_key", 1, BLOCK_DIGITS)
    sums = rows.groupBy("_src", block.alias("_block")).agg(F.sum("size").alias("_sum"))
    so_far = W.partitionBy("_src").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_sum").over(so_far), F.lit(0)))
    cut_block = starts.join(whole.select("_src", "_rest"), "_src").filter(
        (F.col("_start") <= F.col("_rest")) & (F.col("_rest") < F.col("_start") + F.col("_sum")))
    inside = rows.select("_src", block.alias("_block"), "_key", "size").join(cut_block, ["_src", "_block"]).groupBy(
        "_src", "_key", "_start", "_rest").agg(F.sum("size").alias("_group"))
    along = W.partitionBy("_src").orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    at = inside.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_group").over(along), F.lit(0))).filter(
        (F.col("_before") <= F.col("_rest")) & (F.col("_rest") < F.col("_before") + F.col("_group")))
    cut = at.select("_src", F.col("_key").alias("_at"), (F.col("_rest") - F.col("_before")).alias("_left"), "_group")
    return whole.select("_src", "source_size", "target", "_epochs").join(cut, "_src", "left")


def taken(size: Column) -> Column:
    """Words taken of a row of this size, given its key and its source's cut."""
    part = F.when(F.col("_key") < F.col("_at"), size).when(
        F.col("_key") == F.col("_at"), F.floor(size * F.col("_left") / F.col("_group"))).otherwise(F.lit(0))
    return (F.col("_epochs") * size + F.coalesce(part, F.lit(0))).cast("long")


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> tuple[DataFrame, DataFrame]:
    """The rows' sizes and keys, and the cut of each source; both staged, as several branches read them."""
    rows = stage(sized(docs), "sizes")
    return rows, stage(cuts(rows, targets(rows, weights, share, cap)), "mixture")


def digest(docs: DataFrame) -> DataFrame:
    """One row per document: its size, its source's size and target, and the words the mix takes of it."""
    rows, cut = plan(docs)
    return rows.join(cut, "_src").select("doc_id", "size", "source_size", "target", taken(F.col("size")).alias("taken"))


def apply(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row per reading. Where a reading ends inside a document, its words are cut there,
    joined by one space, and n_chars follows. Every other copy is the document unchanged."""
    _, cut = plan(docs)
    w = words(F.col("text"))
    keyed = docs.select(*[F.col(c).alias(f"_in_{c}") for c in docs.columns], source_name(F.col("source")).alias("_src"),
                        random_key(F.col("doc_id")).alias("_key"), F.size(w).cast("long").alias("_size"))
    counted = keyed.join(cut, "_src").withColumn("_taken", taken(F.col("_size"))).filter(F.col("_taken") > 0)
    copies = counted.withColumn("_rest", F.explode(F.transform(
        F.sequence(F.lit(0).cast("long"), F.ceil(F.col("_taken") / F.col("_size")) - 1),
        lambda k: F.least(F.col("_size"), F.col("_taken") - k * F.col("_size")))))
    whole = F.col("_rest") == F.col("_size")
    text = F.when(whole, F.col("_in_text")).otherwise(F.array_join(F.slice(words(F.col("_in_text")), F.lit(1), F.col("_rest").cast("int")), " "))
    out = copies.withColumn("_text", text)
    made = {"text": F.col("_text"), "n_chars": F.when(whole, F.col("_in_n_chars")).otherwise(F.char_length("_text").cast("long"))
            if "n_chars" in docs.columns else None}
    return out.select(*[(made[c] if c in made else F.col(f"_in_{c}")).alias(c) for c in docs.columns])
