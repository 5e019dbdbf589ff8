"""Stable assignment of records to weighted shards by rendezvous hashing.

Each record scores every shard with -weight / ln(u), u being a uniform number drawn from the hash of
(record key, shard), and goes to the shard of the highest score. A record's scores for the old shards do
not change when a shard is added, so it stays or moves into the new one. Nothing but the key, the shard
numbers and their weights decides.

Null keys share one shard, like any other repeated key. Text plays no part. An empty table gives an
empty one. Columns named like the added ones are replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.llm.common import whole

SLOT_BLOCKS = 1024
EQUAL_ROWS = 1 << 16


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard, 0 to len(weights) - 1, that the key belongs to."""
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one at least above zero")
    weight = F.array(*[F.lit(float(w)) for w in weights])

    def score(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard), 12)  # 52 bits and a half are exact, so u is never 1
        return F.struct((-F.get(weight, shard) / F.log((bits + 0.5) / F.lit(2.0**52))).alias("score"), shard.alias("shard"))

    return F.array_max(F.transform(F.sequence(F.lit(0), F.lit(len(weights) - 1)), score))["shard"]


def with_shard(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", name: str = "shard") -> DataFrame:
    return docs.withColumn(name, rendezvous(F.col(key), weights))


def with_slot(rows: DataFrame, key: str = "doc_id", shard: str = "shard", blocks: int = SLOT_BLOCKS) -> DataFrame:
    """Adds slot: a gapless number from 0 within each shard.

    A shard's rows are numbered in `blocks` hash blocks; where a block begins is the sum of
    the counts before it. So a shard of any size is spread over up to `blocks` tasks, and what passes one
    window is `blocks` counts. Rows of one key differ in their block if they differ at all; equal rows are numbered as one
    row with a count and told apart afterwards.
    """
    rows = rows.groupBy(*rows.columns).agg(F.count("*").alias("_n"))
    rest = [c for c in rows.columns if c not in (shard, key, "_n")]
    rows = rows.withColumn("_block", F.pmod(F.xxhash64(F.lit("slot"), F.col(key), *rest), F.lit(blocks)).cast("int"))
    before = W.partitionBy("_shard").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    starts = (
        rows.groupBy(F.col(shard).alias("_shard"), F.col("_block").alias("_of")).agg(F.sum("_n").alias("_size"))
        .withColumn("_start", F.coalesce(F.sum("_size").over(before), F.lit(0)))
        .drop("_size")
    )
    here = W.partitionBy(shard, "_block").orderBy(key, *rest).rowsBetween(W.unboundedPreceding, -1)
    numbered = rows.withColumn("_rank", F.coalesce(F.sum("_n").over(here), F.lit(0)))
    return (
        numbered.join(starts, (F.col(shard) == F.col("_shard")) & (F.col("_block") == F.col("_of")))
        .withColumn("_some", F.explode(F.expr(f"sequence(0L, (_n - 1) div {EQUAL_ROWS})")))
        .withColumn("_copy", F.explode(F.expr(f"sequence(_some * {EQUAL_ROWS}, least(_n, (_some + 1) * {EQUAL_ROWS}) - 1)")))
        .withColumn("slot", F.col("_start") + F.col("_rank") + F.col("_copy"))
        .drop("_n", "_some", "_copy", "_block", "_shard", "_of", "_start", "_rank")
    )


def write_shards(docs: DataFrame, weights: Sequence[float], path: str, key: str = "doc_id") -> None:
    """Write the records as Parquet, one folder shard=N per shard, without a shuffle."""
    with_shard(docs, weights, key).write.partitionBy("shard").parquet(path)


def digest(docs: DataFrame, shards: int = 24) -> DataFrame:
    """One row per document: its size, shard, slot, and the shard it would have with one shard more."""
    text = whole(F.col("text"))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), [1.0] * shards).alias("shard"),
        rendezvous(F.col("doc_id"), [1.0] * (shards + 1)).alias("grown_shard"),
    )
    return with_slot(rows).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
