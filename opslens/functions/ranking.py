"""Top-n and running values per key that stay spread out when one key holds most of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SALT_BUCKETS = 32
BLOCK_ROWS = 1 << 20


def top_n_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, salt: int = SALT_BUCKETS
) -> DataFrame:
    """The first n rows of every key under a total order.

    Two rounds: the rows of one input partition share a salt, so the map side already cuts each
    key to n rows and a hot key is merged by `salt` tasks; the second round sees at most
    salt * n rows of a key. salt=1 leaves the first round out, for input that holds few rows per key.
    """
    rank = F.row_number()
    if salt > 1:
        df = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(salt)))
        first = W.partitionBy(*keys, "_salt").orderBy(*order)
        df = df.withColumn("_rn", rank.over(first)).filter(F.col("_rn") <= n).drop("_rn", "_salt")
    second = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", rank.over(second)).filter(F.col("_rn") <= n).drop("_rn")


def latest_per_asset(events: DataFrame, n: int | None = 1000, *, salt: int = SALT_BUCKETS) -> DataFrame:
    """The newest n events of every asset in arrival order; all of them for n=None."""
    if n is None:
        return events
    return top_n_per_key(events, ["asset_id"], [F.col("seq").desc()], n, salt)


def at_least_one(limit: int | None) -> int | None:
    """A limit as asked for; None is everything."""
    if limit is not None and limit < 1:
        raise ValueError("a limit must be at least 1, or None for everything")
    return limit


def never_null(name: str) -> Column:
    """The long column `name`; a null is an error, where a join on it would lose the row without a word."""
    return F.coalesce(F.col(name), F.raise_error(F.lit(f"{name} is null; number or quarantine such rows first")).cast("long"))


def with_position(df: DataFrame, key: str, order: str, *, buckets: int = 4096) -> DataFrame:
    """Adds pos (from 1, in the order of a unique integer column) and total per key. A null there is an error.

    The order axis is cut into buckets of `buckets` numbers, so a bucket never holds more rows than that, however
    sparse or far apart the numbers of a key are. Rows are ranked inside a bucket, and the counts of the
    buckets before are added.
    """
    cut = df.withColumn("_b", F.floor(never_null(order) / F.lit(buckets)).cast("long"))
    sizes = cut.groupBy(F.col(key).alias("_k"), F.col("_b").alias("_kb")).agg(F.count("*").alias("_n"))
    starts = running(sizes, "_k", "_kb", {"_start": ("sum", F.col("_n"))}, include_current=False, block_rows=buckets)
    totals = sizes.groupBy(F.col("_k").alias("_t")).agg(F.sum("_n").alias("total"))
    inside = F.row_number().over(W.partitionBy(key, "_b").orderBy(order))
    placed = cut.withColumn("_rank", inside).join(
        starts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_b") == F.col("_kb")))
    return placed.join(totals, F.col(key).eqNullSafe(F.col("_t"))).withColumn(
        "pos", F.col("_start") + F.col("_rank")).select(*df.columns, "total", "pos")


def running(
    df: DataFrame,
    key: str,
    order: str,
    specs: dict[str, tuple[str, Column]],
    *,
    include_current: bool = True,
    block_rows: int = BLOCK_ROWS,
    levels: int = 2,
) -> DataFrame:
    """Running sum or max per key in the order of a unique integer column.

    specs maps an output name to ("sum" | "max", value). The order axis is cut into blocks of
    block_rows numbers, so a window never holds more than block_rows rows however hot the key is;
    what came before a block is joined in as one row per (key, block). Sparse numbers make many blocks, so the
    blocks are summed up in blocks of blocks in turn: with two levels only one row per block_rows**2
    numbers of a key meets in a window.
    """
    block = f"_block{levels}"
    blocked = df.withColumn(block, F.floor(F.col(order) / F.lit(block_rows)).cast("long"))
    for name, (_, value) in specs.items():
        blocked = blocked.withColumn(f"_v_{name}", value)
    how = {"sum": F.sum, "max": F.max}

    before = (
        blocked.groupBy(key, block)
        .agg(*[how[kind](f"_v_{name}").alias(f"_b_{name}") for name, (kind, _) in specs.items()])
    )
    if levels > 1:
        sums = {f"_p_{name}": (kind, F.col(f"_b_{name}")) for name, (kind, _) in specs.items()}
        before = running(before, key, block, sums, include_current=False, block_rows=block_rows, levels=levels - 1)
    else:
        earlier = W.partitionBy(key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
        before = before.withColumns(
            {f"_p_{name}": how[kind](f"_b_{name}").over(earlier) for name, (kind, _) in specs.items()})
    before = before.select(F.col(key).alias("_rk"), F.col(block).alias("_rb"), *[f"_p_{name}" for name in specs])

    here = W.partitionBy(key, block).orderBy(order).rowsBetween(
        W.unboundedPreceding, W.currentRow if include_current else -1
    )
    out = blocked.withColumns(
        {f"_l_{name}": how[kind](f"_v_{name}").over(here) for name, (kind, _) in specs.items()}
    ).join(before, F.col(key).eqNullSafe(F.col("_rk")) & (F.col(block) == F.col("_rb")))
    for name, (kind, _) in specs.items():
        local, prior = F.col(f"_l_{name}"), F.col(f"_p_{name}")
        if kind == "sum":
            joined = F.coalesce(local, F.lit(0)) + F.coalesce(prior, F.lit(0))
        else:
            joined = F.greatest(local, prior)
        out = out.withColumn(name, joined)
    return out.select(*df.columns, *specs)
