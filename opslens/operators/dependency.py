"""Sources of one asset that log the same messages (E-05, E-06)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens.functions.ranking import SALT_BUCKETS, at_least_one, latest_per_asset
from opslens.functions.text import share
from opslens.operators.clusters import CLUSTER, with_signature
from opslens.session import stage


def asset_signatures(events: DataFrame, *, limit: int | None = None, salt: int = SALT_BUCKETS) -> DataFrame:
    """Distinct (asset, source, signature) of each asset's newest events: at most `limit` per asset."""
    newest = latest_per_asset(events, at_least_one(limit), salt=salt)
    return with_signature(newest).select(*CLUSTER).distinct()


def _sized(sets: DataFrame) -> DataFrame:
    """Adds signatures, how many the source has, and opens: true once per source."""
    of_source = W.partitionBy("asset_id", "source")
    return sets.withColumns({
        "signatures": F.count("*").over(of_source),
        "opens": F.row_number().over(of_source.orderBy("signature")) == 1,
    })


def dependency_edges(
    events: DataFrame, *, limit: int | None = None, k: int = 20, salt: int = SALT_BUCKETS
) -> DataFrame:
    """Per asset the k strongest source pairs by shared signatures, in `edge_rank` order.

    The join is keyed by (asset, signature), so only sources that really share a message meet, and pairs are
    counted before they leave the task. Sources that log the same messages are alike, and k + 1 of them stand
    for all (_standing), so thousands of sources with the same few messages do not make millions of pairs.
    Runs a job when called: distinct signatures go to the shared folder, so that events are read once.
    """
    return _edges(stage(_sized(asset_signatures(events, limit=limit, salt=salt)), "dependency-signatures"), k)


def _standing(sized: DataFrame, k: int) -> DataFrame:
    """Signatures that several sources share, of those sources that can be in one of the k strongest pairs.

    Take sources of one asset with as many signatures and the same shared ones. Let y be one that has k + 1 others before
    it by name. Put any of these but x in the place of y in a pair (x, y): shared signatures and score stay, and the names
    come earlier. So at least k pairs rank before (x, y), and y is not needed. Sets are compared by 128 bits of hash.
    """
    held = sized.groupBy("asset_id", "signature").agg(F.count("*").alias("holders")).filter("holders > 1")
    shared = sized.join(held.drop("holders"), ["asset_id", "signature"])
    sets = shared.groupBy("asset_id", "source", "signatures").agg(
        F.bit_xor(F.xxhash64("signature")).alias("_x"), F.bit_xor(F.xxhash64(F.lit(1), "signature")).alias("_y")
    )
    by_name = W.partitionBy("asset_id", "signatures", "_x", "_y").orderBy("source")
    first = sets.withColumn("_at", F.row_number().over(by_name)).filter(F.col("_at") <= k + 1)
    return shared.join(first.select("asset_id", "source"), ["asset_id", "source"], "left_semi")


def _edges(sized: DataFrame, k: int) -> DataFrame:
    sized = _standing(sized, k)
    left = sized.select(
        "asset_id", "signature", F.col("source").alias("source_a"), F.col("signatures").alias("size_a")
    )
    right = sized.select(
        "asset_id", "signature", F.col("source").alias("source_b"), F.col("signatures").alias("size_b")
    )
    edges = (
        left.join(right, ["asset_id", "signature"])
        .filter(F.col("source_a") < F.col("source_b"))
        .groupBy("asset_id", "source_a", "source_b")
        .agg(
            F.count("*").alias("shared_signatures"),
            F.min("signature").alias("example_signature"),
            F.least(F.max("size_a"), F.max("size_b")).alias("_smaller"),
        )
        .withColumn("co_occurrence_score", share("shared_signatures", "_smaller"))
        .drop("_smaller")
    )
    order = W.partitionBy("asset_id").orderBy(
        F.col("shared_signatures").desc(), F.col("co_occurrence_score").desc(), "source_a", "source_b"
    )
    return edges.withColumn("edge_rank", F.row_number().over(order)).filter(F.col("edge_rank") <= k)


def dependency_map(events: DataFrame, *, limit: int | None = None, k: int = 20) -> DataFrame:
    """One nested row per asset: number of sources, number of edges kept, the edges.

    Both sides of the edges and the number of sources come from one written table of distinct signatures.
    """
    sized = stage(_sized(asset_signatures(events, limit=limit)), "dependency-signatures")
    sources = sized.groupBy("asset_id").agg(F.count_if("opens").alias("total_sources"))
    edges = _edges(sized, k).groupBy("asset_id").agg(
        F.count("*").alias("total_edges"),
        F.sort_array(F.collect_list(F.struct(
            "edge_rank", "source_a", "source_b", "shared_signatures", "co_occurrence_score",
            "example_signature",
        ))).alias("edges"),
    )
    empty = F.array().cast(edges.schema["edges"].dataType)
    return sources.join(edges, "asset_id", "left").withColumns({
        "total_edges": F.coalesce("total_edges", F.lit(0)), "edges": F.coalesce("edges", empty),
    })


def first_assets(assets: DataFrame, n: int | None = None) -> DataFrame:
    """The asset ids that a cross-asset overview looks at: all, or the first n."""
    ids = assets.select("asset_id").distinct()
    return ids if at_least_one(n) is None else ids.orderBy("asset_id").limit(n)


def dependency_overview(
    events: DataFrame, assets: DataFrame, *, limit_per_asset: int | None = None, max_assets: int | None = None, max_edges: int = 30
) -> DataFrame:
    """The strongest edges over the first max_assets assets (E-06). assets: (asset_id)."""
    looked_at = first_assets(assets, max_assets)
    scope = events.join(looked_at, "asset_id", "left_semi")
    edges = dependency_edges(scope, limit=limit_per_asset, k=max_edges).drop("edge_rank")
    return edges.orderBy(
        F.col("shared_signatures").desc(), F.col("co_occurrence_score").desc(),
        F.col("asset_id").desc(), "source_a", "source_b",
    ).limit(max_edges)
