"""Connected components of a link table by smallest label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.session import stage


def smallest_reachable(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root: for every node of the links the smallest node it reaches.

    Each round gives a node the smallest label among its own and its neighbours', then the label of its
    label, so that chains shrink by jumps. Labels go to the shared folder after each round, which keeps
    the plan short and lets a lost executor cost one round. Minima are combined before shuffles, and nodes with
    very many links are left to the splitting of skewed joins. Null ends and self-links are ignored.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = stage(union_all(pairs, pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    label = stage(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        .select("node", F.least("node", "root").alias("root")), "labels")
    while True:
        near = both.join(label, both.b == label.node).groupBy("a").agg(F.min("root").alias("near"))
        hooked = label.join(near, label.node == near.a).select(
            "node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        target = label.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
        jumped = hooked.join(target, F.col("root") == F.col("_n")).select(
            "node", "old", F.least("root", "_r").alias("root"))
        done = stage(jumped, "labels")
        label = done.select("node", "root")
        if done.filter("root <> old").limit(1).count() == 0:
            return label
