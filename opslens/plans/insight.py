"""Log insight documents and their overview over all assets (C-12, C-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


from opslens.functions.text import severity_rank, share
from opslens.operators.anomalies import BEST_FIRST, REASON, among_largest, cells, findings_of, profile_of, rank_anomalies
from opslens.operators.clusters import analysis_window, ranked_documents
from opslens.operators.dependency import first_assets
from opslens.plans.newest import newest_events

NO_DATA = "Not enough data to analyse the logs"


def log_insight(
    events: DataFrame,
    assets: DataFrame,
    *,
    limit: int | None = None,
    max_clusters: int | None = None,
    max_anomalies: int = 20,
    filters=None,
) -> DataFrame:
    """One nested row per asset: analysed events, clusters (all, or the largest), anomalies, summary lines.

    assets: (asset_id). An asset without events, or with all of them ignored, has empty lists. Clusters, findings and
    counts come from one table of cells.
    """
    newest = newest_events(events, limit)
    table = cells(analysis_window(newest, limit=limit, filters=filters, salt=1))
    shown = profile_of(table).filter(among_largest(max_clusters)).withColumn("share", share("events_count", "total"))
    cluster_rows = shown.groupBy("asset_id").agg(
        ranked_documents(
            "cluster_rank", ["cluster_id", "source", "signature", "example_message", "events_count", "share"]
        ).alias("clusters")
    )
    anomaly_rows = (
        rank_anomalies(findings_of(table, max_clusters=max_clusters), max_anomalies)
        .withColumn("reason", F.expr(REASON))
        .groupBy("asset_id").agg(F.sort_array(F.collect_list(F.struct(
            "anomaly_rank", "kind", "severity", "confidence", "reason_code", "reason", "evidence",
            "related_cluster_id", "related_metric",
        ))).alias("anomalies"))
    )
    seen = newest.groupBy("asset_id").agg(F.count("*").alias("total_events"))
    rows = (
        assets.select("asset_id").distinct()
        .join(seen, "asset_id", "left")
        .join(_analysed(table), "asset_id", "left")
        .withColumn("excluded_events", F.expr("total_events - coalesce(analyzed_events, 0)"))
        .join(cluster_rows, "asset_id", "left")
        .join(anomaly_rows, "asset_id", "left")
    )
    for name, table in (("clusters", cluster_rows), ("anomalies", anomaly_rows)):
        rows = rows.withColumn(name, F.coalesce(name, F.array().cast(table.schema[name].dataType)))
    excluded = F.concat(
        F.col("excluded_events").cast("string"), F.lit(" of "), F.col("total_events").cast("string")
    )
    lines = F.array_compact(F.array(
        F.concat(F.lit("Events analysed: "), F.col("analyzed_events").cast("string"), F.lit(" (whole history)" if limit is None else f" (limit {limit})")),
        F.concat(F.lit("Clusters: "), F.size("clusters").cast("string"), F.lit(" (all)" if max_clusters is None else f" (top {max_clusters})")),
        F.concat(F.lit("Anomalies: "), F.size("anomalies").cast("string"), F.lit(f" (top {max_anomalies})")),
        F.when(F.col("excluded_events") > 0, F.concat(F.lit("Excluded by ignore rules: "), excluded)),
        F.when(F.size("anomalies") > 0, F.concat(F.lit("Top reason: "), F.get("anomalies", F.lit(0))["reason"])),
    ))
    return rows.select(
        "asset_id",
        F.coalesce("analyzed_events", F.lit(0)).alias("analyzed_events"),
        "clusters", "anomalies",
        F.when(F.col("total_events").isNull(), F.array(F.lit(NO_DATA)))
        .when(F.col("analyzed_events").isNull(),
              F.array(F.concat(F.lit("All events are excluded by ignore rules: "), excluded)))
        .otherwise(lines).alias("summary"),
    )


def _analysed(table: DataFrame) -> DataFrame:
    """(asset_id, analyzed_events) from cells."""
    return table.filter("role = 'cluster'").groupBy("asset_id").agg(F.sum("n").alias("analyzed_events"))


def asset_summaries(
    events: DataFrame,
    assets: DataFrame,
    *,
    limit_per_asset: int | None = None,
    max_assets: int | None = None,
    max_clusters: int | None = None,
    max_anomalies: int | None = None,
    filters=None,
) -> DataFrame:
    """Per looked-at asset: analysed events, anomalies by kind and severity, top anomaly.

    All findings of an asset count, or its max_anomalies best.
    """
    looked_at = first_assets(assets, max_assets)
    limit = limit_per_asset
    scope = events.join(looked_at, "asset_id", "left_semi")
    table = cells(analysis_window(newest_events(scope, limit), limit=limit, filters=filters, salt=1))
    found = findings_of(table, max_clusters=max_clusters)
    if max_anomalies is not None:
        found = rank_anomalies(found, max_anomalies)
    kinds = [
        F.count_if(F.col("kind") == kind).alias(kind)
        for kind in ("rare_pattern", "burst_pattern", "metric_outlier")
    ]
    per_asset = found.groupBy("asset_id").agg(
        F.count("*").alias("anomalies_total"),
        F.min_by("severity", F.expr(BEST_FIRST)).alias("top_severity"),
        F.min_by("reason_code", F.expr(BEST_FIRST)).alias("top_reason_code"),
        *kinds,
        F.count_if(F.col("severity") == "warning").alias("warning"),
        F.count_if(F.col("severity") == "critical").alias("critical"),
    )
    counts = ["analyzed_events", "anomalies_total", "rare_pattern", "burst_pattern", "metric_outlier",
              "warning", "critical"]
    return (
        looked_at.join(_analysed(table), "asset_id", "left").join(per_asset, "asset_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    )


def rank_summaries(summaries: DataFrame) -> DataFrame:
    """Worst asset first: most anomalies, worst top severity, most events."""
    return summaries.orderBy(
        F.col("anomalies_total").desc(), severity_rank("top_severity").desc(),
        F.col("analyzed_events").desc(), "asset_id",
    )


def overview_totals(summaries: DataFrame) -> DataFrame:
    """One row over all looked-at assets: assets with anomalies, totals by kind and by severity."""
    return summaries.agg(
        F.count("*").alias("assets_considered"),
        F.count_if(F.col("anomalies_total") > 0).alias("assets_with_anomalies"),
        *[
            F.coalesce(F.sum(c), F.lit(0)).alias(c if c != "anomalies_total" else "total_anomalies")
            for c in ("anomalies_total", "rare_pattern", "burst_pattern", "metric_outlier", "warning", "critical")
        ],
    )


def analytics_overview(events: DataFrame, assets: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """(ranked asset summaries, one-row totals); options as for asset_summaries (C-13)."""
    summaries = asset_summaries(events, assets, **options)
    return rank_summaries(summaries), overview_totals(summaries)
