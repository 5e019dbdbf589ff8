"""Incident briefs per asset and their overview (E-07, E-08)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from opslens.functions.text import quoted
from opslens.operators.anomalies import REASON, among_largest, detect, rank_anomalies
from opslens.operators.clusters import analysis_window
from opslens.operators.dependency import dependency_edges, first_assets
from opslens.operators.rules import (
    ANOMALY_ACTION, DEFAULT_HINT, DEFAULT_RULES, HINT_ANOMALIES, asset_facts, correlations,
    hit_array, runbook_hints,
)
from opslens.plans.newest import newest_events

QUIET = "No significant incident patterns in current window"
TOP = 3


def asset_hints(
    events: DataFrame, assets: DataFrame, *, limit: int | None = None, max_clusters: int | None = None
) -> DataFrame:
    """Runbook hints of every asset in assets(asset_id), from findings in all clusters or the largest ones."""
    newest = newest_events(events, limit)
    found = detect(analysis_window(newest, limit=limit, salt=1), max_clusters=max_clusters)
    return runbook_hints(rank_anomalies(found, HINT_ANOMALIES), correlations(newest, salt=1), assets)


def _first(rank: str, text: str, n: int, name: str, only: str = "true") -> Column:
    """Aggregate: the texts of a group's n best rows in rank order."""
    rows = f"collect_list(CASE WHEN {only} AND {rank} <= {n} THEN struct({rank} AS r, {text} AS t) END)"
    return F.expr(f"transform(sort_array({rows}), x -> x.t) AS {name}")


def incident_briefs(
    events: DataFrame, assets: DataFrame, *, limit: int | None = None, brief_clusters: int | None = None,
    hint_clusters: int | None = None,
) -> DataFrame:
    """One row per asset: headline, confidence, top reasons, actions and dependency hotspots.

    The brief itself looks at the brief_clusters largest clusters, its hints at the hint_clusters largest,
    each at all of them for None; one detection serves both. Each branch ends in one row per asset before
    anything is joined.
    """
    newest = newest_events(events, limit)
    order = "ORDER BY confidence DESC, kind_order, first_seq"
    own, hinted = among_largest(brief_clusters), among_largest(hint_clusters)
    deepest = None if None in (brief_clusters, hint_clusters) else max(brief_clusters, hint_clusters)
    anomalies = (
        detect(analysis_window(newest, limit=limit, salt=1), max_clusters=deepest)
        .selectExpr(
            "*", f"row_number() OVER (PARTITION BY asset_id, {hinted} {order}) AS hint_place",
            f"row_number() OVER (PARTITION BY asset_id, {own} {order}) AS own_place",
        )
        .groupBy("asset_id").agg(
            _first("own_place", REASON, TOP, "anomaly_reasons", only=own),
            F.expr(f"max(CASE WHEN {own} THEN confidence END) AS top_anomaly"),
            _first("hint_place", ANOMALY_ACTION, HINT_ANOMALIES, "anomaly_actions", only=hinted),
        )
    )
    rules = asset_facts(newest, salt=1).selectExpr(
        "asset_id", f"transform({hit_array(DEFAULT_RULES)}, h -> h.recommendation) AS rule_actions"
    )
    edges = dependency_edges(newest, limit=limit, k=5, salt=1).groupBy("asset_id").agg(
        _first("edge_rank", "concat(source_a, ' <-> ', source_b, ' (', shared_signatures, ')')", TOP,
               "dependency_hotspots"),
        F.expr("max(CASE WHEN edge_rank = 1 THEN co_occurrence_score END) AS top_edge"),
    )
    rows = assets.select("asset_id").distinct()
    for part in (anomalies, rules, edges):
        rows = rows.join(part, "asset_id", "left")
    none = "cast(array() AS array<string>)"
    return rows.selectExpr(
        "asset_id", f"coalesce(anomaly_reasons, {none}) AS anomaly_reasons",
        f"coalesce(dependency_hotspots, {none}) AS dependency_hotspots",
        f"concat(coalesce(anomaly_actions, {none}), coalesce(rule_actions, {none})) AS actions",
        # least() skips nulls
        "least(0.35D, coalesce(top_anomaly * 0.4D, 0.0D)) AS from_anomaly",
        "least(0.2D, coalesce(top_edge * 0.2D, 0.0D)) AS from_edge",
    ).selectExpr(
        "asset_id",
        "coalesce(get(anomaly_reasons, 0), concat('Dependency hotspot: ', get(dependency_hotspots, 0)), "
        f"{quoted(QUIET)}) AS headline",
        # every asset has a hint, which is worth 0.1
        "round(least(0.35D + from_anomaly + from_edge + 0.1D, 0.99D), 2) AS confidence",
        "anomaly_reasons",
        f"if(size(actions) = 0, array({quoted(DEFAULT_HINT[2])}), slice(actions, 1, {TOP})) AS runbook_actions",
        "dependency_hotspots",
    )


def incident_overview(
    events: DataFrame, assets: DataFrame, *, limit_per_asset: int | None = None, max_assets: int | None = None,
    min_confidence: float = 0.0, brief_clusters: int | None = None, hint_clusters: int | None = None,
) -> DataFrame:
    """Briefs of all assets (or the first max_assets) with at least min_confidence, most certain first."""
    looked_at = first_assets(assets, max_assets)
    scope = events.join(looked_at, "asset_id", "left_semi")
    floor = min(max(min_confidence, 0.0), 1.0)
    return incident_briefs(
        scope, looked_at, limit=limit_per_asset, brief_clusters=brief_clusters, hint_clusters=hint_clusters
    ).filter(
        F.col("confidence") >= floor
    ).orderBy(F.col("confidence").desc(), "asset_id")
