"""Dashboard roll-ups over events (F-01 ... F-09)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.ranking import latest_per_asset
from opslens.operators.rules import ALERTS, DEFAULT_RULES, asset_facts
from opslens.operators.tables import tenant_scope


def overview(assets: DataFrame, events: DataFrame, *, per_asset: int | None = None) -> DataFrame:
    """One row: registered assets, their events, assets with a critical event (F-01)."""
    known = assets.select(F.col("id").alias("asset_id")).distinct()
    rows = latest_per_asset(events, per_asset).groupBy("asset_id").agg(
        F.count("*").alias("n"), F.bool_or(F.col("severity") == "critical").alias("critical")
    )
    return known.join(rows, "asset_id", "left").agg(
        F.count("*").alias("assets_total"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("events_total"),
        F.count_if("critical").alias("critical_assets"),
    )


def dashboard_filter(
    events: DataFrame, *, now: dt.datetime, period_days: int = 30, asset_id: str | None = None,
    source: str | None = None, tenant: str | None = None, per_asset: int | None = None,
) -> DataFrame:
    """Events of the last days before `now` (naive UTC), of an asset, a source, a tenant (F-02)."""
    cutoff = now - dt.timedelta(days=max(period_days, 1))
    out = latest_per_asset(tenant_scope(events, tenant), per_asset)
    out = out.filter(F.col("ts") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp"))
    if asset_id:
        out = out.filter(F.col("asset_id") == asset_id)
    if source:
        out = out.filter(F.col("source") == source)
    return out


def source_mix(events: DataFrame) -> DataFrame:
    """One row: windows, syslog and agentless events with whole percents (F-03)."""
    counted = events.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("source") == "windows_eventlog").alias("windows"),
        F.count_if(F.col("source") == "syslog").alias("syslog"),
        F.count_if(F.col("source").startswith("agentless_")).alias("agentless"),
    )
    whole = F.greatest(F.col("total"), F.lit(1))
    names = ("windows", "syslog", "agentless")
    return counted.select(
        *names, *[F.floor(F.col(n) / whole * 100).cast("bigint").alias(f"{n}_pct") for n in names]
    )


def severity_mix(events: DataFrame) -> DataFrame:
    """One row with the events per severity (F-04)."""
    return events.agg(*[
        F.count_if(F.col("severity") == s).alias(s) for s in ("info", "warning", "critical")
    ])


def daily_trend(events: DataFrame) -> DataFrame:
    """Events per day (F-05)."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("events")).orderBy("day")


def top_assets(events: DataFrame, k: int = 5) -> DataFrame:
    """The k assets with most events (F-06)."""
    counted = events.groupBy("asset_id").agg(F.count("*").alias("events"))
    return counted.orderBy(F.col("events").desc(), "asset_id").limit(k)


def recent_alerts(events: DataFrame, k: int = 7) -> DataFrame:
    """The newest k warning or critical events (F-07)."""
    return (
        events.filter(F.col("severity").isin("warning", "critical"))
        .orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(k)
        .select("seq", "asset_id", "source", "message", "severity", "ts")
    )


def asset_table(
    assets: DataFrame, filtered: DataFrame, events: DataFrame, *, limit: int | None = None
) -> DataFrame:
    """Per asset: filtered events, alerts and correlations of its newest events; zeros kept (F-08)."""
    facts = asset_facts(events, DEFAULT_RULES, limit=limit)
    alerts = sum((F.col(f"alert_{i}").cast("bigint") for i in range(len(ALERTS))), F.lit(0))
    insights = sum(
        ((F.col(f"rule_{i}") >= rule.min_count).cast("bigint") for i, rule in enumerate(DEFAULT_RULES)), F.lit(0)
    )
    counted = filtered.groupBy("asset_id").agg(F.count("*").alias("events"))
    judged = facts.select("asset_id", alerts.alias("alerts"), insights.alias("insights"))
    return (
        assets.select(F.col("id").alias("asset_id"), "asset_type", F.coalesce("location", F.lit("-")).alias("location"))
        .join(counted, "asset_id", "left").join(judged, "asset_id", "left")
        .withColumns({c: F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in ("events", "alerts", "insights")})
    )


def filter_options(assets: DataFrame, events: DataFrame) -> DataFrame:
    """(kind, id, name): the assets and the sources a dashboard can be filtered by (F-09)."""
    named = assets.select(F.lit("asset").alias("kind"), "id", "name")
    sources = events.select(F.lit("source").alias("kind"), F.col("source").alias("id"), F.col("source").alias("name"))
    return union_all(named, sources.distinct()).orderBy("kind", "id")
