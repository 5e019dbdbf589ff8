"""The dashboard of every tenant as one nested document (H-05): F-01 to F-09 put together.

Events are read once for all counts: one aggregation per (tenant, asset, source, day) that is combined on the map side, rolled up
with grouping sets to tenants, days, assets and sources. The newest alerts are a second, filtered top-n.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens.functions.ranking import at_least_one, top_n_per_key
from opslens.operators.rules import ALERTS, DEFAULT_RULES, fact_columns
from opslens.session import stage

# fixed values: who may see what
ROLES = ("viewer", "operator", "admin")
STAFF_PARTS = ("show_worker_health", "show_recent_alerts", "show_collectors_link", "show_diagnostics_link")
SOURCES = {
    "windows": "source = 'windows_eventlog'", "syslog": "source = 'syslog'", "agentless": "startswith(source, 'agentless_')",
}
SEVERITIES = ("info", "warning", "critical")


def tenant_of(column: str) -> Column:
    """What stands before the first colon of an asset id; empty without one."""
    return F.when(F.contains(F.col(column), F.lit(":")), F.substring_index(column, ":", 1)).otherwise("")


def _shown(now: dt.datetime, period_days: int, asset_id: str | None, source: str | None) -> Column:
    cutoff = now - dt.timedelta(days=max(period_days, 1))
    out = F.col("ts") >= F.lit(cutoff.isoformat(sep=" ")).cast("timestamp")
    if asset_id:
        out = out & (F.col("asset_id") == asset_id)
    if source:
        out = out & (F.col("source") == source)
    return F.coalesce(out, F.lit(False))


def rolled_up(events: DataFrame, shown: Column) -> DataFrame:
    """Counts per tenant, (tenant, day), (tenant, asset) and (tenant, source); `part` tells which. Written once."""
    cells = events.withColumns({"tenant": tenant_of("asset_id"), "day": F.to_date("ts"), "shown": shown}).groupBy(
        "tenant", "asset_id", "source", "day"
    ).agg(
        F.count("*").alias("events"), F.count_if("shown").alias("filtered"),
        *[F.count_if(F.col("shown") & (F.col("severity") == s)).alias(s) for s in SEVERITIES],
        F.bool_or(F.col("severity") == "critical").alias("was_critical"), *fact_columns(DEFAULT_RULES),
    )
    flags = ["was_critical", *[f"alert_{i}" for i in range(len(ALERTS))]]
    sums = ["events", "filtered", *SEVERITIES, *[f"rule_{i}" for i in range(len(DEFAULT_RULES))]]
    totals = [f"sum({c}) AS {c}" for c in sums] + [f"bool_or({c}) AS {c}" for c in flags]
    totals += [f"sum(if({test}, filtered, 0)) AS {name}" for name, test in SOURCES.items()]
    rolled = events.sparkSession.sql(
        f"""SELECT tenant, asset_id, source, day, {', '.join(totals)}, CASE WHEN grouping(day) = 0 THEN 'day'
                     WHEN grouping(asset_id) = 0 THEN 'asset' WHEN grouping(source) = 0 THEN 'source' ELSE 'tenant' END AS part
            FROM {{cells}} GROUP BY GROUPING SETS ((tenant), (tenant, day), (tenant, asset_id), (tenant, source))""",
        cells=cells,
    )
    return stage(rolled, "dashboard")


def _nested(order: list, *fields) -> Column:
    """Sorted array of the structs, without the columns that only give the order."""
    held = F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("_it"))))
    return F.transform(held, lambda x: x["_it"])


def dashboard_documents(
    assets: DataFrame,
    events: DataFrame,
    *,
    now: dt.datetime,
    period_days: int = 30,
    asset_id: str | None = None,
    source: str | None = None,
    role: str = "viewer",
    top: int = 5,
    newest_alerts: int = 7,
    table_rows: int | None = None,
) -> DataFrame:
    """One row per tenant of assets(id, name, asset_type, location): its dashboard as nested columns.

    Period, asset and source filter what is counted; alerts and insights of an asset come from its whole history, the overview
    from all registered assets. An unknown role is a viewer. table_rows: how many assets, in order of their id, the
    nested tables list (all if None; the whole tables are dashboard.asset_table and filter_options).
    """
    table_rows = at_least_one(table_rows)
    shown = _shown(now, period_days, asset_id, source)
    rolled = rolled_up(events, shown)
    known = assets.withColumn("tenant", tenant_of("id"))
    by_asset = rolled.filter("part = 'asset'")

    total = rolled.filter("part = 'tenant'").select("tenant", *SOURCES, *SEVERITIES, "filtered")
    days = rolled.filter("part = 'day' AND filtered > 0").groupBy("tenant").agg(
        F.sort_array(F.collect_list(F.struct(F.date_format("day", "yyyy-MM-dd").alias("day"), "filtered"))).alias("days"))
    seen = rolled.filter("part = 'source'").groupBy("tenant").agg(F.sort_array(F.collect_list("source")).alias("source_names"))

    registered = by_asset.join(known.select("tenant", F.col("id").alias("asset_id")), ["tenant", "asset_id"], "left_semi")
    best = top_n_per_key(registered.filter("filtered > 0"), ["tenant"], [F.col("filtered").desc(), F.col("asset_id")], top, salt=1)
    tops = best.groupBy("tenant").agg(
        _nested([(-F.col("filtered")).alias("_n"), "asset_id"], "asset_id", F.col("filtered").alias("events")).alias("top_assets"))

    warned = events.filter(shown & F.col("severity").isin("warning", "critical")).withColumn("tenant", tenant_of("asset_id"))
    warned = warned.select("tenant", "seq", "ts", "source", "message", "severity")
    newest = top_n_per_key(warned, ["tenant"], [F.col("ts").desc(), F.col("seq").desc()], newest_alerts)
    alerts = newest.groupBy("tenant").agg(F.reverse(_nested(
        ["ts", "seq"], "source", "message", "severity", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"),
    )).alias("recent_alerts"))

    hits = sum((F.coalesce(F.col(f"alert_{i}"), F.lit(False)).cast("long") for i in range(len(ALERTS))), F.lit(0))
    found = sum(
        (F.coalesce(F.col(f"rule_{i}") >= r.min_count, F.lit(False)).cast("long") for i, r in enumerate(DEFAULT_RULES)), F.lit(0))
    listed = known.withColumn("_row", F.row_number().over(W.partitionBy("tenant").orderBy("id"))) if table_rows else known
    listed = listed.filter(F.col("_row") <= table_rows) if table_rows else listed
    facts = listed.join(
        by_asset.select("tenant", F.col("asset_id").alias("id"), "filtered", hits.alias("alerts"), found.alias("insights")),
        ["tenant", "id"], "left")
    number = lambda c, name: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(name)
    row = F.struct(
        "id", "asset_type", F.coalesce("location", F.lit("-")).alias("location"), number("filtered", "events"),
        number("alerts", "alerts"), number("insights", "insights"))
    in_table = F.col("id") == asset_id if asset_id else F.lit(True)
    tables = facts.groupBy("tenant").agg(
        F.sort_array(F.array_compact(F.collect_list(F.when(in_table, row)))).alias("assets_table"),
        F.sort_array(F.collect_list(F.struct("id", "name"))).alias("named"))

    overview = known.select("tenant", F.col("id").alias("asset_id")).distinct().join(by_asset, ["tenant", "asset_id"], "left").agg(
        F.count("*").alias("assets_total"), F.coalesce(F.sum("events"), F.lit(0)).alias("events_total"),
        F.count_if("was_critical").alias("critical_assets"))

    out = tables
    for part in (total, days, seen, tops, alerts):
        out = out.join(part, "tenant", "left")
    out = out.withColumn("_one", F.lit(1)).join(overview.withColumn("_one", F.lit(1)), "_one")
    zero = {c: F.coalesce(c, F.lit(0)) for c in (*SOURCES, *SEVERITIES, "filtered")}
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("days", "source_names", "top_assets", "recent_alerts")}
    out = out.withColumns(zero | empty)

    def percent(name: str) -> Column:
        return F.floor(F.col(name) / F.greatest("filtered", F.lit(1)) * 100).cast("long").alias(f"{name}_pct")

    role = role if role in ROLES else ROLES[0]
    may = {part: role != ROLES[0] for part in STAFF_PARTS} | {"show_filters": True}
    text = lambda value, name: F.lit(value or "").alias(name)
    return out.select(
        "tenant",
        F.struct("assets_total", "events_total", "critical_assets", F.col("filtered").alias("events_filtered")).alias("overview"),
        F.struct(*SOURCES, *[percent(n) for n in SOURCES]).alias("sources"),
        F.struct(F.col("days.day").alias("labels"), F.col("days.filtered").alias("values")).alias("trend"),
        F.struct(*SEVERITIES).alias("severity"), "top_assets", "recent_alerts", "assets_table",
        F.struct(F.lit(period_days).alias("period_days"), text(asset_id, "asset_id"), text(source, "source"),
                 F.col("tenant").alias("tenant_id")).alias("filters"),
        F.struct(F.col("named").alias("assets"), F.col("source_names").alias("sources"),
                 F.array(*[F.lit(r) for r in ROLES]).alias("roles")).alias("filter_options"),
        F.lit(role).alias("role"), F.struct(*[F.lit(v).alias(k) for k, v in may.items()]).alias("permissions"),
    )
