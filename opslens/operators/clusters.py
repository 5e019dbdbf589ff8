"""Analysis window and message clusters (C-01 ... C-05, C-07).

`analysis_rows` cuts each asset to its newest `limit` events (spread over salted tasks while it does) and drops ignored
ones. `analysis_window` adds which rows belong to the recent part. That needs one number per asset, the arrival
number where the recent part begins; it is found by counting (functions.selection), so no row is numbered or
sorted, and later aggregates of the rows combine on the map side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.ranking import SALT_BUCKETS, at_least_one, latest_per_asset, with_position
from opslens.functions.selection import newest_cutoff
from opslens.functions.text import cluster_id, quoted, share, signature
from opslens.schemas import SEVERITIES

CLUSTER = ["asset_id", "source", "signature"]


def severity_counts() -> list[Column]:
    return [F.expr(f"count_if(severity = '{s}') AS {s}_count") for s in SEVERITIES]


def ranked_documents(rank: str, fields: list[str], where: str = "true") -> Column:
    """Aggregate: a group's rows (`where`) as structs in rank order, their severity counts as a map."""
    inner = ", ".join([rank, *fields, *[f"{s}_count" for s in SEVERITIES]])
    outer = ", ".join(f"r.{name} AS {name}" for name in (rank, *fields))
    pairs = ", ".join(f"struct('{s}' AS k, r.{s}_count AS v)" for s in SEVERITIES)
    mix = f"map_filter(map_from_entries(array({pairs})), (k, v) -> v > 0)"
    return F.expr(
        f"transform(sort_array(collect_list(struct({inner})) FILTER (WHERE {where})), r -> struct({outer}, {mix} AS severity_mix))"
    )


def with_signature(events: DataFrame) -> DataFrame:
    return events.withColumn("signature", signature("message"))


def _literals(items) -> str:
    clean = sorted({item.strip().lower() for item in (items or ()) if item and item.strip()})
    return ", ".join(quoted(item) for item in clean) or "NULL"


def flag_ignored(events: DataFrame, filters=None) -> DataFrame:
    """Add `ignored`: source or signature is on an ignore list.

    filters: None, a pair of lists (sources, signatures), or a table (field, item) such as
    policies.resolve_filters returns. Needs the signature column.
    """
    if filters is None:
        return events.withColumn("ignored", F.lit(False))
    if not isinstance(filters, DataFrame):
        sources, signatures = (_literals(items) for items in filters)
        hit = f"coalesce(lower(source) IN ({sources}), false) OR coalesce(signature IN ({signatures}), false)"
        return events.withColumn("ignored", F.expr(hit))
    items = filters.selectExpr("field", "lower(trim(item)) AS item").filter("item <> ''").distinct()
    by_source = items.filter("field = 'source'").selectExpr("item AS _src", "true AS _hit_source")
    by_signature = items.filter("field = 'signature'").selectExpr("item AS _sig", "true AS _hit_signature")
    return (
        events.join(by_source, F.expr("lower(source) = _src"), "left")
        .join(by_signature, F.expr("signature = _sig"), "left")
        .withColumn("ignored", F.expr("coalesce(_hit_source, false) OR coalesce(_hit_signature, false)"))
        .drop("_src", "_sig", "_hit_source", "_hit_signature")
    )


def apply_ignore(events: DataFrame, filters=None) -> DataFrame:
    """Drop the events on an ignore list (C-03)."""
    if filters is None:
        return events
    return flag_ignored(events, filters).filter("NOT ignored").drop("ignored")


def excluded_counts(events: DataFrame, filters=None) -> DataFrame:
    """Per asset: events, how many an ignore list takes out, how many stay."""
    return flag_ignored(events, filters).groupBy("asset_id").agg(
        F.expr("count(*) AS total_events"),
        F.expr("count_if(ignored) AS excluded_events"),
        F.expr("count_if(NOT ignored) AS analyzed_events"),
    )


# SQL: size of the recent part of `total` rows
RECENT_ROWS = "least(greatest(10, total div 3), total)"


def analysis_rows(
    events: DataFrame, *, limit: int | None = None, filters=None, salt: int = SALT_BUCKETS
) -> DataFrame:
    """Newest `limit` events per asset (all for None) minus the ignored ones, with signature and hour of day.

    filters as for flag_ignored, salt as for top_n_per_key.
    """
    newest = with_signature(latest_per_asset(events, at_least_one(limit), salt=salt))
    return apply_ignore(newest, filters).selectExpr("*", "hour(cast(ts AS timestamp)) AS hour")


def analysis_window(
    events: DataFrame, *, limit: int | None = None, filters=None, salt: int = SALT_BUCKETS
) -> DataFrame:
    """analysis_rows with total (rows of the asset), recent_rows (a third of them, 10 at least) and is_recent (C-07)."""
    rows = analysis_rows(events, limit=limit, filters=filters, salt=salt)
    cut = newest_cutoff(rows, "asset_id", "seq", RECENT_ROWS)
    return rows.join(cut, "asset_id").withColumn("is_recent", F.col("seq") >= F.col("cutoff")).drop("cutoff")


def split_recent(
    events: DataFrame, *, limit: int | None = None, filters=None, salt: int = SALT_BUCKETS
) -> DataFrame:
    """analysis_window with every row numbered, too: pos (1 = oldest). For reading a window row by row."""
    rows = analysis_rows(events, limit=limit, filters=filters, salt=salt)
    return with_position(rows, "asset_id", "seq").withColumn("recent_rows", F.expr(RECENT_ROWS)).withColumn(
        "is_recent", F.expr("pos > total - recent_rows"))


def _cluster_aggregates() -> list[Column]:
    return [
        F.expr("count(*) AS events_count"), F.expr("min(seq) AS first_seq"), F.expr("min_by(message, seq) AS example_message"),
        *severity_counts(),
    ]


def clusters(window: DataFrame) -> DataFrame:
    """One row per (asset, source, signature) of analysis rows or an analysis window (C-04).

    Plain aggregates with map-side combine; nothing of an asset but its clusters is brought together.
    """
    rows = window.groupBy(*CLUSTER).agg(*_cluster_aggregates())
    return rows.withColumn("total", F.expr("sum(events_count) OVER (PARTITION BY asset_id)")).withColumns(
        {"cluster_id": cluster_id(), "share": share("events_count", "total")}
    )


def cluster_totals(events: DataFrame) -> DataFrame:
    """Clusters of the whole history: (asset, source, signature) totals and shares."""
    return clusters(with_signature(events))


def with_cluster_rank(table: DataFrame, *inside: str) -> DataFrame:
    """Add cluster_rank: most events first, the earlier first appearance on ties."""
    keys = ", ".join(["asset_id", *inside])
    return table.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {keys} ORDER BY events_count DESC, first_seq) AS cluster_rank"
    )


def top_clusters(table: DataFrame, k: int | None = 30) -> DataFrame:
    """The k largest clusters of every asset (C-05); all of them, ranked, for None."""
    ranked = with_cluster_rank(table)
    return ranked if k is None else ranked.filter(f"cluster_rank <= {int(k)}")
