"""Rare patterns, bursts, metric outliers and their ranking (C-06, C-08 ... C-11).

Everything works on the analysis window (clusters.analysis_window) of all assets at once. Rows of a window meet one
aggregation with map-side combine, `cells`: events per (cluster, hour, recent or older) and samples per
(metric, value). All detectors read that table; no sort or window function ever holds the rows of an asset.
Findings have one shape: asset_id, kind, severity, confidence, reason_code, related_cluster_id,
related_metric, evidence, kind_order, first_seq, cluster_rank.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.selection import medians
from opslens.functions.text import SUSPICIOUS_WORDS, any_word, cluster_id, quoted
from opslens.operators.clusters import CLUSTER, severity_counts, with_cluster_rank
from opslens.schemas import SEVERITIES
from opslens.session import stage

# fixed values of the detectors
RARE_SHARE = 0.05
BURST_MIN_EVENTS, BURST_MIN_RECENT, BURST_MAX_OLDER, BURST_MAX_HOURLY = 3, 0.4, 0.2, 0.15
OUTLIER_MIN_VALUES, OUTLIER_Z, MAD_SCALE = 6, 3, 1.4826
REASONS = {
    "rare_pattern": "Rare log pattern that looks like an error",
    "burst_pattern": "Burst of one repeated pattern among the latest events",
    "metric_outlier": "Metric value far outside its usual range",
}
KIND_ORDER = {"rare_pattern": 0, "burst_pattern": 1, "metric_outlier": 2}


def _finding(kind: str, severity: str, confidence: str, first_seq: str, evidence: list[str],
             *, cluster: str = "NULL", metric: str = "NULL", rank: str = "0") -> str:
    """SQL of one finding; evidence holds SQL texts."""
    return (
        f"struct('{kind}' AS kind, {severity} AS severity, cast({confidence} AS double) AS confidence, "
        f"'{kind}' AS reason_code, cast({cluster} AS string) AS related_cluster_id, "
        f"cast({metric} AS string) AS related_metric, array({', '.join(evidence)}) AS evidence, "
        f"{KIND_ORDER[kind]} AS kind_order, {first_seq} AS first_seq, {rank} AS cluster_rank)"
    )


def _pct(rate: str) -> str:
    return f"cast(round({rate} * 100, 0) AS int), '%'"


RARE_LIMIT = f"greatest(1, floor(total * {RARE_SHARE}D))"
RARE = (
    f"CASE WHEN events_count <= {RARE_LIMIT} AND (critical_count > 0 "
    f"OR {any_word('lower(example_message)', SUSPICIOUS_WORDS)}) THEN "
    + _finding(
        "rare_pattern", "if(critical_count > 0, 'critical', 'warning')", "if(critical_count > 0, 0.84D, 0.72D)",
        "first_seq",
        [
            f"concat('Rule: count <= ', {RARE_LIMIT}, ' (5% of the window)')",
            "concat('Cluster ', cluster_id, ': ', events_count, ' of ', total, ' events')",
            "concat('Example: ', example_message)",
        ],
        cluster="cluster_id", rank="cluster_rank",
    ) + " END"
)
BURST = (
    f"CASE WHEN total > recent_rows AND recent_count >= {BURST_MIN_EVENTS} "
    f"AND recent_rate >= {BURST_MIN_RECENT}D AND older_rate <= {BURST_MAX_OLDER}D "
    f"AND hourly_baseline <= {BURST_MAX_HOURLY}D THEN "
    + _finding(
        "burst_pattern", "if(critical_count > 0, 'critical', 'warning')", "if(critical_count > 0, 0.86D, 0.8D)",
        "first_recent_seq",
        [
            "'Rule: recent count >= 3, recent rate >= 40%, older rate <= 20%, hourly baseline <= 15%'",
            "concat('Cluster ', cluster_id, ': recent ', recent_count, '/', recent_rows, ' (', "
            f"{_pct('recent_rate')}, ')')",
            "concat('Older rate: ', events_count - recent_count, '/', total - recent_rows, ' (', "
            f"{_pct('older_rate')}, ')')",
            f"concat('Hourly baseline (hour ', recent_hour, '): ', {_pct('hourly_baseline')})",
        ],
        cluster="cluster_id", rank="cluster_rank",
    ) + " END"
)
OUTLIER = (
    f"CASE WHEN samples >= {OUTLIER_MIN_VALUES} AND robust_z >= {OUTLIER_Z} THEN "
    + _finding(
        "metric_outlier", "'warning'", "least(0.95D, round(0.65D + robust_z / 10, 2))", "metric_seq",
        [
            "'Rule: robust z >= 3 on median and MAD'",
            "format_string('Latest value: %.2f', last_value)",
            "format_string('Median: %.2f, MAD: %.2f, robust z: %.2f', median_value, mad, robust_z)",
        ],
        metric="metric",
    ) + " END"
)
SAMPLE = "coalesce(metric <> '' AND value IS NOT NULL, false)"


def _findings(rows: DataFrame, *candidates: str) -> DataFrame:
    """One output row per candidate that is not null."""
    found = rows.selectExpr("asset_id", f"explode(array_compact(array({', '.join(candidates)}))) AS a")
    return found.select("asset_id", "a.*")


def hourly_counts(window: DataFrame) -> DataFrame:
    """(asset, source, signature, hour): older events in that hour of day, and those of the cluster (C-08)."""
    cells = window.groupBy(*CLUSTER, "hour").agg(F.count_if(~F.col("is_recent")).alias("older_in_hour_of_cluster"))
    return cells.selectExpr("*", "sum(older_in_hour_of_cluster) OVER (PARTITION BY asset_id, hour) AS older_in_hour")


def with_hourly_baseline(window: DataFrame) -> DataFrame:
    """Rows of a window with the counts of hourly_counts for their hour."""
    return window.join(hourly_counts(window), [*CLUSTER, "hour"])


def cells(window: DataFrame, *, clusters: bool = True, metrics: bool = True) -> DataFrame:
    """What all detectors need of a window, written to the shared folder once.

    role 'cluster': events n per (asset, source, signature, hour, is_recent). role 'metric': samples n per (asset,
    metric, value). Both with their first and last seq, so that cells can be merged further.
    """
    roles = []
    if clusters:
        roles.append("struct('cluster' AS role, source, signature, hour, is_recent, cast(NULL AS string) AS metric, "
                     "cast(NULL AS double) AS value)")
    if metrics:
        roles.append(f"if({SAMPLE}, struct('metric' AS role, cast(NULL AS string) AS source, cast(NULL AS string) AS signature, "
                     "cast(NULL AS int) AS hour, cast(NULL AS boolean) AS is_recent, metric, cast(value AS double) AS value), NULL)")
    rows = window.withColumn("g", F.expr(f"explode(array_compact(array({', '.join(roles)})))"))
    return stage(
        rows.select("asset_id", "g.*", "seq", "severity", "total", "recent_rows", F.expr("if(g.role = 'cluster', message, NULL) AS message"))
        .groupBy("asset_id", "role", "source", "signature", "hour", "is_recent", "metric", "value").agg(
            F.expr("count(*) AS n"), F.expr("min(seq) AS first_seq"), F.expr("max(seq) AS last_seq"),
            F.expr("min_by(message, seq) AS example_message"), F.expr("max(total) AS total"),
            F.expr("max(recent_rows) AS recent_rows"), *severity_counts()),
        "cells")


def _with_rates(rows: DataFrame) -> DataFrame:
    return rows.selectExpr(
        "*", "recent_count / recent_rows AS recent_rate", "last.hour AS recent_hour",
        "if(total > recent_rows, (events_count - recent_count) / (total - recent_rows), 0.0D) AS older_rate",
    ).selectExpr(
        "*", "if(last.older_in_hour > 0, last.older_in_hour_of_cluster / last.older_in_hour, older_rate) "
        "AS hourly_baseline",
    ).drop("last").withColumn("cluster_id", cluster_id())


def profile_of(table: DataFrame) -> DataFrame:
    """cluster_profile from cells. Cells of an asset, not its rows, meet in the task of the asset."""
    older = "sum(if(is_recent, 0, n))"
    counted = table.filter("role = 'cluster'").repartition("asset_id").selectExpr(
        "*", f"{older} OVER (PARTITION BY asset_id, hour) AS older_in_hour",
        f"{older} OVER (PARTITION BY asset_id, source, signature, hour) AS older_in_hour_of_cluster",
    )
    rows = counted.groupBy(*CLUSTER).agg(
        *[F.expr(e) for e in (
            "sum(n) AS events_count", "min(first_seq) AS first_seq", "min_by(example_message, first_seq) AS example_message",
            "max(total) AS total", "max(recent_rows) AS recent_rows", "sum(if(is_recent, n, 0)) AS recent_count",
            "min(if(is_recent, first_seq, NULL)) AS first_recent_seq",
            "max_by(struct(hour, older_in_hour, older_in_hour_of_cluster), if(is_recent, last_seq, NULL)) AS last",
            *(f"sum({s}_count) AS {s}_count" for s in SEVERITIES),
        )])
    return with_cluster_rank(_with_rates(rows))


def cluster_profile(window: DataFrame) -> DataFrame:
    """Clusters of an analysis window with their recent and older rate and their rank.

    hourly_baseline is the rate among the older events of the hour of day of the cluster's last
    recent event. Runs one job when called (cells).
    """
    return profile_of(cells(window, metrics=False))


def among_largest(max_clusters: int | None) -> str:
    """SQL condition: the cluster is one of the asset's max_clusters largest; any cluster for None."""
    return "true" if max_clusters is None else f"cluster_rank <= {int(max_clusters)}"


def rare_patterns(profile: DataFrame, *, max_clusters: int | None = None) -> DataFrame:
    """Small clusters with a critical event or a suspicious first message (C-06).

    All clusters are looked at, or the max_clusters largest of an asset.
    """
    return _findings(profile.filter(among_largest(max_clusters)), RARE)


def burst_patterns(profile: DataFrame, *, max_clusters: int | None = None) -> DataFrame:
    """Clusters that fill the recent part of the window but were rare before (C-09); max_clusters as above."""
    return _findings(profile.filter(among_largest(max_clusters)), BURST)


def metric_stats_of(table: DataFrame) -> DataFrame:
    """metric_stats from cells: two exact selections, of the median and of the median distance from it.

    Runs one job when called: the medians, a row per metric, are written before distances from them are taken.
    """
    keys = ["asset_id", "metric"]
    values = table.filter("role = 'metric'").select(*keys, "value", "n", "first_seq", "last_seq")
    middle = stage(medians(values, keys).withColumnRenamed("median", "median_value"), "medians")
    apart = values.join(middle, keys).select(*keys, F.expr("abs(value - median_value) AS value"), "n")
    spread = medians(apart, keys).select(*keys, F.col("median").alias("mad"))
    ends = values.groupBy(*keys).agg(
        F.expr("min(first_seq) AS metric_seq"), F.expr("max_by(value, last_seq) AS last_value"))
    z = f"abs(last_value - median_value) / ({MAD_SCALE}D * mad)"
    return middle.join(spread, keys).join(ends, keys).selectExpr("*", f"if(mad <> 0, {z}, NULL) AS robust_z")


def metric_stats(window: DataFrame) -> DataFrame:
    """Per (asset, metric) of a window: values, median, median absolute deviation, last value, robust z."""
    return metric_stats_of(cells(window, clusters=False))


def metric_outliers(window: DataFrame) -> DataFrame:
    """Metrics whose latest value lies three robust deviations or more from the median (C-10)."""
    return _findings(metric_stats(window), OUTLIER)


def findings_of(table: DataFrame, *, max_clusters: int | None = None) -> DataFrame:
    """Findings of all detectors from cells, not ranked yet."""
    return union_all(
        _findings(profile_of(table).filter(among_largest(max_clusters)), RARE, BURST),
        _findings(metric_stats_of(table), OUTLIER),
    )


def detect(window: DataFrame, *, max_clusters: int | None = None) -> DataFrame:
    """Findings of all detectors on one window, not ranked yet; max_clusters as for rare_patterns."""
    return findings_of(cells(window), max_clusters=max_clusters)


# SQL: sort key of a finding within its asset, best first
BEST_FIRST = "struct(-confidence AS c, kind_order, first_seq)"


def rank_anomalies(found: DataFrame, m: int = 20, *, max_clusters: int | None = None) -> DataFrame:
    """The m most confident findings per asset, in `anomaly_rank` order (C-11).

    max_clusters narrows the findings to those of larger clusters, so that one detection can serve
    several depths.
    """
    return found.filter(among_largest(max_clusters)).selectExpr(
        "*", "row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind_order, first_seq) AS anomaly_rank"
    ).filter(f"anomaly_rank <= {int(m)}")


def find_anomalies(window: DataFrame, *, max_clusters: int | None = None, max_anomalies: int = 20) -> DataFrame:
    """All detectors on all clusters of one window (or the largest), the max_anomalies best of an asset ranked."""
    return rank_anomalies(detect(window, max_clusters=max_clusters), max_anomalies)


# SQL: reader's text of a finding's reason code
REASON = "CASE reason_code " + " ".join(
    f"WHEN {quoted(code)} THEN {quoted(text)}" for code, text in REASONS.items()
) + " END"
