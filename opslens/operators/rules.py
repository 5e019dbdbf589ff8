"""Alerts, correlation rules, runbook hints, risk score (E-01 ... E-04, E-09).

Rules are plain rows (tuples). They compile to conditional counts of one aggregation per asset, so
any number of rules costs one pass, no join, and one partial row per asset and map task.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.functions.ranking import SALT_BUCKETS, at_least_one, latest_per_asset
from opslens.functions.text import quoted
from opslens.operators.anomalies import REASON


class Correlation(NamedTuple):
    title: str
    source: str
    pattern: str
    min_count: int
    confidence: float
    recommendation: str


# fixed values: the built-in rules, in their reporting order
DEFAULT_RULES = (
    Correlation("Repeated unexpected shutdown pattern", "windows_eventlog", "eventid=6008|eventid=41",
                2, 0.87, "Check power, UPS and the Kernel-Power log; run hardware diagnostics."),
    Correlation("Burst of failed logons", "windows_eventlog", "eventid=4625",
                5, 0.78, "Find where the logons come from, lock accounts, restrict RDP and SMB."),
    Correlation("Windows storage error cluster", "windows_eventlog", "eventid=(7|51|55|153)",
                3, 0.81, "Check controller, cables and disk; run chkdsk and storage path diagnostics."),
    Correlation("iLO thermal/fan alert pattern", "ilo_iml", "fan|thermal|temperature|overheating|caution",
                2, 0.84, "Check fans, thermal paste and airflow in the rack."),
    Correlation("iLO power supply fault", "ilo_iml", "power supply|power fault|power failure|redundan",
                1, 0.90, "Check power supplies, cables and UPS modules; replace the faulty unit."),
    Correlation("iLO storage degradation pattern", "ilo_iml", "drive|disk|smart|storage|array",
                2, 0.82, "Check SMART state and the array controller; prepare a disk replacement."),
)
IOWAIT_LIMIT = 25
ALERTS = (  # reason, severity
    ("High iowait", "warning"),
    ("Thermal warning", "critical"),
    ("SMART degradation", "critical"),
)
ALERT_WEIGHTS = (0.2, 0.15, 0.2)
ALERT_ACTIONS = (
    "High iowait: check the controller queue and LUN latency.",
    "Thermal events: check cooling and airflow.",
    "SMART degradation: prepare a disk replacement.",
)
HINT_ANOMALIES = 5
# SQL: what to do about a finding
ANOMALY_ACTION = (
    """concat("Check the runbook for '", kind, "' and verify the origin: ", """
    "coalesce(related_cluster_id, related_metric, 'n/a'))"
)
DEFAULT_HINT = (
    "No critical patterns", "No high-confidence anomalies or correlations in current window.",
    "Keep monitoring, compare trends daily, keep the basic runbook check.", 0.4,
)


TEXT = "lower(message)"


def _alert_flags() -> list[Column]:
    return [F.expr(e) for e in (
        f"coalesce(bool_or(coalesce(metric = 'iowait' AND coalesce(value, 0) >= {IOWAIT_LIMIT}, false)), false) AS alert_0",
        f"bool_or(contains({TEXT}, 'thermal')) AS alert_1",
        f"bool_or(contains({TEXT}, 'smart')) AS alert_2",
    )]


def _matches(rule: Correlation) -> str:
    return f"(source = {quoted(rule.source)} AND {TEXT} RLIKE {quoted(rule.pattern)})"


def _rule_counts(rules: Sequence[Correlation]) -> list[Column]:
    return [F.expr(f"count_if({_matches(rule)}) AS rule_{i}") for i, rule in enumerate(rules)]


def fact_columns(rules: Sequence[Correlation] = DEFAULT_RULES) -> list[Column]:
    """Aggregates alert_i (a flag) and rule_i (a count); flags of parts add up by OR, counts by sum."""
    return [*_alert_flags(), *_rule_counts(rules)]


def asset_facts(
    events: DataFrame, rules: Sequence[Correlation] = DEFAULT_RULES, *, limit: int | None = None,
    salt: int = SALT_BUCKETS,
) -> DataFrame:
    """One row per asset with every count the rules need, over its newest `limit` events (None = all)."""
    return latest_per_asset(events, limit, salt=salt).groupBy("asset_id").agg(
        F.count("*").alias("events_total"),
        F.expr("count_if(severity = 'critical') AS critical_count"),
        F.expr("count_if(severity = 'warning') AS warning_count"),
        *fact_columns(rules),
    )


def _alert_array() -> str:
    return "array_compact(array(" + ", ".join(
        f"if(alert_{i}, struct({i} AS alert_no, {quoted(severity)} AS severity, {quoted(text)} AS reason), NULL)"
        for i, (text, severity) in enumerate(ALERTS)
    ) + "))"


def hit_array(rules: Sequence[Correlation]) -> str:
    return "array_compact(array(" + ", ".join(
        f"if(rule_{i} >= {rule.min_count}, struct({i} AS rule_no, {quoted(rule.title)} AS title, "
        f"{rule.confidence}D AS confidence, rule_{i} AS evidence_count, "
        f"{quoted(rule.recommendation)} AS recommendation), NULL)"
        for i, rule in enumerate(rules)
    ) + "))"


def alerts(events: DataFrame, *, limit: int | None = None) -> DataFrame:
    """(asset_id, severity, reason) rows (E-01)."""
    return asset_facts(events, (), limit=limit).selectExpr(
        "asset_id", f"explode({_alert_array()}) AS a"
    ).select("asset_id", "a.alert_no", "a.severity", "a.reason")


def correlations(
    events: DataFrame, rules: Sequence[Correlation] = DEFAULT_RULES, *, limit: int | None = None,
    salt: int = SALT_BUCKETS,
) -> DataFrame:
    """Rules that found enough evidence in an asset's newest events (E-02)."""
    return asset_facts(events, rules, limit=limit, salt=salt).selectExpr(
        "asset_id", f"explode({hit_array(rules)}) AS r"
    ).select("asset_id", "r.*")


def correlation_events(
    events: DataFrame, title: str | None = None, rules: Sequence[Correlation] = DEFAULT_RULES,
    *, asset_id: str | None = None, limit: int | None = None, newest: int = 20,
) -> DataFrame:
    """Events behind a rule, newest first: among the newest `limit` of an asset (None = all);
    without a rule each asset's `newest` events."""
    chosen = next((rule for rule in rules if rule.title == (title or "").strip()), None)
    scope = events if asset_id is None else events.filter(F.col("asset_id") == asset_id)
    if chosen is None:
        out = latest_per_asset(scope, newest)
    else:
        out = latest_per_asset(scope, at_least_one(limit)).filter(_matches(chosen))
    return out.orderBy("asset_id", F.col("seq").desc())


def runbook_hints(anomalies: DataFrame, found: DataFrame, assets: DataFrame | None = None) -> DataFrame:
    """Per asset up to 10 hints: its 5 top anomalies, then its correlations, else one default (E-04).

    anomalies: ranked rows (anomalies.rank_anomalies); found: correlations(); assets: (asset_id)
    of all assets that must have a hint.
    """
    from_anomalies = anomalies.filter(f"anomaly_rank <= {HINT_ANOMALIES}").select(
        "asset_id", F.expr(f"{REASON} AS rationale"),
        F.expr("0 AS part"), F.expr("anomaly_rank AS place"), F.expr("concat(kind, ': ', severity) AS title"),
        F.expr(f"{ANOMALY_ACTION} AS action"),
        F.expr("round(confidence, 2) AS confidence"),
    )
    from_rules = found.selectExpr(
        "asset_id", "concat('Correlation evidence count: ', evidence_count) AS rationale", "1 AS part",
        "rule_no AS place", "title", "recommendation AS action", "round(confidence, 2) AS confidence",
    )
    parts = [from_anomalies, from_rules]
    if assets is not None:
        title, rationale, action, confidence = DEFAULT_HINT
        parts.append(assets.select("asset_id").distinct().selectExpr(
            "asset_id", f"{quoted(rationale)} AS rationale", "2 AS part", "0 AS place", f"{quoted(title)} AS title",
            f"{quoted(action)} AS action", f"{confidence}D AS confidence",
        ))
    ranked = union_all(*parts).selectExpr(
        "*", "row_number() OVER (PARTITION BY asset_id ORDER BY part, place) AS hint_rank"
    )
    # the default stays only where nothing ranks before it
    return ranked.filter("hint_rank <= 10 AND (part < 2 OR hint_rank = 1)").drop("part", "place")


def recommendations(
    events: DataFrame, assets: DataFrame | None = None,
    rules: Sequence[Correlation] = DEFAULT_RULES, *, limit: int | None = None,
) -> DataFrame:
    """Risk score, level and actions per asset (E-09). assets: (asset_id); those without events get 0.05."""
    facts = asset_facts(events, rules, limit=limit)
    if assets is not None:
        facts = assets.select("asset_id").distinct().join(facts, "asset_id", "left")
    hits = hit_array(rules)
    score = " + ".join([
        "0.1D", "least(critical_count * 0.2D, 0.5D)", "least(warning_count * 0.05D, 0.2D)",
        *[f"if(alert_{i}, {weight}D, 0.0D)" for i, weight in enumerate(ALERT_WEIGHTS)],
        f"least(size({hits}) * 0.08D, 0.2D)",
    ])
    quiet = "coalesce(events_total, 0) = 0"
    texts = ", ".join(f"if(alert_{i}, {quoted(text)}, NULL)" for i, text in enumerate(ALERT_ACTIONS))
    return facts.selectExpr(
        "asset_id", f"if({quiet}, 0.05D, least({score}, 0.99D)) AS risk", f"{quiet} AS quiet",
        f"""concat(array_compact(array({texts})), transform({hits}, h ->
            concat('Correlation: ', h.title, ' (', h.evidence_count, ' events)'))) AS actions""",
    ).selectExpr(
        "asset_id", "round(risk, 2) AS risk_score",
        "CASE WHEN risk >= 0.75D THEN 'high' WHEN risk >= 0.4D THEN 'moderate' ELSE 'low' END AS risk_level",
        """CASE WHEN quiet THEN array('Keep monitoring', 'Check trends once a day')
           WHEN size(actions) = 0 THEN array('Check the runbook and alert thresholds') ELSE actions END AS actions""",
    )
