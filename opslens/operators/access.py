"""Access evaluation, audit roll-ups, token rejects, compliance reports (G-01 ... G-09)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.ranking import at_least_one
from opslens.functions.text import quoted
from opslens.schemas import ROLES, TOKEN_CLAIMS

AUDIT_KEEP = 500


class AccessRule(NamedTuple):
    method: str
    prefix: str
    min_role: str
    action: str
    default_role: str


# fixed values: the built-in rules; the first matching one decides
DEFAULT_RULES = tuple(AccessRule(*row) for row in (
    ("GET", "/auth/audit", "admin", "read auth audit", "viewer"),
    ("GET", "/auth/audit.csv", "admin", "export auth audit", "viewer"),
    ("GET", "/auth/audit/summary", "admin", "read auth audit summary", "viewer"),
    ("GET", "/auth/audit/alerts", "admin", "read auth audit alerts", "viewer"),
    ("GET", "/auth/jwt/reject-telemetry", "admin", "read jwt reject telemetry", "viewer"),
    ("GET", "/auth/jwt/reject-telemetry/details", "admin", "read jwt reject telemetry details", "viewer"),
    ("GET", "/auth/compliance/status", "admin", "read compliance status", "viewer"),
    ("GET", "/auth/compliance/reports", "admin", "read compliance reports", "viewer"),
    ("POST", "/auth/compliance/run", "admin", "run compliance report", "viewer"),
    ("POST", "/auth/compliance/purge", "admin", "run compliance purge", "viewer"),
    ("GET", "/auth/compliance/deliveries", "admin", "read compliance deliveries", "viewer"),
    ("GET", "/worker/history", "operator", "read worker history", "admin"),
    ("GET", "/worker/history.csv", "operator", "export worker history", "admin"),
    ("GET", "/worker/targets", "operator", "read worker targets", "admin"),
    ("POST", "/worker/run-once", "operator", "run worker", "admin"),
    ("GET", "/collectors", "operator", "read collectors", "admin"),
    ("POST", "/collectors", "operator", "write collectors", "admin"),
    ("DELETE", "/collectors", "operator", "delete collectors", "admin"),
    ("POST", "/assets", "operator", "write assets", "admin"),
    ("POST", "/events", "operator", "write events", "admin"),
    ("POST", "/ingest/events", "operator", "ingest events", "admin"),
    ("POST", "/ingest/csb-merp", "operator", "ingest csb-merp logs", "admin"),
))


def role_rank(column: str) -> str:
    """SQL: viewer 0, operator 1, admin 2."""
    return f"CASE {column} " + " ".join(f"WHEN '{name}' THEN {rank}" for rank, name in enumerate(ROLES)) + " END"


def evaluate_access(requests: DataFrame, rules: Sequence[AccessRule] = DEFAULT_RULES) -> DataFrame:
    """Request log -> audit rows: one allow or deny per request that a rule covers (G-01).

    The rule list is a CASE expression, so first match wins by construction and nothing is joined.
    A request without a role is judged with the default role of its rule, an unknown role as viewer.
    """
    cases = " ".join(
        f"WHEN method = {quoted(r.method)} AND startswith(path, {quoted(r.prefix)}) THEN struct("
        f"{quoted(r.min_role)} AS min_role, {quoted(r.action)} AS action, {quoted(r.default_role)} AS default_role)"
        for r in rules
    )
    known = ", ".join(quoted(name) for name in ROLES)
    return (
        requests.withColumn("rule", F.expr(f"CASE {cases} END")).filter("rule IS NOT NULL")
        .withColumn("given", F.expr("coalesce(nullif(lower(trim(role)), ''), rule.default_role)"))
        .withColumn("role", F.expr(f"if(given IN ({known}), given, 'viewer')"))
        .selectExpr(
            "id", "ts", "path", "role", "rule.action AS action",
            f"if({role_rank('role')} >= {role_rank('rule.min_role')}, 'allow', 'deny') AS result",
        )
    )


def keep_last(df: DataFrame, n: int | None = AUDIT_KEEP, order: Sequence[str] = ("id",)) -> DataFrame:
    """The newest n rows, all for None; a retention ring (G-02)."""
    if at_least_one(n) is None:
        return df
    return df.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def list_audit(audit: DataFrame, limit: int = 100) -> DataFrame:
    return keep_last(audit, limit)


def audit_summary(audit: DataFrame, *, top_actions: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(one-row totals, rows per role, most frequent actions) (G-03)."""
    totals = audit.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("result") == "allow").alias("allow"),
        F.count_if(F.col("result") == "deny").alias("deny"),
    )
    by_role = audit.groupBy("role").agg(F.count("*").alias("n"))
    actions = audit.groupBy("action").agg(F.count("*").alias("n"))
    return totals, by_role, actions.orderBy(F.col("n").desc(), "action").limit(top_actions)


def deny_alerts(audit: DataFrame, lookback: int = 200, threshold: int = 20) -> DataFrame:
    """One row if the newest `lookback` audit rows hold `threshold` denies or more, else none (G-04)."""
    threshold = max(1, threshold)
    newest = keep_last(audit, lookback)
    return (
        newest.agg(F.count_if(F.col("result") == "deny").alias("deny"))
        .filter(F.col("deny") >= threshold)
        .select(F.lit("high_deny_rate").alias("kind"), "deny", F.lit(lookback).cast("bigint").alias("lookback"),
                F.lit(threshold).cast("bigint").alias("threshold"))
    )


def token_claims(token: Column) -> Column:
    """Claims in the body of a three-part token, unverified; null if it cannot be read."""
    parts = F.split(token, r"\.")
    body = F.translate(F.get(parts, F.lit(1)), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    text = F.try_to_binary(padded, F.lit("base64")).cast("string")
    return F.when(F.size(parts) == 3, F.from_json(text, TOKEN_CLAIMS))


def reject_events(rejects: DataFrame) -> DataFrame:
    """(id, ts, reason, token) -> (id, ts, reason, issuer, client)."""
    read = rejects.withColumn("c", token_claims(F.col("token")))
    return read.select(
        "id", "ts", "reason",
        F.coalesce("c.iss", F.lit("unknown")).alias("issuer"),
        F.coalesce(F.nullif("c.azp", F.lit("")), F.nullif("c.client_id", F.lit("")), F.lit("unknown")).alias("client"),
    )


def reject_telemetry(rejects: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows per reason, rows per issuer and client, newest events) of refused tokens (G-05)."""
    read = reject_events(rejects)
    return (
        read.groupBy("reason").agg(F.count("*").alias("n")),
        read.groupBy("issuer", "client").agg(F.count("*").alias("n")),
        keep_last(read, limit),
    )


def compliance_report(
    audit: DataFrame, rejects: DataFrame, *, ts: int, trigger: str = "manual", limit: int | None = None
) -> DataFrame:
    """One report row as of epoch second `ts`: totals of all or the newest `limit` audit rows, all rejects by reason (G-06)."""
    newest = keep_last(audit.filter(F.col("ts") <= ts), limit)
    totals = newest.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("result") == "allow").alias("allow"),
        F.count_if(F.col("result") == "deny").alias("deny"),
    )
    roles = newest.groupBy("role").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("role", "n")))).alias("by_role")
    )
    refused = rejects.filter(F.col("ts") <= ts).groupBy("reason").agg(F.count("*").alias("n")).agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("reason", "n")))).alias("jwt_rejects")
    )
    one = F.lit(1).alias("_one")
    return (
        totals.select(one, "*").join(roles.select(one, "*"), "_one").join(refused.select(one, "*"), "_one")
        .select(
            F.lit(f"cr-{ts}").alias("id"), F.lit(ts).cast("bigint").alias("ts"), F.lit(trigger).alias("trigger"),
            F.struct("rows", "allow", "deny", "by_role", "jwt_rejects").alias("summary"),
        )
    )


def route_reports(reports: DataFrame, channels: dict[str, str]) -> DataFrame:
    """One delivery row per report and configured channel, else one 'skipped' row (G-07)."""
    configured = {name: dest.strip() for name, dest in channels.items() if dest and dest.strip()}
    routes = [(name, dest, "configured") for name, dest in configured.items()] or [("none", "", "skipped")]
    options = F.array(*[
        F.struct(F.lit(n).alias("channel"), F.lit(d).alias("destination"), F.lit(s).alias("status"))
        for n, d, s in routes
    ])
    return reports.select(
        "ts", F.col("id").alias("report_id"), F.explode(options).alias("r")
    ).select("ts", "report_id", "r.*")


def report_history(reports: DataFrame, *, limit: int = 20, retention: int = 100, report_id: str | None = None) -> DataFrame:
    """The newest reports inside the retention ring, or the one asked for (G-08)."""
    kept = keep_last(reports, max(10, retention), order=("ts", "id"))
    if report_id is not None:
        return kept.filter(F.col("id") == report_id)
    return keep_last(kept, limit, order=("ts", "id"))


def purge(
    audit: DataFrame, history: DataFrame, policy_audit: DataFrame, *, now: int,
    audit_max_age_sec: int = 30 * 24 * 3600, history_max_age_sec: int = 30 * 24 * 3600,
    policy_audit_max_age_sec: int = 30 * 24 * 3600,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """(the three logs without rows older than their age, one row with the deleted counts) (G-09).

    `now` is epoch seconds; history.ts is a timestamp, the other two logs keep epoch seconds.
    """
    epoch = F.unix_timestamp(F.col("ts").cast("timestamp"))
    plan = {
        "audit": (audit, F.col("ts"), now - max(0, audit_max_age_sec)),
        "worker_history": (history, epoch, now - max(0, history_max_age_sec)),
        "policy_audit": (policy_audit, F.col("ts"), now - max(0, policy_audit_max_age_sec)),
    }
    kept, counts = {}, None
    for name, (table, ts, cutoff) in plan.items():
        kept[name] = table.filter(ts >= cutoff)
        deleted = table.agg(F.count_if(ts < cutoff).alias(f"deleted_{name}")).withColumn("_one", F.lit(1))
        counts = deleted if counts is None else counts.join(deleted, "_one")
    return kept, counts.drop("_one")
