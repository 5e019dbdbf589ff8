"""Collector run history: state, run events, diagnostics (A-17, A-18, F-10 ... F-13, F-16)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens.functions.ranking import BLOCK_ROWS, at_least_one, running, with_position
from opslens.operators.tables import tenant_scope

CRITICAL_STREAK = 3
VIEWER_ROWS = 40
PROTOCOL_SOURCES = {"csb_merp_share": "agentless_csb_merp"}


def with_streak(runs: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Set failure_streak of every run: failed runs of its target since the last good one.

    Two running values in run order, computed block by block, so a target with most of the runs
    does not end up in one task.
    """
    failed = F.col("last_error").isNotNull().cast("long")
    counted = running(
        runs.drop("failure_streak"), "target_id", "id", {"_failures": ("sum", failed)}, block_rows=block_rows
    )
    at_success = F.when(F.col("last_error").isNull(), F.col("_failures"))
    based = running(counted, "target_id", "id", {"_base": ("max", at_success)}, block_rows=block_rows)
    return based.withColumn(
        "failure_streak", F.col("_failures") - F.coalesce("_base", F.lit(0))
    ).drop("_failures", "_base")


def collector_state(runs: DataFrame, *, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Latest state of every target; success time and cursor survive failed runs (A-17)."""
    ok_id = F.when(F.col("last_error").isNull(), F.col("id"))
    return with_streak(runs, block_rows=block_rows).groupBy("target_id").agg(
        F.max_by("ts", ok_id).alias("last_success_ts"),
        F.max_by("ts", "id").alias("last_run_ts"),
        F.max_by("last_error", "id").alias("last_error"),
        F.max_by("last_cursor", ok_id).alias("last_cursor"),
        F.max_by("failure_streak", "id").alias("failure_streak"),
    )


def run_outcome_events(runs: DataFrame, targets: DataFrame) -> DataFrame:
    """Events a run itself causes: failure, heartbeat when nothing was new, latency of a probe (A-18).

    runs: history columns plus latency_ms (null unless the run was a reachability probe), with
    failure_streak already set.
    """
    named = runs.join(
        targets.select(F.col("id").alias("target_id"), "asset_id", "name", "address", "port"), "target_id"
    )
    proto = F.when(F.col("collector_type") == "csb_merp_share", F.lit("csb")).otherwise(F.col("collector_type"))
    source = F.when(F.col("collector_type") == "csb_merp_share", F.lit("agentless_csb_merp")).otherwise(
        F.concat(F.lit("agentless_"), "collector_type")
    )
    who = F.concat(F.lit("["), proto, F.lit("] "))
    failed = F.col("last_error").isNotNull()
    probe = F.col("latency_ms").isNotNull()
    message = (
        F.when(failed, F.concat(who, F.lit("pull failed for '"), "name", F.lit("': "), "last_error"))
        .when(probe, F.concat(who, F.lit("target '"), "name", F.lit("' reachable at "), "address", F.lit(":"),
                              F.col("port").cast("string")))
        .otherwise(F.concat(who, F.lit("no new events for '"), "name", F.lit("', cursor="),
                            F.coalesce("last_cursor", F.lit(""))))
    )
    return named.filter(failed | probe | (F.col("accepted_events") == 0)).select(
        "asset_id", source.alias("source"), message.alias("message"),
        F.when(failed, F.lit("collector_failure_streak")).when(probe, F.lit("collector_latency_ms")).alias("metric"),
        F.when(failed, F.col("failure_streak").cast("double")).when(probe, F.col("latency_ms")).alias("value"),
        F.when(failed & (F.col("failure_streak") >= CRITICAL_STREAK), F.lit("critical"))
        .when(failed, F.lit("warning")).otherwise(F.lit("info")).alias("severity"),
        "ts",
    )


def query_history(
    history: DataFrame, *, target_id: str | None = None, collector_type: str | None = None,
    has_error: bool | None = None, limit: int = 100, role: str = "operator",
) -> DataFrame:
    """Newest runs that match; a viewer sees at most 40 (F-10)."""
    out = history
    if target_id:
        out = out.filter(F.col("target_id") == target_id)
    if collector_type:
        out = out.filter(F.col("collector_type") == collector_type)
    if has_error is not None:
        error = F.col("last_error").isNotNull()
        out = out.filter(error if has_error else ~error)
    if role == "viewer":
        limit = min(limit, VIEWER_ROWS)
    return out.orderBy(F.col("id").desc()).limit(at_least_one(limit))


def diagnostics_summary(history: DataFrame) -> DataFrame:
    """Runs, good and failed runs, events: one row per collector type and a total row (type null) (F-11)."""
    failed = F.coalesce(F.col("last_error") != "", F.lit(False))
    return history.rollup("collector_type").agg(
        F.count("*").alias("runs"),
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(F.col("accepted_events").cast("long")), F.lit(0)).alias("accepted_events_sum"),
    )


def diagnostics_trend(history: DataFrame, limit: int | None = None) -> DataFrame:
    """All runs, or the newest `limit`, as a chronological series with an index from 0 (F-12)."""
    newest = history if at_least_one(limit) is None else history.orderBy(F.col("id").desc()).limit(limit)
    return with_position(newest.withColumn("_all", F.lit(0)), "_all", "id").select(
        (F.col("pos") - 1).cast("bigint").alias("idx"), "id", "ts", "accepted_events",
        F.coalesce(F.col("last_error") != "", F.lit(False)).alias("has_error"),
    )


def collector_status(targets: DataFrame, state: DataFrame) -> DataFrame:
    """Target table with its latest state; targets that never ran are kept."""
    rows = targets.withColumnRenamed("id", "target_id").join(state, "target_id", "left")
    return rows.select(
        "target_id", "name", "collector_type", "address", "port", "enabled",
        (F.col("last_error").isNull() & F.col("last_run_ts").isNotNull()).alias("last_ok"),
        F.coalesce("last_error", F.lit("ok")).alias("last_message"),
        "last_run_ts", "last_success_ts", "last_cursor",
        F.coalesce(F.col("failure_streak").cast("long"), F.lit(0)).alias("failure_streak"),
    )


def collector_health(targets: DataFrame, state: DataFrame) -> DataFrame:
    """One row: targets tracked, failed at their last run, never run (F-13)."""
    ran = F.col("last_run_ts").isNotNull()
    return collector_status(targets, state).agg(
        F.count("*").alias("tracked"),
        F.count_if(ran & ~F.col("last_ok")).alias("failed"),
        F.count_if(~ran).alias("stale"),
    )


def tenant_history(history: DataFrame, targets: DataFrame, tenant: str | None) -> DataFrame:
    """Runs whose target watches an asset of the tenant (F-16)."""
    if not (tenant or "").strip():
        return history
    own = tenant_scope(targets, tenant).select(F.col("id").alias("target_id"))
    return history.join(own, "target_id", "left_semi")
