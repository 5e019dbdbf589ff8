"""Checks and fingerprints of incoming rows (A-02, A-03, A-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens import schemas as S


def _filled(name: str) -> Column:
    return F.coalesce(F.length(F.trim(F.col(name))) > 0, F.lit(False))


def _member(name: str, allowed) -> Column:
    return F.coalesce(F.col(name).isin(*allowed), F.lit(False))


def _range(name: str, low: int, high: int | None = None) -> Column:
    ok = F.col(name) >= low
    if high is not None:
        ok = ok & (F.col(name) <= high)
    return F.coalesce(ok, F.lit(False))


# rule name -> condition an accepted row fulfils
BARE_EVENT_RULES = {
    "asset_id": lambda: F.col("asset_id").isNotNull(),
    "source": lambda: F.col("source").isNotNull(),
    "message": lambda: F.col("message").isNotNull(),
    "severity": lambda: _member("severity", S.SEVERITIES),
    "ts": lambda: F.col("ts").isNotNull(),
}
# an event without an arrival number would meet nothing in joins and orders by seq
EVENT_RULES = BARE_EVENT_RULES | {"seq": lambda: F.col("seq").isNotNull()}
ASSET_RULES = {
    "id": lambda: F.col("id").isNotNull(),
    "name": lambda: F.col("name").isNotNull(),
    "asset_type": lambda: _member("asset_type", S.ASSET_TYPES),
}
TARGET_RULES = {
    "id": lambda: F.col("id").isNotNull(),
    "name": lambda: F.col("name").isNotNull(),
    "address": lambda: F.col("address").isNotNull(),
    "port": lambda: F.col("port").isNotNull(),
    "asset_id": lambda: _filled("asset_id"),
    "collector_type": lambda: _member("collector_type", S.COLLECTOR_TYPES),
    "poll_interval_sec": lambda: _range("poll_interval_sec", 10),
    "winrm_batch_size": lambda: _range("winrm_batch_size", 1, 500),
    "ssh_tail_lines": lambda: _range("ssh_tail_lines", 1, 500),
    "ilo_event_limit": lambda: _range("ilo_event_limit", 1, 500),
    "csb_max_files": lambda: _range("csb_max_files", 1, 50000),
}
SCORE_RULES = {
    "confidence": lambda: _range("confidence", 0, 1),
}
RISK_RULES = {
    "risk_score": lambda: _range("risk_score", 0, 1),
}


def with_errors(df: DataFrame, rules: dict) -> DataFrame:
    """Add `errors`: the names of the rules a row breaks, in rule order."""
    broken = [F.when(~condition(), F.lit(name)) for name, condition in rules.items()]
    return df.withColumn("errors", F.array_compact(F.array(*broken)))


def validate(df: DataFrame, rules: dict) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and quarantined rows; the latter say in `errors` what is wrong."""
    checked = with_errors(df, rules)
    return checked.filter(F.size("errors") == 0).drop("errors"), checked.filter(F.size("errors") > 0)


def check_assets(rows: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split rows into those whose asset_id is registered and orphans.

    No broadcast is forced: Spark broadcasts the asset ids while they fit its threshold and falls
    back to a skew-split sort-merge join beyond it.
    """
    known = assets.select(F.col("id").alias("asset_id")).distinct()
    return rows.join(known, "asset_id", "left_semi"), rows.join(known, "asset_id", "left_anti")


def fingerprint() -> Column:
    """sha256 over the content of an event; its time is not part of it."""
    return F.sha2(
        F.concat_ws(
            "|", "asset_id", "source", "message",
            F.coalesce(F.col("metric"), F.lit("")),
            F.coalesce(F.col("value").cast("string"), F.lit("")),
            "severity",
        ).cast("binary"),
        256,
    )


def with_fingerprint(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", fingerprint())
