"""Files a result can be written to: CSV, JSON, partitioned parquet (B-05, H-01 ... H-05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

# fixed values: column order of the exports
AUDIT_CSV = ("ts", "path", "role", "action", "result")
HISTORY_CSV = (
    "ts", "target_id", "collector_type", "accepted_events", "failure_streak", "last_cursor", "last_error",
)
POLICY_AUDIT_CSV = ("ts", "policy_id", "tenant_id", "action", "actor_role", "details")
BRIEF_CSV = ("asset_id", "confidence", "headline", "anomaly_reasons", "runbook_actions", "dependency_hotspots")


def _texts(df: DataFrame, columns: Sequence[str]) -> list[Column]:
    """Columns ready for CSV: lists joined with '; ', null as an empty string."""
    types = dict(df.dtypes)
    out = []
    for name in columns:
        col = F.col(name)
        if types[name].startswith("array"):
            col = F.concat_ws("; ", col)
        elif types[name] == "string":
            col = F.coalesce(col, F.lit(""))
        out.append(col.alias(name))
    return out


def csv_lines(
    df: DataFrame, columns: Sequence[str], *, order: str | None = None, quote_all: bool = False
) -> DataFrame:
    """The CSV text of every row in `line` (plus the order column): texts quoted, quotes doubled."""
    types = dict(df.dtypes)

    def cell(name: str) -> Column:
        value = F.coalesce(F.col(name).cast("string"), F.lit(""))
        if not quote_all and types[name] in ("int", "bigint", "double", "boolean"):
            return value
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    keep = [F.col(order).alias("_order")] if order else []
    lined = df.select(*_texts(df, columns), *keep).select(
        F.concat_ws(",", *[cell(name) for name in columns]).alias("line"), *(["_order"] if order else [])
    )
    return lined.withColumnRenamed("_order", order) if order else lined


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """Write the columns as CSV files with a header; every task writes its own file."""
    df.select(*_texts(df, columns)).write.mode(mode).csv(
        path, header=True, quoteAll=True, quote='"', escape='"', emptyValue=""
    )


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write nested result documents, one JSON object per line."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def json_documents(df: DataFrame, key: str) -> DataFrame:
    """(key, document): each row as one JSON text."""
    return df.select(key, F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def with_event_date(events: DataFrame) -> DataFrame:
    return events.withColumn("event_date", F.to_date("ts"))


def write_events(events: DataFrame, path: str, mode: str = "append") -> None:
    """Append events to the parquet table partitioned by day.

    Rows are sorted by day inside each task so that a task keeps one file open at a time; nothing is
    shuffled, so a day with most of the rows is still written by many tasks.
    """
    dated = with_event_date(events)
    dated.sortWithinPartitions("event_date", "asset_id").write.mode(mode).partitionBy("event_date").parquet(path)


def stream_events(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """The same table as a streaming sink; call start() on the result."""
    return (
        with_event_date(events).writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date")
    )
