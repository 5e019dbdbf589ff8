"""Live roll-ups (F-14, streaming F-05)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def diagnostics_stream(history: DataFrame) -> DataFrame:
    """Running totals per collector type of a run-history stream; write it in complete mode."""
    failed = F.coalesce(F.col("last_error") != "", F.lit(False))
    return history.groupBy("collector_type").agg(
        F.count("*").alias("runs"),
        F.count_if(~failed).alias("ok"),
        F.count_if(failed).alias("errors"),
        F.coalesce(F.sum(F.col("accepted_events").cast("long")), F.lit(0)).alias("accepted_events_sum"),
    )


def daily_trend_stream(events: DataFrame, *, late: str | None = None) -> DataFrame:
    """Events per day, open days included; write it in complete (or update) mode.

    State is a row per day, so it is kept and no late event is lost. With `late` a day is final, and its
    state released, once the watermark has passed its end; append mode then emits closed days.
    """
    seen = events if late is None else events.withWatermark("ts", late)
    return (
        seen.groupBy(F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("events"))
        .select(F.to_date("w.start").alias("day"), "events")
    )


def feed(
    table: DataFrame, publish: Callable[[DataFrame, int], None], checkpoint: str, *, every: str | None = "3 seconds"
) -> DataStreamWriter:
    """Hand the whole current table to publish(df, batch_id) after each batch; call start() on the result."""
    writer = table.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(publish)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
