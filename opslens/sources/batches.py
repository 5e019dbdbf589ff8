"""Landed event batches (A-01)."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from opslens.functions.merging import union_all
from opslens.schemas import EVENT_BATCH
from opslens.session import stage

BATCH_BITS = 24
# unnumbered events: 30 bits for the read, 32 for the place in it, all below 0
READ_BITS, PLACE_BITS = 30, 32
RUN_BITS = 33  # of a running id: the place in its task
EPOCH = 1_704_067_200  # 2024-01-01, the first second that read ids count from
_last_read = 0


def new_read_id() -> int:
    """A number for a read, higher than those of earlier reads: the second, or the next one free in this process."""
    global _last_read
    _last_read = max(_last_read + 1, int(time.time()) - EPOCH)
    return _last_read


def number_events(events: DataFrame, read_id: int) -> DataFrame:
    """Fill null seq with negative numbers in the order the rows are read, unique over reads of other read_id.

    Not for streams, but for their micro-batches: number_events(df, epoch) in foreachBatch. Unnumbered rows are
    written to the shared folder once with their running ids, since a second evaluation of a plan may deal rows out
    differently; numbers come from what was written. Runs one job when called; numbered rows are not copied.
    """
    if not 0 <= read_id < 1 << READ_BITS:
        raise ValueError(f"read_id must be from 0 to {(1 << READ_BITS) - 1}")
    held = stage(events.filter("seq IS NULL").withColumn("_at", F.monotonically_increasing_id()), "unnumbered-events")
    rows = held.withColumn("_p", F.shiftright("_at", RUN_BITS))
    # running ids of one task are consecutive, so rows meet only a table with one row per task
    before = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
    parts = rows.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_at").alias("_first")).select(
        "_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at") - F.col("_first")
    place = F.when(place < 1 << PLACE_BITS, place).otherwise(
        F.raise_error(F.lit("too many events for one read; read fewer files at a time")).cast("long"))
    named = rows.join(parts, "_p").withColumn("seq", F.lit(-(1 << 62) + (read_id << PLACE_BITS)) + place)
    return union_all(events.filter("seq IS NOT NULL"), named.select(*events.columns))


def explode_batches(batches: DataFrame, now: Column | None = None, *, read_id: int | None = None) -> DataFrame:
    """(batch_id, events) -> events with defaults: severity info, time `now`.

    The landing process numbers its batches in arrival order. An event's seq is the batch number
    followed by the place in the batch, so numbering needs no sort. Events of a batch without a number
    get negative ones from number_events; without a read_id each call takes a new one (processes that may read
    in the same second name their own). In a stream seq stays null: EVENT_RULES quarantine such events,
    number_events in foreachBatch numbers them.
    """
    now = F.current_timestamp() if now is None else now
    rows = batches.select("batch_id", F.posexplode("events").alias("pos", "e"))
    seq = F.shiftleft(F.col("batch_id"), BATCH_BITS) + F.col("pos")
    events = rows.select(
        seq.alias("seq"),
        "e.asset_id", "e.source", "e.message", "e.metric", "e.value",
        F.coalesce("e.severity", F.lit("info")).alias("severity"),
        F.when(F.col("e.timestamp").isNull(), now.cast("timestamp"))
        .otherwise(F.try_to_timestamp("e.timestamp")).alias("ts"),
    )
    if batches.isStreaming:
        return events
    return number_events(events, new_read_id() if read_id is None else read_id)


def broken_batches(spark: SparkSession, path: str) -> DataFrame:
    """(line, file): lines of a folder of batches that are no JSON object, for quarantine."""
    lines = spark.read.text(path).select(F.trim("value").alias("line"), F.col("_metadata.file_path").alias("file"))
    parsed = F.get_json_object("line", "$")
    return lines.filter((F.col("line") != "") & (parsed.isNull() | ~F.startswith("line", F.lit("{"))))


def read_event_batches(
    spark: SparkSession, path: str, now: Column | None = None, *, read_id: int | None = None
) -> DataFrame:
    """Read a folder of batches, one JSON object {"batch_id": n, "events": [...]} per line."""
    return explode_batches(spark.read.schema(EVENT_BATCH).json(path), now, read_id=read_id)


def stream_event_batches(spark: SparkSession, path: str, *, max_files: int = 1000) -> DataFrame:
    """The same folder as a stream; events of batches without a number have no seq (see explode_batches)."""
    return explode_batches(
        spark.readStream.schema(EVENT_BATCH).option("maxFilesPerTrigger", max_files).json(path)
    )
