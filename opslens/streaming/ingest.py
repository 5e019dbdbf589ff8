"""The ingest chain as one stream (A-01 ... A-06, B-05): number, check, de-duplicate, write three tables.

Every micro-batch writes its rows below `epoch=<n>` of each table, replacing what an earlier try left there. It counts
once the table of last kept times takes the batch, in one step, and readers look at counted batches only. So a stream
that is killed anywhere and started again gives each event once, and all three tables show the same batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from opslens.operators import ingest
from opslens.operators.dedup import kept_rows
from opslens.schemas import EVENT
from opslens.session import shared_dir
from opslens.sinks.exports import with_event_date
from opslens.sinks.keyed import KeyedTable
from opslens.sources.batches import number_events

LAST_KEPT = T.StructType([T.StructField("fingerprint", T.StringType()), T.StructField("last_kept", T.LongType())])
_EVENT = [T.StructField(field.name, field.dataType) for field in EVENT.fields]
_EPOCH = T.StructField("epoch", T.LongType())
SINKS = {
    "accepted": T.StructType([
        *_EVENT, T.StructField("fingerprint", T.StringType()), T.StructField("event_date", T.DateType()), _EPOCH]),
    "quarantined": T.StructType([*_EVENT, T.StructField("errors", T.ArrayType(T.StringType())), _EPOCH]),
    "orphans": T.StructType([*_EVENT, _EPOCH]),
}


def last_kept(spark: SparkSession, path: str, *, buckets: int = 64) -> KeyedTable:
    """The time of the last kept event per fingerprint; its manifest says which batches count."""
    return KeyedTable(spark, f"{path}/last_kept", LAST_KEPT, ["fingerprint"], buckets=buckets)


def _write(rows: DataFrame, path: str, *by: str) -> None:
    rows.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(path)


def ingest_batch(
    events: DataFrame, epoch: int, assets: DataFrame, path: str, *, window_sec: float = 300, buckets: int = 64,
    on_written: Callable[[int], None] | None = None,
) -> None:
    """One micro-batch of events; does nothing if the batch counts already. assets: (id).

    Events without a number get one. Those that break a rule are quarantined with its name, those of unknown assets are
    orphans, of the rest the first of each window is accepted. on_written is called when all is written but does not count yet.
    """
    state = last_kept(events.sparkSession, path, buckets=buckets)
    if state.holds(epoch):
        return
    window_us = int(window_sec * 1_000_000)
    landed = events.persist(StorageLevel.DISK_ONLY)
    try:
        valid, broken = ingest.validate(number_events(landed, epoch), ingest.EVENT_RULES)
        known, orphans = ingest.check_assets(valid, assets)
        _write(broken, f"{path}/quarantined/epoch={epoch}")
        _write(orphans, f"{path}/orphans/epoch={epoch}")
        # a row not newer than last + W is dropped whatever else the batch brings, and the first one beyond is kept;
        # whole rows wait for the numbers of the kept ones, only what decides meets the table of last kept times
        printed = ingest.with_fingerprint(known)
        slim = printed.select("fingerprint", "seq", "ts").join(state.read(), "fingerprint", "left")
        beyond = F.unix_micros("ts") > F.col("last_kept") + window_us
        fresh = slim.filter(F.coalesce(beyond, F.lit(True)))
        accepted = printed.join(kept_rows(fresh, window_sec), "seq", "left_semi")
        kept = with_event_date(accepted).select(*EVENT.names, "fingerprint", "event_date")
        _write(kept.sortWithinPartitions("event_date", "asset_id"), f"{path}/accepted/epoch={epoch}", "event_date")
    finally:
        landed.unpersist()
    if on_written:
        on_written(epoch)
    accepted = _read(events.sparkSession, path, "accepted").filter(F.col("epoch") == epoch)
    state.upsert(accepted.groupBy("fingerprint").agg(F.max(F.unix_micros("ts")).alias("last_kept")), "last_kept", batch=epoch)


def ingest_stream(
    events: DataFrame, assets: DataFrame, path: str, checkpoint: str, *, every: str | None = None, **options
) -> DataStreamWriter:
    """The chain over a stream of events (sources.batches.stream_event_batches); call start() on the result.

    `path` belongs to one stream and its checkpoint. options: those of ingest_batch. Without `every` it takes what is there and stops.
    """
    shared_dir(events.sparkSession)

    def publish(batch: DataFrame, epoch: int) -> None:
        ingest_batch(batch, epoch, assets, path, **options)

    writer = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)


def _read(spark: SparkSession, path: str, sink: str) -> DataFrame:
    return spark.read.schema(SINKS[sink]).option("basePath", f"{path}/{sink}").parquet(f"{path}/{sink}")


def read_sink(spark: SparkSession, path: str, sink: str) -> DataFrame:
    """The rows of one table, 'accepted', 'quarantined' or 'orphans', of all batches that count."""
    done = last_kept(spark, path).manifest()["batch"]
    if done < 0:
        return spark.createDataFrame([], SINKS[sink])
    return _read(spark, path, sink).filter(F.col("epoch") <= done)
