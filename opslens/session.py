"""Session settings the plans in this package are written for."""

from __future__ import annotations

import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

# Runtime SQL settings that shape the physical plan.
PLAN_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # see functions.merging.union_all
    "spark.sql.unionOutputPartitioning": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # the per-asset stages are heavy on CPU and light on bytes: do not merge their partitions to 1 MB
    "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
    # a device payload that repeats a key still counts, with the last value (normalize.redfish_entries)
    "spark.sql.variant.allowDuplicateKeys": "true",
    # row_number() <= n is pruned before the shuffle only up to this n (Spark's default is 1000,
    # the largest analysis window is 2000)
    "spark.sql.optimizer.windowGroupLimitThreshold": "20000",
    # state of streaming.dedup lives outside the heap and needs this store
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

# spark.checkpoint.dir itself cannot be set once the session runs
STAGING_KEY = "spark.opslens.staging"


def tune(spark: SparkSession) -> SparkSession:
    """Apply PLAN_SETTINGS to a session and return it."""
    for key, value in PLAN_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for checkpoints and staged tables.

    The cluster names it in spark.checkpoint.dir. Only a local session may fall back to a
    temporary folder of this machine, which is kept under STAGING_KEY for the session's later calls.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get(STAGING_KEY, None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set; name a folder all executors share")
    folder = tempfile.mkdtemp(prefix="opslens-")
    spark.conf.set(STAGING_KEY, folder)
    return folder


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    For a reduced table that several branches of a plan use: the input behind it is read once, and a
    lost executor costs a re-read of this table only. The files stay until the folder is cleaned.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship(module: str) -> None:
    """Send the module's code along with its tasks, so that workers need no installed package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])
