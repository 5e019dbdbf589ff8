"""Keyed tables that are changed in place (B-01, B-02).

Rows lie in hash buckets of their key, one folder of parquet files each. A change reads and rewrites the buckets its keys
fall into; all others stay as they are. Files in force are named by a manifest, a small JSON file per version, which
appears in one step by a rename: readers see the table before a change or after it, and a write that dies half-way
leaves nothing but files nobody names. One writer at a time; a second one finds its version taken and fails.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.operators import tables
from opslens.session import stage

BUCKET = "table_bucket"


class KeyedTable:
    """A table at `path` on a file system that all executors share.

    `buckets` counts for a new table only; choose it so that a bucket is a few hundred megabytes, as one task rewrites it.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], *, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._path("versions").getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = buckets
        self.buckets = self.manifest()["buckets"]

    def _path(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def _names(self, folder: str) -> list[str]:
        if not self._fs.exists(self._path(folder)):
            return []
        return sorted(found.getPath().getName() for found in self._fs.listStatus(self._path(folder)))

    def versions(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self._names("versions") if name.endswith(".json")]

    def manifest(self, version: int | None = None) -> dict:
        """version, number of buckets, folder per bucket, and the highest batch number that the table holds."""
        known = self.versions()
        if not known:
            return {"version": 0, "buckets": self.buckets, "parts": {}, "batch": -1}
        wanted = known[-1] if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/versions/{wanted:012d}.json", wholetext=True).first()[0])

    def _commit(self, manifest: dict) -> None:
        final, draft = self._path(f"versions/{manifest['version']:012d}.json"), self._path(f"drafts/{uuid.uuid4().hex}")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(manifest), "utf-8"))
        out.close()
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"version {manifest['version']} of {self.path} was written by someone else")

    def _read(self, parts: list[str]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/{part}" for part in parts])

    def read(self, version: int | None = None) -> DataFrame:
        """The newest version of the table, or an earlier one."""
        return self._read(list(self.manifest(version)["parts"].values()))

    def _with_bucket(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _change(self, changes: DataFrame, change, batch: int | None) -> list[int]:
        """Rewrite the buckets of `changes` (one row per key, written already) by change(base rows, changes, how many).

        Both come with their bucket, and what it returns lies in as many partitions, dealt out by bucket.
        """
        now = self.manifest()
        # at most one row per bucket
        touched = sorted(row[0] for row in self._with_bucket(changes).select(BUCKET).distinct().collect())
        old = now["parts"]
        parts = {bucket: part for bucket, part in old.items() if int(bucket) not in touched}
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            base = self._with_bucket(self._read([old[str(b)] for b in touched if str(b) in old]))
            rows = change(base, self._with_bucket(changes), len(touched))
            rows.write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
            written = [name for name in self._names(folder) if name.startswith(BUCKET + "=")]
            parts |= {name.split("=")[1]: f"{folder}/{name}" for name in written}
        self._commit({
            "version": now["version"] + 1, "buckets": self.buckets, "parts": parts,
            "batch": now["batch"] if batch is None else batch,
        })
        return touched

    def holds(self, batch: int | None) -> bool:
        return batch is not None and self.manifest()["batch"] >= batch

    def upsert(self, updates: DataFrame, order: str, *, batch: int | None = None) -> list[int]:
        """Per key the newest update by `order` replaces the row; returns the buckets that were rewritten.

        `batch` makes a repeated call harmless: a batch number that the table holds already changes nothing.
        """
        if self.holds(batch):
            return []
        names = [*self.schema.names, *([] if order in self.schema.names else [order])]
        rest = [n for n in names if n not in self.keys]
        newest = updates.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
        newest = stage(newest.select(*self.keys, "_row.*"), "table-updates")
        keys = [BUCKET, *self.keys]

        def change(base: DataFrame, new: DataFrame, parts: int) -> DataFrame:
            return tables.upsert(base, new, keys, order, by=BUCKET, parts=parts)

        return self._change(newest, change, batch)

    def delete(self, ids: DataFrame, *, batch: int | None = None) -> list[int]:
        """Remove the rows whose key is in `ids`; returns the buckets that were rewritten."""
        if self.holds(batch):
            return []
        gone = stage(ids.select(*self.keys).distinct(), "table-deletes")

        def change(base: DataFrame, gone: DataFrame, parts: int) -> DataFrame:
            return base.join(gone.drop(BUCKET), self.keys, "left_anti").repartition(parts, BUCKET)

        return self._change(gone, change, batch)
