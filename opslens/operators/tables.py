"""Keyed tables: upsert, cascade delete, listings, masking, schema evolution (A-26, B-01 ... B-04)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.functions.merging import union_all
from opslens.schemas import SECRET_MASK


def read_with_defaults(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """Bring an older table to the schema: absent columns are added, nulls get the column's default."""
    defaults = defaults or {}
    present = set(df.columns)

    def column(field: T.StructField) -> Column:
        value = F.col(field.name) if field.name in present else F.lit(None)
        value = value.cast(field.dataType)
        if field.name in defaults:
            value = F.coalesce(value, F.lit(defaults[field.name]).cast(field.dataType))
        return value.alias(field.name)

    return df.select(*[column(field) for field in schema.fields])


def upsert(
    base: DataFrame, updates: DataFrame, keys: list[str], order: str, *, by: str | None = None, parts: int | None = None
) -> DataFrame:
    """Table after the updates: per key the newest update by `order`, else the base row.

    One aggregation with map-side combine, so a key that is updated millions of times is reduced
    before the shuffle. For updates of one row per key: with `by`, one of the keys, the rows are dealt out by it in
    `parts` partitions and stay there.
    """
    columns = base.columns
    rest = [c for c in columns if c not in keys]
    nothing = F.lit(None).cast(updates.schema[order].dataType)
    merged = union_all(
        base.select(*columns, F.lit(0).alias("_new"), nothing.alias("_order")),
        updates.select(*columns, F.lit(1).alias("_new"), F.col(order).alias("_order")),
    )
    if by:
        merged = merged.repartition(parts, by)
    latest = F.max_by(F.struct(*rest), F.struct("_new", "_order"))
    return merged.groupBy(*keys).agg(latest.alias("_row")).select(*keys, "_row.*").select(*columns)


def insert_or_ignore(base: DataFrame, rows: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Add the rows whose key the table does not have yet: of each new key the first by `order`, or as the rows stand."""
    place = F.col(order) if order else F.monotonically_increasing_id()
    fresh = rows.withColumn("_place", place).join(base.select(*keys), keys, "left_anti")
    rest = [c for c in base.columns if c not in keys]
    first = fresh.groupBy(*keys).agg(F.min_by(F.struct(F.lit(0).alias("_"), *rest), "_place").alias("_row"))
    return union_all(base, first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest]).select(*base.columns))


def delete_assets(
    assets: DataFrame, events: DataFrame, targets: DataFrame, state: DataFrame, ids: DataFrame
) -> dict[str, DataFrame]:
    """The four tables without the assets in ids(id) and all that hangs on them."""
    gone = ids.select("id").distinct()
    by_asset = gone.select(F.col("id").alias("asset_id"))
    dead_targets = targets.join(by_asset, "asset_id", "left_semi").select(F.col("id").alias("target_id"))
    return {
        "assets": assets.join(gone, "id", "left_anti"),
        "events": events.join(by_asset, "asset_id", "left_anti"),
        "targets": targets.join(by_asset, "asset_id", "left_anti"),
        "state": state.join(dead_targets, "target_id", "left_anti"),
    }


def delete_targets(targets: DataFrame, state: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    gone = ids.select("id").distinct()
    return (
        targets.join(gone, "id", "left_anti"),
        state.join(gone.select(F.col("id").alias("target_id")), "target_id", "left_anti"),
    )


def list_assets(assets: DataFrame, tenant: str | None = None) -> DataFrame:
    return tenant_scope(assets, tenant, column="id").orderBy("id")


def list_targets(targets: DataFrame, *, enabled_only: bool = False, tenant: str | None = None) -> DataFrame:
    rows = targets.filter(F.col("enabled")) if enabled_only else targets
    return mask_secrets(tenant_scope(rows, tenant)).orderBy("id")


def list_policies(policies: DataFrame, *, enabled_only: bool = False, tenant: str | None = None) -> DataFrame:
    rows = policies.filter(F.col("enabled")) if enabled_only else policies
    if tenant is not None:
        rows = rows.filter(F.col("tenant_id") == tenant)
    return rows.orderBy("id")


def mask_secrets(targets: DataFrame) -> DataFrame:
    return targets.withColumns({c: F.lit(SECRET_MASK) for c in ("password", "snmp_community")})


def tenant_scope(df: DataFrame, tenant: str | None, column: str = "asset_id") -> DataFrame:
    """Rows of one tenant: the asset id starts with '<tenant>:' (F-15)."""
    name = (tenant or "").strip()
    return df.filter(F.col(column).startswith(name + ":")) if name else df
