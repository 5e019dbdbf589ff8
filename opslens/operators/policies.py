"""Noise policies: resolving, dry run, change audit (D-01 ... D-08)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens.functions.merging import union_all
from opslens.functions.ranking import at_least_one, latest_per_asset
from opslens.functions.text import cluster_id, share
from opslens.operators.clusters import CLUSTER, flag_ignored, ranked_documents, severity_counts, with_signature
from opslens.schemas import IMPACT_MODES, MERGE_STRATEGIES, POLICY_DETAILS, POLICY_FIELDS

IMPACT_WEIGHTS = {"critical": 3, "warning": 2, "info": 1}
TOP_IMPACTED = 10


def _requested(policies: DataFrame, ids: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(ids, DataFrame):
        return ids.select(F.col("id").cast("string")).distinct()
    wanted = sorted({i for i in ids if i})
    return policies.sparkSession.createDataFrame([(i,) for i in wanted], "id string")


def lookup_policies(
    policies: DataFrame, ids: DataFrame | Sequence[str], tenant: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """(found policies, requested ids without one). A policy of another tenant counts as not found."""
    visible = policies if tenant is None else policies.filter(F.col("tenant_id") == tenant)
    wanted = _requested(policies, ids)
    return (
        visible.join(wanted, "id", "left_semi"),
        wanted.join(visible.select("id"), "id", "left_anti"),
    )


def policy_items(policies: DataFrame) -> DataFrame:
    """(id, field, item): one row per ignore-list entry, lower-cased and stripped."""

    def entries(column: str, field: str) -> Column:
        return F.transform(
            F.coalesce(column, F.array().cast("array<string>")),
            lambda item: F.struct(F.lit(field).alias("field"), F.lower(F.trim(item)).alias("item")),
        )

    both = F.concat(entries("ignore_sources", "source"), entries("ignore_signatures", "signature"))
    return (
        policies.select("id", F.explode(both).alias("e"))
        .select("id", "e.field", "e.item").filter(F.col("item") != "").distinct()
    )


def merge_policies(policies: DataFrame, strategy: str = "union") -> DataFrame:
    """(field, item) rows that any (union) or every (intersection) enabled policy holds."""
    strategy = strategy.strip().lower()
    if strategy not in MERGE_STRATEGIES:
        raise ValueError("Unknown merge_strategy. Allowed values: union, intersection")
    enabled = policies.filter(F.col("enabled"))
    holders = policy_items(enabled).groupBy("field", "item").agg(F.count("id").alias("holders"))
    if strategy == "intersection":
        everyone = enabled.agg(F.countDistinct("id").alias("n")).select("n")
        holders = holders.filter(F.col("holders") == everyone.scalar())
    return holders.select("field", "item")


def _refused(missing: DataFrame) -> DataFrame:
    """No rows; an error that names the ids if there are any."""
    ids = missing.agg(F.array_join(F.sort_array(F.collect_list("id")), ", ").alias("ids"))
    item = F.when(F.col("ids") != "", F.raise_error(F.concat(F.lit("Unknown policy ids: "), F.col("ids"))))
    return ids.select(F.lit(None).cast("string").alias("field"), item.cast("string").alias("item")).filter("item IS NOT NULL")


def resolve_filters(
    policies: DataFrame,
    ids: DataFrame | Sequence[str] = (),
    *,
    strategy: str = "union",
    ignore_sources: Sequence[str] = (),
    ignore_signatures: Sequence[str] = (),
    tenant: str | None = None,
) -> DataFrame:
    """The effective ignore lists as (field, item): explicit lists plus the merged policies (D-01)."""
    found, missing = lookup_policies(policies, ids, tenant)
    explicit = [("source", s.strip().lower()) for s in ignore_sources if s.strip()]
    explicit += [("signature", s.strip().lower()) for s in ignore_signatures if s.strip()]
    merged = union_all(merge_policies(found, strategy), _refused(missing))
    if not explicit:
        return merged
    named = policies.sparkSession.createDataFrame(explicit, "field string, item string")
    return union_all(merged, named).distinct()


def impact_score(mode: str = "weighted") -> Column:
    """Score of a cluster that a policy would hide, from its severity counts (D-04)."""
    mode = mode.strip().lower() or "weighted"
    if mode not in IMPACT_MODES:
        raise ValueError("Unknown impact_mode. Allowed values: weighted, critical_warning, critical_only")
    if mode == "critical_only":
        return F.col("critical_count").cast("double")
    named = ("critical", "warning") if mode == "critical_warning" else ("critical", "warning", "info")
    return sum((F.col(f"{s}_count") * IMPACT_WEIGHTS[s] for s in named), F.lit(0)).cast("double")


def _cluster_counts(events: DataFrame, filters, limit: int | None) -> DataFrame:
    """Events and severities per (asset, source, signature) and whether the filters hide it."""
    newest = latest_per_asset(events, at_least_one(limit))
    return flag_ignored(with_signature(newest), filters).groupBy(*CLUSTER, "ignored").agg(
        F.count("*").alias("events_filtered"), *severity_counts())


def _with_impact_rank(clusters: DataFrame, mode: str) -> DataFrame:
    """Adds impact_score, cluster_id and impact_rank; ignored clusters of an asset rank before the others."""
    order = W.partitionBy("asset_id").orderBy(
        F.col("ignored").desc(), F.col("impact_score").desc(), F.col("events_filtered").desc(),
        F.col("source").desc(), F.col("signature").desc(),
    )
    scored = clusters.withColumns({"impact_score": impact_score(mode), "cluster_id": cluster_id()})
    return scored.withColumn("impact_rank", F.row_number().over(order))


def _totals(total: Column, hidden: Column) -> list[Column]:
    return [total.alias("total_events"), hidden.alias("filtered_events"), (total - hidden).alias("remaining_events")]


def _with_shares(counts: DataFrame) -> DataFrame:
    return counts.withColumns({
        "filtered_share": share("filtered_events", "total_events"),
        "remaining_share": share("remaining_events", "total_events"),
    })


def dry_run_totals(events: DataFrame, filters, *, limit: int | None = None) -> DataFrame:
    """Per asset: how many of its newest events the filters would hide and leave."""
    flagged = flag_ignored(with_signature(latest_per_asset(events, at_least_one(limit))), filters)
    return _with_shares(flagged.groupBy("asset_id").agg(*_totals(F.count("*"), F.count_if("ignored"))))


def dry_run_impact(
    events: DataFrame, filters, *, limit: int | None = None, mode: str = "weighted", k: int = TOP_IMPACTED
) -> DataFrame:
    """Per asset: the k clusters the filters hit hardest, in `impact_rank` order."""
    hit = _cluster_counts(events, filters, limit).filter("ignored")
    return _with_impact_rank(hit, mode).filter(F.col("impact_rank") <= k).drop("ignored")


def policy_dry_run(
    events: DataFrame, filters: DataFrame, *, limit: int | None = None, mode: str = "weighted", k: int = TOP_IMPACTED
) -> DataFrame:
    """One nested row per asset: totals, applied lists, top impacted clusters (D-03).

    Totals and ranks come from one table of cluster counts, so the events are read once.
    """
    ranked = _with_impact_rank(_cluster_counts(events, filters, limit), mode)
    top = F.col("ignored") & (F.col("impact_rank") <= k)
    n = F.col("events_filtered")
    rows = ranked.withColumn("top", top).groupBy("asset_id").agg(
        *_totals(F.sum(n), F.sum(F.when(F.col("ignored"), n).otherwise(0))),
        ranked_documents(
            "impact_rank", ["source", "signature", "cluster_id", "events_filtered", "impact_score"], where="top"
        ).alias("top_impacted_clusters"),
    )

    def applied(field: str) -> Column:
        return (
            filters.filter(F.col("field") == field)
            .agg(F.sort_array(F.collect_set("item")).alias("items")).select("items").scalar()
        )

    return _with_shares(rows).withColumns({
        "applied_sources": applied("source"),
        "applied_signatures": applied("signature"),
        "impact_mode": F.lit(mode.strip().lower() or "weighted"),
    })


def _snapshot(prefix: str) -> Column:
    fields = [
        F.sort_array(F.col(f"{prefix}.{name}")).alias(name) if name.startswith("ignore_")
        else F.col(f"{prefix}.{name}").alias(name)
        for name in ("id", *POLICY_FIELDS)
    ]
    return F.when(F.col(prefix).isNotNull(), F.struct(*fields))


def policy_audit(before: DataFrame, after: DataFrame) -> DataFrame:
    """Compare two states of the policy table: one row per policy that was created, changed or deleted.

    Returns policy_id, tenant_id, action, changed_fields and the JSON text `details`.
    """
    old = before.select(F.col("id").alias("policy_id"), F.struct("*").alias("b"))
    new = after.select(F.col("id").alias("policy_id"), F.struct("*").alias("a"))
    rows = old.join(new, "policy_id", "full").select(
        "policy_id", _snapshot("b").alias("before"), _snapshot("a").alias("after")
    )
    differing = F.array_compact(F.array(*[
        F.when(~F.col(f"before.{name}").eqNullSafe(F.col(f"after.{name}")), F.lit(name))
        for name in POLICY_FIELDS
    ]))
    changed = (
        F.when(F.col("after").isNull(), F.array(F.lit("deleted")))
        .when(F.col("before").isNull(), F.array(*[F.lit(n) for n in ("created", *POLICY_FIELDS)]))
        .otherwise(differing)
    )
    return (
        rows.withColumn("changed_fields", changed).filter(F.size("changed_fields") > 0)
        .withColumn("action", F.when(F.col("after").isNull(), F.lit("delete")).otherwise(F.lit("upsert")))
        .select(
            "policy_id",
            F.coalesce("after.tenant_id", "before.tenant_id").alias("tenant_id"),
            "action", "changed_fields",
            F.to_json(F.struct(
                F.lit(1).alias("schema_version"), "action", "changed_fields", "before", "after",
            )).alias("details"),
        )
    )


def parse_audit(audit: DataFrame) -> DataFrame:
    """Add details_json: the details text as a struct, null where it is not valid JSON (D-08)."""
    parsed = F.from_json("details", POLICY_DETAILS, {"mode": "PERMISSIVE"})
    usable = F.try_parse_json("details").isNotNull() & parsed["action"].isNotNull()
    return audit.withColumn("details_json", F.when(usable, parsed))


def filter_audit(
    audit: DataFrame,
    *,
    tenant: str | None = None,
    action: str | None = None,
    policy_id: str | None = None,
    min_ts: int | None = None,
    max_ts: int | None = None,
    changed_field: str | None = None,
) -> DataFrame:
    out = audit
    if tenant is not None:
        out = out.filter(F.col("tenant_id") == tenant)
    if action is not None:
        out = out.filter(F.col("action") == action.strip())
    if policy_id is not None:
        out = out.filter(F.col("policy_id") == policy_id.strip())
    if min_ts is not None:
        out = out.filter(F.col("ts") >= int(min_ts))
    if max_ts is not None:
        out = out.filter(F.col("ts") <= int(max_ts))
    if changed_field is not None:
        # a field counts as changed only if the change list names it
        names = F.from_json("details", POLICY_DETAILS)["changed_fields"]
        out = out.filter(F.array_contains(names, changed_field.strip()))
    return out


def query_audit(
    audit: DataFrame, *, sort: str = "desc", limit: int = 100, offset: int = 0, **filters
) -> DataFrame:
    """A page of audit rows, newest first unless sort='asc' (D-06)."""
    sort = str(sort).strip().lower()
    if sort not in ("asc", "desc"):
        raise ValueError("sort must be 'asc' or 'desc'")
    order = F.col("id").asc() if sort == "asc" else F.col("id").desc()
    page = filter_audit(audit, **filters).orderBy(order)
    return page.offset(max(0, offset)).limit(at_least_one(limit))


def audit_pages(audit: DataFrame, *, limit: int = 100, offset: int = 0, **filters) -> DataFrame:
    """One row: matching rows, current and last page, offsets of the neighbouring pages (D-07)."""
    limit = at_least_one(limit)
    offset = max(0, offset)
    total = filter_audit(audit, **filters).agg(F.count("*").alias("total_rows"))
    last = F.greatest(F.lit(1), F.ceil(F.col("total_rows") / limit))
    return total.select(
        "total_rows",
        F.lit(offset // limit + 1).cast("bigint").alias("current_page"),
        last.cast("bigint").alias("last_page"),
        F.lit(max(0, offset - limit)).cast("bigint").alias("prev_offset"),
        F.lit(offset + limit).cast("bigint").alias("next_offset"),
        ((last - 1) * limit).cast("bigint").alias("last_offset"),
    )
