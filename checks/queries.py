"""Every operator as a query over the driver tables.

SQL engine can reproduce. Times leave as zone-less UTC timestamps.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as t
from opslens import schemas as S
from opslens.functions.merging import union_all
from opslens.functions.ranking import latest_per_asset
from opslens.functions.text import cluster_id, signature
from opslens.operators import access, anomalies, clusters, collectors, csb, dashboard, dependency
from opslens.operators import ingest, normalize, policies, rules
from opslens.operators import tables as keyed
from opslens.operators.dedup import dedup_events
from opslens.plans import dashboard as dashboards
from opslens.plans import incidents, insight
from opslens.session import shared_dir, tune
from opslens.sinks import exports
from opslens.sinks.keyed import KeyedTable
from opslens.sources import batches, tail, text_logs
from opslens.streaming import dedup as stream_dedup
from opslens.streaming import feeds
from opslens.streaming.ingest import ingest_stream, read_sink

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

WINDOW = None  # the whole history
COLLECTED = "2024-02-01 00:00:00"
NOW = dt.datetime(2024, 1, 31)
NOW_EPOCH = 1706659200
POLICY_IDS = ("pol-0", "pol-2", "pol-6", "pol-24")
IGNORE = (["linux"], ["click request <num> done", "eventid=<num> failed login user=<num>"])


def query(name: str):
    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(tune(spark), sf_dir)
        return fn

    return register


def ntz(name: str, alias: str | None = None) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(alias or name)


def text(column, sep: str = ",") -> Column:
    return F.concat_ws(sep, column)


def staged(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def window(spark: SparkSession, sf: str) -> DataFrame:
    return clusters.analysis_window(t.events(spark, sf), limit=WINDOW)


# --- A: sources, checks, normalisers -------------------------------------------------------------


@query("a01_event_batches")
def _(spark, sf):
    path = staged(spark, "batches")
    stamp = F.when(F.col("source") != "app", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
    event = F.struct(
        "asset_id", "source", "message", "metric", "value",
        F.when(F.col("severity") != "info", F.col("severity")).alias("severity"), stamp.alias("timestamp"),
    )
    rows = t.events(spark, sf).withColumn("batch_id", F.floor(F.col("seq") / 100))
    packed = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("seq", event.alias("e")))).alias("b"))
    packed.select("batch_id", F.transform("b", lambda r: r["e"]).alias("events")).write.json(path)
    read = batches.read_event_batches(spark, path, F.lit(COLLECTED))
    return read.select("seq", "asset_id", "source", "message", "metric", "value", "severity", ntz("ts"))


@query("a02_validate")
def _(spark, sf):
    rows = keyed.read_with_defaults(t.targets(spark, sf), S.TARGET, S.TARGET_DEFAULTS)
    rows = rows.withColumn("ilo_event_limit", (F.col("port") - 5000).cast("int"))
    ok, bad = ingest.validate(rows, ingest.TARGET_RULES)
    return ok.select("id", F.lit("").alias("errors")).unionByName(bad.select("id", text("errors").alias("errors")))


@query("a03_check_assets")
def _(spark, sf):
    ok, orphans = ingest.check_assets(t.events(spark, sf), t.registered(spark, sf))
    return ok.select("seq", "asset_id", F.lit(True).alias("known")).unionByName(
        orphans.select("seq", "asset_id", F.lit(False).alias("known"))
    )


@query("a04_fingerprint")
def _(spark, sf):
    return ingest.with_fingerprint(t.events(spark, sf)).select("seq", "fingerprint")


def _dedup_key(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", F.concat_ws("|", "asset_id", "source", "severity"))


@query("a05_dedup_events")
def _(spark, sf):
    events = _dedup_key(t.events(spark, sf))
    return dedup_events(events, window_sec=6 * 3600).select("seq", "asset_id", ntz("ts"))


@query("a05_dedup_fingerprint")
def _(spark, sf):
    return dedup_events(ingest.with_fingerprint(t.events(spark, sf))).select("seq", "asset_id", ntz("ts"))


@query("a05_dedup_hot_keys")
def _(spark, sf):
    # five keys hold all rows, so their islands take the chunked path
    events = t.events(spark, sf).withColumn("fingerprint", F.col("source"))
    return dedup_events(events, 3600, short_island_rows=50, chunk_rows=4096, block_rows=4096).select("seq", "source", ntz("ts"))


@query("a06_dedup_stream")
def _(spark, sf):
    # four batches in arrival order, so state is carried over them
    landed = staged(spark, "landed")
    events = _dedup_key(t.events(spark, sf))
    last = events.agg(F.max("seq")).select("max(seq)").scalar()
    quarter = F.least(F.lit(3), F.floor(F.col("seq") * 4 / last))
    for k in range(4):
        events.filter(quarter == k).coalesce(1).write.mode("append").parquet(landed)
    raw = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(landed)
    kept = stream_dedup.dedup_stream(raw, window_sec=6 * 3600)
    out = staged(spark, "dedup")
    run = (
        kept.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state")
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(kept.schema).parquet(out).select("seq", "asset_id", ntz("ts"))


@query("a06_ingest_chain")
def _(spark, sf):
    # four runs of one stream, each over a quarter of the batches; the third dies before its batch counts and starts again
    landed, out = staged(spark, "landed"), staged(spark, "ingest")
    severity = F.when(F.col("seq") % 97 == 0, "fatal").otherwise(F.col("severity"))
    rows = t.events(spark, sf).withColumns({"severity": severity, "batch_id": F.floor(F.col("seq") / 100)})
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp")
    event = F.struct("asset_id", "source", "message", "metric", "value", "severity", stamp)
    packed = rows.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("seq", event.alias("e")))).alias("b"))
    last = rows.agg(F.max("batch_id")).first()[0]
    quarter = F.least(F.lit(3), F.floor(F.col("batch_id") * 4 / last))

    def run(**options):
        stream = batches.stream_event_batches(spark, landed)
        ingest_stream(stream, t.registered(spark, sf), out, out + "-state", window_sec=10 * 86400, **options).start().awaitTermination()

    def die(epoch):
        raise RuntimeError("killed")

    for k in range(4):
        quartered = packed.filter(quarter == k).select("batch_id", F.transform("b", lambda r: r["e"]).alias("events"))
        quartered.write.mode("append").json(landed)
        if k == 2:
            try:
                run(on_written=die)
            except StreamingQueryException:
                pass
        run()
    sinks = [
        read_sink(spark, out, name).select(F.lit(name).alias("sink"), "seq", "asset_id", "severity", ntz("ts"))
        for name in ("accepted", "quarantined", "orphans")
    ]
    return union_all(*sinks)


@query("a07_latest_per_asset")
def _(spark, sf):
    return latest_per_asset(t.events(spark, sf), 100).select("seq", "asset_id", "message")


def _event_columns(df: DataFrame) -> DataFrame:
    return df.select("asset_id", "source", "message", "metric", "value", "severity", ntz("ts"))


@query("a08_normalize_host_log")
def _(spark, sf):
    return _event_columns(normalize.normalize_host_log(t.document_lines(spark, sf), tail=None))


@query("a08_host_log_tail")
def _(spark, sf):
    return _event_columns(normalize.normalize_host_log(t.document_lines(spark, sf)))


@query("a09_normalize_host_metrics")
def _(spark, sf):
    samples = t.table(spark, sf, "orders").selectExpr(
        "concat('t0:host-', o_custkey) AS asset_id", "cast(o_custkey % 64 AS double) AS load1",
        "o_totalprice AS disk_used", "520000.0D AS disk_total", "cast(o_orderdate AS timestamp) AS collected_ts",
    )
    return _event_columns(normalize.normalize_host_metrics(samples))


@query("a10_normalize_winevent")
def _(spark, sf):
    return _event_columns(normalize.normalize_winevent(normalize.parse_winevents(t.winevents(spark, sf))))


def _cursors(spark, sf) -> tuple[DataFrame, DataFrame]:
    state = t.table(spark, sf, "customer").selectExpr(
        "concat('col-', c_custkey) AS target_id",
        "CASE WHEN c_custkey % 3 = 0 THEN 'none' ELSE cast(c_custkey * 20 AS string) END AS last_cursor",
    )
    return normalize.advance_cursor(normalize.parse_winevents(t.winevents(spark, sf)), state, batch=40)


@query("a11_advance_cursor")
def _(spark, sf):
    return _cursors(spark, sf)[0].select("target_id", "record_id")


@query("a11_cursor_state")
def _(spark, sf):
    return _cursors(spark, sf)[1]


def _ssh_raw(spark, sf) -> DataFrame:
    return t.table(spark, sf, "orders").selectExpr(
        "concat('t0:host-', o_custkey) AS asset_id",
        """CASE o_orderstatus WHEN 'P' THEN 'busy'
           WHEN 'F' THEN concat('x ', o_custkey % 9, '.25  0.3 1/100 ', o_orderkey, '\\n0.1 0.1 0.1')
           ELSE concat(o_custkey % 7, '.5 0.4 0.3 1/100 ', o_orderkey) END AS metrics_raw""",
        "concat('  sshd line ', o_orderkey, '  \\n\\n \\ncron ', o_custkey, '\\n') AS log_raw",
        "cast(o_orderdate AS timestamp) AS collected_ts",
    )


@query("a12_normalize_ssh")
def _(spark, sf):
    return _event_columns(normalize.normalize_ssh(_ssh_raw(spark, sf)))


def _snmp_raw(spark, sf) -> DataFrame:
    return t.table(spark, sf, "orders").selectExpr(
        "concat('t0:host-', o_custkey) AS asset_id", "concat('1.3.6.1.2.1.1.', o_custkey % 10, '.0') AS oid",
        "CASE WHEN o_orderstatus = 'P' THEN 'up' ELSE cast(o_orderkey AS string) END AS value",
        "cast(o_orderdate AS timestamp) AS collected_ts",
    )


@query("a13_normalize_snmp")
def _(spark, sf):
    return _event_columns(normalize.normalize_snmp(_snmp_raw(spark, sf)))


@query("a14_normalize_redfish")
def _(spark, sf):
    return _event_columns(
        normalize.normalize_redfish(normalize.redfish_entries(t.redfish_payloads(spark, sf)), mode="device")
    )


@query("a15_hydrate_links")
def _(spark, sf):
    payloads, docs = t.link_payloads(spark, sf)
    entries = normalize.hydrate_links(normalize.redfish_entries(payloads), docs)
    return entries.select(
        "payload_id", F.col("entry_no").cast("bigint").alias("entry_no"),
        F.expr("entry['Message'] AS message"),
    )


def _redfish_cursor(spark, sf) -> tuple[DataFrame, DataFrame]:
    state = t.table(spark, sf, "customer").filter("c_custkey < 80").selectExpr(
        "concat('col-', c_custkey) AS target_id", "c_custkey * 100 AS cursor_id",
        "cast(NULL AS timestamp) AS cursor_created",
    )
    return normalize.redfish_cursor(normalize.redfish_entries(t.redfish_payloads(spark, sf)), state)


@query("a16_redfish_cursor")
def _(spark, sf):
    return _redfish_cursor(spark, sf)[0].select("target_id", "payload_id", "entry_id")


@query("a16_redfish_cursor_state")
def _(spark, sf):
    return _redfish_cursor(spark, sf)[1].select("target_id", "cursor_id", ntz("cursor_created"))


@query("a17_run_streaks")
def _(spark, sf):
    return collectors.with_streak(t.runs(spark, sf)).select("id", "target_id", "failure_streak")


def _state(spark, sf) -> DataFrame:
    return collectors.collector_state(t.runs(spark, sf))


@query("a17_collector_state")
def _(spark, sf):
    return _state(spark, sf).select(
        "target_id", ntz("last_success_ts"), ntz("last_run_ts"), "last_error", "last_cursor", "failure_streak"
    )


@query("a18_run_outcome_events")
def _(spark, sf):
    return _event_columns(
        collectors.run_outcome_events(collectors.with_streak(t.runs(spark, sf)), t.targets(spark, sf))
    )


@query("a19_normalize_all")
def _(spark, sf):
    merged = normalize.normalize_all(
        winrm=normalize.parse_winevents(t.winevents(spark, sf)), ssh=_ssh_raw(spark, sf), snmp=_snmp_raw(spark, sf),
        ilo=normalize.redfish_entries(t.redfish_payloads(spark, sf)), csb_merp_share=t.csb_lines(spark, sf),
    )
    return merged.groupBy("source", "severity").agg(
        F.count("*").alias("events"), F.countDistinct("asset_id").alias("assets"), F.count("metric").alias("metrics")
    )


def _staged_lines(spark, sf) -> str:
    """Warehouse lines as text files, a folder per month."""
    path = staged(spark, "csb")
    lines = t.csb_lines(spark, sf).withColumn("month", F.substring("day", 1, 6))
    # months are spread over the tasks, no month has to fit into one
    lines.select("month", "value").write.partitionBy("month").text(path)
    return path


def month() -> Column:
    return F.regexp_extract("file", r"month=(\d+)", 1)


@query("a20_scan_text_logs")
def _(spark, sf):
    lines = text_logs.scan_text_logs(spark, _staged_lines(spark, sf))
    per_file = lines.groupBy("file").agg(
        F.count("*").alias("n"), F.max("line_no").alias("last"), F.countDistinct("seq").alias("numbers")
    )
    return per_file.groupBy(month().alias("month")).agg(
        F.sum("n").alias("lines"), F.sum("last").alias("last_numbers"), F.sum("numbers").alias("distinct_numbers")
    )


@query("a21_parse_csb")
def _(spark, sf):
    return csb.parse_csb(t.csb_lines(spark, sf)).select(
        "seq", "raw", ntz("ts"), "session", "thread_id", "kind", "payload", "command"
    )


def _fields(spark, sf) -> DataFrame:
    return csb.extract_csb_fields(csb.parse_csb(t.csb_lines(spark, sf)))


@query("a22_csb_fields")
def _(spark, sf):
    return _fields(spark, sf).select(
        "seq", text("sscc").alias("sscc"), "script", "user_id", "user_name", "error_code", "error_message"
    )


@query("a23_csb_events")
def _(spark, sf):
    return csb.csb_to_events(csb.parse_csb(t.csb_lines(spark, sf))).select(
        "seq", "asset_id", "source", "message", "severity", ntz("ts")
    )


@query("a24_csb_ingest_summary")
def _(spark, sf):
    path = _staged_lines(spark, sf)
    lines = text_logs.scan_text_logs(spark, path).withColumn("asset_id", F.lit("t0:csb"))
    fresh = dedup_events(ingest.with_fingerprint(csb.csb_to_events(csb.parse_csb(lines))))
    found = text_logs.list_text_logs(spark, path)
    # how many files a month was written as depends on the number of tasks
    return csb.csb_ingest_summary(
        lines.withColumn("file", month()), fresh, found.select(month().alias("file"))
    )


@query("a25_tail_text")
def _(spark, sf):
    spark.dataSource.register(tail.TailTextSource)
    rows = (
        spark.readStream.format("tail_text").option("path", _staged_lines(spark, sf)).option("glob", "*.txt").load()
    )
    out = staged(spark, "tail")
    run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-state").start()
    run.processAllAvailable()
    run.stop()
    read = spark.read.schema(rows.schema).parquet(out)
    return read.groupBy(month().alias("month")).agg(
        F.count("*").alias("lines"), F.countDistinct("file", "offset").alias("positions")
    )


@query("a26_read_with_defaults")
def _(spark, sf):
    old = t.targets(spark, sf).drop("snmp_community", "enabled").withColumn(
        "poll_interval_sec", F.when(F.col("poll_interval_sec") > 20, F.col("poll_interval_sec"))
    )
    return keyed.read_with_defaults(old, S.TARGET, S.TARGET_DEFAULTS).select(
        "id", "poll_interval_sec", "enabled", "snmp_community", "winrm_batch_size", "csb_source", "ilo_use_https"
    )


# --- B: keyed tables -----------------------------------------------------------------------------


@query("b01_upsert")
def _(spark, sf):
    base = t.table(spark, sf, "customer").selectExpr(
        "c_custkey AS id", "c_mktsegment AS status", "c_acctbal AS amount"
    )
    updates = t.table(spark, sf, "orders").selectExpr(
        "o_custkey + 10 AS id", "o_orderstatus AS status", "o_totalprice AS amount", "o_orderkey AS at"
    )
    return keyed.upsert(base, updates, ["id"], "at")


@query("b01_keyed_table")
def _(spark, sf):
    # a written table: customers, then the newest order of each, then those in debt removed
    customers = t.table(spark, sf, "customer")
    base = customers.selectExpr("c_custkey AS id", "c_mktsegment AS status", "c_acctbal AS amount", "0 AS at")
    updates = t.table(spark, sf, "orders").selectExpr(
        "o_custkey + 10 AS id", "o_orderstatus AS status", "o_totalprice AS amount", "o_orderkey AS at"
    )
    kept = KeyedTable(spark, staged(spark, "customers"), base.drop("at").schema, ["id"], buckets=16)
    kept.upsert(base, "at")
    kept.upsert(updates, "at")
    kept.delete(customers.filter("c_acctbal < 0").selectExpr("c_custkey AS id"))
    return kept.read()


@query("b01_insert_or_ignore")
def _(spark, sf):
    states = _state(spark, sf).select("target_id", "failure_streak")
    fresh = t.targets(spark, sf).select(F.col("id").alias("target_id"), F.lit(0).cast("long").alias("failure_streak"))
    return keyed.insert_or_ignore(states, fresh, ["target_id"])


@query("b02_delete_assets")
def _(spark, sf):
    assets = t.assets(spark, sf)
    left = keyed.delete_assets(
        assets, t.events(spark, sf), t.targets(spark, sf), _state(spark, sf),
        assets.filter("asset_type = 'bmc'").select("id"),
    )
    key = {"assets": "id", "events": "seq", "targets": "id", "state": "target_id"}
    parts = [
        df.select(F.lit(name).alias("table_name"), F.col(key[name]).cast("string").alias("key"))
        for name, df in left.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("b03_list_policies")
def _(spark, sf):
    return keyed.list_policies(t.policies(spark, sf), enabled_only=True, tenant="t1").select(
        "id", "name", "tenant_id", text("ignore_sources").alias("ignore_sources")
    )


@query("b03_list_assets")
def _(spark, sf):
    return keyed.list_assets(t.assets(spark, sf), "t2")


@query("b03_list_targets")
def _(spark, sf):
    return keyed.list_targets(t.targets(spark, sf), enabled_only=True, tenant="t1").select(
        "id", "name", "asset_id", "password"
    )


@query("b04_mask_secrets")
def _(spark, sf):
    return keyed.mask_secrets(t.targets(spark, sf)).select("id", "username", "password", "snmp_community")


@query("b05_write_events")
def _(spark, sf):
    path = staged(spark, "events")
    exports.write_events(t.events(spark, sf), path)
    back = spark.read.parquet(path)
    return back.groupBy("event_date", "source").agg(F.count("*").alias("events"), F.max("seq").alias("last_seq"))


# --- C: log analytics ----------------------------------------------------------------------------


@query("c01_signature")
def _(spark, sf):
    return t.events(spark, sf).select("seq", signature("message").alias("signature"))


@query("c01_document_line_clusters")
def _(spark, sf):
    lines = t.document_lines(spark, sf).select("asset_id", signature("value").alias("signature"))
    return lines.groupBy("asset_id", "signature").agg(F.count("*").alias("lines"))


@query("c02_cluster_id")
def _(spark, sf):
    pairs = clusters.with_signature(t.events(spark, sf)).select("source", "signature").distinct()
    return pairs.withColumn("cluster_id", cluster_id())


@query("c03_ignore_filtered")
def _(spark, sf):
    events = clusters.with_signature(t.events(spark, sf))
    return clusters.apply_ignore(events, IGNORE).select("seq", "asset_id", "source")


@query("c03_excluded_counts")
def _(spark, sf):
    # ignore lists as a table: the union of all enabled policies
    items = policies.merge_policies(t.policies(spark, sf))
    return clusters.excluded_counts(clusters.with_signature(t.events(spark, sf)), items)


CLUSTER_COLUMNS = [
    "asset_id", "source", "signature", "cluster_id", "example_message", "events_count", "share",
    "info_count", "warning_count", "critical_count",
]


@query("c04_clusters")
def _(spark, sf):
    return clusters.clusters(clusters.analysis_rows(t.events(spark, sf), limit=WINDOW)).select(*CLUSTER_COLUMNS)


@query("c04_cluster_totals")
def _(spark, sf):
    return clusters.cluster_totals(t.events(spark, sf)).select(*CLUSTER_COLUMNS)


@query("c05_top_clusters")
def _(spark, sf):
    top = clusters.top_clusters(clusters.cluster_totals(t.events(spark, sf)), 10)
    return top.select(*CLUSTER_COLUMNS, F.col("cluster_rank").cast("bigint").alias("cluster_rank"))


def _anomaly_columns(df: DataFrame, *more) -> DataFrame:
    return df.select(
        "asset_id", "kind", "severity", "confidence", "related_cluster_id", "related_metric", "first_seq", *more
    )


# the SQL twins of these look at the largest clusters only; the queries named ..._all look at every cluster
LARGEST, HINT_LARGEST, BRIEF_LARGEST = 30, 15, 10


def _rare(spark, sf, max_clusters=None) -> DataFrame:
    found = anomalies.rare_patterns(anomalies.cluster_profile(window(spark, sf)), max_clusters=max_clusters)
    return _anomaly_columns(found, text("evidence", " | ").alias("evidence"))


@query("c06_rare_patterns")
def _(spark, sf):
    return _rare(spark, sf, LARGEST)


@query("c06_rare_patterns_all")
def _(spark, sf):
    return _rare(spark, sf)


@query("c07_split_recent")
def _(spark, sf):
    rows = clusters.split_recent(t.events(spark, sf), limit=WINDOW)
    return rows.select("seq", "asset_id", F.col("pos").cast("bigint").alias("pos"), "total", "is_recent")


@query("c08_hourly_baseline")
def _(spark, sf):
    return anomalies.with_hourly_baseline(window(spark, sf)).select(
        "seq", F.col("hour").cast("bigint").alias("hour"), "older_in_hour", "older_in_hour_of_cluster"
    )


@query("c09_burst_rates")
def _(spark, sf):
    return anomalies.cluster_profile(window(spark, sf)).select(
        "asset_id", "cluster_id", "events_count", "recent_count",
        *[F.round(c, 6).alias(c) for c in ("recent_rate", "older_rate", "hourly_baseline")],
    )


@query("c09_burst_patterns")
def _(spark, sf):
    profile = anomalies.cluster_profile(window(spark, sf))
    return _anomaly_columns(anomalies.burst_patterns(profile, max_clusters=LARGEST))


@query("c09_burst_patterns_all")
def _(spark, sf):
    return _anomaly_columns(anomalies.burst_patterns(anomalies.cluster_profile(window(spark, sf))))


@query("c10_metric_stats")
def _(spark, sf):
    return anomalies.metric_stats(window(spark, sf)).select(
        "asset_id", "metric", "samples", "last_value",
        *[F.round(c, 6).alias(c) for c in ("median_value", "mad", "robust_z")],
    )


@query("c10_metric_outliers")
def _(spark, sf):
    return _anomaly_columns(anomalies.metric_outliers(window(spark, sf)))


def _ranked(spark, sf, max_clusters=None) -> DataFrame:
    found = anomalies.find_anomalies(window(spark, sf), max_clusters=max_clusters)
    return _anomaly_columns(found, F.col("anomaly_rank").cast("bigint").alias("anomaly_rank"))


@query("c11_anomalies_ranked")
def _(spark, sf):
    return _ranked(spark, sf, LARGEST)


@query("c11_anomalies_ranked_all")
def _(spark, sf):
    return _ranked(spark, sf)


@query("c12_log_insight")
def _(spark, sf):
    return _insight_columns(insight.log_insight(
        t.events(spark, sf), t.asset_ids(spark, sf), limit=WINDOW, max_clusters=LARGEST, filters=IGNORE
    ))


@query("c12_log_insight_all")
def _(spark, sf):
    return _insight_columns(insight.log_insight(
        t.events(spark, sf), t.asset_ids(spark, sf), limit=WINDOW, filters=IGNORE
    ))


def _insight_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "asset_id", "analyzed_events",
        text(F.transform("clusters", lambda c: c["cluster_id"])).alias("cluster_ids"),
        text(F.transform("anomalies", lambda a: a["kind"])).alias("anomaly_kinds"),
        text("summary", " | ").alias("summary"),
    )


def _overview(spark, sf, **depth) -> tuple[DataFrame, DataFrame]:
    return insight.analytics_overview(t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW, **depth)


@query("c13_analytics_overview")
def _(spark, sf):
    return _overview(spark, sf, max_clusters=LARGEST, max_anomalies=20)[0]


@query("c13_analytics_overview_all")
def _(spark, sf):
    return _overview(spark, sf)[0]


@query("c13_overview_totals")
def _(spark, sf):
    return _overview(spark, sf, max_clusters=LARGEST, max_anomalies=20)[1]


@query("c13_overview_totals_all")
def _(spark, sf):
    return _overview(spark, sf)[1]


# --- D: noise policies ---------------------------------------------------------------------------


@query("d01_policy_merge_union")
def _(spark, sf):
    return policies.resolve_filters(
        t.policies(spark, sf), POLICY_IDS, ignore_sources=["SysLog"], ignore_signatures=["a, b"]
    )


@query("d01_policy_merge_intersection")
def _(spark, sf):
    return policies.resolve_filters(t.policies(spark, sf), POLICY_IDS, strategy="intersection")


@query("d02_lookup_policies")
def _(spark, sf):
    found, missing = policies.lookup_policies(t.policies(spark, sf), (*POLICY_IDS, "pol-99"), tenant="t0")
    return found.select("id", F.lit(True).alias("found")).unionByName(missing.select("id", F.lit(False).alias("found")))


def _filters(spark, sf) -> DataFrame:
    return policies.resolve_filters(t.policies(spark, sf), POLICY_IDS)


@query("d03_policy_dry_run")
def _(spark, sf):
    rows = policies.policy_dry_run(t.events(spark, sf), _filters(spark, sf), limit=WINDOW)
    top = F.get("top_impacted_clusters", F.lit(0))
    return rows.select(
        "asset_id", "total_events", "filtered_events", "remaining_events", "filtered_share", "remaining_share",
        text("applied_sources").alias("applied_sources"), text("applied_signatures", "; ").alias("applied_signatures"),
        top["cluster_id"].alias("top_cluster_id"), top["impact_score"].alias("top_score"),
        F.size("top_impacted_clusters").cast("bigint").alias("impacted"),
    )


@query("d03_dry_run_impact")
def _(spark, sf):
    rows = policies.dry_run_impact(t.events(spark, sf), _filters(spark, sf), limit=WINDOW)
    return rows.select(
        "asset_id", F.col("impact_rank").cast("bigint").alias("impact_rank"), "source", "signature", "cluster_id",
        "events_filtered", "impact_score",
    )


@query("d04_impact_modes")
def _(spark, sf):
    counted = clusters.cluster_totals(t.events(spark, sf))
    return counted.select(
        "asset_id", "cluster_id", *[policies.impact_score(mode).alias(mode) for mode in S.IMPACT_MODES]
    )


@query("d05_policy_audit_diff")
def _(spark, sf):
    rows = policies.policy_audit(*t.policy_states(spark, sf))
    details = F.from_json("details", S.POLICY_DETAILS)
    return rows.select(
        "policy_id", "tenant_id", "action", text("changed_fields").alias("changed_fields"),
        details["before"]["enabled"].alias("was_enabled"), details["after"]["enabled"].alias("is_enabled"),
    )


AUDIT_FILTER = {"tenant": "t1", "action": "upsert", "min_ts": 800000000, "changed_field": "enabled"}


@query("d06_policy_audit_query")
def _(spark, sf):
    return policies.query_audit(t.policy_audit(spark, sf), limit=50, offset=20, **AUDIT_FILTER)


@query("d07_audit_pages")
def _(spark, sf):
    return policies.audit_pages(t.policy_audit(spark, sf), limit=50, offset=20, **AUDIT_FILTER)


@query("d08_parse_audit")
def _(spark, sf):
    rows = policies.parse_audit(t.policy_audit(spark, sf))
    return rows.select(
        "id", F.col("details_json").isNotNull().alias("parsed"),
        F.col("details_json.schema_version").alias("schema_version"),
        F.when(F.col("details_json").isNotNull(), text("details_json.changed_fields")).alias("changed_fields"),
    )


# --- E: rules and reasoning ----------------------------------------------------------------------


@query("e01_alerts")
def _(spark, sf):
    return rules.alerts(t.events(spark, sf)).select("asset_id", "severity", "reason")


@query("e02_correlations")
def _(spark, sf):
    return rules.correlations(t.events(spark, sf)).select("asset_id", "title", "confidence", "evidence_count")


@query("e03_correlation_events")
def _(spark, sf):
    rows = rules.correlation_events(t.events(spark, sf), "Windows storage error cluster")
    return rows.select("asset_id", "seq", "source", "severity", "message", ntz("ts"))


def _hints(spark, sf, max_clusters=None) -> DataFrame:
    rows = incidents.asset_hints(
        t.events(spark, sf), t.asset_ids(spark, sf), limit=WINDOW, max_clusters=max_clusters
    )
    return rows.select(
        "asset_id", F.col("hint_rank").cast("bigint").alias("hint_rank"), "title", "rationale", "action", "confidence"
    )


@query("e04_runbook_hints")
def _(spark, sf):
    return _hints(spark, sf, HINT_LARGEST)


@query("e04_runbook_hints_all")
def _(spark, sf):
    return _hints(spark, sf)


EDGE_COLUMNS = ["asset_id", "source_a", "source_b", "shared_signatures", "co_occurrence_score", "example_signature"]


@query("e05_dependency_edges")
def _(spark, sf):
    return dependency.dependency_edges(t.events(spark, sf), limit=WINDOW).select(
        *EDGE_COLUMNS, F.col("edge_rank").cast("bigint").alias("edge_rank")
    )


@query("e05_dependency_map")
def _(spark, sf):
    rows = dependency.dependency_map(t.events(spark, sf), limit=WINDOW)
    return rows.select("asset_id", "total_sources", "total_edges", F.size("edges").cast("bigint").alias("edges"))


@query("e06_dependency_overview")
def _(spark, sf):
    return dependency.dependency_overview(
        t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW
    ).select(*EDGE_COLUMNS)


def _brief_columns(rows: DataFrame) -> DataFrame:
    return rows.select(
        "asset_id", "headline", "confidence", text("anomaly_reasons", "; ").alias("anomaly_reasons"),
        text("dependency_hotspots", "; ").alias("dependency_hotspots"),
        F.size("runbook_actions").cast("bigint").alias("actions"),
    )


DEPTH = {"brief_clusters": BRIEF_LARGEST, "hint_clusters": HINT_LARGEST}


@query("e07_incident_briefs")
def _(spark, sf):
    return _brief_columns(
        incidents.incident_briefs(t.events(spark, sf), t.asset_ids(spark, sf), limit=WINDOW, **DEPTH)
    )


@query("e07_incident_briefs_all")
def _(spark, sf):
    return _brief_columns(incidents.incident_briefs(t.events(spark, sf), t.asset_ids(spark, sf), limit=WINDOW))


@query("e08_incident_overview")
def _(spark, sf):
    return _brief_columns(incidents.incident_overview(
        t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW, min_confidence=0.9, **DEPTH
    ))


@query("e08_incident_overview_all")
def _(spark, sf):
    return _brief_columns(incidents.incident_overview(
        t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW, min_confidence=0.9
    ))


@query("e09_recommendations")
def _(spark, sf):
    rows = rules.recommendations(t.events(spark, sf), t.asset_ids(spark, sf))
    return rows.select("asset_id", "risk_score", "risk_level", F.size("actions").cast("bigint").alias("actions"))


# --- F: operations -------------------------------------------------------------------------------


@query("f01_overview")
def _(spark, sf):
    return dashboard.overview(t.registered(spark, sf), t.events(spark, sf))


def _month(spark, sf, **options) -> DataFrame:
    return dashboard.dashboard_filter(t.events(spark, sf), now=NOW, **options)


@query("f02_dashboard_filter")
def _(spark, sf):
    return _month(spark, sf, period_days=10, source="app", tenant="t1").select("seq", "asset_id", "source", ntz("ts"))


@query("f03_source_mix")
def _(spark, sf):
    return dashboard.source_mix(_month(spark, sf))


@query("f04_severity_mix")
def _(spark, sf):
    return dashboard.severity_mix(_month(spark, sf))


@query("f05_daily_trend")
def _(spark, sf):
    return dashboard.daily_trend(_month(spark, sf))


@query("f05_daily_trend_stream")
def _(spark, sf):
    raw = spark.readStream.schema(t.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    trend = feeds.daily_trend_stream(t.canonical(raw))
    out = staged(spark, "trend")
    feeds.feed(
        trend, lambda now, _: now.write.mode("overwrite").parquet(out), out + "-state", every=None
    ).start().awaitTermination()
    return spark.read.schema(trend.schema).parquet(out)


@query("f06_top_assets")
def _(spark, sf):
    return dashboard.top_assets(_month(spark, sf))


@query("f07_recent_alerts")
def _(spark, sf):
    return dashboard.recent_alerts(_month(spark, sf)).select("seq", "source", "message", "severity", ntz("ts"))


@query("f08_asset_table")
def _(spark, sf):
    events = t.events(spark, sf)
    return dashboard.asset_table(t.assets(spark, sf), _month(spark, sf, period_days=10), events)


@query("f09_filter_options")
def _(spark, sf):
    return dashboard.filter_options(t.assets(spark, sf), t.events(spark, sf))


@query("f10_query_history")
def _(spark, sf):
    rows = collectors.query_history(t.runs(spark, sf), collector_type="ssh", has_error=True, limit=200)
    return rows.select("id", "target_id", "last_error", ntz("ts"))


@query("f11_diagnostics_summary")
def _(spark, sf):
    return collectors.diagnostics_summary(t.runs(spark, sf))


@query("f12_diagnostics_trend")
def _(spark, sf):
    return collectors.diagnostics_trend(t.runs(spark, sf)).select("idx", "id", "accepted_events", "has_error")


@query("f13_collector_status")
def _(spark, sf):
    return collectors.collector_status(t.targets(spark, sf), _state(spark, sf)).select(
        "target_id", "collector_type", "enabled", "last_ok", "last_message", "last_cursor", "failure_streak",
        ntz("last_run_ts"),
    )


@query("f13_collector_health")
def _(spark, sf):
    return collectors.collector_health(t.targets(spark, sf), _state(spark, sf))


@query("f14_diagnostics_stream")
def _(spark, sf):
    raw = spark.readStream.schema(t.EVENTS_SCHEMA).option("pathGlobFilter", "events.parquet").parquet(sf)
    out = staged(spark, "diagnostics")

    def publish(table: DataFrame, batch_id: int) -> None:
        table.write.mode("overwrite").parquet(out)

    totals = feeds.diagnostics_stream(t.runs_of(raw))
    run = feeds.feed(totals, publish, out + "-state", every=None).start()
    run.awaitTermination()
    return spark.read.schema(totals.schema).parquet(out)


@query("f15_tenant_scope")
def _(spark, sf):
    return keyed.tenant_scope(t.events(spark, sf), "t1").select("seq", "asset_id")


@query("f16_tenant_history")
def _(spark, sf):
    return collectors.tenant_history(t.runs(spark, sf), t.targets(spark, sf), "t2").select("id", "target_id")


# --- G: access audit and compliance --------------------------------------------------------------


def _audit(spark, sf) -> DataFrame:
    return access.evaluate_access(t.requests(spark, sf))


@query("g01_evaluate_access")
def _(spark, sf):
    return _audit(spark, sf)


@query("g02_keep_last")
def _(spark, sf):
    return access.keep_last(_audit(spark, sf)).select("id", "path", "result")


@query("g03_audit_summary")
def _(spark, sf):
    totals, by_role, actions = access.audit_summary(_audit(spark, sf))
    counts = totals.select(F.explode(F.array(*[
        F.struct(F.lit("result").alias("part"), F.lit(c).alias("name"), F.col(c).alias("n"))
        for c in ("rows", "allow", "deny")
    ])).alias("r")).select("r.*")
    return counts.unionByName(by_role.select(F.lit("role").alias("part"), F.col("role").alias("name"), "n")).unionByName(
        actions.select(F.lit("action").alias("part"), F.col("action").alias("name"), "n")
    )


@query("g04_deny_alerts")
def _(spark, sf):
    return access.deny_alerts(_audit(spark, sf))


@query("g05_reject_events")
def _(spark, sf):
    return access.reject_events(t.rejects(spark, sf))


@query("g05_newest_rejects")
def _(spark, sf):
    return access.reject_telemetry(t.rejects(spark, sf))[2].select("id", "ts", "reason", "issuer", "client")


@query("g05_reject_telemetry")
def _(spark, sf):
    by_reason, by_client, _ = access.reject_telemetry(t.rejects(spark, sf))
    return by_reason.select(F.lit("reason").alias("part"), F.col("reason").alias("name"), "n").unionByName(
        by_client.select(F.lit("client").alias("part"), F.concat("issuer", F.lit("|"), "client").alias("name"), "n")
    )


def _report(spark, sf) -> DataFrame:
    return access.compliance_report(_audit(spark, sf), t.rejects(spark, sf), ts=NOW_EPOCH)


@query("g06_compliance_report")
def _(spark, sf):
    return _report(spark, sf).select(
        "id", "ts", "trigger", "summary.rows", "summary.allow", "summary.deny",
        F.to_json("summary.by_role").alias("by_role"), F.to_json("summary.jwt_rejects").alias("jwt_rejects"),
    )


def _reports(spark, sf) -> DataFrame:
    return t.table(spark, sf, "orders").selectExpr(
        "concat('cr-', o_orderkey) AS id", "unix_timestamp(cast(o_orderdate AS timestamp)) AS ts", "'manual' AS trigger"
    )


@query("g07_route_reports")
def _(spark, sf):
    both = access.route_reports(_reports(spark, sf), {"webhook": "https://hook.example", "email": " ops@example.org "})
    none = access.route_reports(_reports(spark, sf), {"webhook": "", "email": " "})
    return both.unionByName(none)


@query("g08_report_history")
def _(spark, sf):
    return access.report_history(_reports(spark, sf), limit=50).select("id", "ts")


@query("g09_purge")
def _(spark, sf):
    _, counts = access.purge(
        _audit(spark, sf), t.runs(spark, sf), t.policy_audit(spark, sf), now=NOW_EPOCH,
        audit_max_age_sec=800000000, history_max_age_sec=14 * 24 * 3600, policy_audit_max_age_sec=900000000,
    )
    return counts


@query("g09_purged_history")
def _(spark, sf):
    kept, _ = access.purge(
        _audit(spark, sf), t.runs(spark, sf), t.policy_audit(spark, sf), now=NOW_EPOCH,
        history_max_age_sec=14 * 24 * 3600,
    )
    return kept["worker_history"].select("id", "target_id")


# --- H: exports ----------------------------------------------------------------------------------


@query("h01_audit_csv")
def _(spark, sf):
    return exports.csv_lines(_audit(spark, sf), exports.AUDIT_CSV, order="id")


@query("h02_history_csv")
def _(spark, sf):
    runs = collectors.with_streak(t.runs(spark, sf)).withColumn("ts", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return exports.csv_lines(runs, exports.HISTORY_CSV, order="id")


@query("h03_policy_audit_csv")
def _(spark, sf):
    return exports.csv_lines(t.policy_audit(spark, sf), exports.POLICY_AUDIT_CSV, order="id", quote_all=True)


@query("h04_brief_csv")
def _(spark, sf):
    briefs = incidents.incident_overview(
        t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW, **DEPTH
    )
    return exports.csv_lines(briefs, exports.BRIEF_CSV, quote_all=True)


@query("h04_brief_csv_all")
def _(spark, sf):
    briefs = incidents.incident_overview(t.events(spark, sf), t.asset_ids(spark, sf), limit_per_asset=WINDOW)
    return exports.csv_lines(briefs, exports.BRIEF_CSV, quote_all=True)


@query("h05_json_documents")
def _(spark, sf):
    top = clusters.top_clusters(clusters.cluster_totals(t.events(spark, sf)), 10)
    nested = top.groupBy("asset_id").agg(
        F.sort_array(F.collect_list(F.struct(
            F.col("cluster_rank").alias("rank"), F.col("cluster_id").alias("id"), F.col("events_count").alias("n"),
        ))).alias("clusters")
    )
    return exports.json_documents(nested, "asset_id")


@query("h05_dashboard")
def _(spark, sf):
    rows = dashboards.dashboard_documents(t.assets(spark, sf), t.events(spark, sf), now=NOW, period_days=10, role="operator")
    return exports.json_documents(rows, "tenant")


# --- K: chain report -----------------------------------------------------------------------------


@query("k01_chain_filter")
def _(spark, sf):
    fields = _fields(spark, sf)
    by_user = csb.chain_filter(fields, user="48 ANN").select("seq", F.lit("user").alias("by"))
    by_script = csb.chain_filter(fields, script="64_TMC_7").select("seq", F.lit("script").alias("by"))
    by_sscc = csb.chain_filter(fields, sscc=str(42).zfill(18)).select("seq", F.lit("sscc").alias("by"))
    return by_user.unionByName(by_script).unionByName(by_sscc)


@query("k02_touched")
def _(spark, sf):
    return csb.touched(_fields(spark, sf))


@query("k03_chain_errors")
def _(spark, sf):
    return csb.chain_errors(_fields(spark, sf))


@query("k04_chain_tail")
def _(spark, sf):
    return csb.chain_tail(_fields(spark, sf)).select("seq", "timestamp", "kind", "command", text("sscc").alias("sscc"))


def _warehouse_report(spark, sf, **depth) -> DataFrame:
    events = csb.csb_to_events(csb.parse_csb(t.csb_lines(spark, sf)))
    rows = csb.csb_report(events, "t0:csb", user="berg", **depth)
    return rows.select(
        "asset_id", "total_lines", "matched_lines", F.col("filters")["user"].alias("user_filter"),
        text("users_touched").alias("users"), text("scripts_touched").alias("scripts"),
        F.size("errors").cast("bigint").alias("errors"), F.size("chain").cast("bigint").alias("chain"),
        F.element_at("chain", 1)["seq"].alias("chain_from"), F.element_at("chain", -1)["seq"].alias("chain_to"),
    )


@query("k05_csb_report")
def _(spark, sf):
    return _warehouse_report(spark, sf, limit=20000)


@query("k05_csb_report_all")
def _(spark, sf):
    return _warehouse_report(spark, sf)
