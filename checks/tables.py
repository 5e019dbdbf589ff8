"""Derive the package's input tables from the driver tables. Projections only; whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def canonical(raw: DataFrame) -> DataFrame:
    """Driver events -> log events of 60 assets in 3 tenants with error storms at the end of the month."""
    storm = "(day(ts) >= 22 AND (user_id % 60) % 5 = 0)"
    return raw.selectExpr(
        "event_id AS seq",
        "concat('t', user_id % 3, ':srv-', lpad(user_id % 60, 2, '0')) AS asset_id",
        f"""CASE WHEN {storm} THEN 'windows_eventlog'
            ELSE element_at(array('windows_eventlog', 'ilo_iml', 'linux', 'app', 'agentless_ssh'),
                            cast(event_id % 5 AS int) + 1) END AS source""",
        f"""CASE WHEN {storm} THEN concat('disk error EventID=153 block=', event_id)
            WHEN event_type = 'error' THEN
              CASE (event_id div 5) % 5
                WHEN 0 THEN concat('EventID=6008 RecordId=', event_id, ' unexpected shutdown')
                WHEN 1 THEN concat('disk error EventID=153 block=', user_id)
                WHEN 2 THEN concat('fan failed thermal caution zone ', user_id)
                WHEN 3 THEN concat('power supply redundancy lost bay ', user_id)
                ELSE concat('service timeout code=', user_id, ' host=10.0.', user_id % 250, '.', event_id % 250)
              END
            WHEN event_type = 'signup' THEN concat('EventID=4625 failed login user=', user_id)
            ELSE concat(event_type, ' request ', event_id, ' done') END AS message""",
        "CASE event_type WHEN 'purchase' THEN 'iowait' WHEN 'view' THEN 'cpu_load' END AS metric",
        "CASE WHEN event_type IN ('purchase', 'view') THEN value END AS value",
        "CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity",
        "cast(ts AS timestamp) AS ts",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(table(spark, sf_dir, "events"))


def asset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select("asset_id").distinct()


def assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset that logs."""
    number = "cast(right(asset_id, 2) AS int)"
    return asset_ids(spark, sf_dir).selectExpr(
        "asset_id AS id", "concat('server ', asset_id) AS name",
        f"element_at(array('server', 'storage_shelf', 'network', 'bmc'), {number} % 4 + 1) AS asset_type",
        f"CASE WHEN {number} % 10 <> 0 THEN concat('R', {number} % 7) END AS location",
    )


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An asset registry that lacks the shelves, so that their events are orphans."""
    return assets(spark, sf_dir).filter("asset_type <> 'storage_shelf'")


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One collector per customer; those of customers without events never ran."""
    return table(spark, sf_dir, "customer").selectExpr(
        "concat('col-', c_custkey) AS id", "c_name AS name",
        "concat('10.1.', c_custkey % 250, '.', c_nationkey) AS address",
        """element_at(array('winrm', 'ssh', 'snmp', 'ilo', 'csb_merp_share'), cast(c_custkey % 5 AS int) + 1)
           AS collector_type""",
        "cast(5000 + c_custkey % 1000 AS int) AS port", "'svc' AS username", "c_mktsegment AS password",
        "c_nationkey + 5 AS poll_interval_sec", "c_acctbal >= 0 AS enabled",
        "concat('t', c_custkey % 3, ':srv-', lpad(c_custkey % 60, 2, '0')) AS asset_id",
        "'public' AS snmp_community",
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_of(table(spark, sf_dir, "events"))


def runs_of(raw: DataFrame) -> DataFrame:
    """Run log: one run of collector col-<user> per event; error events are failed runs."""
    return raw.selectExpr(
        "event_id AS id", "cast(ts AS timestamp) AS ts", "concat('col-', user_id) AS target_id",
        """element_at(array('winrm', 'ssh', 'snmp', 'ilo', 'csb_merp_share'), cast(user_id % 5 AS int) + 1)
           AS collector_type""",
        "cast(CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END AS int) AS accepted_events",
        "CASE WHEN event_type = 'error' THEN concat('timeout after ', event_id % 7, ' s') END AS last_error",
        "CASE WHEN event_type <> 'error' THEN cast(event_id AS string) END AS last_cursor",
        "CASE WHEN event_type = 'view' THEN value END AS latency_ms",
    )


def policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One policy per nation."""
    return table(spark, sf_dir, "nation").selectExpr(
        "concat('pol-', n_nationkey) AS id", "n_name AS name", "concat('t', n_nationkey % 3) AS tenant_id",
        "array('Linux', element_at(array('app', 'ilo_iml'), n_nationkey % 2 + 1)) AS ignore_sources",
        """array('click request <num> done', concat(element_at(array('view', 'purchase'), n_nationkey % 2 + 1),
                 ' request <num> done')) AS ignore_signatures""",
        "n_regionkey <> 4 AS enabled",
    )


def policy_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two states of a policy table with one policy per part."""
    part = table(spark, sf_dir, "part")
    before = part.filter("p_size <> 1").selectExpr(
        "concat('pol-', p_partkey) AS id", "p_name AS name", "concat('t', p_partkey % 3) AS tenant_id",
        "array(p_brand, 'linux') AS ignore_sources", "array(p_type) AS ignore_signatures",
        "p_retailprice < 1000 AS enabled",
    )
    after = part.filter("p_size <> 2").selectExpr(
        "concat('pol-', p_partkey) AS id",
        "CASE WHEN p_size = 3 THEN concat(p_name, ' new') ELSE p_name END AS name",
        "concat('t', p_partkey % 3) AS tenant_id",
        "CASE WHEN p_size = 4 THEN array('linux') ELSE array('linux', p_brand) END AS ignore_sources",
        "array(p_type) AS ignore_signatures",
        "CASE WHEN p_size <= 6 THEN p_retailprice >= 1000 ELSE p_retailprice < 1000 END AS enabled",
    )
    return before, after


def policy_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Policy change log, one row per order; urgent ones carry broken JSON."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "unix_timestamp(cast(o_orderdate AS timestamp)) AS ts",
        "concat('pol-', o_custkey) AS policy_id", "concat('t', o_custkey % 3) AS tenant_id",
        "CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS action",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'admin' ELSE 'operator' END AS actor_role",
        """CASE WHEN o_orderpriority = '1-URGENT' THEN concat('{"action": broken ', o_orderkey)
           WHEN o_orderstatus = 'F' THEN
             '{"schema_version":1,"action":"delete","changed_fields":["deleted"],"before":{"enabled":true}}'
           WHEN o_orderstatus = 'O' THEN
             '{"schema_version":1,"action":"upsert","changed_fields":["enabled"],"before":null}'
           ELSE '{"schema_version":1,"action":"upsert","changed_fields":["name","ignore_sources"]}' END AS details""",
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Request log, one row per order."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS id", "unix_timestamp(cast(o_orderdate AS timestamp)) AS ts",
        """element_at(array('GET', 'POST', 'DELETE'),
             CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END) AS method""",
        """element_at(array('/auth/audit.csv', '/auth/compliance/run', '/worker/history', '/worker/run-once',
             '/collectors/col-1', '/assets', '/events', '/ingest/csb-merp', '/health'),
             cast(o_custkey % 9 AS int) + 1) AS path""",
        """CASE o_orderpriority WHEN '1-URGENT' THEN 'admin' WHEN '2-HIGH' THEN 'operator'
             WHEN '3-MEDIUM' THEN 'Viewer' WHEN '5-LOW' THEN 'guest' END AS role""",
    )


def rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused tokens, one per event; view events carry an unreadable token, clicks none."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "unix_timestamp(cast(ts AS timestamp)) AS ts", "event_type AS reason",
        "concat('iss-', user_id % 5) AS iss", "concat('app-', user_id % 4) AS azp", "event_type",
    ).select(
        "id", "ts", "reason",
        F.when(
            F.col("event_type") == "view", F.lit("a.%%%.c")
        ).when(
            F.col("event_type") != "click",
            F.concat(
                F.lit("h."),
                F.translate(
                    F.rtrim(F.translate(F.base64(F.to_json(F.struct(
                        "iss", F.when(F.col("event_type") != "error", F.col("azp")).alias("azp"),
                    )).cast("binary")), "=", " ")),
                    "+/", "-_",
                ),
                F.lit(".s"),
            ),
        ).alias("token"),
    )


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document as a log line of the asset <source>."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("t0:"), F.coalesce("source", F.lit("none"))).alias("asset_id"),
        F.col("doc_id").cast("string").alias("file"),
        F.posexplode(F.split("text", "\n")).alias("line_no", "value"),
    ).withColumn("collected_ts", F.lit("2024-02-01 00:00:00").cast("timestamp"))


def csb_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warehouse log lines, one per order, of three assets; pending orders write unparsable lines."""
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS seq", "concat('t', o_custkey % 3, ':csb') AS asset_id",
        "date_format(o_orderdate, 'yyyyMMdd') AS day",
        """CASE WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN concat('broken line ', o_orderkey) ELSE
           concat('  ', date_format(o_orderdate, 'dd.MM.yyyy HH:mm:ss.SSS'), ' 4619-', o_custkey, ' ID ', o_orderkey,
             CASE o_orderpriority
               WHEN '1-URGENT' THEN concat(' Write     SYS+ERRINFO;!:L1+', 4000 + o_custkey % 50, '+2+"Bad row ',
                                           o_custkey, '"+""')
               WHEN '2-HIGH' THEN concat(' Query     SYS+SKRIPT;?:L1+"64_TMC_', o_custkey % 20, '":L2+"A":L3+8')
               WHEN '3-MEDIUM' THEN concat(' Write     SYS+LOGIN;!:L1+903003+2:L2+', 4800 + o_custkey % 100,
                                           '+82+9048+"Ann"+"Berg', o_custkey % 10, '":L3+""')
               WHEN '5-LOW' THEN concat(' Query     DT8580+SSCCDET;?:L1+', lpad(o_custkey, 18, '0'), '+',
                                        lpad(o_orderkey, 18, '0'))
               ELSE concat(' Import    STOCK error ', o_orderkey) END) END AS value""",
    )


def winevents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed Windows records as JSON text, one per event."""
    return table(spark, sf_dir, "events").selectExpr(
        "concat('col-', user_id) AS target_id",
        "concat('t', user_id % 3, ':srv-', lpad(user_id % 60, 2, '0')) AS asset_id",
        "timestamp '2024-02-01 00:00:00' AS collected_ts",
        "event_id", "user_id", "event_type", "value",
        "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS created",
    ).select(
        "target_id", "asset_id", "collected_ts",
        F.to_json(F.struct(
            F.col("event_id").alias("RecordId"), (F.col("user_id") % 7000).alias("Id"),
            F.when(F.col("event_type") != "click", F.lit("System")).alias("LogName"),
            F.lit("Disk").alias("ProviderName"),
            F.when(F.col("event_type") == "error", F.lit("Critical"))
            .when(F.col("event_type") == "signup", F.lit("Warning"))
            .when(F.col("event_type") == "view", F.lit("Error")).alias("LevelDisplayName"),
            F.when(F.col("event_type") != "purchase", F.col("created")).alias("TimeCreated"),
            F.when(F.col("event_type") != "view", F.concat(F.lit("block "), F.col("event_id").cast("string"))).alias("Message"),
        )).alias("record"),
    )


def redfish_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device payloads, one per order, holding its lineitems as log entries under changing keys."""
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("payload_id"), "l_linenumber",
        F.struct(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("Id"),
            F.when(F.col("l_returnflag") == "R", F.lit("Critical"))
            .when(F.col("l_returnflag") == "A", F.lit("Caution")).alias("Severity"),
            F.concat(F.lit("Part "), F.col("l_partkey").cast("string"), F.lit(" failed")).alias("Message"),
            F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("Created"),
        ).alias("entry"),
    )
    # an order has a handful of lineitems
    grouped = lines.groupBy("payload_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "entry"))), lambda r: r["entry"]).alias("m")
    )
    members = F.to_json("m")
    return grouped.select(
        "payload_id", F.concat(F.lit("col-"), (F.col("payload_id") % 100).cast("string")).alias("target_id"),
        F.concat(F.lit("t0:srv-"), F.lpad((F.col("payload_id") % 60).cast("string"), 2, "0")).alias("asset_id"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("collected_ts"),
        F.when(F.col("payload_id") % 4 == 0, F.concat(F.lit('{"Members":'), members, F.lit("}")))
        .when(F.col("payload_id") % 4 == 1, F.concat(F.lit('{"Members":null,"items":'), members, F.lit("}")))
        .when(F.col("payload_id") % 4 == 2, F.concat(F.lit('{"links":{"Member":'), members, F.lit("}}")))
        .otherwise(F.to_json(F.get("m", F.lit(0)))).alias("payload"),
    )


def link_payloads(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Payloads that hold only links to entries, and the landed entry documents of shipped items."""
    lines = table(spark, sf_dir, "lineitem")
    link = F.concat(F.lit("/Entries/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_linenumber").cast("string"))
    payloads = lines.groupBy(F.col("l_orderkey").alias("payload_id")).agg(
        F.sort_array(F.collect_list(F.concat(F.lit('{"@odata.id":"'), link, F.lit('"}')))).alias("m")
    ).select(
        "payload_id", F.concat(F.lit("col-"), (F.col("payload_id") % 100).cast("string")).alias("target_id"),
        F.concat(F.lit("t0:srv-"), F.lpad((F.col("payload_id") % 60).cast("string"), 2, "0")).alias("asset_id"),
        F.lit("2024-02-01 00:00:00").cast("timestamp").alias("collected_ts"),
        F.concat(F.lit('{"Members":['), F.concat_ws(",", "m"), F.lit("]}")).alias("payload"),
    )
    docs = lines.filter(F.col("l_linestatus") == "F").select(
        link.alias("odata_id"),
        F.to_json(F.struct(
            F.col("l_linenumber").alias("Number"),
            F.concat(F.lit("Slot of order "), F.col("l_orderkey").cast("string")).alias("Message"),
            F.lit("Warning").alias("Severity"),
        )).alias("body"),
    )
    return payloads, docs
