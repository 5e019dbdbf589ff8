"""The registered queries once more as plain SQL for DuckDB, written independently of the package."""

from __future__ import annotations

import re


def sig(expr: str) -> str:
    out = f"lower({expr})"
    for pattern, placeholder in (
        (r"\b\d{1,3}(?:\.\d{1,3}){3}\b", "<ip>"),
        (r"\b0x[0-9a-f]+\b", "<hex>"),
        (r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<guid>"),
        (r"\b\d+\b", "<num>"),
        (r"\s+", " "),
    ):
        out = f"regexp_replace({out}, '{pattern}', '{placeholder}', 'g')"
    return f"trim({out})"


def cid(source: str, signature: str) -> str:
    letters = f"substr(regexp_replace(lower({source}), '[^a-z0-9]', '', 'g'), 1, 6)"
    return (
        f"('cl-' || CASE WHEN {letters} = '' THEN 'src' ELSE {letters} END || '-' || "
        f"substr(sha1({source} || '|' || {signature}), 1, 8))"
    )


def share(part: str, whole: str) -> str:
    return f"round({part}::DOUBLE / {whole}, 3)"


RULES = (
    (0, "Repeated unexpected shutdown pattern", "windows_eventlog", "eventid=6008|eventid=41", 2, 0.87,
     "Check power, UPS and the Kernel-Power log; run hardware diagnostics."),
    (1, "Burst of failed logons", "windows_eventlog", "eventid=4625", 5, 0.78,
     "Find where the logons come from, lock accounts, restrict RDP and SMB."),
    (2, "Windows storage error cluster", "windows_eventlog", "eventid=(7|51|55|153)", 3, 0.81,
     "Check controller, cables and disk; run chkdsk and storage path diagnostics."),
    (3, "iLO thermal/fan alert pattern", "ilo_iml", "fan|thermal|temperature|overheating|caution", 2, 0.84,
     "Check fans, thermal paste and airflow in the rack."),
    (4, "iLO power supply fault", "ilo_iml", "power supply|power fault|power failure|redundan", 1, 0.90,
     "Check power supplies, cables and UPS modules; replace the faulty unit."),
    (5, "iLO storage degradation pattern", "ilo_iml", "drive|disk|smart|storage|array", 2, 0.82,
     "Check SMART state and the array controller; prepare a disk replacement."),
)
ACCESS = (
    ("GET", "/auth/audit", 2, "read auth audit", "viewer"),
    ("POST", "/auth/compliance/run", 2, "run compliance report", "viewer"),
    ("GET", "/worker/history", 1, "read worker history", "admin"),
    ("POST", "/worker/run-once", 1, "run worker", "admin"),
    ("GET", "/collectors", 1, "read collectors", "admin"),
    ("POST", "/collectors", 1, "write collectors", "admin"),
    ("DELETE", "/collectors", 1, "delete collectors", "admin"),
    ("POST", "/assets", 1, "write assets", "admin"),
    ("POST", "/events", 1, "write events", "admin"),
    ("POST", "/ingest/csb-merp", 1, "ingest csb-merp logs", "admin"),
)


def values(rows) -> str:
    def cell(v):
        return f"{v}::DOUBLE" if isinstance(v, float) else str(v) if isinstance(v, int) else f"'{v}'"

    return ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)


SEVERITY_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE severity = '{s}') AS {s}_count" for s in ("info", "warning", "critical")
)
STORM = "(day(ts) >= 22 AND (user_id % 60) % 5 = 0)"
TYPES = "['winrm', 'ssh', 'snmp', 'ilo', 'csb_merp_share']"

# name -> definition; a definition may use the ones above it
CTES = {
    "ev": f"""
        SELECT event_id AS seq,
          't' || (user_id % 3) || ':srv-' || lpad((user_id % 60)::VARCHAR, 2, '0') AS asset_id,
          CASE WHEN {STORM} THEN 'windows_eventlog'
            ELSE ['windows_eventlog', 'ilo_iml', 'linux', 'app', 'agentless_ssh'][event_id % 5 + 1] END AS source,
          CASE WHEN {STORM} THEN 'disk error EventID=153 block=' || event_id
            WHEN event_type = 'error' THEN CASE (event_id // 5) % 5
              WHEN 0 THEN 'EventID=6008 RecordId=' || event_id || ' unexpected shutdown'
              WHEN 1 THEN 'disk error EventID=153 block=' || user_id
              WHEN 2 THEN 'fan failed thermal caution zone ' || user_id
              WHEN 3 THEN 'power supply redundancy lost bay ' || user_id
              ELSE 'service timeout code=' || user_id || ' host=10.0.' || (user_id % 250) || '.' || (event_id % 250) END
            WHEN event_type = 'signup' THEN 'EventID=4625 failed login user=' || user_id
            ELSE event_type || ' request ' || event_id || ' done' END AS message,
          CASE event_type WHEN 'purchase' THEN 'iowait' WHEN 'view' THEN 'cpu_load' END AS metric,
          CASE WHEN event_type IN ('purchase', 'view') THEN value END AS value,
          CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' ELSE 'info' END AS severity,
          ts
        FROM events""",
    "assets": """
        SELECT id, 'server ' || id AS name,
          ['server', 'storage_shelf', 'network', 'bmc'][n % 4 + 1] AS asset_type,
          CASE WHEN n % 10 <> 0 THEN 'R' || (n % 7) END AS location
        FROM (SELECT DISTINCT asset_id AS id, right(asset_id, 2)::INTEGER AS n FROM ev)""",
    "targets": f"""
        SELECT 'col-' || c_custkey AS id, c_name AS name,
          {TYPES}[c_custkey % 5 + 1] AS collector_type, c_nationkey + 5 AS poll_interval_sec,
          c_acctbal >= 0 AS enabled, (c_custkey % 1000)::INTEGER AS ilo_event_limit,
          '10.1.' || (c_custkey % 250) || '.' || c_nationkey AS address, 5000 + c_custkey % 1000 AS port,
          't' || (c_custkey % 3) || ':srv-' || lpad((c_custkey % 60)::VARCHAR, 2, '0') AS asset_id
        FROM customer""",
    "runs": f"""
        SELECT event_id AS id, ts, 'col-' || user_id AS target_id, {TYPES}[user_id % 5 + 1] AS collector_type,
          (CASE WHEN event_type = 'error' THEN 0 ELSE event_id % 4 END)::INTEGER AS accepted_events,
          CASE WHEN event_type = 'error' THEN 'timeout after ' || (event_id % 7) || ' s' END AS last_error,
          CASE WHEN event_type <> 'error' THEN event_id::VARCHAR END AS last_cursor,
          CASE WHEN event_type = 'view' THEN value END AS latency_ms
        FROM events""",
    "streaks": """
        SELECT *, row_number() OVER (PARTITION BY target_id, spell ORDER BY id)
            - CASE WHEN spell = 0 THEN 0 ELSE 1 END AS failure_streak
        FROM (SELECT *, count(*) FILTER (WHERE last_error IS NULL)
                OVER (PARTITION BY target_id ORDER BY id) AS spell FROM runs)""",
    "state": """
        SELECT target_id, max(ts) FILTER (WHERE last_error IS NULL) AS last_success_ts, max(ts) AS last_run_ts,
          arg_max_null(last_error, id) AS last_error, arg_max(last_cursor, id) AS last_cursor,
          arg_max(failure_streak, id) AS failure_streak
        FROM streaks GROUP BY target_id""",
    "policies": """
        SELECT 'pol-' || n_nationkey AS id, n_name AS name, 't' || (n_nationkey % 3) AS tenant_id,
          ['linux', ['app', 'ilo_iml'][n_nationkey % 2 + 1]] AS ignore_sources,
          ['click request <num> done', ['view', 'purchase'][n_nationkey % 2 + 1] || ' request <num> done']
            AS ignore_signatures,
          n_regionkey <> 4 AS enabled
        FROM nation""",
    "paudit": """
        SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS ts, 'pol-' || o_custkey AS policy_id,
          't' || (o_custkey % 3) AS tenant_id, CASE WHEN o_orderstatus = 'F' THEN 'delete' ELSE 'upsert' END AS action,
          CASE WHEN o_orderkey % 2 = 0 THEN 'admin' ELSE 'operator' END AS actor_role,
          o_orderpriority <> '1-URGENT' AS valid,
          CASE o_orderstatus WHEN 'F' THEN 'deleted' WHEN 'O' THEN 'enabled' ELSE 'name,ignore_sources' END AS changed,
          CASE WHEN o_orderpriority = '1-URGENT' THEN '{"action": broken ' || o_orderkey
            WHEN o_orderstatus = 'F' THEN
              '{"schema_version":1,"action":"delete","changed_fields":["deleted"],"before":{"enabled":true}}'
            WHEN o_orderstatus = 'O' THEN
              '{"schema_version":1,"action":"upsert","changed_fields":["enabled"],"before":null}'
            ELSE '{"schema_version":1,"action":"upsert","changed_fields":["name","ignore_sources"]}' END AS details
        FROM orders""",
    "paudit_hits": """
        SELECT * FROM paudit WHERE tenant_id = 't1' AND action = 'upsert' AND ts >= 800000000
          AND valid AND changed = 'enabled'""",
    "req": """
        SELECT o_orderkey AS id, epoch(o_orderdate)::BIGINT AS ts,
          CASE o_orderstatus WHEN 'F' THEN 'GET' WHEN 'O' THEN 'POST' ELSE 'DELETE' END AS method,
          ['/auth/audit.csv', '/auth/compliance/run', '/worker/history', '/worker/run-once',
           '/collectors/col-1', '/assets', '/events', '/ingest/csb-merp', '/health'][o_custkey % 9 + 1] AS path,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'admin' WHEN '2-HIGH' THEN 'operator'
            WHEN '3-MEDIUM' THEN 'viewer' WHEN '5-LOW' THEN 'viewer' END AS role
        FROM orders""",
    "audit": f"""
        SELECT id, ts, path, coalesce(role, default_role) AS role, action,
          CASE WHEN (CASE coalesce(role, default_role) WHEN 'admin' THEN 2 WHEN 'operator' THEN 1 ELSE 0 END) >= need
            THEN 'allow' ELSE 'deny' END AS result
        FROM req JOIN (VALUES {values(ACCESS)}) AS rules(m, prefix, need, action, default_role)
          ON req.method = rules.m AND starts_with(req.path, rules.prefix)""",
    "rej": """
        SELECT event_id AS id, epoch(date_trunc('second', ts))::BIGINT AS ts, event_type AS reason,
          CASE WHEN event_type IN ('view', 'click') THEN 'unknown' ELSE 'iss-' || (user_id % 5) END AS issuer,
          CASE WHEN event_type IN ('view', 'click', 'error') THEN 'unknown' ELSE 'app-' || (user_id % 4) END AS client
        FROM events""",
    "doclines": """
        SELECT 't0:' || coalesce(source, 'none') AS asset_id, doc_id::VARCHAR AS file,
          unnest(string_split(text, chr(10))) AS value,
          generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents""",
    "docevents": """
        SELECT asset_id, file, line_no, 'logfile' AS source, value AS message,
          NULL::VARCHAR AS metric, NULL::DOUBLE AS value,
          CASE WHEN lower(value) LIKE '%panic%' OR lower(value) LIKE '%critical%' THEN 'critical'
            WHEN lower(value) LIKE '%error%' OR lower(value) LIKE '%failed%' THEN 'warning' ELSE 'info' END AS severity,
          TIMESTAMP '2024-02-01 00:00:00' AS ts
        FROM doclines""",
    "csb": """
        SELECT o_orderkey AS seq, 't' || (o_custkey % 3) || ':csb' AS asset_id,
          strftime(o_orderdate, '%Y%m') AS month, o_orderdate AS ts, o_orderpriority AS p, o_custkey AS c,
          NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0) AS parsed,
          strftime(o_orderdate, '%d.%m.%Y %H:%M:%S') || '.000' AS ts_text,
          '4619-' || o_custkey AS session, o_orderkey::VARCHAR AS thread_id,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'Write' WHEN '3-MEDIUM' THEN 'Write' WHEN '2-HIGH' THEN 'Query'
            WHEN '5-LOW' THEN 'Query' ELSE 'Import' END AS kind,
          CASE WHEN o_orderpriority IN ('1-URGENT', '3-MEDIUM', '2-HIGH', '5-LOW') THEN '     '
            ELSE '    ' END AS gap,
          CASE o_orderpriority
            WHEN '1-URGENT' THEN 'SYS+ERRINFO;!:L1+' || (4000 + o_custkey % 50) || '+2+"Bad row ' || o_custkey || '"+""'
            WHEN '2-HIGH' THEN 'SYS+SKRIPT;?:L1+"64_TMC_' || (o_custkey % 20) || '":L2+"A":L3+8'
            WHEN '3-MEDIUM' THEN 'SYS+LOGIN;!:L1+903003+2:L2+' || (4800 + o_custkey % 100) || '+82+9048+"Ann"+"Berg'
              || (o_custkey % 10) || '":L3+""'
            WHEN '5-LOW' THEN 'DT8580+SSCCDET;?:L1+' || lpad(o_custkey::VARCHAR, 18, '0') || '+'
              || lpad(o_orderkey::VARCHAR, 18, '0')
            ELSE 'STOCK error ' || o_orderkey END AS payload,
          CASE o_orderpriority WHEN '1-URGENT' THEN 'SYS+ERRINFO' WHEN '2-HIGH' THEN 'SYS+SKRIPT'
            WHEN '3-MEDIUM' THEN 'SYS+LOGIN' WHEN '5-LOW' THEN 'DT8580+SSCCDET'
            ELSE 'STOCK error ' || o_orderkey END AS command,
          CASE WHEN p = '5-LOW' THEN lpad(c::VARCHAR, 18, '0') || ',' || lpad(seq::VARCHAR, 18, '0') ELSE '' END AS sscc,
          CASE WHEN p = '2-HIGH' THEN '64_TMC_' || (c % 20) END AS script,
          CASE WHEN p = '3-MEDIUM' THEN (4800 + c % 100)::VARCHAR END AS user_id,
          CASE WHEN p = '3-MEDIUM' THEN 'Ann Berg' || (c % 10) END AS user_name,
          CASE WHEN p = '1-URGENT' THEN (4000 + c % 50)::VARCHAR END AS error_code,
          CASE WHEN p = '1-URGENT' THEN 'Bad row ' || c END AS error_message
        FROM orders""",
    "csbp": """
        SELECT *, ts_text || ' ' || session || ' ID ' || thread_id || ' ' || kind || gap || payload AS raw,
          CASE WHEN p IN ('1-URGENT') OR command LIKE 'STOCK%' THEN 'warning' ELSE 'info' END AS severity
        FROM csb WHERE parsed""",
    "win0": f"""
        SELECT *, {sig("message")} AS signature
        FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq DESC) AS newest FROM ev)""",
    "win": """
        SELECT *, hour(ts) AS hour, pos > total - recent_rows AS is_recent
        FROM (SELECT *, least(greatest(10, total // 3), total) AS recent_rows
              FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS pos,
                      count(*) OVER (PARTITION BY asset_id) AS total FROM win0))""",
    "cl": f"""
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY events_count DESC, first_seq) AS cluster_rank
        FROM (SELECT asset_id, source, signature, {cid("source", "signature")} AS cluster_id,
                arg_min(message, seq) AS example_message, count(*) AS events_count,
                {share("count(*)", "max(total)")} AS share, {SEVERITY_COUNTS}, max(total) AS total, min(seq) AS first_seq
              FROM win GROUP BY asset_id, source, signature)""",
    "rare": """
        SELECT asset_id, 'rare_pattern' AS kind,
          CASE WHEN critical_count > 0 THEN 'critical' ELSE 'warning' END AS severity,
          CASE WHEN critical_count > 0 THEN 0.84::DOUBLE ELSE 0.72::DOUBLE END AS confidence,
          cluster_id AS related_cluster_id, NULL::VARCHAR AS related_metric, first_seq, 0 AS kind_order, cluster_rank,
          'Rule: count <= ' || cap || ' (5% of the window) | Cluster ' || cluster_id || ': ' || events_count || ' of '
            || total || ' events | Example: ' || example_message AS evidence
        FROM (SELECT *, greatest(1, floor(total * 0.05::DOUBLE)::BIGINT) AS cap FROM cl)
        WHERE events_count <= cap AND (critical_count > 0
          OR regexp_matches(lower(example_message), 'error|fail|timeout|panic|denied|refused|critical'))""",
    "hours": """
        SELECT asset_id, hour, count(*) AS n FROM win WHERE NOT is_recent GROUP BY asset_id, hour""",
    "hour_cl": """
        SELECT asset_id, hour, source, signature, count(*) AS n FROM win WHERE NOT is_recent
        GROUP BY asset_id, hour, source, signature""",
    "rates": f"""
        SELECT c.asset_id, c.source, c.signature, c.cluster_id, c.cluster_rank, c.critical_count, c.total,
          c.events_count, w.recent_count, w.recent_rows, w.first_recent_seq,
          w.recent_count::DOUBLE / w.recent_rows AS recent_rate, w.older_rate,
          CASE WHEN h.n > 0 THEN coalesce(hc.n, 0)::DOUBLE / h.n ELSE w.older_rate END AS hourly_baseline
        FROM cl c JOIN (
          SELECT asset_id, source, signature, count(*) FILTER (WHERE is_recent) AS recent_count,
            max(recent_rows) AS recent_rows, min(seq) FILTER (WHERE is_recent) AS first_recent_seq,
            arg_max(hour, seq) FILTER (WHERE is_recent) AS last_hour,
            CASE WHEN max(total) > max(recent_rows) THEN
              count(*) FILTER (WHERE NOT is_recent)::DOUBLE / (max(total) - max(recent_rows)) ELSE 0 END AS older_rate
          FROM win GROUP BY asset_id, source, signature) w USING (asset_id, source, signature)
        LEFT JOIN hours h ON h.asset_id = c.asset_id AND h.hour = w.last_hour
        LEFT JOIN hour_cl hc ON hc.asset_id = c.asset_id AND hc.hour = w.last_hour
          AND hc.source = c.source AND hc.signature = c.signature""",
    "burst": """
        SELECT asset_id, 'burst_pattern' AS kind,
          CASE WHEN critical_count > 0 THEN 'critical' ELSE 'warning' END AS severity,
          CASE WHEN critical_count > 0 THEN 0.86::DOUBLE ELSE 0.8::DOUBLE END AS confidence,
          cluster_id AS related_cluster_id, NULL::VARCHAR AS related_metric, first_recent_seq AS first_seq,
          1 AS kind_order, cluster_rank
        FROM rates WHERE total > recent_rows AND recent_count >= 3 AND recent_rate >= 0.4::DOUBLE
          AND older_rate <= 0.2::DOUBLE AND hourly_baseline <= 0.15::DOUBLE""",
    "med": """
        SELECT asset_id, metric, count(*) AS samples, min(seq) AS first_seq, median(value) AS median_value,
          arg_max(value, seq) AS last_value
        FROM win WHERE metric IS NOT NULL AND value IS NOT NULL GROUP BY asset_id, metric""",
    "mstats": """
        SELECT *, CASE WHEN mad <> 0 THEN abs(last_value - median_value) / (1.4826::DOUBLE * mad) END AS robust_z
        FROM (SELECT m.*, d.mad FROM med m JOIN (
          SELECT w.asset_id, w.metric, median(abs(w.value - m.median_value)) AS mad
          FROM win w JOIN med m ON w.asset_id = m.asset_id AND w.metric = m.metric WHERE w.value IS NOT NULL
          GROUP BY w.asset_id, w.metric) d USING (asset_id, metric))""",
    "outliers": """
        SELECT asset_id, 'metric_outlier' AS kind, 'warning' AS severity,
          least(0.95::DOUBLE, round(0.65::DOUBLE + robust_z / 10, 2)) AS confidence,
          NULL::VARCHAR AS related_cluster_id, metric AS related_metric, first_seq, 2 AS kind_order, 0 AS cluster_rank
        FROM mstats WHERE samples >= 6 AND robust_z >= 3""",
    "found": """
        SELECT asset_id, kind, severity, confidence, related_cluster_id, related_metric, first_seq, kind_order,
          cluster_rank FROM rare
        UNION ALL SELECT * FROM burst UNION ALL SELECT * FROM outliers""",
    "ranked": """
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind_order, first_seq)
            AS anomaly_rank FROM found WHERE cluster_rank <= 30 QUALIFY anomaly_rank <= 20""",
    "ranked15": """
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind_order, first_seq)
            AS anomaly_rank FROM found WHERE cluster_rank <= 15 QUALIFY anomaly_rank <= 15""",
    "ranked10": """
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY confidence DESC, kind_order, first_seq)
            AS anomaly_rank FROM found WHERE cluster_rank <= 10 QUALIFY anomaly_rank <= 10""",
    "reasons": """
        SELECT * FROM (VALUES ('rare_pattern', 'Rare log pattern that looks like an error'),
          ('burst_pattern', 'Burst of one repeated pattern among the latest events'),
          ('metric_outlier', 'Metric value far outside its usual range')) AS r(kind, reason)""",
    "last1000": """
        SELECT * FROM ev""",
    "alerts": """
        SELECT asset_id, 'warning' AS severity, 'High iowait' AS reason, 0 AS no FROM last1000
          WHERE metric = 'iowait' AND value >= 25 GROUP BY asset_id
        UNION ALL SELECT asset_id, 'critical', 'Thermal warning', 1 FROM last1000
          WHERE lower(message) LIKE '%thermal%' GROUP BY asset_id
        UNION ALL SELECT asset_id, 'critical', 'SMART degradation', 2 FROM last1000
          WHERE lower(message) LIKE '%smart%' GROUP BY asset_id""",
    "corr": f"""
        SELECT asset_id, no AS rule_no, title, confidence, count(*) AS evidence_count, recommendation
        FROM last1000 JOIN (VALUES {values(RULES)}) AS r(no, title, src, pattern, need, confidence, recommendation)
          ON source = src AND regexp_matches(lower(message), pattern)
        GROUP BY asset_id, no, title, confidence, need, recommendation HAVING count(*) >= need""",
    "hints": """
        SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY part, place) AS hint_rank FROM (
          SELECT asset_id, 0 AS part, anomaly_rank AS place, kind || ': ' || severity AS title, reason AS rationale,
            round(confidence, 2) AS confidence,
            'Check the runbook for ''' || kind || ''' and verify the origin: '
              || coalesce(related_cluster_id, related_metric, 'n/a') AS action FROM ranked15 JOIN reasons USING (kind) WHERE anomaly_rank <= 5
          UNION ALL SELECT asset_id, 1, rule_no, title, 'Correlation evidence count: ' || evidence_count,
            round(confidence, 2), recommendation FROM corr
          UNION ALL SELECT DISTINCT asset_id, 2, 0, 'No critical patterns',
            'No high-confidence anomalies or correlations in current window.', 0.4::DOUBLE,
            'Keep monitoring, compare trends daily, keep the basic runbook check.' FROM ev
            WHERE asset_id NOT IN (SELECT asset_id FROM corr UNION SELECT asset_id FROM ranked15))
        QUALIFY hint_rank <= 10""",
    "sets": "SELECT DISTINCT asset_id, source, signature FROM win0",
    "edges": """
        SELECT *, row_number() OVER (PARTITION BY asset_id
            ORDER BY shared_signatures DESC, co_occurrence_score DESC, source_a, source_b) AS edge_rank
        FROM (SELECT asset_id, a.source AS source_a, b.source AS source_b, count(*) AS shared_signatures,
                round(count(*)::DOUBLE / least(max(a.n), max(b.n)), 3) AS co_occurrence_score,
                min(signature) AS example_signature
              FROM (SELECT *, count(*) OVER (PARTITION BY asset_id, source) AS n FROM sets) a
              JOIN (SELECT *, count(*) OVER (PARTITION BY asset_id, source) AS n FROM sets) b
                USING (asset_id, signature)
              WHERE a.source < b.source GROUP BY asset_id, a.source, b.source)""",
    "briefs": """
        SELECT a.asset_id,
          coalesce(r.reasons[1], 'Dependency hotspot: ' || e.spots[1],
            'No significant incident patterns in current window') AS headline,
          round(least(0.35::DOUBLE + least(0.35::DOUBLE, coalesce(r.best * 0.4::DOUBLE, 0))
            + least(0.2::DOUBLE, coalesce(e.best * 0.2::DOUBLE, 0)) + 0.1::DOUBLE, 0.99::DOUBLE), 2) AS confidence,
          coalesce(array_to_string(r.reasons, '; '), '') AS anomaly_reasons,
          coalesce(array_to_string(e.spots, '; '), '') AS dependency_hotspots, h.actions, h.actions_text
        FROM (SELECT DISTINCT asset_id FROM ev) a
        LEFT JOIN (SELECT asset_id, list(reason ORDER BY anomaly_rank) FILTER (WHERE anomaly_rank <= 3) AS reasons,
            max(confidence) AS best FROM ranked10 JOIN reasons USING (kind) GROUP BY asset_id) r USING (asset_id)
        LEFT JOIN (SELECT asset_id,
            list(source_a || ' <-> ' || source_b || ' (' || shared_signatures || ')' ORDER BY edge_rank)
              FILTER (WHERE edge_rank <= 3) AS spots,
            max(co_occurrence_score) FILTER (WHERE edge_rank = 1) AS best FROM edges GROUP BY asset_id) e USING (asset_id)
        LEFT JOIN (SELECT asset_id, least(3, count(*)) AS actions,
            string_agg(action, '; ' ORDER BY hint_rank) FILTER (WHERE hint_rank <= 3) AS actions_text
          FROM hints GROUP BY asset_id) h USING (asset_id)""",
    "month": "SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-01 00:00:00'",
    "last10": "SELECT * FROM ev WHERE ts >= TIMESTAMP '2024-01-21 00:00:00'",
    "chosen": "SELECT * FROM policies WHERE id IN ('pol-0', 'pol-2', 'pol-6', 'pol-24') AND enabled",
    "items": """
        SELECT DISTINCT id, 'source' AS field, unnest(ignore_sources) AS item FROM chosen
        UNION SELECT DISTINCT id, 'signature', unnest(ignore_signatures) FROM chosen""",
    "hit": """
        SELECT *, source IN (SELECT item FROM items WHERE field = 'source')
            OR signature IN (SELECT item FROM items WHERE field = 'signature') AS ignored FROM win0""",
    "impact": f"""
        SELECT *, row_number() OVER (PARTITION BY asset_id
            ORDER BY impact_score DESC, events_filtered DESC, source DESC, signature DESC) AS impact_rank
        FROM (SELECT asset_id, source, signature, {cid("source", "signature")} AS cluster_id,
                count(*) AS events_filtered,
                sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)::DOUBLE AS impact_score
              FROM hit WHERE ignored GROUP BY asset_id, source, signature)""",
    "before": """
        SELECT 'pol-' || p_partkey AS id, 't' || (p_partkey % 3) AS tenant_id, p_size AS size,
          p_retailprice < 1000 AS enabled FROM part WHERE p_size <> 1""",
    "after": """
        SELECT 'pol-' || p_partkey AS id, 't' || (p_partkey % 3) AS tenant_id, p_size AS size,
          CASE WHEN p_size <= 6 THEN p_retailprice >= 1000 ELSE p_retailprice < 1000 END AS enabled
        FROM part WHERE p_size <> 2""",
    "ssh": """
        SELECT 't0:host-' || o_custkey AS asset_id, o_orderstatus AS st, o_custkey AS c, o_orderkey AS k,
          o_orderdate AS ts FROM orders""",
    "sshe": """
        SELECT asset_id, 'ssh_metrics' AS source, 'SSH metric load1=' || (c % 7) || '.5' AS message, 'load1' AS metric,
          (c % 7) + 0.5::DOUBLE AS value, ts FROM ssh WHERE st = 'O'
        UNION ALL SELECT asset_id, 'ssh_metrics', 'SSH metric load5=0.4', 'load5', 0.4::DOUBLE, ts FROM ssh WHERE st = 'O'
        UNION ALL SELECT asset_id, 'ssh_metrics', 'SSH metric load15=0.3', 'load15', 0.3::DOUBLE, ts FROM ssh
          WHERE st IN ('O', 'F')
        UNION ALL SELECT asset_id, 'ssh_metrics', 'SSH metric load5=' || (c % 9) || '.25', 'load5',
          (c % 9) + 0.25::DOUBLE, ts FROM ssh WHERE st = 'F'
        UNION ALL SELECT asset_id, 'ssh_log', '[ssh metrics] busy', NULL, NULL, ts FROM ssh WHERE st = 'P'
        UNION ALL SELECT asset_id, 'ssh_log', '[ssh log] sshd line ' || k, NULL, NULL, ts FROM ssh
        UNION ALL SELECT asset_id, 'ssh_log', '[ssh log] cron ' || c, NULL, NULL, ts FROM ssh""",
    "redfish": """
        SELECT l_orderkey AS payload_id, 'col-' || (l_orderkey % 100) AS target_id,
          't0:srv-' || lpad((l_orderkey % 60)::VARCHAR, 2, '0') AS asset_id,
          l_orderkey * 10 + l_linenumber AS entry_id, l_shipdate AS ts, l_returnflag AS flag, l_partkey AS part
        FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,
                CASE l_returnflag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Caution' END NULLS FIRST,
                'Part ' || l_partkey || ' failed',
                l_shipdate) AS place FROM lineitem)
        WHERE l_orderkey % 4 < 3 OR place = 1""",
    "redfish_state": """
        SELECT 'col-' || c_custkey AS target_id, c_custkey * 100 AS cursor_id FROM customer WHERE c_custkey < 80""",
    "winevt": """
        SELECT 'col-' || user_id AS target_id, event_id, user_id, event_type, ts FROM events""",
    "wincur": """
        SELECT 'col-' || c_custkey AS target_id, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE c_custkey * 20 END AS cursor
        FROM customer""",
    "winrows": """
        SELECT target_id, event_id AS record_id, cursor FROM winevt LEFT JOIN wincur USING (target_id)
        WHERE event_id > coalesce(cursor, 0)
        QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY event_id) <= 40""",
}
USES = {
    "assets": "ev", "streaks": "runs", "state": "streaks", "paudit_hits": "paudit", "audit": "req",
    "docevents": "doclines", "csbp": "csb", "win0": "ev", "win": "win0", "cl": "win", "rare": "cl", "hours": "win",
    "hour_cl": "win", "rates": "cl hours hour_cl", "burst": "rates", "med": "win", "mstats": "med",
    "outliers": "mstats", "found": "rare burst outliers", "ranked": "found", "ranked15": "found", "ranked10": "found",
    "last1000": "ev", "alerts": "last1000", "corr": "last1000", "hints": "ranked15 corr reasons", "sets": "win0",
    "edges": "sets", "briefs": "ranked10 reasons edges hints", "month": "ev", "last10": "ev", "chosen": "policies",
    "items": "chosen", "hit": "win0 items", "impact": "hit", "sshe": "ssh", "winrows": "winevt wincur",
}


def needed(names: str) -> list[str]:
    todo, seen = names.split(), set()
    while todo:
        name = todo.pop()
        if name not in seen:
            seen.add(name)
            todo += USES.get(name, "").split()
    return [name for name in CTES if name in seen]


def sql(names: str, body: str, recursive: bool = False) -> str:
    parts = [f"{name} AS ({CTES[name].strip()})" for name in needed(names)]
    if not parts:
        return body.strip()
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + body.strip()


def dedup_sql(key: str, seconds: int, columns: str, events: str = "", result: str = "") -> str:
    """A row-by-row walk per fingerprint in arrival order. events: CTEs that end with the `ev` to walk over."""
    steps = f"""
      o AS (SELECT seq, {key} AS fp, epoch_us(ts) AS t,
              row_number() OVER (PARTITION BY {key} ORDER BY seq) AS k FROM ev),
      walk AS (
        SELECT seq, fp, k, t AS last_kept, true AS kept FROM o WHERE k = 1
        UNION ALL
        SELECT o.seq, o.fp, o.k, CASE WHEN o.t - w.last_kept > {seconds * 1000000} THEN o.t ELSE w.last_kept END,
          o.t - w.last_kept > {seconds * 1000000}
        FROM walk w JOIN o ON o.fp = w.fp AND o.k = w.k + 1)"""
    events = events or f"ev AS ({CTES['ev'].strip()})"
    result = result or f"SELECT {columns} FROM ev WHERE seq IN (SELECT seq FROM walk WHERE kept)"
    return f"WITH RECURSIVE {events},{steps}\n{result}"


FINGERPRINT = (
    "sha256(asset_id || '|' || source || '|' || message || '|' || coalesce(metric, '') || '|' "
    "|| coalesce(value::VARCHAR, '') || '|' || severity)"
)
SIX_HOURS = dedup_sql("(asset_id || '|' || source || '|' || severity)", 21600, "seq, asset_id, ts")
# events land in batches, some with a severity that breaks the rules and some of assets that nobody registered
CHAIN = dedup_sql(FINGERPRINT, 864000, "", f"""
      raw AS ({CTES['ev'].strip()}),
      landed AS (SELECT * REPLACE ((seq // 100) * 16777216 + seq % 100 AS seq,
        CASE WHEN seq % 97 = 0 THEN 'fatal' ELSE severity END AS severity) FROM raw),
      good AS (SELECT * FROM landed WHERE severity <> 'fatal'),
      ev AS (SELECT * FROM good WHERE right(asset_id, 2)::INTEGER % 4 <> 1)""", """
      SELECT 'accepted' AS sink, seq, asset_id, severity, ts FROM ev WHERE seq IN (SELECT seq FROM walk WHERE kept)
      UNION ALL SELECT 'quarantined', seq, asset_id, severity, ts FROM landed WHERE severity = 'fatal'
      UNION ALL SELECT 'orphans', seq, asset_id, severity, ts FROM good WHERE right(asset_id, 2)::INTEGER % 4 = 1""")
UPSERT = """
        SELECT coalesce(u.id, c_custkey) AS id, CASE WHEN u.id IS NULL THEN c_mktsegment ELSE u.status END AS status,
          CASE WHEN u.id IS NULL THEN c_acctbal ELSE u.amount END AS amount
        FROM customer FULL JOIN (
          SELECT o_custkey + 10 AS id, arg_max(o_orderstatus, o_orderkey) AS status,
            arg_max(o_totalprice, o_orderkey) AS amount FROM orders GROUP BY o_custkey) u ON u.id = c_custkey"""
EVENT7 = "asset_id, source, message, metric, value, severity, ts"
CLUSTER = (
    "asset_id, source, signature, cluster_id, example_message, events_count, share, info_count, warning_count, "
    "critical_count"
)
ANOMALY = "asset_id, kind, severity, confidence, related_cluster_id, related_metric, first_seq"
EDGE = "asset_id, source_a, source_b, shared_signatures, co_occurrence_score, example_signature"
BRIEF = "asset_id, headline, confidence, anomaly_reasons, dependency_hotspots, actions"
IGNORED = (
    "(lower(source) IN ('linux') OR signature IN ('click request <num> done', "
    "'eventid=<num> failed login user=<num>'))"
)
# the asset ids an overview looks at
EVERY = "(SELECT DISTINCT asset_id FROM ev)"


def csv(*cells: str) -> str:
    """Cells marked with q: are quoted, with quotes doubled."""
    out = []
    for c in cells:
        if c.startswith("q:"):
            out.append(f"""'"' || replace(coalesce(({c[2:]})::VARCHAR, ''), '"', '""') || '"'""")
        else:
            out.append(f"coalesce(({c})::VARCHAR, '')")
    return " || ',' || ".join(out)


REDFISH_MESSAGE = """'[iLO] Entry=' || entry_id || ' Created=' || strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' Severity=' ||
  CASE flag WHEN 'R' THEN 'Critical' WHEN 'A' THEN 'Caution' ELSE 'Unknown' END || ' :: Part ' || part || ' failed'"""
REDFISH_SEVERITY = "CASE flag WHEN 'R' THEN 'critical' WHEN 'A' THEN 'warning' ELSE 'info' END"
WIN_SEVERITY = (
    "CASE event_type WHEN 'error' THEN 'critical' WHEN 'signup' THEN 'warning' WHEN 'view' THEN 'warning' "
    "ELSE 'info' END"
)

ORACLE: dict[str, str] = {
    "a01_event_batches": sql("ev", """
        SELECT (seq // 100) * 16777216 + seq % 100 AS seq, asset_id, source, message, metric, value, severity,
          CASE WHEN source = 'app' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE ts END AS ts FROM ev"""),
    "a02_validate": sql("targets", """
        SELECT id, concat_ws(',', 
            CASE WHEN poll_interval_sec < 10 THEN 'poll_interval_sec' END,
            CASE WHEN ilo_event_limit NOT BETWEEN 1 AND 500 THEN 'ilo_event_limit' END)
          AS errors FROM targets"""),
    "a03_check_assets": sql("assets", """
        SELECT seq, asset_id, asset_type <> 'storage_shelf' AS known FROM ev JOIN assets ON asset_id = id"""),
    "a04_fingerprint": sql("ev", f"SELECT seq, {FINGERPRINT} AS fingerprint FROM ev"),
    "a05_dedup_events": SIX_HOURS,
    "a05_dedup_fingerprint": dedup_sql(FINGERPRINT, 300, "seq, asset_id, ts"),
    "a05_dedup_hot_keys": dedup_sql("source", 3600, "seq, source, ts"),
    "a06_dedup_stream": SIX_HOURS,
    "a06_ingest_chain": CHAIN,
    "a07_latest_per_asset": sql("ev", """
        SELECT seq, asset_id, message FROM ev
        QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY seq DESC) <= 100"""),
    "a08_normalize_host_log": sql("docevents", f"SELECT {EVENT7} FROM docevents"),
    "a08_host_log_tail": sql("docevents", f"""
        SELECT {EVENT7} FROM docevents
        QUALIFY row_number() OVER (PARTITION BY asset_id, file ORDER BY line_no DESC) <= 20"""),
    "a09_normalize_host_metrics": """
        SELECT 't0:host-' || o_custkey AS asset_id, 'agent' AS source, 'host load sample' AS message,
          'load1' AS metric, (o_custkey % 64)::DOUBLE AS value, 'info' AS severity, o_orderdate AS ts FROM orders
        UNION ALL
        SELECT 't0:host-' || o_custkey, 'agent', 'root fs usage', 'disk_used_pct', pct,
          CASE WHEN pct >= 85 THEN 'warning' ELSE 'info' END, o_orderdate
        FROM (SELECT *, round(o_totalprice / 520000.0::DOUBLE * 100, 2) AS pct FROM orders)""",
    "a10_normalize_winevent": sql("winevt", f"""
        SELECT 't' || (user_id % 3) || ':srv-' || lpad((user_id % 60)::VARCHAR, 2, '0') AS asset_id,
          'windows_eventlog' AS source,
          '[' || CASE WHEN event_type = 'click' THEN 'Unknown' ELSE 'System' END || '] EventID=' || (user_id % 7000)
            || ' RecordId=' || event_id || ' Provider=Disk :: '
            || CASE WHEN event_type = 'view' THEN '(no message)' ELSE 'block ' || event_id END AS message,
          NULL::VARCHAR AS metric, NULL::DOUBLE AS value, {WIN_SEVERITY} AS severity,
          CASE WHEN event_type = 'purchase' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE date_trunc('second', ts) END AS ts
        FROM winevt"""),
    "a11_advance_cursor": sql("winrows", "SELECT target_id, record_id FROM winrows"),
    "a11_cursor_state": sql("winrows", """
        SELECT target_id, greatest(coalesce(c.cursor, 0), coalesce(r.top, 0))::VARCHAR AS last_cursor
        FROM wincur c FULL JOIN (SELECT target_id, max(record_id) AS top FROM winrows GROUP BY target_id) r
          USING (target_id)"""),
    "a12_normalize_ssh": sql("sshe", "SELECT asset_id, source, message, metric, value, 'info' AS severity, ts FROM sshe"),
    "a13_normalize_snmp": """
        SELECT 't0:host-' || o_custkey AS asset_id, 'snmp_metric' AS source,
          'SNMP 1.3.6.1.2.1.1.' || (o_custkey % 10) || '.0=' ||
            CASE WHEN o_orderstatus = 'P' THEN 'None' ELSE o_orderkey || '.0' END AS message,
          'snmp_1_3_6_1_2_1_1_' || (o_custkey % 10) || '_0' AS metric,
          CASE WHEN o_orderstatus <> 'P' THEN o_orderkey::DOUBLE END AS value, 'info' AS severity, o_orderdate AS ts
        FROM orders""",
    "a14_normalize_redfish": sql("redfish", f"""
        SELECT asset_id, 'ilo_iml' AS source, {REDFISH_MESSAGE} AS message, NULL::VARCHAR AS metric,
          NULL::DOUBLE AS value, {REDFISH_SEVERITY} AS severity, ts FROM redfish"""),
    "a15_hydrate_links": """
        WITH entries AS (
          SELECT l_orderkey AS payload_id, l_linenumber AS n,
            row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS entry_no,
            bool_or(l_linestatus = 'F') OVER (PARTITION BY l_orderkey, l_linenumber) AS landed,
            bool_or(l_linestatus = 'F') OVER (PARTITION BY l_orderkey) AS any_landed
          FROM lineitem)
        SELECT payload_id, entry_no, CASE WHEN landed THEN 'Slot of order ' || payload_id END AS message
        FROM entries WHERE landed OR NOT any_landed""",
    "a16_redfish_cursor": sql("redfish redfish_state", """
        SELECT target_id, payload_id, entry_id FROM redfish LEFT JOIN redfish_state USING (target_id)
        WHERE entry_id > coalesce(cursor_id, 0)"""),
    "a16_redfish_cursor_state": sql("redfish redfish_state", """
        SELECT target_id, greatest(coalesce(cursor_id, 0), coalesce(top, 0)) AS cursor_id,
          CASE WHEN greatest(coalesce(cursor_id, 0), coalesce(top, 0)) = 0 THEN last END AS cursor_created
        FROM redfish_state FULL JOIN (SELECT target_id, max(entry_id) AS top, max(ts) AS last FROM redfish
          GROUP BY target_id) USING (target_id)"""),
    "a17_run_streaks": sql("streaks", "SELECT id, target_id, failure_streak FROM streaks"),
    "a17_collector_state": sql("state", "SELECT * FROM state"),
    "a18_run_outcome_events": sql("streaks targets", """
        SELECT asset_id, CASE WHEN s.collector_type = 'csb_merp_share' THEN 'agentless_csb_merp'
            ELSE 'agentless_' || s.collector_type END AS source,
          '[' || CASE WHEN s.collector_type = 'csb_merp_share' THEN 'csb' ELSE s.collector_type END || '] ' ||
          CASE WHEN last_error IS NOT NULL THEN 'pull failed for ''' || name || ''': ' || last_error
            WHEN latency_ms IS NOT NULL THEN 'target ''' || name || ''' reachable at ' || address || ':' || port
            ELSE 'no new events for ''' || name || ''', cursor=' || coalesce(last_cursor, '') END AS message,
          CASE WHEN last_error IS NOT NULL THEN 'collector_failure_streak'
            WHEN latency_ms IS NOT NULL THEN 'collector_latency_ms' END AS metric,
          CASE WHEN last_error IS NOT NULL THEN failure_streak::DOUBLE ELSE latency_ms END AS value,
          CASE WHEN last_error IS NULL THEN 'info' WHEN failure_streak >= 3 THEN 'critical' ELSE 'warning' END AS severity,
          ts
        FROM streaks s JOIN targets t ON t.id = s.target_id
        WHERE last_error IS NOT NULL OR latency_ms IS NOT NULL OR accepted_events = 0"""),
    "a19_normalize_all": sql("winevt sshe redfish csbp", f"""
        SELECT source, severity, count(*) AS events, count(DISTINCT asset_id) AS assets, count(metric) AS metrics FROM (
          SELECT 'windows_eventlog' AS source, {WIN_SEVERITY} AS severity, NULL::VARCHAR AS metric,
            't' || (user_id % 3) || ':srv-' || lpad((user_id % 60)::VARCHAR, 2, '0') AS asset_id FROM winevt
          UNION ALL SELECT source, 'info', metric, asset_id FROM sshe
          UNION ALL SELECT 'snmp_metric', 'info', 'x', 't0:host-' || o_custkey FROM orders
          UNION ALL SELECT 'ilo_iml', {REDFISH_SEVERITY}, NULL, asset_id FROM redfish
          UNION ALL SELECT 'csb_merp_txt', severity, NULL, asset_id FROM csbp)
        GROUP BY source, severity"""),
    "a20_scan_text_logs": sql("csb", """
        SELECT month, count(*) AS lines, count(*) AS last_numbers, count(*) AS distinct_numbers FROM csb GROUP BY month"""),
    "a21_parse_csb": sql("csbp", "SELECT seq, raw, ts, session, thread_id, kind, payload, command FROM csbp"),
    "a22_csb_fields": sql("csbp", """
        SELECT seq, sscc, script, user_id, user_name, error_code, error_message FROM csbp"""),
    "a23_csb_events": sql("csbp", """
        SELECT seq, asset_id, 'csb_merp_txt' AS source, raw AS message, severity, ts FROM csbp"""),
    "a24_csb_ingest_summary": sql("csb", """
        SELECT count(DISTINCT month) AS files_found, count(DISTINCT month) AS files_processed, count(*) AS lines_seen,
          count(*) FILTER (WHERE parsed) AS lines_parsed, count(*) FILTER (WHERE parsed) AS events_accepted FROM csb"""),
    "a25_tail_text": sql("csb", "SELECT month, count(*) AS lines, count(*) AS positions FROM csb GROUP BY month"),
    "a26_read_with_defaults": sql("targets", """
        SELECT id, CASE WHEN poll_interval_sec > 20 THEN poll_interval_sec ELSE 60 END AS poll_interval_sec,
          true AS enabled, 'public' AS snmp_community, 50 AS winrm_batch_size, 'csb_merp_txt' AS csb_source,
          true AS ilo_use_https FROM targets"""),

    "b01_upsert": UPSERT,
    "b01_keyed_table": f"""
        SELECT * FROM ({UPSERT}) WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)""",
    "b01_insert_or_ignore": sql("state targets", """
        SELECT target_id, failure_streak FROM state
        UNION ALL SELECT id, 0 FROM targets WHERE id NOT IN (SELECT target_id FROM state)"""),
    "b02_delete_assets": sql("assets targets state", """
        SELECT 'assets' AS table_name, id AS key FROM assets WHERE asset_type <> 'bmc'
        UNION ALL SELECT 'events', seq::VARCHAR FROM ev
          WHERE asset_id NOT IN (SELECT id FROM assets WHERE asset_type = 'bmc')
        UNION ALL SELECT 'targets', id FROM targets
          WHERE asset_id NOT IN (SELECT id FROM assets WHERE asset_type = 'bmc')
        UNION ALL SELECT 'state', target_id FROM state WHERE target_id NOT IN (SELECT id FROM targets
          WHERE asset_id IN (SELECT id FROM assets WHERE asset_type = 'bmc'))"""),
    "b03_list_policies": """
        SELECT 'pol-' || n_nationkey AS id, n_name AS name, 't1' AS tenant_id,
          'Linux,' || CASE WHEN n_nationkey % 2 = 0 THEN 'app' ELSE 'ilo_iml' END AS ignore_sources
        FROM nation WHERE n_nationkey % 3 = 1 AND n_regionkey <> 4""",
    "b03_list_assets": sql("assets", "SELECT * FROM assets WHERE starts_with(id, 't2:')"),
    "b03_list_targets": sql("targets", """
        SELECT id, name, asset_id, '********' AS password FROM targets WHERE enabled AND starts_with(asset_id, 't1:')"""),
    "b04_mask_secrets": sql("targets", """
        SELECT id, 'svc' AS username, '********' AS password, '********' AS snmp_community FROM targets"""),
    "b05_write_events": sql("ev", """
        SELECT ts::DATE AS event_date, source, count(*) AS events, max(seq) AS last_seq FROM ev GROUP BY ts::DATE, source"""),

    "c01_signature": sql("ev", f"SELECT seq, {sig('message')} AS signature FROM ev"),
    "c01_document_line_clusters": sql("doclines", f"""
        SELECT asset_id, {sig("value")} AS signature, count(*) AS lines FROM doclines GROUP BY 1, 2"""),
    "c02_cluster_id": sql("ev", f"""
        SELECT source, signature, {cid("source", "signature")} AS cluster_id
        FROM (SELECT DISTINCT source, {sig("message")} AS signature FROM ev)"""),
    "c03_ignore_filtered": sql("ev", f"""
        SELECT seq, asset_id, source FROM (SELECT *, {sig("message")} AS signature FROM ev) WHERE NOT {IGNORED}"""),
    "c03_excluded_counts": sql("ev policies", f"""
        SELECT asset_id, count(*) AS total_events, count(*) FILTER (WHERE hit) AS excluded_events,
          count(*) FILTER (WHERE NOT hit) AS analyzed_events
        FROM (SELECT asset_id, source IN (SELECT unnest(ignore_sources) FROM policies WHERE enabled)
            OR {sig("message")} IN (SELECT unnest(ignore_signatures) FROM policies WHERE enabled) AS hit FROM ev)
        GROUP BY asset_id"""),
    "c04_clusters": sql("cl", f"SELECT {CLUSTER} FROM cl"),
    "c04_cluster_totals": sql("ev", f"""
        SELECT asset_id, source, signature, {cid("source", "signature")} AS cluster_id,
          arg_min(message, seq) AS example_message, count(*) AS events_count,
          {share("count(*)", "sum(count(*)) OVER (PARTITION BY asset_id)")} AS share, {SEVERITY_COUNTS}
        FROM (SELECT *, {sig("message")} AS signature FROM ev) GROUP BY asset_id, source, signature"""),
    "c05_top_clusters": sql("cl", f"SELECT {CLUSTER}, cluster_rank FROM cl WHERE cluster_rank <= 10"),
    "c06_rare_patterns": sql("rare", f"SELECT {ANOMALY}, evidence FROM rare WHERE cluster_rank <= 30"),
    "c07_split_recent": sql("win", "SELECT seq, asset_id, pos, total, is_recent FROM win"),
    "c08_hourly_baseline": sql("win hours hour_cl", """
        SELECT w.seq, w.hour, coalesce(h.n, 0) AS older_in_hour, coalesce(hc.n, 0) AS older_in_hour_of_cluster
        FROM win w LEFT JOIN hours h ON h.asset_id = w.asset_id AND h.hour = w.hour
        LEFT JOIN hour_cl hc ON hc.asset_id = w.asset_id AND hc.hour = w.hour AND hc.source = w.source
          AND hc.signature = w.signature"""),
    "c09_burst_rates": sql("rates", """
        SELECT asset_id, cluster_id, events_count, recent_count, round(recent_rate, 6) AS recent_rate,
          round(older_rate, 6) AS older_rate, round(hourly_baseline, 6) AS hourly_baseline FROM rates"""),
    "c09_burst_patterns": sql("burst", f"SELECT {ANOMALY} FROM burst WHERE cluster_rank <= 30"),
    "c10_metric_stats": sql("mstats", """
        SELECT asset_id, metric, samples, last_value, round(median_value, 6) AS median_value, round(mad, 6) AS mad,
          round(robust_z, 6) AS robust_z FROM mstats"""),
    "c10_metric_outliers": sql("outliers", f"SELECT {ANOMALY} FROM outliers"),
    "c11_anomalies_ranked": sql("ranked", f"SELECT {ANOMALY}, anomaly_rank FROM ranked"),
    "c13_analytics_overview": sql("ranked win", f"""
        SELECT asset_id, n AS analyzed_events, coalesce(anomalies_total, 0) AS anomalies_total, top_severity,
          top_reason_code, coalesce(rare_pattern, 0) AS rare_pattern, coalesce(burst_pattern, 0) AS burst_pattern,
          coalesce(metric_outlier, 0) AS metric_outlier, coalesce(warning, 0) AS warning,
          coalesce(critical, 0) AS critical
        FROM {EVERY} JOIN (SELECT asset_id, count(*) AS n FROM win GROUP BY asset_id) USING (asset_id)
        LEFT JOIN (SELECT asset_id, count(*) AS anomalies_total, arg_min(severity, anomaly_rank) AS top_severity,
            arg_min(kind, anomaly_rank) AS top_reason_code,
            count(*) FILTER (WHERE kind = 'rare_pattern') AS rare_pattern,
            count(*) FILTER (WHERE kind = 'burst_pattern') AS burst_pattern,
            count(*) FILTER (WHERE kind = 'metric_outlier') AS metric_outlier,
            count(*) FILTER (WHERE severity = 'warning') AS warning,
            count(*) FILTER (WHERE severity = 'critical') AS critical
          FROM ranked GROUP BY asset_id) USING (asset_id)"""),
    "c13_overview_totals": sql("ranked", f"""
        SELECT (SELECT count(*) FROM {EVERY}) AS assets_considered,
          count(DISTINCT asset_id) AS assets_with_anomalies, count(*) AS total_anomalies,
          count(*) FILTER (WHERE kind = 'rare_pattern') AS rare_pattern,
          count(*) FILTER (WHERE kind = 'burst_pattern') AS burst_pattern,
          count(*) FILTER (WHERE kind = 'metric_outlier') AS metric_outlier,
          count(*) FILTER (WHERE severity = 'warning') AS warning,
          count(*) FILTER (WHERE severity = 'critical') AS critical
        FROM ranked WHERE asset_id IN {EVERY}"""),

    "d01_policy_merge_union": sql("items", """
        SELECT DISTINCT field, item FROM items UNION SELECT 'source', 'syslog' UNION SELECT 'signature', 'a, b'"""),
    "d01_policy_merge_intersection": sql("items", """
        SELECT field, item FROM items GROUP BY field, item
        HAVING count(DISTINCT id) = (SELECT count(*) FROM chosen)"""),
    "d02_lookup_policies": sql("policies", """
        SELECT w.id, p.id IS NOT NULL AS found
        FROM (VALUES ('pol-0'), ('pol-2'), ('pol-6'), ('pol-24'), ('pol-99')) AS w(id)
        LEFT JOIN policies p ON p.id = w.id AND p.tenant_id = 't0'"""),
    "d03_policy_dry_run": sql("hit impact", """
        SELECT asset_id, total_events, filtered_events, total_events - filtered_events AS remaining_events,
          round(filtered_events::DOUBLE / total_events, 3) AS filtered_share,
          round((total_events - filtered_events)::DOUBLE / total_events, 3) AS remaining_share,
          (SELECT string_agg(DISTINCT item, ',' ORDER BY item) FROM items WHERE field = 'source') AS applied_sources,
          (SELECT string_agg(DISTINCT item, '; ' ORDER BY item) FROM items WHERE field = 'signature')
            AS applied_signatures,
          top_cluster_id, top_score, coalesce(impacted, 0) AS impacted
        FROM (SELECT asset_id, count(*) AS total_events, count(*) FILTER (WHERE ignored) AS filtered_events
              FROM hit GROUP BY asset_id)
        LEFT JOIN (SELECT asset_id, arg_min(cluster_id, impact_rank) AS top_cluster_id,
            max(impact_score) AS top_score, count(*) AS impacted FROM impact WHERE impact_rank <= 10
            GROUP BY asset_id) USING (asset_id)"""),
    "d03_dry_run_impact": sql("impact", """
        SELECT asset_id, impact_rank, source, signature, cluster_id, events_filtered, impact_score FROM impact
        WHERE impact_rank <= 10"""),
    "d04_impact_modes": sql("ev", f"""
        SELECT asset_id, {cid("source", "signature")} AS cluster_id,
          sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 1 END)::DOUBLE AS weighted,
          sum(CASE severity WHEN 'critical' THEN 3 WHEN 'warning' THEN 2 ELSE 0 END)::DOUBLE AS critical_warning,
          sum(CASE severity WHEN 'critical' THEN 1 ELSE 0 END)::DOUBLE AS critical_only
        FROM (SELECT *, {sig("message")} AS signature FROM ev) GROUP BY asset_id, source, signature"""),
    "d05_policy_audit_diff": sql("before after", """
        SELECT * FROM (
          SELECT coalesce(a.id, b.id) AS policy_id, coalesce(a.tenant_id, b.tenant_id) AS tenant_id,
            CASE WHEN a.id IS NULL THEN 'delete' ELSE 'upsert' END AS action,
            CASE WHEN a.id IS NULL THEN 'deleted'
              WHEN b.id IS NULL THEN 'created,name,tenant_id,enabled,ignore_sources,ignore_signatures'
              ELSE concat_ws(',', CASE WHEN a.size = 3 THEN 'name' END,
                CASE WHEN a.enabled <> b.enabled THEN 'enabled' END,
                CASE WHEN a.size = 4 THEN 'ignore_sources' END) END AS changed_fields,
            b.enabled AS was_enabled, a.enabled AS is_enabled
          FROM before b FULL JOIN after a ON a.id = b.id)
        WHERE changed_fields <> ''"""),
    "d06_policy_audit_query": sql("paudit_hits", """
        SELECT id, ts, policy_id, tenant_id, action, actor_role, details FROM paudit_hits
        ORDER BY id DESC LIMIT 50 OFFSET 20"""),
    "d07_audit_pages": sql("paudit_hits", """
        SELECT total_rows, 1::BIGINT AS current_page, greatest(1, ceil(total_rows / 50.0))::BIGINT AS last_page,
          0::BIGINT AS prev_offset, 70::BIGINT AS next_offset,
          ((greatest(1, ceil(total_rows / 50.0)) - 1) * 50)::BIGINT AS last_offset
        FROM (SELECT count(*) AS total_rows FROM paudit_hits)"""),
    "d08_parse_audit": sql("paudit", """
        SELECT id, valid AS parsed, CASE WHEN valid THEN 1 END AS schema_version,
          CASE WHEN valid THEN changed END AS changed_fields FROM paudit"""),

    "e01_alerts": sql("alerts", "SELECT asset_id, severity, reason FROM alerts"),
    "e02_correlations": sql("corr", "SELECT asset_id, title, confidence, evidence_count FROM corr"),
    "e03_correlation_events": sql("ev", """
        SELECT asset_id, seq, source, severity, message, ts FROM ev
        WHERE source = 'windows_eventlog' AND regexp_matches(lower(message), 'eventid=(7|51|55|153)')"""),
    "e04_runbook_hints": sql("hints", "SELECT asset_id, hint_rank, title, rationale, action, confidence FROM hints"),
    "e05_dependency_edges": sql("edges", f"SELECT {EDGE}, edge_rank FROM edges WHERE edge_rank <= 20"),
    "e05_dependency_map": sql("edges sets", """
        SELECT asset_id, total_sources, coalesce(n, 0) AS total_edges, coalesce(n, 0) AS edges
        FROM (SELECT asset_id, count(DISTINCT source) AS total_sources FROM sets GROUP BY asset_id)
        LEFT JOIN (SELECT asset_id, count(*) AS n FROM edges WHERE edge_rank <= 20 GROUP BY asset_id) USING (asset_id)"""),
    "e06_dependency_overview": sql("edges", f"""
        SELECT {EDGE} FROM edges WHERE edge_rank <= 30 AND asset_id IN {EVERY}
        ORDER BY shared_signatures DESC, co_occurrence_score DESC, asset_id DESC, source_a, source_b LIMIT 30"""),
    "e07_incident_briefs": sql("briefs", f"SELECT {BRIEF} FROM briefs"),
    "e08_incident_overview": sql("briefs", f"""
        SELECT {BRIEF} FROM briefs WHERE asset_id IN {EVERY} AND confidence >= 0.9::DOUBLE"""),
    "e09_recommendations": sql("last1000 alerts corr", """
        SELECT asset_id, round(risk, 2) AS risk_score,
          CASE WHEN risk >= 0.75::DOUBLE THEN 'high' WHEN risk >= 0.4::DOUBLE THEN 'moderate' ELSE 'low' END AS risk_level,
          greatest(1, alerts + rules) AS actions
        FROM (SELECT asset_id, a.n AS alerts, c.n AS rules, least(0.99::DOUBLE, 0.1::DOUBLE + least(0.2::DOUBLE * crit, 0.5::DOUBLE)
                + least(0.05::DOUBLE * warn, 0.2::DOUBLE) + a.score + least(0.08::DOUBLE * c.n, 0.2::DOUBLE)) AS risk
              FROM (SELECT asset_id, count(*) FILTER (WHERE severity = 'critical') AS crit,
                      count(*) FILTER (WHERE severity = 'warning') AS warn FROM last1000 GROUP BY asset_id) e
              CROSS JOIN LATERAL (SELECT count(*) AS n,
                coalesce(sum(CASE no WHEN 1 THEN 0.15::DOUBLE ELSE 0.2::DOUBLE END), 0) AS score
                FROM alerts x WHERE x.asset_id = e.asset_id) a
              CROSS JOIN LATERAL (SELECT count(*) AS n FROM corr x WHERE x.asset_id = e.asset_id) c)"""),

    "f01_overview": sql("assets", """
        SELECT count(DISTINCT id) AS assets_total, count(seq) AS events_total,
          count(DISTINCT CASE WHEN severity = 'critical' THEN id END) AS critical_assets
        FROM assets LEFT JOIN ev ON asset_id = id WHERE asset_type <> 'storage_shelf'"""),
    "f02_dashboard_filter": sql("last10", """
        SELECT seq, asset_id, source, ts FROM last10 WHERE source = 'app' AND starts_with(asset_id, 't1:')"""),
    "f03_source_mix": sql("month", """
        SELECT windows, syslog, agentless, floor(windows::DOUBLE / total * 100)::BIGINT AS windows_pct,
          floor(syslog::DOUBLE / total * 100)::BIGINT AS syslog_pct,
          floor(agentless::DOUBLE / total * 100)::BIGINT AS agentless_pct
        FROM (SELECT greatest(1, count(*)) AS total, count(*) FILTER (WHERE source = 'windows_eventlog') AS windows,
                count(*) FILTER (WHERE source = 'syslog') AS syslog,
                count(*) FILTER (WHERE source LIKE 'agentless_%') AS agentless FROM month)"""),
    "f04_severity_mix": sql("month", """
        SELECT count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warning') AS warning,
          count(*) FILTER (WHERE severity = 'critical') AS critical FROM month"""),
    "f05_daily_trend": sql("month", "SELECT ts::DATE AS day, count(*) AS events FROM month GROUP BY ts::DATE"),
    "f05_daily_trend_stream": sql("ev", "SELECT ts::DATE AS day, count(*) AS events FROM ev GROUP BY ts::DATE"),
    "f06_top_assets": sql("month", """
        SELECT asset_id, count(*) AS events FROM month GROUP BY asset_id ORDER BY events DESC, asset_id LIMIT 5"""),
    "f07_recent_alerts": sql("month", """
        SELECT seq, source, message, severity, ts FROM month WHERE severity IN ('warning', 'critical')
        ORDER BY ts DESC, seq DESC LIMIT 7"""),
    "f08_asset_table": sql("assets last10 alerts corr", """
        SELECT id AS asset_id, asset_type, coalesce(location, '-') AS location,
          (SELECT count(*) FROM last10 x WHERE x.asset_id = id) AS events,
          (SELECT count(*) FROM alerts x WHERE x.asset_id = id) AS alerts,
          (SELECT count(*) FROM corr x WHERE x.asset_id = id) AS insights FROM assets"""),
    "f09_filter_options": sql("assets", """
        SELECT 'asset' AS kind, id, name FROM assets UNION ALL SELECT DISTINCT 'source', source, source FROM ev"""),
    "f10_query_history": sql("runs", """
        SELECT id, target_id, last_error, ts FROM runs WHERE collector_type = 'ssh' AND last_error IS NOT NULL
        ORDER BY id DESC LIMIT 200"""),
    "f11_diagnostics_summary": sql("runs", """
        SELECT collector_type, count(*) AS runs, count(*) FILTER (WHERE last_error IS NULL) AS ok,
          count(*) FILTER (WHERE last_error IS NOT NULL) AS errors, sum(accepted_events)::BIGINT AS accepted_events_sum
        FROM runs GROUP BY ROLLUP (collector_type)"""),
    "f12_diagnostics_trend": sql("runs", """
        SELECT row_number() OVER (ORDER BY id) - 1 AS idx, id, accepted_events, last_error IS NOT NULL AS has_error
        FROM runs"""),
    "f13_collector_status": sql("targets state", """
        SELECT t.id AS target_id, collector_type, enabled, last_error IS NULL AND last_run_ts IS NOT NULL AS last_ok,
          coalesce(last_error, 'ok') AS last_message, last_cursor, coalesce(failure_streak, 0) AS failure_streak,
          last_run_ts FROM targets t LEFT JOIN state s ON s.target_id = t.id"""),
    "f13_collector_health": sql("targets state", """
        SELECT count(*) AS tracked, count(*) FILTER (WHERE last_error IS NOT NULL) AS failed,
          count(*) FILTER (WHERE last_run_ts IS NULL) AS stale
        FROM targets t LEFT JOIN state s ON s.target_id = t.id"""),
    "f14_diagnostics_stream": sql("runs", """
        SELECT collector_type, count(*) AS runs, count(*) FILTER (WHERE last_error IS NULL) AS ok,
          count(*) FILTER (WHERE last_error IS NOT NULL) AS errors, sum(accepted_events)::BIGINT AS accepted_events_sum
        FROM runs GROUP BY collector_type"""),
    "f15_tenant_scope": sql("ev", "SELECT seq, asset_id FROM ev WHERE starts_with(asset_id, 't1:')"),
    "f16_tenant_history": sql("runs targets", """
        SELECT id, target_id FROM runs WHERE target_id IN (SELECT id FROM targets WHERE starts_with(asset_id, 't2:'))"""),

    "g01_evaluate_access": sql("audit", "SELECT id, ts, path, role, action, result FROM audit"),
    "g02_keep_last": sql("audit", "SELECT id, path, result FROM audit ORDER BY id DESC LIMIT 500"),
    "g03_audit_summary": sql("audit", """
        SELECT 'result' AS part, 'rows' AS name, count(*) AS n FROM audit
        UNION ALL SELECT 'result', 'allow', count(*) FILTER (WHERE result = 'allow') FROM audit
        UNION ALL SELECT 'result', 'deny', count(*) FILTER (WHERE result = 'deny') FROM audit
        UNION ALL SELECT 'role', role, count(*) FROM audit GROUP BY role
        UNION ALL (SELECT 'action', action, count(*) AS n FROM audit GROUP BY action ORDER BY n DESC, action LIMIT 10)"""),
    "g04_deny_alerts": sql("audit", """
        SELECT 'high_deny_rate' AS kind, deny, 200::BIGINT AS lookback, 20::BIGINT AS threshold
        FROM (SELECT count(*) FILTER (WHERE result = 'deny') AS deny
              FROM (SELECT * FROM audit ORDER BY id DESC LIMIT 200)) WHERE deny >= 20"""),
    "g05_reject_events": sql("rej", "SELECT id, ts, reason, issuer, client FROM rej"),
    "g05_newest_rejects": sql("rej", "SELECT id, ts, reason, issuer, client FROM rej ORDER BY id DESC LIMIT 100"),
    "g05_reject_telemetry": sql("rej", """
        SELECT 'reason' AS part, reason AS name, count(*) AS n FROM rej GROUP BY reason
        UNION ALL SELECT 'client', issuer || '|' || client, count(*) FROM rej GROUP BY issuer, client"""),
    "g06_compliance_report": sql("audit rej", """
        SELECT 'cr-1706659200' AS id, 1706659200::BIGINT AS ts, 'manual' AS trigger, count(*) AS rows,
          count(*) FILTER (WHERE result = 'allow') AS allow, count(*) FILTER (WHERE result = 'deny') AS deny,
          (SELECT '{' || string_agg('"' || role || '":' || n, ',' ORDER BY role) || '}'
           FROM (SELECT role, count(*) AS n FROM newest GROUP BY role)) AS by_role,
          (SELECT '{' || string_agg('"' || reason || '":' || n, ',' ORDER BY reason) || '}'
           FROM (SELECT reason, count(*) AS n FROM rej WHERE ts <= 1706659200 GROUP BY reason)) AS jwt_rejects
        FROM newest""").replace(
            "\nSELECT 'cr-",
            ",\nnewest AS (SELECT * FROM audit WHERE ts <= 1706659200)\nSELECT 'cr-"),
    "g07_route_reports": """
        SELECT epoch(o_orderdate)::BIGINT AS ts, 'cr-' || o_orderkey AS report_id, channel, destination, status
        FROM orders CROSS JOIN (VALUES ('webhook', 'https://hook.example', 'configured'),
          ('email', 'ops@example.org', 'configured'), ('none', '', 'skipped')) AS c(channel, destination, status)""",
    "g08_report_history": """
        SELECT 'cr-' || o_orderkey AS id, epoch(o_orderdate)::BIGINT AS ts FROM orders
        ORDER BY ts DESC, id DESC LIMIT 50""",
    "g09_purge": sql("audit runs paudit", """
        SELECT (SELECT count(*) FROM audit WHERE ts < 1706659200 - 800000000) AS deleted_audit,
          (SELECT count(*) FROM runs WHERE ts < TIMESTAMP '2024-01-17 00:00:00') AS deleted_worker_history,
          (SELECT count(*) FROM paudit WHERE ts < 1706659200 - 900000000) AS deleted_policy_audit"""),
    "g09_purged_history": sql("runs", "SELECT id, target_id FROM runs WHERE ts >= TIMESTAMP '2024-01-17 00:00:00'"),

    "h01_audit_csv": sql("audit", f"SELECT {csv('ts', 'q:path', 'q:role', 'q:action', 'q:result')} AS line, id FROM audit"),
    "h02_history_csv": sql("streaks", f"""
        SELECT {csv("q:strftime(ts, '%Y-%m-%dT%H:%M:%SZ')", 'q:target_id', 'q:collector_type', 'accepted_events',
                    'failure_streak', 'q:last_cursor', 'q:last_error')} AS line, id FROM streaks"""),
    "h03_policy_audit_csv": sql("paudit", f"""
        SELECT {csv('q:ts', 'q:policy_id', 'q:tenant_id', 'q:action', 'q:actor_role', 'q:details')} AS line, id
        FROM paudit"""),
    "h05_json_documents": sql("cl", """
        SELECT asset_id, '{"asset_id":"' || asset_id || '","clusters":[' || string_agg('{"rank":' || cluster_rank
            || ',"id":"' || cluster_id || '","n":' || events_count || '}', ',' ORDER BY cluster_rank) || ']}' AS document
        FROM cl WHERE cluster_rank <= 10 GROUP BY asset_id"""),

    "h05_dashboard": sql("assets last10 alerts corr", """
        SELECT t.tenant, to_json({
          'tenant': t.tenant,
          'overview': (SELECT {'assets_total': (SELECT count(*) FROM assets), 'events_total': count(*),
            'critical_assets': count(DISTINCT CASE WHEN severity = 'critical' THEN asset_id END), 'events_filtered': c.total} FROM ev),
          'sources': {'windows': c.windows, 'syslog': c.syslog, 'agentless': c.agentless,
            'windows_pct': floor(c.windows::DOUBLE / greatest(1, c.total) * 100)::BIGINT,
            'syslog_pct': floor(c.syslog::DOUBLE / greatest(1, c.total) * 100)::BIGINT,
            'agentless_pct': floor(c.agentless::DOUBLE / greatest(1, c.total) * 100)::BIGINT},
          'trend': {'labels': (SELECT list(strftime(day, '%Y-%m-%d') ORDER BY day) FROM days d WHERE d.tenant = t.tenant),
            'values': (SELECT list(n ORDER BY day) FROM days d WHERE d.tenant = t.tenant)},
          'severity': {'info': c.info, 'warning': c.warning, 'critical': c.critical},
          'top_assets': (SELECT list({'asset_id': asset_id, 'events': n} ORDER BY n DESC, asset_id) FROM (
            SELECT asset_id, count(*) AS n FROM shown s WHERE s.tenant = t.tenant GROUP BY asset_id ORDER BY n DESC, asset_id LIMIT 5)),
          'recent_alerts': (SELECT list({'source': source, 'message': message, 'severity': severity,
              'timestamp': strftime(ts, '%Y-%m-%d %H:%M:%S')} ORDER BY ts DESC, seq DESC) FROM (
            SELECT * FROM shown s WHERE s.tenant = t.tenant AND severity <> 'info' ORDER BY ts DESC, seq DESC LIMIT 7)),
          'assets_table': (SELECT list({'id': id, 'asset_type': asset_type, 'location': coalesce(location, '-'),
              'events': (SELECT count(*) FROM last10 x WHERE x.asset_id = id),
              'alerts': (SELECT count(*) FROM alerts x WHERE x.asset_id = id),
              'insights': (SELECT count(*) FROM corr x WHERE x.asset_id = id)} ORDER BY id)
            FROM assets WHERE starts_with(id, t.tenant || ':')),
          'filters': {'period_days': 10, 'asset_id': '', 'source': '', 'tenant_id': t.tenant},
          'filter_options': {
            'assets': (SELECT list({'id': id, 'name': name} ORDER BY id) FROM assets WHERE starts_with(id, t.tenant || ':')),
            'sources': (SELECT list(DISTINCT source ORDER BY source) FROM ev WHERE starts_with(asset_id, t.tenant || ':')),
            'roles': ['viewer', 'operator', 'admin']},
          'role': 'operator',
          'permissions': {'show_worker_health': true, 'show_recent_alerts': true, 'show_collectors_link': true,
            'show_diagnostics_link': true, 'show_filters': true}})::VARCHAR AS document
        FROM (SELECT DISTINCT split_part(id, ':', 1) AS tenant FROM assets) t JOIN counts c USING (tenant)""").replace(
            "\nSELECT t.tenant", """,
shown AS (SELECT *, split_part(asset_id, ':', 1) AS tenant FROM last10),
days AS (SELECT tenant, ts::DATE AS day, count(*) AS n FROM shown GROUP BY tenant, ts::DATE),
counts AS (SELECT tenant, count(*) AS total, count(*) FILTER (WHERE source = 'windows_eventlog') AS windows,
  count(*) FILTER (WHERE source = 'syslog') AS syslog, count(*) FILTER (WHERE source LIKE 'agentless_%') AS agentless,
  count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'critical') AS critical FROM shown GROUP BY tenant)
SELECT t.tenant"""),

    "k01_chain_filter": sql("csbp", """
        SELECT seq, 'user' AS by FROM csbp WHERE contains(lower(payload), '48 ann')
          OR contains(lower(user_id || ' ' || user_name), '48 ann')
        UNION ALL SELECT seq, 'script' FROM csbp WHERE script = '64_TMC_7'
        UNION ALL SELECT seq, 'sscc' FROM csbp WHERE contains(sscc, '000000000000000042')"""),
    "k02_touched": sql("csbp", """
        SELECT DISTINCT 'script' AS kind, script AS value FROM csbp WHERE script IS NOT NULL
        UNION ALL SELECT DISTINCT 'user', user_id || ' ' || user_name FROM csbp WHERE user_id IS NOT NULL
        UNION ALL SELECT DISTINCT 'sscc', unnest(string_split(sscc, ',')) FROM csbp WHERE sscc <> ''"""),
    "k03_chain_errors": sql("csbp", """
        SELECT seq, error_code, error_message FROM csbp WHERE error_code IS NOT NULL """),
    "k04_chain_tail": sql("csbp", """
        SELECT seq, ts_text AS timestamp, kind, command, sscc FROM csbp"""),
    "k05_csb_report": sql("csbp", """
        SELECT 't0:csb' AS asset_id, (SELECT count(*) FROM lines) AS total_lines, count(*) AS matched_lines,
          'berg' AS user_filter, string_agg(DISTINCT user_id || ' ' || user_name, ',' ORDER BY user_id || ' ' || user_name)
            AS users, '' AS scripts, 0::BIGINT AS errors, least(500, count(*)) AS chain,
          (SELECT min(seq) FROM (SELECT seq FROM lines WHERE user_id IS NOT NULL ORDER BY seq DESC LIMIT 500)) AS chain_from,
          max(seq) AS chain_to
        FROM lines WHERE user_id IS NOT NULL""").replace(
            "\nSELECT 't0:csb'",
            ",\nlines AS (SELECT * FROM csbp WHERE asset_id = 't0:csb' ORDER BY seq DESC LIMIT 20000)\nSELECT 't0:csb'"),
}
ORACLE["h04_brief_csv"] = sql("briefs", f"""
    SELECT {csv('q:asset_id', 'q:confidence', 'q:headline', 'q:anomaly_reasons', "q:actions_text",
                'q:dependency_hotspots')} AS line
    FROM briefs WHERE asset_id IN {EVERY}""")
ORACLE["c12_log_insight"] = sql("ranked reasons", """
    SELECT asset_id, analyzed_events, coalesce(cluster_ids, '') AS cluster_ids,
      coalesce(anomaly_kinds, '') AS anomaly_kinds,
      CASE WHEN analyzed_events = 0
        THEN 'All events are excluded by ignore rules: ' || excluded || ' of ' || total_events
        ELSE 'Events analysed: ' || analyzed_events || ' (whole history) | Clusters: ' || clusters || ' (top 30) | Anomalies: '
          || coalesce(anomalies, 0) || ' (top 20)'
          || CASE WHEN excluded > 0 THEN ' | Excluded by ignore rules: ' || excluded || ' of ' || total_events ELSE '' END
          || CASE WHEN anomalies > 0 THEN ' | Top reason: ' || top_reason ELSE '' END END AS summary
    FROM (SELECT asset_id, count(*) AS total_events, count(*) FILTER (WHERE IGNORED) AS excluded,
            count(*) FILTER (WHERE NOT IGNORED) AS analyzed_events FROM win0 GROUP BY asset_id)
    LEFT JOIN (SELECT asset_id, count(*) AS clusters, string_agg(cluster_id, ',' ORDER BY cluster_rank) AS cluster_ids
               FROM cl WHERE cluster_rank <= 30 GROUP BY asset_id) USING (asset_id)
    LEFT JOIN (SELECT asset_id, count(*) AS anomalies, string_agg(kind, ',' ORDER BY anomaly_rank) AS anomaly_kinds,
                 arg_min(reason, anomaly_rank) AS top_reason
               FROM ranked JOIN reasons USING (kind) GROUP BY asset_id) USING (asset_id)""".replace("IGNORED", IGNORED)
).replace("AS total FROM win0)", f"AS total FROM win0 WHERE NOT {IGNORED})")


def every_cluster(name: str) -> str:
    """The SQL of a query without its condition on the rank of a cluster."""
    text = re.sub(r" WHERE cluster_rank <= (10|15|30)\b", "", ORACLE[name])
    if text == ORACLE[name]:
        raise ValueError(f"{name} has no condition on the rank of a cluster")
    return text


for _name in (
    "c06_rare_patterns", "c09_burst_patterns", "c11_anomalies_ranked", "c12_log_insight", "e04_runbook_hints",
    "e07_incident_briefs", "e08_incident_overview", "h04_brief_csv",
):
    ORACLE[f"{_name}_all"] = every_cluster(_name).replace("' (top 30) |", "' (all) |")
for _name in ("c13_analytics_overview", "c13_overview_totals"):
    ORACLE[f"{_name}_all"] = every_cluster(_name).replace(" QUALIFY anomaly_rank <= 20", "")
ORACLE["k05_csb_report_all"] = ORACLE["k05_csb_report"].replace(" ORDER BY seq DESC LIMIT 20000", "")
