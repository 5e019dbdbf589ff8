"""A-02, A-03, A-17, A-18, A-26, B, D, F, G, H."""

import csv
import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opslens import schemas as S
from opslens.functions.ranking import with_position
from opslens.operators import access, collectors, dashboard, ingest, normalize, policies, tables
from opslens.operators.dedup import dedup_events
from opslens.sinks import exports
from opslens.sources import batches, text_logs
from opslens.streaming import feeds

AT = dt.datetime(2024, 5, 1, 12, 0, 0)


def policy_table(spark, *rows):
    return spark.createDataFrame(list(rows), S.POLICY)


def history(spark, outcomes, target="t", kind="ssh"):
    rows = [
        (i, AT + dt.timedelta(minutes=i), target, kind, 0 if bad else i, "boom" if bad else None, None, None if bad else str(i))
        for i, bad in enumerate(outcomes, 1)
    ]
    return spark.createDataFrame(rows, S.HISTORY)


def targets(spark, *rows):
    base = spark.createDataFrame(
        [(i, f"name {i}", "10.0.0.1", kind, 22, asset) for i, kind, asset in rows],
        "id string, name string, address string, collector_type string, port int, asset_id string",
    )
    return tables.read_with_defaults(base, S.TARGET, S.TARGET_DEFAULTS)


def test_validation_and_defaults(spark):
    rows = targets(spark, ("a", "ssh", "x"), ("b", "ftp", ""), ("c", "ilo", "x")).withColumn(
        "ilo_event_limit", F.expr("if(id = 'c', 501, ilo_event_limit)")
    )
    ok, bad = ingest.validate(rows, ingest.TARGET_RULES)
    assert [r.id for r in ok.collect()] == ["a"]
    assert {r.id: r.errors for r in bad.collect()} == {"b": ["asset_id", "collector_type"], "c": ["ilo_event_limit"]}
    assert rows.first().csb_max_files == 2000


def test_old_events_table_gets_a_fingerprint_column(spark, make_events):
    from pyspark.sql import types as T

    wide = T.StructType(S.EVENT.fields + [T.StructField("fingerprint", T.StringType())])
    row = tables.read_with_defaults(make_events([("a", "s", "m", "info")]), wide).first()
    assert row.fingerprint is None and row.message == "m"


def test_referential_check(spark, make_events):
    assets = spark.createDataFrame([("a", "a", "server", None)], S.ASSET)
    ok, orphans = ingest.check_assets(make_events([("a", "s", "m", "info"), ("b", "s", "m", "info")]), assets)
    assert ([r.asset_id for r in ok.collect()], [r.asset_id for r in orphans.collect()]) == (["a"], ["b"])


def test_upsert_and_insert_or_ignore(spark):
    base = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3, 1), ("b", 4, 2), ("c", 5, 1)], "id string, v int, at int")
    assert sorted(tables.upsert(base, new, ["id"], "at").collect()) == [("a", 1), ("b", 4), ("c", 5)]
    assert sorted(tables.insert_or_ignore(base, new.select("id", "v").filter("at = 1"), ["id"]).collect()) == [
        ("a", 1), ("b", 2), ("c", 5)
    ]


def test_cascade_delete(spark, make_events):
    assets = spark.createDataFrame([("a", "a", "server", None), ("b", "b", "bmc", None)], S.ASSET)
    all_targets = targets(spark, ("t1", "ssh", "a"), ("t2", "ssh", "b"))
    state = spark.createDataFrame([("t1", 0), ("t2", 0)], "target_id string, failure_streak int")
    left = tables.delete_assets(
        assets, make_events([("a", "s", "m", "info"), ("b", "s", "m", "info")]), all_targets, state,
        spark.createDataFrame([("b",)], "id string"),
    )
    assert {k: v.count() for k, v in left.items()} == {"assets": 1, "events": 1, "targets": 1, "state": 1}
    kept, states = tables.delete_targets(all_targets, state, spark.createDataFrame([("t1",)], "id string"))
    assert (kept.first().id, states.first().target_id) == ("t2", "t2")


def test_listings_mask_and_tenants(spark):
    rows = targets(spark, ("z", "ssh", "t1:srv-a"), ("y", "ssh", "t2:srv-b"))
    got = tables.list_targets(rows, tenant="t1").collect()
    assert [(r.id, r.password, r.snmp_community) for r in got] == [("z", "********", "********")]
    assert tables.tenant_scope(rows, " ").count() == 2
    runs = history(spark, [0, 1], target="y").unionByName(history(spark, [0], target="z"))
    assert collectors.tenant_history(runs, rows, "t2").count() == 2


def test_run_history(spark):
    runs = history(spark, [0, 1, 1, 1, 0, 1])
    streaks = collectors.with_streak(runs, block_rows=2).orderBy("id")
    assert [r.failure_streak for r in streaks.collect()] == [0, 1, 2, 3, 0, 1]
    state = collectors.collector_state(runs, block_rows=2).first()
    assert (state.failure_streak, state.last_cursor, state.last_error) == (1, "5", "boom")
    assert state.last_success_ts == AT + dt.timedelta(minutes=5)
    events = collectors.run_outcome_events(
        streaks.withColumn("latency_ms", F.lit(None).cast("double")), targets(spark, ("t", "ssh", "a"))
    ).orderBy("ts").collect()
    assert [e.severity for e in events] == ["warning", "warning", "critical", "warning"]
    assert (events[2].source, events[2].value) == ("agentless_ssh", 3.0)
    total = {r.collector_type: r for r in collectors.diagnostics_summary(runs).collect()}[None]
    assert (total.runs, total.ok, total.errors) == (6, 2, 4)
    trend = collectors.diagnostics_trend(runs, 3).orderBy("idx").collect()
    assert [(r.idx, r.id, r.has_error) for r in trend] == [(0, 4, True), (1, 5, False), (2, 6, True)]
    assert [r.id for r in collectors.query_history(runs, has_error=False).collect()] == [5, 1]
    assert collectors.query_history(history(spark, [0] * 60), limit=100, role="viewer").count() == 40


def test_heartbeat_and_probe(spark):
    rows = spark.createDataFrame(
        [(1, AT, "t", "csb_merp_share", 0, None, 0, "7", None), (2, AT, "t", "csb_merp_share", 4, None, 0, "8", None),
         (3, AT, "t", "csb_merp_share", 0, None, 0, None, 3.5)],
        "id bigint, ts timestamp, target_id string, collector_type string, accepted_events int, last_error string, "
        "failure_streak int, last_cursor string, latency_ms double",
    )
    got = collectors.run_outcome_events(rows, targets(spark, ("t", "csb_merp_share", "a"))).collect()
    assert sorted((e.source, e.metric or "", e.severity) for e in got) == [
        ("agentless_csb_merp", "", "info"), ("agentless_csb_merp", "collector_latency_ms", "info")
    ]


def test_health(spark):
    state = collectors.collector_state(history(spark, [0, 1]).unionByName(history(spark, [0], target="u")))
    row = collectors.collector_health(targets(spark, ("t", "ssh", "a"), ("u", "ssh", "a"), ("v", "ssh", "a")), state).first()
    assert tuple(row) == (3, 1, 1)


POL = [
    ("u1", "ignore linux", "t1", ["Linux "], [], True),
    ("u2", "ignore windows", "t2", ["windows_eventlog"], ["a, b"], True),
    ("off", "disabled", "t1", ["app"], [], False),
]


def items(df):
    return sorted((r.field, r.item) for r in df.collect())


def test_policy_merge(spark):
    table = policy_table(spark, *POL)
    union = policies.resolve_filters(table, ["u1", "u2", "off"])
    assert items(union) == [("signature", "a, b"), ("source", "linux"), ("source", "windows_eventlog")]
    assert items(policies.resolve_filters(table, ["u1", "u2"], strategy="intersection")) == []
    assert items(policies.resolve_filters(table, ["u1"], strategy="intersection", ignore_sources=["X "])) == [
        ("source", "linux"), ("source", "x")
    ]
    assert items(policies.resolve_filters(table)) == []
    with pytest.raises(ValueError, match="union, intersection"):
        policies.resolve_filters(table, ["u1"], strategy="xor")
    found, missing = policies.lookup_policies(table, ["u1", "u2", "nope"], tenant="t1")
    assert ([r.id for r in found.collect()], sorted(r.id for r in missing.collect())) == (["u1"], ["nope", "u2"])
    inside = set(items(policies.merge_policies(table, "intersection")))
    assert inside <= set(items(policies.merge_policies(table, "union")))


def test_dry_run(spark, make_events):
    events = make_events([
        ("m", "linux", "timeout warning", "warning"), ("m", "linux", "timeout critical", "critical"),
        ("n", "app", "fine", "info"),
    ])
    filters = policies.resolve_filters(policy_table(spark, *POL), ["u1"])
    for mode, scores in (("weighted", [3.0, 2.0]), ("critical_warning", [3.0, 2.0]), ("critical_only", [1.0, 0.0])):
        row, other = policies.policy_dry_run(events, filters, mode=mode).orderBy("asset_id").collect()
        assert [c.impact_score for c in row.top_impacted_clusters] == scores
        assert (row.total_events, row.filtered_events, row.remaining_events) == (2, 2, 0)
        assert (row.filtered_share, row.remaining_share, row.impact_mode) == (1.0, 0.0, mode)
        assert (row.applied_sources, row.applied_signatures) == (["linux"], [])
        assert (other.filtered_events, other.top_impacted_clusters) == (0, [])
    assert row.top_impacted_clusters[0].severity_mix == {"critical": 1}
    with pytest.raises(ValueError, match="critical_warning"):
        policies.policy_dry_run(events, filters, mode="bad")


def test_policy_audit(spark):
    before = policy_table(spark, POL[0], POL[1], ("same", "s", None, ["b", "a"], None, True))
    after = policy_table(
        spark, (*POL[0][:5], False), ("new", "n", "t9", [], [], True), ("same", "s", None, ["a", "b"], None, True)
    )
    rows = {r.policy_id: r for r in policies.policy_audit(before, after).collect()}
    assert set(rows) == {"u1", "u2", "new"}
    assert rows["u1"].changed_fields == ["enabled"] and rows["u2"].changed_fields == ["deleted"]
    assert rows["new"].changed_fields == ["created", "name", "tenant_id", "enabled", "ignore_sources", "ignore_signatures"]
    gone = json.loads(rows["u2"].details)
    assert gone["before"]["id"] == "u2" and "after" not in gone and gone["schema_version"] == 1
    log = spark.createDataFrame(
        [(i, 100 + i, r.policy_id, r.tenant_id, r.action, "admin", r.details) for i, r in enumerate(rows.values())]
        + [(9, 109, "x", None, "upsert", "admin", "{oops")], S.POLICY_AUDIT,
    )
    page = policies.query_audit(log, action="delete", changed_field="deleted").collect()
    assert [r.policy_id for r in page] == ["u2"]
    parsed = {r.policy_id: r.details_json for r in policies.parse_audit(log).collect()}
    assert parsed["x"] is None and parsed["u1"].before.enabled is True and parsed["u1"].after.enabled is False
    row = policies.audit_pages(log, limit=3, offset=3).first()
    assert tuple(row) == (4, 2, 2, 0, 6, 3)
    with pytest.raises(ValueError):
        policies.query_audit(log, sort="up")


def test_dashboard(spark, make_events):
    events = make_events([
        ("a", "windows_eventlog", "w", "warning"), ("a", "syslog", "s", "info"), ("a", "agentless_ssh", "x", "info"),
    ])
    day = dt.datetime(2024, 3, 2)
    only = dashboard.dashboard_filter(events, now=day, period_days=2, source="windows_eventlog")
    assert tuple(dashboard.source_mix(only).first()) == (1, 0, 0, 100, 0, 0)
    assert tuple(dashboard.source_mix(events).first()) == (1, 1, 1, 33, 33, 33)
    assert tuple(dashboard.source_mix(events.filter("false")).first()) == (0, 0, 0, 0, 0, 0)
    assert tuple(dashboard.severity_mix(events).first()) == (2, 1, 0)
    assert dashboard.dashboard_filter(events, now=dt.datetime(2024, 6, 1)).count() == 0
    assets = spark.createDataFrame([("a", "A", "server", None), ("b", "B", "bmc", "R1")], S.ASSET)
    assert tuple(dashboard.overview(assets, events).first()) == (2, 3, 0)
    table = {r.asset_id: r for r in dashboard.asset_table(assets, only, events).collect()}
    assert (table["a"].events, table["a"].location, table["b"].events, table["b"].alerts) == (1, "-", 0, 0)
    assert [r.message for r in dashboard.recent_alerts(events).collect()] == ["w"]
    assert [(r.kind, r.id) for r in dashboard.filter_options(assets, events).collect()] == [
        ("asset", "a"), ("asset", "b"), ("source", "agentless_ssh"), ("source", "syslog"), ("source", "windows_eventlog")
    ]


def test_access(spark):
    rows = [
        (1, 5, "GET", "/auth/audit.csv", "viewer"), (2, 6, "POST", "/events", "operator"), (3, 7, "GET", "/assets", "admin"),
        (4, 8, "POST", "/assets", None), (5, 9, "GET", "/auth/audit", "boss"),
    ]
    audit = access.evaluate_access(spark.createDataFrame(rows, S.REQUEST))
    got = {r.id: (r.role, r.action, r.result) for r in audit.collect()}
    assert got == {
        1: ("viewer", "read auth audit", "deny"), 2: ("operator", "write events", "allow"),
        4: ("admin", "write assets", "allow"), 5: ("viewer", "read auth audit", "deny"),
    }


def audit_rows(spark, denies, allows=0):
    rows = [(i, i, "/x", "viewer", "read", "deny") for i in range(denies)]
    rows += [(denies + i, denies + i, '/"q"', "admin", "write", "allow") for i in range(allows)]
    return spark.createDataFrame(rows, S.ACCESS_AUDIT)


def test_audit_rollups(spark):
    assert access.deny_alerts(audit_rows(spark, 19)).count() == 0
    assert tuple(access.deny_alerts(audit_rows(spark, 20)).first()) == ("high_deny_rate", 20, 200, 20)
    assert access.deny_alerts(audit_rows(spark, 20, 200)).count() == 0
    totals, by_role, actions = access.audit_summary(audit_rows(spark, 2, 3))
    assert tuple(totals.first()) == (5, 3, 2)
    assert {r.role: r.n for r in by_role.collect()} == {"viewer": 2, "admin": 3}
    assert [tuple(r) for r in actions.collect()] == [("write", 3), ("read", 2)]
    assert access.keep_last(audit_rows(spark, 600)).agg(F.min("id")).first()[0] == 100


def test_rejects_and_reports(spark):
    import base64

    def token(claims):
        body = base64.urlsafe_b64encode(json.dumps(claims).encode()).decode().rstrip("=")
        return f"h.{body}.s"

    rows = [
        (1, 10, "expired", token({"iss": "https://id/ü>?", "azp": "app"})), (2, 11, "expired", token({"client_id": "c"})),
        (3, 12, "bad", "x.y"), (4, 13, "bad", None), (5, 14, "bad", "a.!!.c"),
    ]
    rejects = spark.createDataFrame(rows, "id bigint, ts bigint, reason string, token string")
    reasons, clients, newest = access.reject_telemetry(rejects, limit=2)
    assert {r.reason: r.n for r in reasons.collect()} == {"expired": 2, "bad": 3}
    assert {(r.issuer, r.client): r.n for r in clients.collect()} == {
        ("https://id/ü>?", "app"): 1, ("unknown", "c"): 1, ("unknown", "unknown"): 3
    }
    assert [r.id for r in newest.collect()] == [5, 4]
    report = access.compliance_report(audit_rows(spark, 2, 3), rejects, ts=12)
    row = report.first()
    assert (row.id, row.summary.rows, row.summary.by_role) == ("cr-12", 5, {"viewer": 2, "admin": 3})
    assert row.summary.jwt_rejects == {"expired": 2, "bad": 1}
    both = access.route_reports(report, {"webhook": "http://h", "email": "a@b"})
    assert sorted(r.channel for r in both.collect()) == ["email", "webhook"]
    assert [(r.channel, r.status) for r in access.route_reports(report, {"webhook": " "}).collect()] == [("none", "skipped")]
    assert access.report_history(report, report_id="cr-12").count() == 1


def test_purge(spark):
    now = 200_000
    audit = audit_rows(spark, 0, 0).unionByName(spark.createDataFrame(
        [(1, now - 100_000, "/", "viewer", "a", "allow"), (2, now, "/", "viewer", "a", "allow")], S.ACCESS_AUDIT))
    kept, counts = access.purge(
        audit, history(spark, [0]), spark.createDataFrame([], S.POLICY_AUDIT), now=now, audit_max_age_sec=1
    )
    assert tuple(counts.first()) == (1, 0, 0) and [r.id for r in kept["audit"].collect()] == [2]


def test_csv_files_and_lines(spark, tmp_path):
    audit = audit_rows(spark, 1, 1)
    exports.write_csv(audit.coalesce(1), str(tmp_path / "csv"), exports.AUDIT_CSV)
    part = next((tmp_path / "csv").glob("part-*"))
    with part.open(newline="") as fh:
        got = list(csv.reader(fh))
    assert got[0] == list(exports.AUDIT_CSV) and sorted(got[1:]) == [
        ["0", "/x", "viewer", "read", "deny"], ["1", '/"q"', "admin", "write", "allow"]
    ]
    lines = [r.line for r in exports.csv_lines(audit, exports.AUDIT_CSV, order="id").orderBy("id").collect()]
    assert lines[1] == '1,"/""q""","admin","write","allow"'
    brief = spark.createDataFrame([("a", 0.5, 'say "x"', ["r1", "r2"], [], ["h"])],
                                  "asset_id string, confidence double, headline string, anomaly_reasons array<string>, "
                                  "runbook_actions array<string>, dependency_hotspots array<string>")
    assert exports.csv_lines(brief, exports.BRIEF_CSV, quote_all=True).first().line == (
        '"a","0.5","say ""x""","r1; r2","","h"')
    exports.write_json(brief, str(tmp_path / "json"))
    docs = [json.loads(x) for p in (tmp_path / "json").glob("part-*") for x in p.read_text().splitlines()]
    assert [doc["anomaly_reasons"] for doc in docs] == [["r1", "r2"]]


def test_event_table_is_partitioned_by_day(spark, make_events, tmp_path):
    path = str(tmp_path / "events")
    exports.write_events(make_events([("a", "s", "m", "info", None, None, i * 86400) for i in range(3)]), path)
    back = spark.read.parquet(path).filter("event_date = date'2024-03-02'")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(event_date" in back._jdf.queryExecution().executedPlan().toString()


def test_streams(spark, tmp_path, make_events):
    source, seen = str(tmp_path / "runs"), {}
    history(spark, [0, 1, 0]).write.parquet(source)
    totals = feeds.diagnostics_stream(spark.readStream.schema(S.HISTORY).parquet(source))
    run = feeds.feed(
        totals, lambda df, _: seen.update({r.collector_type: (r.runs, r.ok, r.errors) for r in df.collect()}),
        str(tmp_path / "state"), every=None,
    ).start()
    run.awaitTermination()
    assert seen == {"ssh": (3, 2, 1)}
    events, out = str(tmp_path / "ev"), str(tmp_path / "table")
    make_events([("a", "s", "m", "info", None, None, i * 86400) for i in range(4)]).write.parquet(events)
    stream = spark.readStream.schema(S.EVENT).parquet(events)
    run = exports.stream_events(stream, out, str(tmp_path / "s2")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.read.parquet(out).select("event_date").distinct().count() == 4


def test_first_row_of_a_new_key_wins(spark):
    base = spark.createDataFrame([("a", 1, 0)], "id string, v int, at int")
    rows = spark.createDataFrame([("b", 2, 9), ("b", 3, 1), ("a", 4, 2)], "id string, v int, at int").coalesce(1)
    assert sorted(tuple(r) for r in tables.insert_or_ignore(base, rows, ["id"]).collect()) == [("a", 1, 0), ("b", 2, 9)]
    assert sorted(tuple(r) for r in tables.insert_or_ignore(base, rows, ["id"], "at").collect()) == [("a", 1, 0), ("b", 3, 1)]


def test_batches_without_number_and_broken_lines(spark, tmp_path):
    event = '{"asset_id":"a","source":"s","message":"%s"}'
    (tmp_path / "b.json").write_text(
        f'{{"events":[{event % "m1"},{event % "m2"}]}}\nno json\n{{"batch_id":2,"events":[{event % "m3"}]}}\n')
    rows = batches.read_event_batches(spark, str(tmp_path)).collect()
    assert sorted(r.message for r in rows) == ["m1", "m2", "m3"]
    assert len({r.seq for r in rows}) == 3 and None not in {r.seq for r in rows}
    assert [r.line for r in batches.broken_batches(spark, str(tmp_path)).collect()] == ["no json"]


def test_text_logs_with_any_file_name(spark, tmp_path):
    names = ["a b.txt", "c%20d.txt", "plain.txt", "ü.txt"]
    for n in names:
        (tmp_path / n).write_text("one\ntwo\nthree\n")
    rows = text_logs.scan_text_logs(spark, str(tmp_path)).collect()
    assert len(rows) == 12 and len({r.seq for r in rows}) == 12 and len({r.file for r in rows}) == 4
    assert {(r.line_no, r.value) for r in rows} == {(1, "one"), (2, "two"), (3, "three")}
    assert text_logs.scan_text_logs(spark, str(tmp_path), max_files=2).count() == 6


def test_cursor_loses_no_repeated_record_ids(spark):
    rows = spark.createDataFrame([("t", 1, "App"), ("t", 2, "App"), ("t", 2, "Sys"), ("t", 3, "App")],
                                 "target_id string, record_id long, LogName string")
    state, seen = spark.createDataFrame([("t", "0")], "target_id string, last_cursor string"), []
    for _ in range(3):
        got, state = normalize.advance_cursor(rows, state, 2)
        seen += [(r.record_id, r.LogName) for r in got.collect()]
    assert sorted(seen) == [(1, "App"), (2, "App"), (2, "Sys"), (3, "App")]


def test_unknown_policy_is_an_error(spark):
    held = spark.createDataFrame([("p1", None, True, ["a"], [])],
                                 "id string, tenant_id string, enabled boolean, ignore_sources array<string>, ignore_signatures array<string>")
    assert [tuple(r) for r in policies.resolve_filters(held, ["p1"]).collect()] == [("source", "a")]
    with pytest.raises(Exception, match="Unknown policy ids: nope"):
        policies.resolve_filters(held, ["p1", "nope"]).collect()


def test_positions_over_buckets(spark):
    rows = spark.createDataFrame([(k, s * s) for k in ("x", None) for s in range(50)], "k string, seq long")
    got = with_position(rows, "k", "seq", buckets=7).collect()
    assert sorted((str(r.k), r.seq, r.pos, r.total) for r in got) == sorted(
        (str(k), s * s, s + 1, 50) for k in ("x", None) for s in range(50))


def test_a_null_seq_is_never_lost_without_a_word(spark):
    rows = spark.createDataFrame(
        [(1, "a", "s", "m", "info", "2024-01-01"), (None, "a", "s", "n", "info", "2024-01-01")],
        "seq long, asset_id string, source string, message string, severity string, ts string",
    ).withColumn("ts", F.col("ts").cast("timestamp"))
    ok, bad = ingest.validate(rows, ingest.EVENT_RULES)
    assert [r.message for r in ok.collect()] == ["m"]
    assert [(r.message, r.errors) for r in bad.collect()] == [("n", ["seq"])]
    assert ingest.validate(rows.drop("seq"), ingest.BARE_EVENT_RULES)[0].count() == 2
    with pytest.raises(Exception, match="seq is null"):
        with_position(rows, "asset_id", "seq").collect()
    with pytest.raises(Exception, match="seq is null"):
        dedup_events(ingest.with_fingerprint(rows.withColumns({"metric": F.lit(None).cast("string"), "value": F.lit(1.0)})))


def test_unnumbered_batches_are_numbered_over_reads_and_in_streams(spark, tmp_path):
    event = '{"asset_id":"a","source":"s","message":"%s"}'
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"{i}.json").write_text("".join(f'{{"events":[{event % f"{i}{j}x"},{event % f"{i}{j}y"}]}}\n' for j in range(2)))
    reads = [batches.read_event_batches(spark, str(folder)) for _ in range(2)]
    both = reads[0].unionByName(reads[1]).collect()
    assert len({r.seq for r in both}) == len(both) == 24 and all(r.seq < 0 for r in both)
    in_file = [r.message for r in sorted(both[:12], key=lambda r: r.seq) if r.message[0] == "0"]
    assert in_file == ["00x", "00y", "01x", "01y"]
    out = str(tmp_path / "out")
    stream = batches.stream_event_batches(spark, str(folder), max_files=1)
    run = stream.writeStream.foreachBatch(
        lambda df, epoch: batches.number_events(df, epoch).write.mode("append").parquet(out)
    ).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = [r.seq for r in spark.read.parquet(out).collect()]
    assert len(set(got)) == len(got) == 12 and None not in got


@pytest.mark.parametrize("shuffled", ["repartition", "dropDuplicates", "foreachBatch"])
def test_no_event_is_lost_by_numbering_after_a_shuffle(spark, tmp_path, shuffled):
    """Adaptive execution merges partitions differently each time a plan runs."""
    rows = spark.range(0, 40_000, 1, 16).selectExpr(
        "cast(if(id % 5 = 0, id, NULL) AS bigint) AS seq", "concat('a', id % 7) AS asset_id", "id AS key")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        if shuffled == "foreachBatch":
            source, out = str(tmp_path / "in"), str(tmp_path / "out")
            rows.write.parquet(source)

            def land(df, epoch):
                batches.number_events(df.repartition("asset_id"), epoch).write.mode("append").parquet(out)

            spark.readStream.schema(rows.schema).parquet(source).writeStream.foreachBatch(land).option(
                "checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
            got = spark.read.parquet(out)
        else:
            dealt = rows.repartition("asset_id") if shuffled == "repartition" else rows.dropDuplicates(["key"])
            got = batches.number_events(dealt, 3)
        row = got.selectExpr("count(*) AS n", "count(DISTINCT seq) AS numbers", "count(DISTINCT key) AS keys",
                             "count_if(seq = key) AS kept").first()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert tuple(row) == (40_000, 40_000, 40_000, 8_000)
