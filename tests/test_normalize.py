"""A-01, A-08 ... A-16, A-19 and K: raw collector rows."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from opslens.operators import csb, ingest, normalize
from opslens.functions.text import strip
from opslens.operators.dedup import dedup_events
from opslens.session import tune
from opslens.sources import batches, tail, text_logs

AT = dt.datetime(2024, 5, 1, 12, 0, 0)
CSB = [
    '03.03.2026 10:17:07.638 46192204-001 ID 4635491 Write     SYS+LOGIN;!:L1+903003+2:L2+4824+82+9048+"A"+"B":L3+""',
    '03.03.2026 10:17:07.778 46192204-001 ID 4649403 Query     SYS+SKRIPT;?:L1+"64_TMC_SPE":L2+"887A":L3+8',
    "03.03.2026 10:17:17.294 46192204-002 ID 4649403 Query     DT8580+SSCCDET;?:L1+246700022810196136",
    '03.03.2026 10:17:08.981 46192204-002 ID 4635491 Write     SYS+ERRINFO;!:L1+4007+2+"Bad row."+""',
]


def winevents(spark, *records):
    rows = [("t", "a", json.dumps(r), AT) for r in records]
    return normalize.parse_winevents(
        spark.createDataFrame(rows, "target_id string, asset_id string, record string, collected_ts timestamp")
    )


def payloads(spark, *docs):
    rows = [(i, "t", "a", d if isinstance(d, str) else json.dumps(d), AT) for i, d in enumerate(docs)]
    return spark.createDataFrame(
        rows, "payload_id bigint, target_id string, asset_id string, payload string, collected_ts timestamp"
    )


def test_winevent_and_cursor(spark):
    raw = winevents(
        spark,
        {"RecordId": 20, "Id": 1, "LogName": "Security", "LevelDisplayName": "Information", "Message": "ok",
         "TimeCreated": "2024-01-02T03:04:05Z"},
        {"RecordId": 19, "Id": 2, "LevelDisplayName": "Critical error", "Message": ""},
    )
    state = spark.createDataFrame([("t", "19"), ("idle", "x")], "target_id string, last_cursor string")
    rows, moved = normalize.advance_cursor(raw, state)
    assert [r.record_id for r in rows.collect()] == [20]
    assert {r.target_id: r.last_cursor for r in moved.collect()} == {"t": "20", "idle": "0"}
    new, old = normalize.normalize_winevent(raw).orderBy("ts").collect()
    assert new.message == "[Security] EventID=1 RecordId=20 Provider=Unknown :: ok"
    assert (new.severity, new.ts) == ("info", dt.datetime(2024, 1, 2, 3, 4, 5))
    assert (old.severity, old.ts) == ("critical", AT) and old.message.endswith(":: (no message)")
    short = normalize.normalize_winevent(raw, with_record_id=False).first().message
    assert "RecordId" not in short


def test_cursor_takes_the_lowest_records_first(spark):
    raw = winevents(spark, *[{"RecordId": i, "Id": 1} for i in range(1, 30)])
    state = spark.createDataFrame([("t", "5")], "target_id string, last_cursor string")
    rows, moved = normalize.advance_cursor(raw, state, batch=7)
    assert sorted(r.record_id for r in rows.collect()) == list(range(6, 13))
    assert moved.first().last_cursor == "12"


def test_ssh(spark):
    rows = [("a", "0.5 0.4 0.3 1/100 123\nmore", " one \n\n two\n", AT), ("b", "busy", None, AT), ("c", "x 1 2 3", "", AT)]
    raw = spark.createDataFrame(rows, "asset_id string, metrics_raw string, log_raw string, collected_ts timestamp")
    got = {(r.asset_id, r.source, r.message, r.metric, r.value) for r in normalize.normalize_ssh(raw).collect()}
    assert got == {
        ("a", "ssh_metrics", "SSH metric load1=0.5", "load1", 0.5), ("a", "ssh_metrics", "SSH metric load5=0.4", "load5", 0.4),
        ("a", "ssh_metrics", "SSH metric load15=0.3", "load15", 0.3), ("a", "ssh_log", "[ssh log] one", None, None),
        ("a", "ssh_log", "[ssh log] two", None, None), ("b", "ssh_log", "[ssh metrics] busy", None, None),
        ("c", "ssh_metrics", "SSH metric load5=1", "load5", 1.0), ("c", "ssh_metrics", "SSH metric load15=2", "load15", 2.0),
    }


def test_snmp(spark):
    raw = spark.createDataFrame(
        [("a", "1.3.6.1.2.1.1.3.0", "12345", AT), ("a", "1.3", "up", AT)],
        "asset_id string, oid string, value string, collected_ts timestamp",
    )
    number, words = normalize.normalize_snmp(raw).orderBy(F.col("value").desc_nulls_last()).collect()
    assert (number.metric, number.value) == ("snmp_1_3_6_1_2_1_1_3_0", 12345.0)
    assert (words.message, words.value) == ("SNMP 1.3=None", None)


def test_host_log_and_metrics(spark):
    lines = [("a", "f", i, f"line {i}", AT) for i in range(30)] + [
        ("a", "f", 30, "Job FAILED", AT), ("a", "f", 31, "critical failed " + "x" * 600, AT)
    ]
    raw = spark.createDataFrame(lines, "asset_id string, file string, line_no int, value string, collected_ts timestamp")
    got = normalize.normalize_host_log(raw).collect()
    assert len(got) == 20 and max(len(r.message) for r in got) == 616
    assert sorted(r.severity for r in got if r.severity != "info") == ["critical", "warning"]
    samples = spark.createDataFrame(
        [("a", 0.5, 85.0, 100.0, AT), ("b", 1.0, 1.0, 3.0, AT)],
        "asset_id string, load1 double, disk_used double, disk_total double, collected_ts timestamp",
    )
    got = {(r.asset_id, r.metric): (r.value, r.severity) for r in normalize.normalize_host_metrics(samples).collect()}
    assert got[("a", "disk_used_pct")] == (85.0, "warning") and got[("b", "disk_used_pct")] == (33.33, "info")
    assert got[("b", "load1")] == (1.0, "info")


@pytest.mark.parametrize("wrap", [
    lambda m: {"Members": m}, lambda m: {"Members": None, "Items": m}, lambda m: {"items": m}, lambda m: {"value": m},
    lambda m: {"members": m}, lambda m: {"links": {"Member": m}}, lambda m: {"Links": {"members": m}},
])
def test_redfish_lists(spark, wrap):
    members = [
        {"Id": "101", "Severity": "Warning", "Message": "Power supply degraded", "Created": "2024-01-01T00:00:00Z"},
        {"Number": 102, "Severity": "Critical", "Name": "Fan failed"}, "not an entry",
    ]
    entries = normalize.redfish_entries(payloads(spark, wrap(members)))
    got = normalize.normalize_redfish(entries, mode="device").orderBy("message").collect()
    assert [(r.severity, r.message) for r in got] == [
        ("warning", "[iLO] Entry=101 Created=2024-01-01T00:00:00Z Severity=Warning :: Power supply degraded"),
        ("critical", "[iLO] Entry=102 Created= Severity=Critical :: Fan failed"),
    ]
    assert [r.ts for r in got] == [dt.datetime(2024, 1, 1), AT]
    state = spark.createDataFrame([("t", 101, None)], "target_id string, cursor_id bigint, cursor_created timestamp")
    rows, moved = normalize.redfish_cursor(entries, state)
    assert [r.entry_id for r in rows.collect()] == [102]
    assert moved.first().cursor_id == 102


def test_redfish_single_entry_and_empty(spark):
    docs = payloads(spark, {"Members": [], "Message": "alone", "Oem": {"Severity": "Caution"}}, {"Members": []}, "broken {")
    got = normalize.normalize_redfish(normalize.redfish_entries(docs)).collect()
    assert [(r.severity, r.message) for r in got] == [("warning", "[iLO] Entry=unknown Created= Severity=Unknown :: alone")]


def test_redfish_ids_and_time_cursor(spark):
    entries = normalize.redfish_entries(payloads(
        spark, {"Members": [{"Id": " 7. ", "Message": "a"}, {"Id": "x", "EntryId": 9, "Message": "b"}]}
    ))
    state = spark.createDataFrame([], "target_id string, cursor_id bigint, cursor_created timestamp")
    rows, _ = normalize.redfish_cursor(entries, state)
    assert sorted(r.entry_id for r in rows.collect()) == [7, 9]
    timed = normalize.redfish_entries(payloads(spark, {"Members": [
        {"Message": "old", "Created": "2024-01-01T00:00:00Z"}, {"Message": "new", "Created": "2024-01-03T00:00:00Z"},
    ]}))
    state = spark.createDataFrame(
        [("t", 0, dt.datetime(2024, 1, 2))], "target_id string, cursor_id bigint, cursor_created timestamp"
    )
    rows, moved = normalize.redfish_cursor(timed, state)
    assert rows.count() == 1 and moved.first().cursor_created == dt.datetime(2024, 1, 3)


def test_hydration(spark):
    links = [{"@odata.id": "/E/51"}, {"@odata.id": "/E/52"}]
    entries = normalize.redfish_entries(payloads(
        spark, {"Members": links}, {"Members": [{"@odata.id": "/E/99"}]}, {"Members": [links[0], {"Message": "plain"}]}
    ))
    docs = spark.createDataFrame(
        [("/E/51", '{"Id":"51","Message":"Fan degraded"}'), ("E/52", "{}")], "odata_id string, body string"
    )
    got = normalize.hydrate_links(entries, docs)
    texts = {(r.payload_id, r.entry.get("Message", "link")) for r in got.collect()}
    assert texts == {(0, "Fan degraded"), (1, "link"), (2, "link"), (2, "plain")}


def lines(spark, rows, asset="m"):
    return spark.createDataFrame(
        [(i, asset, "f", r) for i, r in enumerate(rows)], "seq bigint, asset_id string, file string, value string"
    )


def test_csb_lines(spark):
    parsed = csb.parse_csb(lines(spark, CSB + ["no such line", "  "]))
    events = csb.csb_to_events(parsed).orderBy("seq").collect()
    assert [e.severity for e in events] == ["info", "info", "info", "warning"]
    assert events[0].ts == dt.datetime(2026, 3, 3, 10, 17, 7, 638000)
    fields = csb.extract_csb_fields(parsed)
    assert csb.chain_filter(fields, sscc="246700022810196136").count() == 1
    assert csb.chain_filter(fields, script="64_TMC_SPE").count() == 1
    assert csb.chain_filter(fields, user="4824").count() == 1
    assert [(r.error_code, r.error_message) for r in csb.chain_errors(fields).collect()] == [("4007", "Bad row.")]
    assert {(r.kind, r.value) for r in csb.touched(fields).collect()} == {
        ("sscc", "246700022810196136"), ("script", "64_TMC_SPE"), ("user", "4824 A B")
    }


def test_csb_report(spark):
    events = csb.csb_to_events(csb.parse_csb(lines(spark, CSB)))
    doc = csb.csb_report(events, "m").first()
    assert (doc.total_lines, doc.matched_lines, doc.users_touched) == (4, 4, ["4824 A B"])
    assert [c.kind for c in doc.chain] == ["Write", "Query", "Query", "Write"]
    assert (doc.errors[0].code, doc.chain[3].error_message) == ("4007", "Bad row.")
    one = csb.csb_report(events, "m", user="a b").first()
    assert (one.total_lines, one.matched_lines, one.filters["user"]) == (4, 1, "a b")
    assert csb.csb_report(events, "other").first().chain == []


def test_scan_text_logs_numbers_lines(spark, tmp_path):
    for name, rows in (("b/one.txt", CSB), ("a/two.txt", CSB[:2] + ["", "junk"]), ("skip.log", CSB)):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    got = text_logs.scan_text_logs(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r.file.rsplit("/", 1)[1], r.line_no) for r in got] == [
        *[("two.txt", i) for i in range(1, 5)], *[("one.txt", i) for i in range(1, 5)]
    ]
    assert text_logs.scan_text_logs(spark, str(tmp_path), max_files=1).count() == 4
    assert text_logs.scan_text_logs(spark, str(tmp_path), recursive=False).count() == 0
    scanned = text_logs.scan_text_logs(spark, str(tmp_path)).withColumn("asset_id", F.lit("m"))
    events = csb.csb_to_events(csb.parse_csb(scanned))
    kept = dedup_events(ingest.with_fingerprint(events))
    row = csb.csb_ingest_summary(scanned, kept, text_logs.list_text_logs(spark, str(tmp_path))).first()
    # the two lines of two.txt also stand in one.txt
    assert tuple(row) == (2, 2, 7, 6, 4)


def test_scan_numbers_lines_across_splits(spark, tmp_path):
    (tmp_path / "big.txt").write_text("".join(f"line {i}\n" for i in range(1, 3001)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = text_logs.scan_text_logs(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.value == f"line {r.line_no}" for r in rows) and len(rows) == 3000


def test_tail_reader(tmp_path):
    path = tmp_path / "x.txt"
    reader = tail.TailReader({"path": str(tmp_path), "splitBytes": "16"})

    def read(start):
        end = reader.latestOffset()
        found = [batch for part in reader.partitions(start, end) for batch in reader.read(part)]
        return [value for batch in found for value in batch["value"].to_pylist()], end

    path.write_text("one\ntwo")
    got, at = read(reader.initialOffset())
    assert got == ["one"]
    with path.open("a") as fh:
        fh.write(" more\n\n" + "".join(f"line {i}\n" for i in range(20)) + "half")
    got, at = read(at)
    assert got == ["two more"] + [f"line {i}" for i in range(20)]
    assert read(at)[0] == []
    path.write_text("new\n")
    got, at = read(at)
    assert got == ["new"]

    for i in range(2100):
        (tmp_path / f"a{i:04d}.txt").write_text("first\n")
    got, at = read(at)
    assert got == ["first"] * 2100  # more files than fit any limit, all sorted before x.txt
    path.rename(tmp_path / "x.away")
    got, at = read(at)
    assert got == []
    (tmp_path / "x.away").rename(path)
    with path.open("a") as fh:
        fh.write("later\n")
    got, at = read(at)
    assert got == ["later"]  # what was read before it went is not read again
    with path.open("a") as fh:
        fh.write("lost\n")
    end = reader.latestOffset()
    path.unlink()
    assert [b for part in reader.partitions(at, end) for b in reader.read(part)] == []
    again = tail.TailReader({"path": str(tmp_path)})
    assert again.partitions(end, again.latestOffset()) == []
    with pytest.raises(ValueError):
        tail.TailReader({"path": str(tmp_path), "maxFiles": "0"})


def test_tail_stream(spark, tmp_path):
    spark.dataSource.register(tail.TailTextSource)
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "part1.txt").write_text(CSB[2] + "\n", encoding="utf-8")
    counts = []
    for extra in ("", CSB[1] + "\n"):
        with (folder / "part1.txt").open("a", encoding="utf-8") as fh:
            fh.write(extra)
        rows = spark.readStream.format("tail_text").option("path", str(folder)).load()
        run = rows.writeStream.format("parquet").option("path", out).option(
            "checkpointLocation", str(tmp_path / "state")).start()
        run.processAllAvailable()
        run.stop()
        counts.append(spark.read.parquet(out).count())
    assert counts == [1, 2]


def test_event_batches(spark, tmp_path):
    (tmp_path / "b.json").write_text(
        json.dumps({"batch_id": 3, "events": [
            {"asset_id": "a", "source": "s", "message": "m"},
            {"asset_id": "a", "source": "s", "message": "n", "severity": "critical", "value": 2,
             "timestamp": "2024-01-01T01:00:00+01:00"},
        ]}) + "\n"
    )
    first, second = batches.read_event_batches(spark, str(tmp_path), F.lit("2024-02-02 00:00:00")).orderBy("seq").collect()
    assert (first.severity, first.ts, first.seq) == ("info", dt.datetime(2024, 2, 2), 3 << 24)
    assert (second.severity, second.value, second.ts) == ("critical", 2.0, dt.datetime(2024, 1, 1))


def test_normalize_all(spark):
    merged = normalize.normalize_all(
        winrm=winevents(spark, {"RecordId": 1, "Message": "x"}),
        ilo=normalize.redfish_entries(payloads(spark, {"Members": [{"Id": 1, "Message": "y"}]})),
        csb_merp_share=lines(spark, CSB[:1]),
    )
    assert sorted(r.source for r in merged.collect()) == ["csb_merp_txt", "ilo_iml", "windows_eventlog"]
    with pytest.raises(ValueError):
        normalize.normalize_all()


def test_csb_report_covers_every_line(spark):
    row = "03.03.2026 10:17:%02d.638  S1 ID 7 Query SYS+LOGIN;!:a:L2+%d+1+1+\"Ann\"+\"Lee\""
    old = [row % (i % 60, 4000) for i in range(20)]
    new = [row % (i % 60, 4001) for i in range(3100)]
    events = csb.csb_to_events(csb.parse_csb(lines(spark, old + new)))
    doc = csb.csb_report(events, "m").first()
    assert (doc.total_lines, doc.matched_lines) == (3120, 3120)
    assert doc.users_touched == ["4000 Ann Lee", "4001 Ann Lee"]
    assert len(doc.chain) == 500
    assert len(csb.csb_report(events, "m", max_chain=None).first().chain) == 3120
    newest = csb.csb_report(events, "m", limit=30, max_chain=5).first()
    assert (newest.total_lines, newest.users_touched, len(newest.chain)) == (30, ["4001 Ann Lee"], 5)


def test_redfish_payload_that_repeats_a_key(spark):
    tune(spark)
    rows = [(1, "t", "a", '{"Members": [{"Id": 1, "Message": "old", "Message": "new"}, 7, "x", null]}', None)]
    docs = spark.createDataFrame(rows, "payload_id bigint, target_id string, asset_id string, payload string, collected_ts timestamp")
    assert [r.entry["Message"] for r in normalize.redfish_entries(docs).collect()] == ["new"]


def test_strip_takes_what_the_unicode_class_takes(spark):
    every = spark.range(1, 0x10000).filter("id < 55296 OR id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 4, "0")), "UTF-16BE").alias("c"))
    rows = every.select(F.concat("c", F.lit(" \n"), "c", F.lit("a"), "c", F.lit("b"), "c", F.lit("\r\n"), "c").alias("v"))
    slow = F.regexp_replace("v", r"(?U)^\s+|\s+$", "")
    assert rows.filter(strip(F.col("v")) != slow).count() == 0
    assert rows.filter(strip(F.col("v")) != F.col("v")).count() == 25
    assert spark.sql("SELECT '' AS v UNION ALL SELECT ' \n ' UNION ALL SELECT NULL").select(strip(F.col("v")).alias("s")).filter("s = ''").count() == 2


def test_ssh_text_is_taken_apart_once(spark):
    """The generator names two columns made before it, and no expression over the raw text."""
    raw = spark.createDataFrame([("a", " 0.5  0.4 0.3 1/100 7 \nx", "b", dt.datetime(2024, 1, 1))], "asset_id string, metrics_raw string, log_raw string, collected_ts timestamp")
    out = normalize.normalize_ssh(raw)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "metrics_raw" not in next(line for line in plan.splitlines() if "Generate" in line)
    assert [r.value for r in out.collect()] == [0.5, 0.4, 0.3, None]


def test_links_are_joined_once(spark):
    """No second pass over the payloads; rows without a payload_id each decide for themselves."""
    links = [(1, "/a"), (1, "/b"), (None, "/a"), (None, "/b"), (2, "/c"), (2, "/d")]
    entries = spark.createDataFrame(links, "payload_id long, link string").select(
        "payload_id", "link", F.lit(True).alias("is_link"), F.create_map(F.lit("@odata.id"), "link").alias("entry"))
    docs = spark.createDataFrame([("/a", '{"Message":"old"}'), ("/a", '{"Message":"new"}'), ("/b", "broken")], "odata_id string, body string").coalesce(1)
    got = normalize.hydrate_links(entries, docs)
    assert sorted((r.payload_id or 0, r.entry.get("Message") or r.entry["@odata.id"]) for r in got.collect()) == [
        (0, "/b"), (0, "new"), (1, "new"), (2, "/c"), (2, "/d")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
