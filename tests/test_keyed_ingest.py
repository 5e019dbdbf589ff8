"""B-01, B-02 as written tables, and the ingest chain as one stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from opslens.operators import tables
from opslens.schemas import EVENT
from opslens.sinks.keyed import KeyedTable
from opslens.sources.batches import stream_event_batches
from opslens.streaming.ingest import ingest_batch, ingest_stream, read_sink

SCHEMA = "id bigint, name string, amount double"


@pytest.fixture
def table(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    made = KeyedTable(spark, str(tmp_path / "table"), schema, ["id"], buckets=32)
    made.upsert(spark.range(1000).selectExpr("id", "'old' AS name", "id / 2 AS amount", "0 AS at"), "at")
    return made


def content(df):
    return sorted(tuple(row) for row in df.collect())


def updates(spark, rows):
    return spark.createDataFrame(rows, SCHEMA + ", at bigint")


def test_only_touched_buckets_are_rewritten(spark, table):
    before, base = table.manifest()["parts"], table.read()
    new = updates(spark, [(i * 97, "new", 1.0, 1) for i in range(9)] + [(5000, None, None, 1), (5000, "newest", 2.0, 2)])
    want = content(tables.upsert(base, new, ["id"], "at"))
    rewritten = table.upsert(new, "at")
    after = table.manifest()["parts"]
    assert 1 <= len(rewritten) <= 10
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in rewritten}
    assert content(table.read()) == want and len(want) == 1001
    assert content(table.read(1)) == content(spark.range(1000).selectExpr("id", "'old'", "id / 2"))


def test_a_killed_write_leaves_the_old_table(spark, table):
    want, version = content(table.read()), table.manifest()["version"]
    table._commit, commit = (lambda manifest: (_ for _ in ()).throw(KeyboardInterrupt())), table._commit
    with pytest.raises(KeyboardInterrupt):
        table.upsert(updates(spark, [(1, "half", 0.0, 9)]), "at")
    table._commit = commit
    broken = updates(spark, [(1, "x", 0.0, 9)]).withColumn("name", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        table.upsert(broken, "at")
    assert (content(table.read()), table.manifest()["version"]) == (want, version)


def test_a_second_writer_fails(spark, table):
    stale = dict(table.manifest(), version=table.manifest()["version"])
    with pytest.raises(RuntimeError, match="someone else"):
        table._commit(stale)


def test_batches_count_once(spark, table):
    assert table.upsert(updates(spark, [(1, "a", 0.0, 1)]), "at", batch=4)
    assert table.upsert(updates(spark, [(1, "b", 0.0, 1)]), "at", batch=4) == []
    assert table.read().filter("id = 1").first().name == "a"
    assert KeyedTable(spark, table.path, table.schema, ["id"], buckets=7).buckets == 32


def test_delete_and_empty_changes(spark, table):
    table.delete(spark.range(990))
    assert [r[0] for r in content(table.read())] == list(range(990, 1000))
    parts = table.manifest()["parts"]
    assert table.upsert(updates(spark, []), "at") == [] and table.manifest()["parts"] == parts
    table.delete(spark.range(2000))
    assert table.read().count() == 0 and table.manifest()["parts"] == {}
    table.upsert(updates(spark, [(None, "no key", 1.0, 1), (3, None, None, 1)]), "at")
    assert {r.id for r in table.read().collect()} == {None, 3}


def land(path, batches):
    path.mkdir(exist_ok=True)
    for number, events in batches:
        (path / f"{number}.json").write_text(json.dumps({"batch_id": number, "events": events}))


def event(asset, message, second, severity="info"):
    stamp = f"2024-03-01T{second // 3600:02d}:{second % 3600 // 60:02d}:{second % 60:02d}Z"
    return {"asset_id": asset, "source": "s", "message": message, "severity": severity, "timestamp": stamp}


def walk(batches, known, window):
    """Row by row: messages of what each table gets."""
    last, out = {}, {"accepted": [], "quarantined": [], "orphans": []}
    for number, events in batches:
        for place, e in enumerate(events):
            seq, at = (number << 24) + place, sum(int(x) * f for x, f in zip(e["timestamp"][11:19].split(":"), (3600, 60, 1)))
            key = (e["asset_id"], e["message"], e["severity"])
            if e["severity"] not in ("info", "warning", "critical"):
                out["quarantined"].append(seq)
            elif e["asset_id"] not in known:
                out["orphans"].append(seq)
            elif key not in last or at - last[key] > window:
                last[key] = at
                out["accepted"].append(seq)
    return out


@pytest.mark.parametrize("dies_at", [0, 1])
def test_killed_and_restarted_chain_equals_the_loop(spark, tmp_path, dies_at):
    rng = random.Random(11)
    batches, clock = [], 0
    for number in range(6):
        events = []
        for _ in range(40):
            clock += rng.choice([0, 5, 40])
            events.append(event(rng.choice(["a", "b", "shelf"]), rng.choice(["x", "y"]), max(0, clock - rng.choice([0, 0, 300])),
                                rng.choice(["info", "info", "critical", "odd"])))
        batches.append((number, events))
    assets = spark.createDataFrame([("a",), ("b",)], "id string")
    source, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")

    def die(epoch):
        if epoch == dies_at:
            raise RuntimeError("killed")

    def run(**options):
        stream = stream_event_batches(spark, str(source))
        ingest_stream(stream, assets, out, state, window_sec=60, buckets=4, **options).start().awaitTermination()

    land(source, batches[:3])
    if dies_at == 0:
        with pytest.raises(Exception, match="killed"):
            run(on_written=die)
        assert read_sink(spark, out, "accepted").count() == 0
    run()
    first = walk(batches[:3], {"a", "b"}, 60)
    land(source, batches[3:])
    if dies_at == 1:
        with pytest.raises(Exception, match="killed"):
            run(on_written=die)
        assert sorted(r.seq for r in read_sink(spark, out, "orphans").collect()) == first["orphans"]
    run()
    run()
    want = walk(batches, {"a", "b"}, 60)
    for sink, seqs in want.items():
        assert sorted(r.seq for r in read_sink(spark, out, sink).collect()) == seqs, sink
    assert all(want.values())


def test_batch_without_rows_and_without_numbers(spark, tmp_path):
    assets = spark.createDataFrame([("a",)], "id string")
    out = str(tmp_path / "out")
    nothing = spark.createDataFrame([], EVENT).select(*[F.col(n).alias(n) for n in EVENT.names])
    ingest_batch(nothing, 0, assets, out)
    assert [read_sink(spark, out, s).count() for s in ("accepted", "quarantined", "orphans")] == [0, 0, 0]
    rows = spark.sql("""SELECT CAST(NULL AS bigint) AS seq, * FROM VALUES
        ('a', 's', 'm', NULL, NULL, 'info', TIMESTAMP '2024-03-01 10:00:00'),
        ('a', 's', 'm', NULL, NULL, 'info', TIMESTAMP '2024-03-01 10:00:00'),
        (NULL, 's', 'm', NULL, NULL, 'info', TIMESTAMP '2024-03-01 10:00:00'),
        ('b', 's', 'm', NULL, NULL, 'info', TIMESTAMP '2024-03-01 10:00:00')
        AS t(asset_id, source, message, metric, value, severity, ts)""").selectExpr(
        "seq", "asset_id", "source", "message", "CAST(metric AS string) AS metric", "CAST(value AS double) AS value", "severity", "ts")
    ingest_batch(rows, 1, assets, out)
    ingest_batch(rows, 1, assets, out)
    assert [read_sink(spark, out, s).count() for s in ("accepted", "quarantined", "orphans")] == [1, 1, 1]
    assert read_sink(spark, out, "quarantined").first().errors == ["asset_id"]


def test_a_change_deals_its_rows_out_once(spark):
    """Rows of a keyed table are shuffled by bucket, and neither by key before nor by bucket after."""
    base = spark.createDataFrame([(1, i, "old") for i in range(5)], "table_bucket int, id long, v string")
    new = spark.createDataFrame([(1, 3, "new"), (2, 9, "new")], base.schema)
    got = tables.upsert(base, new, ["table_bucket", "id"], "v", by="table_bucket", parts=2)
    assert sorted((r.id, r.v) for r in got.collect()) == [(0, "old"), (1, "old"), (2, "old"), (3, "new"), (4, "old"), (9, "new")]
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange ") == 1
