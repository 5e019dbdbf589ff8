"""A-04 ... A-06: fingerprints and window de-duplication."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from opslens.operators import dedup
from opslens.operators.dedup import NEVER, composed, dedup_events, passed, steps
from opslens.operators.ingest import with_fingerprint
from opslens.functions.ranking import running
from opslens.streaming.dedup import dedup_stream, kept_positions, rising

SCHEMA = "seq bigint, fingerprint string, ts timestamp"
BASE = dt.datetime(2024, 1, 1)


def loop(rows, window):
    """Row by row, as the rule is stated."""
    last, kept = {}, []
    for seq, fp, t in sorted(rows):
        if fp not in last or t - last[fp] > window:
            last[fp] = t
            kept.append(seq)
    return kept


def frame(spark, rows):
    return spark.createDataFrame([(s, f, BASE + dt.timedelta(seconds=t)) for s, f, t in rows], SCHEMA)


def seqs(df):
    return sorted(r.seq for r in df.select("seq").collect())


def test_identical_rows_are_one_event(make_events):
    events = with_fingerprint(make_events([
        ("win-01", "windows_eventlog", "EventID=6008", "critical", None, None, 0),
        ("win-01", "windows_eventlog", "EventID=6008", "critical", None, None, 0),
    ]))
    assert seqs(dedup_events(events)) == [1]


def test_chain_and_late_row(spark):
    times = [0, 200, 301, 602, 500, 903]
    rows = [(i + 1, "a", t) for i, t in enumerate(times)]
    assert seqs(dedup_events(frame(spark, rows))) == [1, 3, 4, 6]


def test_gap_equal_to_window_is_dropped(spark):
    assert seqs(dedup_events(frame(spark, [(1, "a", 0), (2, "a", 300), (3, "a", 301)]))) == [1, 3]


@pytest.mark.parametrize("short_rows", [10_000, 3])
@pytest.mark.parametrize("seed", [1, 2])
def test_matches_the_loop_on_random_rows(spark, seed, short_rows):
    rng = random.Random(seed)
    rows, clock = [], 0
    for seq in range(1, 1200):
        clock += rng.choice([0, 1, 5, 20, 90, 400])
        # a third of the rows share one fingerprint; some rows are late
        fp = "hot" if rng.random() < 0.35 else f"fp{rng.randrange(12)}"
        rows.append((seq, fp, clock - rng.choice([0, 0, 0, 50, 700])))
    got = dedup_events(
        frame(spark, rows), 300, short_island_rows=short_rows, chunk_rows=16, fanout=2, block_rows=64
    )
    assert seqs(got) == loop(rows, 300)


def test_dense_hot_fingerprint(spark):
    rng = random.Random(7)
    rows = [(i, "hot", t) for i, t in enumerate(sorted(rng.randrange(0, 40_000) for _ in range(3000)))]
    for chunk_rows, fanout in ((64, 3), (300, 16)):
        got = dedup_events(frame(spark, rows), 300, short_island_rows=10, chunk_rows=chunk_rows, fanout=fanout, block_rows=128)
        assert seqs(got) == loop(rows, 300)


def test_sparse_and_negative_numbers_in_the_tree(spark):
    rng = random.Random(5)
    times = sorted(rng.randrange(0, 9_000) for _ in range(900))
    rows = [((i - 400) * 100_003, "hot", t) for i, t in enumerate(times)]
    got = dedup_events(frame(spark, rows), 60, short_island_rows=3, chunk_rows=1_000_000, fanout=2, block_rows=1 << 20)
    assert seqs(got) == loop(rows, 60)


def test_keys_with_few_rows_need_no_blocks(spark, monkeypatch):
    """One shuffle by key is enough for them; 700 rows of one island are folded over several slices."""
    monkeypatch.setattr(dedup, "running", None)
    rng = random.Random(11)
    times = sorted(rng.randrange(0, 60_000) for _ in range(1400))
    rows = [(i, f"fp{i % 2}", t) for i, t in enumerate(times)] + [(9000 + i, f"once{i}", i) for i in range(50)]
    rows += [(9500, "late", 500), (9501, "late", 100), (9502, "late", 900)]
    assert seqs(dedup_events(frame(spark, rows), 100)) == loop(rows, 100)


def test_times_that_are_null_are_kept_until_one_is_known(spark):
    rows = [(1, "a", None), (2, "a", None), (3, "a", BASE), (4, "a", None), (5, "b", BASE)]
    for sizes in ({}, {"short_island_rows": 2, "chunk_rows": 4, "block_rows": 4}):
        assert seqs(dedup_events(spark.createDataFrame(rows, SCHEMA), 300, **sizes)) == [1, 2, 3, 5]


def test_chunks_hold_rows_not_numbers(spark, monkeypatch):
    """Rows with numbers far apart share a chunk; keys with few rows beside a hot one stay right."""
    staged = {}

    def noted(df, name):
        out = staged[name] = stage(df, name)
        return out

    stage = dedup.stage
    monkeypatch.setattr(dedup, "stage", noted)
    rng = random.Random(3)
    times = sorted(rng.sample(range(9_000), 640))
    rows = [(i * 1_000_003, "hot", t) for i, t in enumerate(times)]
    rows += [(i * 1_000_003 + 1, f"fp{i % 40}", t) for i, t in enumerate(times[:300])]
    got = dedup_events(frame(spark, rows), 60, short_island_rows=5, chunk_rows=64, fanout=4)
    assert seqs(got) == loop(rows, 60)
    # a place more or less, where a restart cuts a chunk in two
    assert 10 <= staged["dedup-chunks"].count() <= 20


@pytest.mark.parametrize("seed", range(6))
def test_composed_steps_are_the_walk_over_both_chunks(seed):
    """Any number of chunks, grouped any way, for every last kept time that may come before them."""
    rng = random.Random(seed)
    t = np.array(sorted(rng.sample(range(rng.choice([80, 400, 3000])), 60)), np.int64)
    window = rng.choice([0, 3, 25, 90, 5000])
    cuts = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
    chunks = np.split(t, cuts)
    whole = steps(chunks[0], window)
    for one in chunks[1:]:
        whole = composed(int(t[0]), whole, steps(one, window), window)
    right = steps(chunks[-1], window)
    for i in range(len(chunks) - 2, -1, -1):
        right = composed(int(chunks[i][0]), steps(chunks[i], window), right, window)
    for before in [NEVER, *range(-window - 5, int(t[0]))]:
        last = before
        for x in t.tolist():
            if x > last + window:
                last = x
        for entry, after in (whole, right):
            assert passed(entry, after, np.array([before]), window)[0] == last


def test_fingerprint_ignores_time_and_null_metric(make_events):
    rows = with_fingerprint(make_events([
        ("a", "s", "m", "info", None, None, 0), ("a", "s", "m", "info", None, None, 99),
        ("a", "s", "m", "info", "", None, 0), ("a", "s", "m", "info", "cpu", 25.0, 0),
    ])).orderBy("seq").collect()
    assert rows[0].fingerprint == rows[1].fingerprint == rows[2].fingerprint != rows[3].fingerprint
    import hashlib

    assert rows[3].fingerprint == hashlib.sha256(b"a|s|m|cpu|25.0|info").hexdigest()


def test_running_values_across_blocks(spark):
    df = spark.range(1, 101).select(
        F.col("id").alias("seq"), F.expr("cast(id % 2 AS string)").alias("k"), F.expr("id % 7").alias("v")
    )
    got = running(df, "k", "seq", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block_rows=8)
    total, top = {}, {}
    for r in got.orderBy("seq").collect():
        total[r.k] = total.get(r.k, 0) + r.v
        top[r.k] = max(top.get(r.k, 0), r.v)
        assert (r.s, r.m) == (total[r.k], top[r.k])


def test_running_values_of_sparse_and_negative_numbers(spark):
    df = spark.range(1, 41).select(
        ((F.col("id") - 20) * 1000).alias("seq"), F.lit("k").alias("k"), F.expr("id * 5 % 11").alias("v"))
    for levels in (1, 2, 3):
        got = running(df, "k", "seq", {"s": ("sum", F.col("v")), "m": ("max", F.col("v"))}, block_rows=16, levels=levels)
        seen = []
        for r in got.orderBy("seq").collect():
            seen.append(r.v)
            assert (r.s, r.m) == (sum(seen), max(seen))


def test_kept_positions_carries_state():
    kept, last = kept_positions(np.array([0, 200, 301]), None, 300)
    assert (kept, last) == ([0, 2], 301)
    assert kept_positions(np.array([500, 602, 300, 903]), last, 300) == ([1, 3], 903)


def _stream_run(spark, tmp_path, **options):
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    run = (
        dedup_stream(source, **options).writeStream.format("parquet")
        .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return run.lastProgress


def test_stream_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, f"fp{rng.randrange(3)}", i * 40 - rng.choice([0, 0, 500])) for i in range(1, 200)]
    for part in range(4):
        frame(spark, rows[part * 50:(part + 1) * 50]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        _stream_run(spark, tmp_path)
    assert seqs(spark.read.parquet(str(tmp_path / "out"))) == loop(rows, 300)


def test_stream_takes_frames_out_of_order(spark, tmp_path):
    """One fingerprint, many small frames, rows of which come in any order."""
    rng = random.Random(4)
    rows = [(i, "hot", i * 7 - rng.choice([0, 0, 90])) for i in range(1, 600)]
    mixed = rng.sample(rows, len(rows))
    frame(spark, mixed).repartition(5).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        _stream_run(spark, tmp_path, window_sec=30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert seqs(spark.read.parquet(str(tmp_path / "out"))) == loop(rows, 30)


def test_stream_releases_state_and_keeps_the_same_rows(spark, tmp_path):
    rows = [(i, f"fp{i}", i * 100) for i in range(1, 40)] + [(40, "fp39", 3950), (41, "fp38", 4200)]
    parts = [rows[:20], rows[20:41], [(42, "end", 9000)], [(43, "end", 9001)]]
    held = []
    for part in parts:
        frame(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        held.append(_stream_run(spark, tmp_path, late="200 seconds").stateOperators[0].numRowsTotal)
    assert seqs(spark.read.parquet(str(tmp_path / "out"))) == loop(rows + [(42, "end", 9000), (43, "end", 9001)], 300)
    state = spark.read.format("statestore").option("stateVarName", "last_kept").load(str(tmp_path / "state"))
    assert [r.key[0] for r in state.select("key").collect()] == ["end"], held


def test_rising_rows():
    seq, t = np.array([3, 1, 2, 4]), np.array([50, 10, 40, 50])
    assert rising(seq, t, 10).tolist() == [2, 0]
    assert rising(seq[:0], t[:0], 0).tolist() == []
