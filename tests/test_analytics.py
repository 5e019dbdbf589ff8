"""C: signatures, clusters, detectors, insight, overview; E: rules, edges, briefs, risk."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from opslens.functions.ranking import latest_per_asset
from opslens.functions.selection import medians
from opslens.functions.text import cluster_id, signature
from opslens.operators import anomalies, clusters, dependency, rules
from opslens.plans import incidents, insight

FX04 = (
    [("srv-ai", "windows_eventlog", f"EventID=4625 user=ops host=10.0.0.{i}", "warning") for i in range(1, 7)]
    + [("srv-ai", "linux", f"cpu load high value={20 + i}", "info", "cpu_load", 20.0 + i) for i in range(6)]
    + [("srv-ai", "linux", "cpu load high value=120", "warning", "cpu_load", 120.0)]
    + [("srv-ai", "windows_eventlog", "Kernel panic on node 77", "critical")]
)


@pytest.mark.parametrize("message, expected", [
    ("EventID=4625 user=ops host=10.0.0.1", "eventid=<num> user=ops host=<ip>"),
    ("addr 0xFF in 12ms node_5", "addr <hex> in 12ms node_5"),
    ("id 3f2504e0-4f89-11d3-9a0c-0305e82c3301  7", "id <guid> <num>"),
    ("service timeout code=500", "service timeout code=<num>"),
    ("  ошибка5 \t на узле 7 ", "ошибка5 на узле <num>"),
])
def test_signature(spark, message, expected):
    row = spark.createDataFrame([(message,)], "message string").select(signature().alias("s")).first()
    assert row.s == expected


def test_long_messages_keep_their_whole_signature(spark):
    row = spark.createDataFrame([("x" * 500,)], "message string").select(signature().alias("s")).first()
    assert row.s == "x" * 500


def test_cluster_id(spark):
    import hashlib

    rows = spark.createDataFrame([("Windows_EventLog", "a"), ("--", "b")], "source string, signature string")
    got = [r.c for r in rows.select(cluster_id().alias("c")).collect()]
    assert got == [
        "cl-window-" + hashlib.sha1(b"Windows_EventLog|a").hexdigest()[:8],
        "cl-src-" + hashlib.sha1(b"--|b").hexdigest()[:8],
    ]


def test_latest_per_asset_with_a_hot_asset(spark):
    rows = spark.range(0, 5000, 1, 16).select(
        F.col("id").alias("seq"), F.expr("if(id % 3 = 0, 'hot', concat('a', id % 40))").alias("asset_id")
    )
    got = latest_per_asset(rows, 25)
    counted = {r.asset_id: (r["n"], r.low) for r in got.groupBy("asset_id").agg(
        F.count("*").alias("n"), F.min("seq").alias("low")).collect()}
    assert counted["hot"] == (25, 4998 - 24 * 3)
    assert all(n == 25 for n, _ in counted.values())


def test_insight_of_one_asset(make_events, ids):
    row = insight.log_insight(make_events(FX04), ids("srv-ai", "empty"), limit=200).orderBy("asset_id").collect()
    empty, doc = row
    assert (empty.analyzed_events, empty.clusters, empty.anomalies) == (0, [], [])
    assert doc.analyzed_events == 14
    assert [(c.events_count, c.share) for c in doc.clusters] == [(7, 0.5), (6, 0.429), (1, 0.071)]
    assert doc.clusters[0].severity_mix == {"info": 6, "warning": 1}
    assert [(a.kind, a.severity, a.confidence) for a in doc.anomalies] == [
        ("metric_outlier", "warning", 0.95), ("rare_pattern", "critical", 0.84), ("burst_pattern", "warning", 0.8),
    ]
    assert "robust z: 32.71" in doc.anomalies[0].evidence[2]
    assert any("Cluster " in e for e in doc.anomalies[1].evidence)


def test_metric_stats(make_events):
    window = clusters.analysis_window(make_events(FX04))
    row = anomalies.metric_stats(window).first()
    assert (row.samples, row.median_value, row.mad, row.last_value) == (7, 23.0, 2.0, 120.0)
    assert round(row.robust_z, 2) == 32.71


def test_split_baseline_and_rates(make_events):
    window = clusters.analysis_window(make_events(FX04))
    assert window.filter("is_recent").count() == 10
    profile = {r.source + r.signature[:3]: r for r in anomalies.cluster_profile(window).collect()}
    cpu = profile["linuxcpu"]
    assert (cpu.recent_count, cpu.recent_rate, cpu.older_rate, cpu.hourly_baseline) == (7, 0.7, 0.0, 0.0)
    assert profile["windows_eventlogeve"].recent_count == 2


def test_single_detectors_agree_with_detect(make_events):
    window = clusters.analysis_window(make_events(FX04))
    profile = anomalies.cluster_profile(window)
    parts = [anomalies.rare_patterns(profile), anomalies.burst_patterns(profile), anomalies.metric_outliers(window)]
    singly = {(r.kind, r.confidence, r.related_metric) for p in parts for r in p.collect()}
    assert singly == {(r.kind, r.confidence, r.related_metric) for r in anomalies.detect(window).collect()}


def test_limits(make_events, ids):
    events = make_events([("t", "linux", f"service timeout {'x' * i} code=1", "warning") for i in range(15)])
    doc = insight.log_insight(events, ids("t"), limit=200, max_clusters=5, max_anomalies=1).first()
    assert (len(doc.clusters), len(doc.anomalies)) == (5, 1)
    assert clusters.analysis_window(events, limit=4).count() == 4


def test_ignore_lists(make_events, ids, spark):
    rows = [("f", "linux", f"service timeout code={500 + i}", "warning") for i in range(8)]
    rows += [("f", "windows_eventlog", f"EventID=4625 user=ops host=10.10.0.{i}", "warning") for i in range(1, 6)]
    events = make_events(rows)
    doc = insight.log_insight(events, ids("f"), limit=200, filters=([" Linux "], [])).first()
    assert {c.source for c in doc.clusters} == {"windows_eventlog"}
    assert "Excluded by ignore rules: 8 of 13" in doc.summary
    table = spark.createDataFrame(
        [("signature", "service timeout code=<num>"), ("source", "windows_eventlog")], "field string, item string"
    )
    doc = insight.log_insight(events, ids("f"), limit=200, filters=table).first()
    assert (doc.analyzed_events, doc.clusters) == (0, [])
    assert doc.summary == ["All events are excluded by ignore rules: 13 of 13"]


def test_shares_add_up(make_events):
    rng = random.Random(5)
    events = make_events([
        (f"a{rng.randrange(3)}", rng.choice(["x", "y"]), f"msg {rng.choice('abcdef')} 1", "info") for _ in range(300)
    ])
    for table in (clusters.clusters(clusters.analysis_window(events)), clusters.cluster_totals(events)):
        for r in table.groupBy("asset_id").agg(F.sum("share").alias("s")).collect():
            assert r.s == pytest.approx(1, abs=0.01)


def test_overview(make_events, ids):
    events = make_events([
        ("ov-1", "linux", f"service timeout code={c}", "warning") for c in (501, 502, 503)
    ] + [("ov-2", "windows_eventlog", "Kernel panic on node 3", "critical")])
    ranked, totals = insight.analytics_overview(events, ids("ov-1", "ov-2"), limit_per_asset=200)
    assert [(r.asset_id, r.anomalies_total, r.top_severity) for r in ranked.collect()] == [
        ("ov-2", 1, "critical"), ("ov-1", 0, None)
    ]
    row = totals.first()
    assert (row.assets_considered, row.assets_with_anomalies, row.total_anomalies, row.critical) == (2, 1, 1, 1)


def test_dependency_map(make_events):
    events = make_events([
        ("d", "linux", "timeout code=501", "warning"), ("d", "app", "timeout code=502", "warning"),
        ("d", "linux", "db down hard", "critical"), ("d", "app", "db down hard", "critical"),
        ("lone", "app", "db down hard", "critical"),
    ])
    doc, lone = dependency.dependency_map(events).orderBy("asset_id").collect()
    assert (doc.total_sources, doc.total_edges) == (2, 1)
    edge = doc.edges[0]
    assert (edge.source_a, edge.source_b, edge.shared_signatures, edge.co_occurrence_score) == ("app", "linux", 2, 1.0)
    assert edge.example_signature == "db down hard"
    assert (lone.total_sources, lone.total_edges, lone.edges) == (1, 0, [])


def test_edges_do_not_depend_on_input_order(make_events, spark):
    rows = [("a", s, f"m{w} x", "info") for s in "pqrs" for w in "abc" if (s, w) != ("q", "b")]
    forward = dependency.dependency_edges(make_events(rows)).drop("edge_rank").collect()
    backward = dependency.dependency_edges(make_events(rows[::-1])).drop("edge_rank").collect()
    assert sorted(forward) == sorted(backward) and len(forward) == 6


def strongest(rows, k):
    """The k best source pairs of every asset, from all pairs."""
    sets = {}
    for asset, source, message, _ in rows:
        sets.setdefault(asset, {}).setdefault(source, set()).add(message)
    out = []
    for asset, of in sets.items():
        pairs = []
        for a, b in itertools.combinations(sorted(of), 2):
            both = of[a] & of[b]
            if both:
                pairs.append((-len(both), -round(len(both) / min(len(of[a]), len(of[b])), 3), a, b, min(both)))
        out += [(asset, rank, a, b, -n, -score, least) for rank, (n, score, a, b, least) in enumerate(sorted(pairs)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_strongest_pairs_among_alike_sources(make_events, seed):
    rng = random.Random(seed)
    kinds = [[w for w in "abcdefg" if rng.random() < 0.4] or ["a"] for _ in range(4)]
    rows = []
    for asset in ("one", "two"):
        for n in range(30):
            words = kinds[rng.randrange(4)] + rng.choice([[], ["own" + chr(97 + n % 26)], ["z"]])
            rows += [(asset, f"s{n:02d}", f"m{w} x", "info") for w in words]
    for k in (1, 3, 20):
        got = dependency.dependency_edges(make_events(rows), k=k).collect()
        assert sorted((r.asset_id, r.edge_rank, r.source_a, r.source_b, r.shared_signatures, r.co_occurrence_score,
                       r.example_signature) for r in got) == strongest(rows, k)


def test_thousands_of_sources_with_one_message_make_few_pairs(spark):
    # each has the hot message, half of them one of their own too
    events = spark.range(5000).selectExpr(
        "id AS seq", "'hot' AS asset_id", "concat('s', lpad(id, 4, '0')) AS source",
        "explode(if(id % 2 = 0, array('hot message'), array('hot message', concat('own ', translate(id, '0123456789', 'abcdefghij'))))) AS message",
        "'info' AS severity")
    sized = dependency._sized(dependency.asset_signatures(events))
    assert dependency._standing(sized, 20).count() == 42
    got = [(r.source_a, r.source_b) for r in dependency.dependency_edges(events).orderBy("edge_rank").collect()]
    assert got == [("s0000", f"s{n:04d}") for n in range(1, 21)]


def test_dependency_overview(make_events, ids):
    events = make_events([
        ("over-a", "linux", "cache miss hot", "warning"), ("over-a", "app", "cache miss hot", "warning"),
        ("over-b", "db", "replication lag high", "warning"), ("over-b", "app", "replication lag high", "warning"),
    ])
    got = dependency.dependency_overview(events, ids("over-a", "over-b"), max_edges=5).collect()
    assert [(r.asset_id, r.source_a, r.source_b) for r in got] == [("over-b", "app", "db"), ("over-a", "app", "linux")]


def test_incident_brief(make_events, ids):
    events = make_events([
        ("b", "linux", "panic in module abc", "critical"), ("b", "app", "panic in module abc", "critical"),
        ("b", "app", "timeout 503 downstream", "warning"),
    ])
    brief, quiet = incidents.incident_briefs(events, ids("b", "quiet")).orderBy("asset_id").collect()
    assert brief.confidence == 0.99 and len(brief.anomaly_reasons) == 3
    assert brief.dependency_hotspots == ["app <-> linux (1)"]
    assert quiet.headline == incidents.QUIET and quiet.confidence == 0.45
    assert quiet.runbook_actions == [rules.DEFAULT_HINT[2]]
    over = incidents.incident_overview(events, ids("b", "quiet"), min_confidence=0.5).collect()
    assert [r.asset_id for r in over] == ["b"]


def test_correlations_and_drill_down(make_events):
    events = make_events(
        [("c", "windows_eventlog", f"disk error EventID=153 block={i}", "warning") for i in range(3)]
        + [("c", "windows_eventlog", "EventID=4625", "warning"), ("c", "syslog", "disk", "info")]
    )
    hit = rules.correlations(events).collect()
    assert [(r.title, r.evidence_count, r.confidence) for r in hit] == [("Windows storage error cluster", 3, 0.81)]
    found = rules.correlation_events(events, "Windows storage error cluster").collect()
    assert [r.seq for r in found] == [3, 2, 1]
    assert rules.correlation_events(events).count() == 5


def test_own_rules(make_events):
    own = [rules.Correlation("It's db", "app", "db (down|slow)", 1, 0.5, "restart")]
    events = make_events([("c", "app", "DB down", "info"), ("c", "app", "fine", "info")])
    assert [(r.title, r.evidence_count) for r in rules.correlations(events, own).collect()] == [("It's db", 1)]


def test_runbook_hints(make_events, ids):
    one = make_events([("r", "windows_eventlog", "EventID=4625 failed login", "warning")])
    hints = incidents.asset_hints(one, ids("r", "none")).orderBy("asset_id", "hint_rank").collect()
    assert [(h.asset_id, h.title, h.confidence) for h in hints] == [
        ("none", "No critical patterns", 0.4), ("r", "rare_pattern: warning", 0.72)
    ]
    five = make_events([("r", "windows_eventlog", f"EventID=4625 failed login from host{i}", "warning") for i in range(5)])
    titles = [h.title for h in incidents.asset_hints(five, ids("r")).orderBy("hint_rank").collect()]
    assert "Burst of failed logons" in titles and "No critical patterns" not in titles


def test_alerts_and_recommendation(make_events, ids):
    events = make_events([
        ("s", "linux", "Thermal trip", "critical"), ("s", "linux", "io", "warning", "iowait", 30.0),
        ("s", "linux", "SMART error", "warning"),
    ])
    assert {(r.severity, r.reason) for r in rules.alerts(events).collect()} == {
        ("warning", "High iowait"), ("critical", "Thermal warning"), ("critical", "SMART degradation")
    }
    empty, full = rules.recommendations(events, ids("s", "e")).orderBy("asset_id").collect()
    assert (full.risk_score, full.risk_level, len(full.actions)) == (0.95, "high", 3)
    assert (empty.risk_score, empty.risk_level) == (0.05, "low")


def many_clusters(make_events):
    """40 clusters of two or more events, then a rare critical one that comes last by size, in one asset."""
    words = [a + b for a in "abcdefgh" for b in "vwxyz"]
    rows = [("big", "linux", f"routine {w} done", "info") for w in words for _ in range(2)]
    return make_events(rows + [("big", "linux", "kernel panic on the disk", "critical")])


def test_detectors_see_clusters_of_any_rank(make_events, ids):
    events = many_clusters(make_events)
    window = clusters.analysis_window(events)
    profile = anomalies.cluster_profile(window)
    assert profile.filter("critical_count > 0").first().cluster_rank == 41
    for found in (anomalies.rare_patterns(profile), anomalies.detect(window), anomalies.find_anomalies(window)):
        assert [(r.kind, r.severity) for r in found.collect()] == [("rare_pattern", "critical")]
    assert anomalies.rare_patterns(profile, max_clusters=30).count() == 0
    doc = insight.log_insight(events, ids("big")).first()
    assert (len(doc.clusters), len(doc.anomalies)) == (41, 1) and "Clusters: 41 (all)" in doc.summary
    late = make_events(
        [("b", "linux", f"m {a}{b}", "info") for a in "abcdefgh" for b in "vwxyz" for _ in range(50)]
        + [("b", "app", "spike", "info")] * 3)
    burst = anomalies.cluster_profile(clusters.analysis_window(late)).filter("cluster_rank = 41").selectExpr(
        "*", "0.5D AS now").drop("recent_rate").withColumnRenamed("now", "recent_rate")
    assert [r.kind for r in anomalies.burst_patterns(burst).collect()] == ["burst_pattern"]


def test_hints_and_briefs_see_clusters_of_any_rank(make_events, ids):
    events = many_clusters(make_events)
    hints = incidents.asset_hints(events, ids("big")).collect()
    assert [h.title for h in hints] == ["rare_pattern: critical"]
    brief = incidents.incident_briefs(events, ids("big")).first()
    assert brief.headline == anomalies.REASONS["rare_pattern"]
    cut = incidents.incident_briefs(events, ids("big"), brief_clusters=10, hint_clusters=15).first()
    assert (cut.headline, cut.anomaly_reasons) == (incidents.QUIET, [])
    mixed = incidents.incident_briefs(events, ids("big"), brief_clusters=10).first()
    assert mixed.headline == incidents.QUIET and "rare_pattern" in mixed.runbook_actions[0]


def test_overview_counts_all_findings(make_events, ids):
    def rows(asset, n):
        names = [f"{asset} {a}{b} failed" for a in "abcdefgh" for b in "vwxyz"][:n]
        return [(asset, "linux", name, "warning") for name in names] + [(asset, "linux", "panic here", "critical")]

    events = make_events(rows("fewer", 34) + rows("more", 39))
    ranked, totals = insight.analytics_overview(events, ids("fewer", "more"))
    assert [(r.asset_id, r.anomalies_total, r.warning, r.critical, r.top_severity) for r in ranked.collect()] == [
        ("more", 40, 39, 1, "critical"), ("fewer", 35, 34, 1, "critical")
    ]
    assert totals.first().total_anomalies == 75
    cut = insight.overview_totals(insight.asset_summaries(events, ids("fewer", "more"), max_anomalies=20)).first()
    assert cut.total_anomalies == 40


def _hot_rows(spark, n=30_000):
    """One hot asset; numbered rows, ten unnumbered ones far below, and a metric of repeated, signed and huge values."""
    return spark.range(-10, n, 1, 8).selectExpr(
        "if(id < 0, -4611686018427387904 + id, id * 3) AS seq", "if(id % 50 = 0, concat('a', id % 7), 'hot') AS asset_id",
        "'s' AS source", "concat('m', id % 5) AS message", "'cpu' AS metric",
        "CASE WHEN id % 1000 = 0 THEN 1e300 WHEN id % 3 = 0 THEN 7.25D ELSE (id * 7919 % 20011) / 13D - 300 END AS value",
        "'info' AS severity", "timestamp_seconds(1700000000 + id * 60) AS ts")


def test_cutoff_and_positions_agree_with_sorting(spark):
    rows = _hot_rows(spark)
    window = clusters.analysis_window(rows)
    plain = rows.selectExpr("asset_id", "seq", "row_number() OVER (PARTITION BY asset_id ORDER BY seq) AS p",
                            "count(*) OVER (PARTITION BY asset_id) AS t").selectExpr(
        "asset_id", "seq", "p", "t", "p > t - least(greatest(10, t div 3), t) AS r")
    want = {(r.asset_id, r.seq): (r.p, r.t, r.r) for r in plain.collect()}
    assert {(r.asset_id, r.seq): r.is_recent for r in window.collect()} == {k: v[2] for k, v in want.items()}
    numbered = clusters.split_recent(rows).collect()
    assert {(r.asset_id, r.seq): (r.pos, r.total, r.is_recent) for r in numbered} == want


def test_positions_never_bring_a_key_together(spark):
    rows = _hot_rows(spark).filter("asset_id = 'hot'")
    sizes = [r["count"] for r in rows.groupBy(F.floor(F.col("seq") / 4096)).count().collect()]
    assert max(sizes) <= 3 * sum(sizes) / len(sizes)


@pytest.mark.parametrize("extra", ["", "UNION ALL SELECT 'k', double('NaN'), 3L", "UNION ALL SELECT 'k', double('-Infinity'), 900L"])
def test_medians_agree_with_the_built_in(spark, extra):
    rows = spark.sql("SELECT 'k' AS g, value AS v, 1L AS n FROM {r} UNION ALL SELECT 'one', 4.5D, 1L UNION ALL "
                     "SELECT 'two', 1D, 1L UNION ALL SELECT 'two', 2D, 1L UNION ALL SELECT 'zero', 0D, 4L UNION ALL "
                     f"SELECT 'zero', -0.5D, 4L {extra}", r=_hot_rows(spark, 4000))
    got = {r.g: (r.samples, r["median"]) for r in medians(rows, ["g"], "v", "n").collect()}
    each = rows.selectExpr("g", "v", "explode(sequence(1L, n)) AS i")
    assert got == {r.g: (r.s, r.m) for r in each.groupBy("g").agg(F.count("*").alias("s"), F.median("v").alias("m")).collect()}


def test_detection_has_no_window_over_rows(spark):
    """Rows meet aggregates only: the window functions of detection read cells."""
    window = clusters.analysis_window(_hot_rows(spark))
    rows = window._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in rows and rows.count("Window [") == rows.count("Window [sum(n")
    found = anomalies.detect(window)._jdf.queryExecution().optimizedPlan().toString()
    assert "message" not in found.replace("example_message", "")
