"""H-05: the dashboard of a tenant as one document."""

import datetime as dt

from opslens.plans.dashboard import dashboard_documents

NOW = dt.datetime(2024, 1, 10)
EVENTS = "seq bigint, asset_id string, source string, message string, metric string, value double, severity string, ts timestamp"


def rows(spark):
    day = lambda n: dt.datetime(2024, 1, n, 12)
    events = [
        (1, "t0:a", "syslog", "m1", None, None, "info", day(8)), (2, "t0:a", "agentless_ssh", "thermal", None, None, "critical", day(9)),
        (3, "t0:b", "windows_eventlog", "m3", None, None, "warning", day(9)), (4, "t0:a", "syslog", "old", None, None, "critical", day(1)),
        (5, "t0:ghost", "syslog", "m5", None, None, "warning", day(9)), (6, "lone", "app", "m6", "iowait", 99.0, "info", day(9)),
    ]
    assets = [("t0:a", "A", "server", None), ("t0:b", "B", "bmc", "R1"), ("lone", "L", "server", "R2"), ("t9:quiet", "Q", "server", "R3")]
    return (spark.createDataFrame(assets, "id string, name string, asset_type string, location string"),
            spark.createDataFrame(events, EVENTS))


def test_documents_of_all_tenants(spark):
    assets, events = rows(spark)
    got = {r.tenant: r for r in dashboard_documents(assets, events, now=NOW, period_days=5).collect()}
    assert set(got) == {"t0", "", "t9"}
    t0 = got["t0"]
    assert tuple(t0.overview) == (4, 5, 1, 4)  # the unregistered asset is in no total, but in what is shown
    assert tuple(t0.sources) == (1, 2, 1, 25, 50, 25)
    assert (t0.trend.labels, t0.trend["values"]) == (["2024-01-08", "2024-01-09"], [1, 3])
    assert [tuple(x) for x in t0.top_assets] == [("t0:a", 2), ("t0:b", 1)]
    assert [x.message for x in t0.recent_alerts] == ["m5", "m3", "thermal"]
    assert [tuple(x) for x in t0.assets_table] == [("t0:a", "server", "-", 2, 1, 0), ("t0:b", "bmc", "R1", 1, 0, 0)]
    assert t0.filter_options.sources == ["agentless_ssh", "syslog", "windows_eventlog"]
    assert t0.role == "viewer" and not t0.permissions.show_recent_alerts and t0.permissions.show_filters
    assert [tuple(x) for x in got[""].assets_table] == [("lone", "server", "R2", 1, 1, 0)]
    quiet = got["t9"]
    assert quiet.trend.labels == quiet.recent_alerts == quiet.top_assets == [] and quiet.overview.events_filtered == 0


def test_filters_and_a_bounded_table(spark):
    assets, events = rows(spark)
    one = dashboard_documents(assets, events, now=NOW, asset_id="t0:a", source="syslog", role="admin").filter("tenant = 't0'").first()
    assert one.overview.events_filtered == 2 and [x.id for x in one.assets_table] == ["t0:a"] and one.permissions.show_worker_health
    short = dashboard_documents(assets, events, now=NOW, table_rows=1).filter("tenant = 't0'").first()
    assert [x.id for x in short.assets_table] == ["t0:a"] and len(short.filter_options.assets) == 1


def test_no_events(spark):
    assets, events = rows(spark)
    got = dashboard_documents(assets, events.filter("false"), now=NOW).collect()
    assert len(got) == 3 and all(r.overview.events_total == 0 and r.filter_options.sources == [] for r in got)
