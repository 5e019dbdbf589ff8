"""Raw rows of the collectors -> events without arrival number (A-08 ... A-16, A-19).

Each normaliser is a projection (plus an explode where one raw row holds several entries): no
shuffle, no Python. `collected_ts` is the time the raw row was fetched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from opslens import schemas as S
from opslens.functions.merging import union_all
from opslens.functions.ranking import at_least_one, top_n_per_key
from opslens.functions.text import severity_from, strip

HOST_LOG_TAIL = 20
DISK_WARNING_PCT = 85
LOAD_METRICS = ("load1", "load5", "load15")
# fixed values: keys under which a device payload may keep its entry list, in order of preference
LIST_KEYS = ("Members", "Items", "items", "value", "members")
LINK_KEYS = ("links", "link", "Links")
LINK_MEMBER_KEYS = ("Member", "Members", "member", "members")


def _event(asset_id, source, message, severity, ts, metric=None, value=None) -> list[Column]:
    return [
        asset_id.alias("asset_id"),
        source.alias("source"),
        message.alias("message"),
        (F.lit(None) if metric is None else metric).cast("string").alias("metric"),
        (F.lit(None) if value is None else value).cast("double").alias("value"),
        severity.alias("severity"),
        ts.cast("timestamp").alias("ts"),
    ]


def event_time(mode: str, device: Column, collected: Column) -> Column:
    """'device': the time the device reports, else the collection time; 'collected': always the latter."""
    if mode not in ("device", "collected"):
        raise ValueError("event_time must be 'device' or 'collected'")
    return F.coalesce(device, collected) if mode == "device" else collected


def normalize_host_log(lines: DataFrame, *, source: str = "logfile", tail: int | None = HOST_LOG_TAIL) -> DataFrame:
    """(asset_id, file, line_no, value, collected_ts) -> events; the last `tail` lines per file and poll."""
    if tail is not None:
        lines = top_n_per_key(lines, ["asset_id", "file", "collected_ts"], [F.col("line_no").desc()], tail)
    severity = severity_from("lower(value)", warning=("error", "failed"), critical=("panic", "critical"))
    return lines.select(
        *_event(
            F.col("asset_id"), F.lit(source), F.col("value"),
            severity, F.col("collected_ts"),
        )
    )


def normalize_host_metrics(samples: DataFrame) -> DataFrame:
    """(asset_id, load1, disk_used, disk_total, collected_ts) -> two metric events per sample."""
    used = F.round(F.col("disk_used") / F.col("disk_total") * 100, 2)
    warn = F.when(used >= DISK_WARNING_PCT, F.lit("warning")).otherwise(F.lit("info"))

    def entry(message, metric, value, severity):
        return F.struct(
            F.lit(message).alias("message"), F.lit(metric).alias("metric"),
            value.cast("double").alias("value"), severity.alias("severity"),
        )

    both = F.array(
        entry("host load sample", "load1", F.col("load1"), F.lit("info")),
        entry("root fs usage", "disk_used_pct", used, warn),
    )
    return samples.select("asset_id", "collected_ts", F.explode(both).alias("e")).select(
        *_event(
            F.col("asset_id"), F.lit("agent"), F.col("e.message"), F.col("e.severity"),
            F.col("collected_ts"), F.col("e.metric"), F.col("e.value"),
        )
    )


def parse_winevents(raw: DataFrame) -> DataFrame:
    """Expand the JSON text in `record` to columns; `record_id` is the numeric cursor."""
    fields = F.from_json("record", S.WINEVENT)
    return (
        raw.withColumn("r", fields)
        .select("*", "r.*")
        .drop("r", "record")
        .withColumn("record_id", F.col("RecordId").try_cast("bigint"))
    )


def normalize_winevent(records: DataFrame, *, with_record_id: bool = True, mode: str = "device") -> DataFrame:
    """Windows event records -> events. with_record_id=False is the agent's shorter message form."""
    level = "lower(coalesce(LevelDisplayName, ''))"

    def part(name):
        return F.coalesce(F.col(name), F.lit("Unknown"))

    text = F.when(F.length("Message") > 0, F.col("Message")).otherwise(F.lit("(no message)"))
    pieces = [F.lit("["), part("LogName"), F.lit("] EventID="), part("Id")]
    if with_record_id:
        pieces += [F.lit(" RecordId="), part("RecordId")]
    pieces += [F.lit(" Provider="), part("ProviderName"), F.lit(" :: "), text]
    device = F.try_to_timestamp(strip(F.col("TimeCreated")))
    return records.select(
        *_event(
            F.col("asset_id"), F.lit("windows_eventlog"), F.concat(*pieces),
            severity_from(level, warning=("warning", "error"), critical=("critical",)),
            event_time(mode, device, F.col("collected_ts").cast("timestamp")),
        )
    )


def numeric_cursor(text: Column) -> Column:
    """Cursor text as a number; anything but digits counts as 0."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def advance_cursor(records: DataFrame, state: DataFrame, batch: int = 50) -> tuple[DataFrame, DataFrame]:
    """Rows behind each target's cursor, the first `batch` by record id, and the moved cursors.

    records: target_id, record_id, ...; state: target_id, last_cursor. Returns (rows, new state). Record
    ids may repeat, as logs of a target count on their own: all rows of the last id come with the batch.
    """
    if batch < 1:
        raise ValueError("batch must be at least 1")
    cursors = state.select("target_id", numeric_cursor(F.col("last_cursor")).alias("_cursor"))
    fresh = records.join(cursors, "target_id", "left").filter(
        F.col("record_id") > F.coalesce("_cursor", F.lit(0))
    ).drop("_cursor")
    first = top_n_per_key(fresh.select("target_id", "record_id"), ["target_id"], [F.col("record_id").asc()], batch)
    moved = first.groupBy("target_id").agg(F.max("record_id").alias("_top"))
    rows = fresh.join(moved, "target_id").filter(F.col("record_id") <= F.col("_top")).drop("_top")
    new_state = cursors.join(moved, "target_id", "full").select(
        "target_id",
        F.greatest(F.coalesce("_cursor", F.lit(0)), F.coalesce("_top", F.lit(0)))
        .cast("string").alias("last_cursor"),
    )
    return rows, new_state


def normalize_ssh(raw: DataFrame) -> DataFrame:
    """(asset_id, metrics_raw, log_raw, collected_ts) -> load metrics and log events."""
    # columns of their own: the generator below would evaluate them anew wherever it names them
    raw = raw.withColumn("_first", F.split(strip(F.col("metrics_raw")), r"\r\n|\r|\n")[0])
    raw = raw.withColumn("_parts", F.split(strip(F.col("_first")), r"(?U)\s+"))
    first, parts = F.col("_first"), F.col("_parts")

    def entry(source, message, metric=None, value=None):
        return F.struct(
            F.lit(source).alias("source"), message.alias("message"),
            (F.lit(metric) if metric else F.lit(None)).cast("string").alias("metric"),
            (F.lit(None) if value is None else value).cast("double").alias("value"),
        )

    loads = F.array(*[
        F.when(
            F.get(parts, F.lit(i)).try_cast("double").isNotNull(),
            entry(
                "ssh_metrics", F.concat(F.lit(f"SSH metric {name}="), F.get(parts, F.lit(i))),
                name, F.get(parts, F.lit(i)).try_cast("double"),
            ),
        )
        for i, name in enumerate(LOAD_METRICS)
    ])
    short = F.array(entry("ssh_log", F.concat(F.lit("[ssh metrics] "), first)))
    metrics = (
        F.when(F.coalesce(first, F.lit("")) == "", F.array().cast(
            "array<struct<source:string,message:string,metric:string,value:double>>"))
        .when(F.size(parts) >= 3, F.array_compact(loads))
        .otherwise(short)
    )
    lines = F.filter(
        F.transform(F.split(F.coalesce(F.col("log_raw"), F.lit("")), r"\r\n|\r|\n"), strip),
        lambda line: line != "",
    )
    logs = F.transform(lines, lambda line: entry("ssh_log", F.concat(F.lit("[ssh log] "), line)))
    return raw.select("asset_id", "collected_ts", F.explode(F.concat(metrics, logs)).alias("e")).select(
        *_event(
            F.col("asset_id"), F.col("e.source"), F.col("e.message"), F.lit("info"),
            F.col("collected_ts"), F.col("e.metric"), F.col("e.value"),
        )
    )


def normalize_snmp(raw: DataFrame) -> DataFrame:
    """(asset_id, oid, value, collected_ts) -> metric events; text values become null."""
    metric = F.concat(F.lit("snmp_"), F.replace(F.col("oid"), F.lit("."), F.lit("_")))
    message = F.concat(
        F.lit("SNMP "), F.col("oid"), F.lit("="),
        F.coalesce(F.col("value").try_cast("double").cast("string"), F.lit("None")),
    )
    return raw.select(
        *_event(
            F.col("asset_id"), F.lit("snmp_metric"), message, F.lit("info"),
            F.col("collected_ts"), metric, F.col("value").try_cast("double"),
        )
    )


MAP = "'map<string,string>'"


def _first_text(*names: str) -> str:
    """SQL: first non-empty value among the keys of an entry."""
    return "coalesce(" + ", ".join(f"nullif(entry['{n}'], '')" for n in names) + ")"


def redfish_entries(payloads: DataFrame, *, limit: int | None = None) -> DataFrame:
    """Device payloads (JSON text in `payload`) -> one row per log entry, its keys in the map `entry`.

    `is_link` marks entries of a payload that holds nothing but links to its entries; all of
    those are followed, or the first `limit`. Members that are no objects are dropped. A payload is parsed once, to a VARIANT.
    """
    followed = "true" if at_least_one(limit) is None else f"entry_no < {limit}"
    paths = [*LIST_KEYS, *[f"{link}.{member}" for link in LINK_KEYS for member in LINK_MEMBER_KEYS]]
    lists = ", ".join(f"try_variant_get(doc, '$.{path}', 'array<variant>')" for path in paths)
    alone = " OR ".join(f"variant_get(doc, '$.{name}', 'variant') IS NOT NULL" for name in ("Message", "Severity", "Name"))
    bare = "coalesce(map_contains_key(m, '@odata.id') AND NOT map_contains_key(m, 'Message'), false)"
    wide = (
        payloads.withColumn("doc", F.expr("try_parse_json(payload)"))
        .withColumn("members", F.expr(f"coalesce({lists})"))
        .withColumn("entries", F.expr(
            f"CASE WHEN size(members) > 0 THEN transform(members, e -> try_variant_get(e, '$', {MAP})) "
            f"WHEN {alone} THEN array(try_variant_get(doc, '$', {MAP})) END"
        ))
        .withColumn("is_link", F.expr(f"forall(entries, m -> {bare})"))
    )
    kept = [c for c in payloads.columns if c != "payload"]
    return wide.select(*kept, "is_link", F.posexplode("entries").alias("entry_no", "entry")).filter(
        "entry IS NOT NULL"
    ).withColumn("link", F.expr(f"CASE WHEN is_link AND {followed} THEN trim(entry['@odata.id']) END"))


def hydrate_links(entries: DataFrame, docs: DataFrame) -> DataFrame:
    """Replace link-only entries by the landed documents (odata_id, body JSON text).

    Links without a document are dropped, unless no link of the payload (payload_id) has one.
    """
    # links begin alike: sorted by their hash first, few are compared to the end
    place, hashed = F.monotonically_increasing_id(), F.xxhash64("link").alias("_hash")
    landed = docs.filter(F.col("odata_id").startswith("/")).select(F.col("odata_id").alias("link"), "body", place.alias("_place"))
    # of a document that landed twice the later one counts
    bodies = landed.groupBy(hashed, "link").agg(F.max_by("body", "_place").alias("_body"))
    bodies = bodies.withColumn("_doc", F.expr(f"from_json(_body, {MAP})")).filter(F.col("_doc").isNotNull()).drop("_body")
    joined = entries.withColumn("_hash", F.xxhash64("link")).join(bodies, ["_hash", "link"], "left").withColumns(
        {"_found": F.col("_doc").isNotNull(), "entry": F.coalesce("_doc", "entry")}).drop("_doc", "_hash")
    # a payload came as one row; rows without a payload_id are payloads of their own, and are spread by their links
    lone = F.when(F.col("payload_id").isNull(), F.xxhash64("link"))
    some = F.max("_found").over(W.partitionBy("payload_id", lone)) & F.col("payload_id").isNotNull()
    return (
        joined.withColumn("_any", some)
        .filter(~F.col("is_link") | F.col("_found") | ~F.col("_any"))
        .drop("_found", "_any", "link")
    )


ENTRY_ID = "coalesce(" + ", ".join(
    f"try_cast(rtrim('.', trim(entry['{name}'])) AS bigint)" for name in ("Id", "Number", "RecordId", "EntryId")
) + ")"
CREATED = _first_text("Created", "CreatedTime", "created")


def redfish_cursor(entries: DataFrame, state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries behind each target's cursor and the moved cursors.

    state: target_id, cursor_id BIGINT, cursor_created TIMESTAMP. Entries with a number are
    compared by number; entries without one pass unless a time cursor already covers them. The
    time cursor moves only for targets that never showed a number.
    """
    with_id = entries.withColumns(
        {"entry_id": F.expr(ENTRY_ID), "created": F.expr(f"try_to_timestamp({CREATED})")}
    )
    cursors = state.select(
        "target_id", F.coalesce("cursor_id", F.lit(0)).alias("cursor_id"), "cursor_created"
    )
    joined = with_id.join(cursors, "target_id", "left")
    numbered = F.col("entry_id") > F.coalesce("cursor_id", F.lit(0))
    timed = F.col("entry_id").isNull() & (
        F.col("cursor_created").isNull() | F.col("created").isNull() | (F.col("created") > F.col("cursor_created"))
    )
    rows = joined.filter(F.coalesce(numbered, F.lit(False)) | timed).drop("cursor_id", "cursor_created")
    seen = with_id.groupBy("target_id").agg(
        F.max("entry_id").alias("_id"), F.max("created").alias("_created")
    )
    top = F.greatest(F.coalesce("cursor_id", F.lit(0)), F.coalesce("_id", F.lit(0)))
    new_state = cursors.join(seen, "target_id", "full").select(
        "target_id", top.alias("cursor_id"),
        F.when(top == 0, F.greatest("cursor_created", "_created")).alias("cursor_created"),
    )
    return rows, new_state


def normalize_redfish(entries: DataFrame, *, mode: str = "collected") -> DataFrame:
    """Redfish / IML log entries -> events."""
    oem = "get_json_object(entry['Oem'], '$.Severity')"
    level = f"lower(coalesce({_first_text('Severity', 'severity')}, {oem}, ''))"
    shown = "coalesce(entry['Severity'], entry['severity'], 'Unknown')"
    number = f"coalesce({_first_text('Id', 'Number', 'RecordId', 'EntryCode')}, 'unknown')"
    body = f"coalesce({_first_text('Message', 'Name', 'Description', 'MessageId')}, 'iLO log entry')"
    message = F.expr(
        f"concat('[iLO] Entry=', {number}, ' Created=', coalesce({CREATED}, ''), "
        f"' Severity=', {shown}, ' :: ', {body})"
    )
    device = F.expr(f"try_to_timestamp({CREATED})")
    return entries.select(
        *_event(
            F.col("asset_id"), F.lit("ilo_iml"), message,
            severity_from(level, warning=("warn", "caution"), critical=("crit", "fatal")),
            event_time(mode, device, F.col("collected_ts").cast("timestamp")),
        )
    )


def normalize_all(
    *,
    winrm: DataFrame | None = None,
    ssh: DataFrame | None = None,
    snmp: DataFrame | None = None,
    ilo: DataFrame | None = None,
    csb_merp_share: DataFrame | None = None,
) -> DataFrame:
    """Send the raw rows of each collector type to its normaliser and merge the events.

    Raw shapes: winrm = parsed records, ssh / snmp = raw rows, ilo = entries, csb_merp_share =
    text lines (asset_id, value).
    """
    from opslens.operators.csb import csb_to_events, parse_csb

    makers = (
        (winrm, normalize_winevent), (ssh, normalize_ssh), (snmp, normalize_snmp),
        (ilo, normalize_redfish), (csb_merp_share, lambda raw: csb_to_events(parse_csb(raw))),
    )
    parts = [make(raw).select(*S.BARE_EVENT_COLUMNS) for raw, make in makers if raw is not None]
    if not parts:
        raise ValueError("no raw table given")
    return union_all(*parts)
