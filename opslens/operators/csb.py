"""Warehouse log lines: parsing, ingest summary, chain report (A-21 ... A-24, K-01 ... K-05)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.functions.ranking import at_least_one
from opslens.functions.text import severity_from, strip

# fixed values: the line format and the fields inside a payload
LINE = (
    r"^(\d{2}\.\d{2}\.\d{4} \d{2}:\d{2}:\d{2}\.\d{3})\s+(\S+)\s+ID\s+(\d+)\s+"
    r"(Import|Query|Write)\s+(.+)$"
)
SSCC = r"\b\d{18}\b"
SCRIPT = r'SYS\+SKRIPT;\?:L1\+"([^"]+)"'
USER = r'SYS\+LOGIN;!:[^\n]*:L2\+([^+]+)\+\d+\+\d+\+"([^"]+)"\+"([^"]+)"'
ERROR = r'SYS\+ERRINFO;!:[^\n]*L1\+(\d+)\+\d+\+"([^"]+)"'
TIME_FORMAT = "dd.MM.yyyy HH:mm:ss.SSS"
SOURCE = "csb_merp_txt"
ERROR_WORDS = ("sys+errinfo", "error", "ошиб")


def parse_csb(lines: DataFrame, column: str = "value") -> DataFrame:
    """Keep the lines of the known format and add raw, ts, session, thread_id, kind, payload, command."""
    raw = lines.withColumn("raw", strip(F.col(column))).filter(F.col("raw").rlike(LINE))
    names = ("ts_text", "session", "thread_id", "kind", "payload")
    parsed = raw.withColumns({name: F.regexp_extract("raw", LINE, i + 1) for i, name in enumerate(names)})
    return parsed.withColumn("command", strip(F.split("payload", ";", 2)[0])).withColumn(
        "ts", F.try_to_timestamp("ts_text", F.lit(TIME_FORMAT))
    )


def _found(pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract("payload", pattern, group), F.lit(""))


def extract_csb_fields(parsed: DataFrame) -> DataFrame:
    """Add sscc (all 18-digit codes), script, user_id, user_name, error_code, error_message."""
    first, last = _found(USER, 2), _found(USER, 3)
    return parsed.withColumns({
        "sscc": F.regexp_extract_all("payload", F.lit(SSCC), F.lit(0)),
        "script": _found(SCRIPT, 1),
        "user_id": _found(USER, 1),
        "user_name": F.when(first.isNotNull(), F.concat(first, F.lit(" "), last)),
        "error_code": _found(ERROR, 1),
        "error_message": _found(ERROR, 2),
    })


def csb_to_events(parsed: DataFrame, source: str = SOURCE) -> DataFrame:
    """Parsed lines -> events; the stripped line is the message, the line's own time the event time."""
    extra = [c for c in ("seq",) if c in parsed.columns]
    return parsed.select(
        *extra, "asset_id", F.lit(source).alias("source"), F.col("raw").alias("message"),
        F.lit(None).cast("string").alias("metric"), F.lit(None).cast("double").alias("value"),
        severity_from("lower(payload)", warning=ERROR_WORDS).alias("severity"), "ts",
    )


def csb_ingest_summary(
    lines: DataFrame, accepted: DataFrame, files_found: DataFrame, column: str = "value"
) -> DataFrame:
    """One row: files found / processed, non-blank lines seen, lines parsed, events accepted.

    lines: the scanned lines with their `file`; accepted: the events left after de-duplication;
    files_found: every file that matched, before the cap on files.
    """
    text = strip(F.col(column))
    seen = lines.agg(
        F.countDistinct("file").alias("files_processed"),
        F.count_if(text != "").alias("lines_seen"),
        F.count_if(text.rlike(LINE)).alias("lines_parsed"),
    )
    found = files_found.agg(F.countDistinct("file").alias("files_found"))
    kept = accepted.agg(F.count("*").alias("events_accepted"))
    one = F.lit(1).alias("_one")
    return (
        found.select("*", one).join(seen.select("*", one), "_one").join(kept.select("*", one), "_one")
        .select("files_found", "files_processed", "lines_seen", "lines_parsed", "events_accepted")
    )


def csb_lines_of(events: DataFrame, asset_id: str, limit: int | None = None) -> DataFrame:
    """The warehouse lines among one asset's newest events (all for None): raw lines before parsing."""
    newest = events.filter(F.col("asset_id") == asset_id)
    if at_least_one(limit) is not None:
        newest = newest.orderBy(F.col("seq").desc()).limit(limit)
    return newest.filter(F.col("source") == SOURCE).select("seq", F.col("message").alias("value"))


def chain_filter(
    fields: DataFrame, *, sscc: str | None = None, script: str | None = None, user: str | None = None
) -> DataFrame:
    """Lines that touch the given SSCC, run exactly the script, mention the user (any case)."""
    out = fields
    if sscc:
        out = out.filter(F.array_contains("sscc", sscc))
    if script:
        out = out.filter(F.col("script") == script)
    if user:
        who = F.lower(F.concat_ws(" ", "user_id", "user_name"))
        wanted = F.lower(F.lit(user))
        out = out.filter(F.contains(F.lower("payload"), wanted) | F.contains(who, wanted))
    return out


def touched(fields: DataFrame) -> DataFrame:
    """(kind, value) rows: the distinct SSCC, scripts and users of a chain. Spread over the cluster."""
    items = F.concat(
        F.transform("sscc", lambda s: F.struct(F.lit("sscc").alias("kind"), s.alias("value"))),
        F.array(
            F.struct(F.lit("script").alias("kind"), F.col("script").alias("value")),
            F.struct(
                F.lit("user").alias("kind"),
                F.when(F.col("user_id").isNotNull(), F.concat_ws(" ", "user_id", "user_name")).alias("value"),
            ),
        ),
    )
    return (
        fields.select(F.explode(items).alias("i"))
        .select("i.kind", "i.value").filter(F.col("value").isNotNull()).distinct()
    )


def chain_errors(fields: DataFrame, k: int | None = None) -> DataFrame:
    """The first k errors in arrival order; all for None."""
    found = (
        fields.filter(F.col("error_code").isNotNull())
        .select("seq", "error_code", "error_message")
    )
    return found if k is None else found.orderBy("seq").limit(k)


def chain_tail(fields: DataFrame, k: int | None = None) -> DataFrame:
    """The last k lines of a chain, all for None; sort by seq for arrival order."""
    kept = fields if k is None else fields.orderBy(F.col("seq").desc()).limit(k)
    return (
        kept.select(
            "seq", F.col("ts_text").alias("timestamp"), "session", "thread_id", "kind", "command",
            "payload", "sscc", "script", "user_id", "user_name", "error_code", "error_message",
        )
    )


def csb_report(
    events: DataFrame,
    asset_id: str,
    *,
    sscc: str | None = None,
    script: str | None = None,
    user: str | None = None,
    limit: int | None = None,
    max_errors: int | None = 100,
    max_chain: int | None = 500,
) -> DataFrame:
    """One nested row: totals, filter echo, touched sets, errors, chain.

    Totals and touched sets cover all lines of the asset, or those among its newest `limit` events. Only the
    shown lists are shortened, to the first max_errors errors and the last max_chain lines (None: whole lists
    in the one row); the whole lists as tables are chain_errors and chain_tail.
    """
    lines = csb_lines_of(events, asset_id, limit)
    chain = chain_filter(
        extract_csb_fields(parse_csb(lines)), sscc=sscc, script=script, user=user
    )
    one = F.lit(1).alias("_one")
    sets = touched(chain).groupBy().agg(*[
        F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.col("value")))).alias(name)
        for kind, name in (("sscc", "sscc_touched"), ("script", "scripts_touched"), ("user", "users_touched"))
    ])
    errors = chain_errors(chain, max_errors).agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("seq", "error_code", "error_message"))),
            lambda e: F.struct(e["error_code"].alias("code"), e["error_message"].alias("message")),
        ).alias("errors")
    )
    tail = chain_tail(chain, max_chain).agg(F.sort_array(F.collect_list(F.struct("*"))).alias("chain"))
    totals = lines.agg(F.count("*").alias("total_lines"))
    matched = chain.agg(F.count("*").alias("matched_lines"))
    out = totals.select(one, "*")
    for part in (matched, sets, errors, tail):  # one row each
        out = out.join(part.select(one, "*"), "_one")
    echo = F.create_map(
        F.lit("sscc"), F.lit(sscc or ""), F.lit("script"), F.lit(script or ""), F.lit("user"), F.lit(user or "")
    )
    return out.select(
        F.lit(asset_id).alias("asset_id"), "total_lines", "matched_lines", echo.alias("filters"),
        "sscc_touched", "scripts_touched", "users_touched", "errors", "chain",
    )
