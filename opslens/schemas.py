"""Row types of every table the package reads or returns. Nothing is ever inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS = T.TimestampType()


def _struct(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(f[0], f[1], f[2] if len(f) > 2 else True) for f in fields])


# fixed values: names the tables use
SEVERITIES = ("info", "warning", "critical")
ASSET_TYPES = ("server", "storage_shelf", "network", "bmc")
COLLECTOR_TYPES = ("winrm", "ssh", "snmp", "ilo", "csb_merp_share")
MERGE_STRATEGIES = ("union", "intersection")
IMPACT_MODES = ("weighted", "critical_warning", "critical_only")
ROLES = ("viewer", "operator", "admin")
SECRET_MASK = "********"

EVENT = _struct(
    ("seq", _L, False), ("asset_id", _S, False), ("source", _S, False), ("message", _S, False),
    ("metric", _S), ("value", _D), ("severity", _S, False), ("ts", _TS, False),
)
EVENT_COLUMNS = [f.name for f in EVENT.fields]
# what a normaliser returns: an event that has no arrival number yet
BARE_EVENT_COLUMNS = [c for c in EVENT_COLUMNS if c != "seq"]

EVENT_BATCH = _struct(
    ("batch_id", _L),
    ("events", T.ArrayType(_struct(
        ("asset_id", _S), ("source", _S), ("message", _S), ("metric", _S), ("value", _D),
        ("severity", _S), ("timestamp", _S),
    ))),
)

ASSET = _struct(("id", _S, False), ("name", _S), ("asset_type", _S), ("location", _S))

TARGET = _struct(
    ("id", _S, False), ("name", _S), ("address", _S), ("collector_type", _S), ("port", _I),
    ("username", _S), ("password", _S), ("poll_interval_sec", _I), ("enabled", _B), ("asset_id", _S),
    ("winrm_transport", _S), ("winrm_use_https", _B), ("winrm_validate_tls", _B),
    ("winrm_event_logs", _S), ("winrm_batch_size", _I), ("ssh_metrics_command", _S),
    ("ssh_log_path", _S), ("ssh_tail_lines", _I), ("snmp_community", _S), ("snmp_version", _S),
    ("snmp_oids", _S), ("ilo_use_https", _B), ("ilo_validate_tls", _B), ("ilo_log_path", _S),
    ("ilo_event_limit", _I), ("csb_share_path", _S), ("csb_glob_pattern", _S),
    ("csb_recursive", _B), ("csb_max_files", _I), ("csb_source", _S),
)
# fixed values: defaults of the target columns that may be missing in older tables
TARGET_DEFAULTS = {
    "poll_interval_sec": 60, "enabled": True,
    "winrm_transport": "ntlm", "winrm_use_https": False, "winrm_validate_tls": False,
    "winrm_event_logs": "System,Application", "winrm_batch_size": 50,
    "ssh_metrics_command": "cat /proc/loadavg", "ssh_log_path": "/var/log/syslog",
    "ssh_tail_lines": 50, "snmp_community": "public", "snmp_version": "2c",
    "snmp_oids": "1.3.6.1.2.1.1.3.0,1.3.6.1.2.1.1.5.0", "ilo_use_https": True,
    "ilo_validate_tls": False, "ilo_log_path": "/rest/v1/Systems/1/LogServices/IML/Entries",
    "ilo_event_limit": 50, "csb_share_path": "", "csb_glob_pattern": "*.txt",
    "csb_recursive": True, "csb_max_files": 2000, "csb_source": "csb_merp_txt",
}

HISTORY = _struct(
    ("id", _L, False), ("ts", _TS), ("target_id", _S), ("collector_type", _S),
    ("accepted_events", _I), ("last_error", _S), ("failure_streak", _I), ("last_cursor", _S),
)
STATE = _struct(
    ("target_id", _S, False), ("last_success_ts", _TS), ("last_run_ts", _TS), ("last_error", _S),
    ("last_cursor", _S), ("failure_streak", _L),
)
POLICY = _struct(
    ("id", _S, False), ("name", _S), ("tenant_id", _S), ("ignore_sources", T.ArrayType(_S)),
    ("ignore_signatures", T.ArrayType(_S)), ("enabled", _B),
)
POLICY_FIELDS = ("name", "tenant_id", "enabled", "ignore_sources", "ignore_signatures")
POLICY_DETAILS = _struct(
    ("schema_version", _I), ("action", _S), ("changed_fields", T.ArrayType(_S)),
    ("before", POLICY), ("after", POLICY),
)
POLICY_AUDIT = _struct(
    ("id", _L, False), ("ts", _L), ("policy_id", _S), ("tenant_id", _S), ("action", _S),
    ("actor_role", _S), ("details", _S),
)
REQUEST = _struct(("id", _L, False), ("ts", _L), ("method", _S), ("path", _S), ("role", _S))
ACCESS_AUDIT = _struct(
    ("id", _L, False), ("ts", _L), ("path", _S), ("role", _S), ("action", _S), ("result", _S),
)
TOKEN_CLAIMS = _struct(("iss", _S), ("azp", _S), ("client_id", _S))
WINEVENT = _struct(
    ("RecordId", _S), ("Id", _S), ("LogName", _S), ("ProviderName", _S), ("LevelDisplayName", _S),
    ("TimeCreated", _S), ("Message", _S),
)
