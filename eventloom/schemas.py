"""Declared schemas of the source records; nothing is inferred."""

from __future__ import annotations

# The source's own field names; the dots are part of the names.
ZEEK_HTTP = """
    ts DOUBLE, uid STRING,
    `id.orig_h` STRING, `id.orig_p` BIGINT, `id.resp_h` STRING, `id.resp_p` BIGINT,
    method STRING, host STRING, uri STRING, referrer STRING, user_agent STRING,
    request_body_len BIGINT, response_body_len BIGINT, status_code BIGINT,
    orig_mime_types VARIANT, cookie_vars VARIANT
"""

ZEEK_CONN = """
    ts DOUBLE, uid STRING,
    `id.orig_h` STRING, `id.orig_p` BIGINT, `id.resp_h` STRING, `id.resp_p` BIGINT,
    proto STRING, service STRING,
    orig_bytes BIGINT, resp_bytes BIGINT, orig_pkts BIGINT, resp_pkts BIGINT
"""

# Titles of a process listing that have a use; every value is text.
PROCESS_TITLES = (
    "USER",
    "PID",
    "PPID",
    "PGID",
    "SESS",
    "JOBC",
    "STAT",
    "TT",
    "TIME",
    "ELAPSED",
    "LOGNAME",
    "%CPU",
    "%MEM",
    "COMMAND",
)

PROCESS_TABLE = "Titles ARRAY<STRING>, Processes ARRAY<ARRAY<STRING>>"

# Column with the names of the keys that were null in the record itself, set by
# readers in exact mode.
NULL_KEYS = "_null_keys"
CORRUPT = "_corrupt_record"


def quoted(name: str) -> str:
    """A column name as SQL text; dots and signs in it stay literal."""
    return "`" + name.replace("`", "``") + "`"
