"""Host, path and query of a URL, normalised, in native expressions.

Each step adds helper columns that the next one reads, so Spark evaluates an
intermediate text once per row and drops the steps nothing asks for. Rows in the
usual shape (a path without dot segments, made of plain characters) never reach
the costly branches.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.schemas import quoted

# The grammar of RFC 3986.
SCHEME_OR_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+\-]*:|/)"
HIERARCHY = r"(?s)^(?:([a-zA-Z][a-zA-Z0-9+.\-]*):)?(?://([^\\/]*))?(.*)$"
REGISTERED_NAME = r"(?:[^\[\]%:/?#]++|%[a-fA-F0-9]{2})*+"
PORT = r"0*?(|0|[1-9][0-9]{0,4})"
PATH_CHARACTERS = "A-Za-z0-9._~!$&'()*+,;=:@/\\-"
QUERY_CHARACTERS = PATH_CHARACTERS + "?"

DOT_SEGMENT = r"(?:^|/)\.\.?(?:/|\z)"

# Allowed characters that url_encode() escapes all the same.
OVER_ENCODED = "~!$&'()+,;=:@/?"

MAX_PORT = 65535


def _ipv6_literal() -> str:
    """Bracketed IPv6 address with an optional zone, from the rule of RFC 3986."""
    group = "[0-9A-Fa-f]{1,4}"
    dotted = r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}"
    last_two = f"(?:{group}:{group}|{dotted})"
    forms = [f"(?:{group}:){{6}}{last_two}"]
    # "::" may stand for the groups that are missing; `after` counts the single
    # groups between it and the tail.
    tails = [f"(?:{group}:){{{after}}}{last_two}" for after in range(5, -1, -1)]
    for most, tail in enumerate([*tails, group, ""]):
        before = f"(?:(?:{group}:){{0,{most - 1}}}{group})?" if most else ""
        forms.append(f"{before}::{tail}")
    zone = r"(?:%25|%)(?:[A-Za-z0-9._~\-]|%[a-fA-F0-9]{2})+"
    return rf"\[(?:{'|'.join(forms)})(?:{zone})?\]"


HOST_AND_PORT = f"(?ds)^({REGISTERED_NAME}|{_ipv6_literal()})(?::{PORT})?$"


# The steps below are SQL text over a lambda variable ``t``: long chains are built
# and parsed much faster that way than call by call.

_NONE = "CAST(array() AS array<string>)"


def _without_dot_segments() -> str:
    """Resolve ``.`` and ``..`` segments of a path; a rooted path keeps its leading
    slash, and a trailing dot segment leaves a trailing slash."""
    return rf"""CASE WHEN t RLIKE r'{DOT_SEGMENT}' THEN aggregate(
        split(t, '/'), {_NONE},
        (seen, part) -> CASE WHEN part = '.' THEN seen
            WHEN part = '..' THEN slice(seen, 1, greatest(size(seen) - 1, 0))
            ELSE array_append(seen, part) END,
        seen -> array_join(concat(
            CASE WHEN startswith(t, '/') AND coalesce(try_element_at(seen, 1), 'x') <> ''
                THEN array('') ELSE {_NONE} END,
            seen,
            CASE WHEN t RLIKE r'/\.\.?\z' THEN array('') ELSE {_NONE} END), '/'))
        ELSE t END"""


def _upper_case_triplets() -> str:
    """Upper-case the hex digits of every ``%xx``."""
    changed = "t"
    for digit in "abcdef":
        after = f"(?<=%){digit}(?=[0-9a-fA-F])|(?<=%[0-9a-fA-F]){digit}"
        changed = f"regexp_replace({changed}, '{after}', '{digit.upper()}')"
    return f"CASE WHEN t RLIKE '%(?:[a-f][0-9a-fA-F]|[0-9A-F][a-f])' THEN {changed} ELSE t END"


def _percent_encoded(allowed: str) -> str:
    """Percent-encode what is not allowed, in text with upper-case triplets."""
    encoded = "replace(url_encode(t), '+', '%20')"
    for ch in OVER_ENCODED:
        if ch != "?" or "?" in allowed:
            encoded = f"replace({encoded}, '%{ord(ch):02X}', chr({ord(ch)}))"
    # A stray "%" leaves every "%" escaped.
    kept = "CASE WHEN t RLIKE '%(?![0-9A-F]{2})' THEN '%25' ELSE '%' END"
    return f"replace({encoded}, '%25', {kept})"


def _normal_literal() -> str:
    """Lower-case an address in brackets; of a zone only the separator is unified."""
    zone = r"^(\[[^%]*)%(?:25(?=.))?([^\]]+)\]$"
    # "%25" alone before the bracket is a separator plus the zone "25".
    return f"""CASE WHEN NOT contains(t, '%') THEN lower(t)
        WHEN endswith(t, '%25]') THEN concat(lower(substring_index(t, '%', 1)), '%25]')
        ELSE concat(lower(regexp_extract(t, r'{zone}', 1)), '%',
            transform(array(regexp_extract(t, r'{zone}', 2)), t -> {_upper_case_triplets()})[0],
            ']') END"""


def _plain(text: Column, allowed: str) -> Column:
    return text.rlike(rf"^[{allowed}]*\z")


def _rarely(column: str, *steps: str) -> Column:
    """Apply SQL steps in turn, for branches few rows take.

    Inside a lambda a step is evaluated as it stands and adds nothing to the
    generated code, which has to stay small for the many rows that pass by.
    """
    value = f"array({quoted(column)})"
    for step in steps:
        value = f"transform({value}, t -> {step})"
    return F.expr(f"{value}[0]")


def with_url_parts(
    df: DataFrame,
    source: Column | str,
    prefix: str,
    parts: Iterable[str] = ("host", "path", "query"),
) -> DataFrame:
    """Add ``<prefix>_host``, ``_path``, ``_query`` (those asked for) and ``_ok`` for
    a URL column.

    A text without scheme or leading slash is read as host and path. Hosts are
    lower-cased, dot segments resolved and illegal characters percent-encoded
    when the scheme is absent, ``http`` or ``https``. A URL that cannot be parsed
    (bad port, broken host, a host that is not ASCII) has null parts and
    ``_ok`` false; a null or empty URL has null parts.
    """
    text = F.col(source) if isinstance(source, str) else source

    def name(part: str) -> str:
        return f"__{prefix}_{part}"

    def got(part: str) -> Column:
        return F.col(name(part))

    web = text.startswith("http://") | text.startswith("https://")
    full = F.when(text.startswith("/") | web | text.rlike(SCHEME_OR_PATH), text).otherwise(
        F.concat(F.lit("//"), text)
    )
    df = df.withColumn(name("full"), F.when(text != "", full))
    df = df.withColumn(name("plain"), F.substring_index(got("full"), "#", 1))
    df = df.withColumn(name("head"), F.substring_index(got("plain"), "?", 1))

    # The two usual shapes, a path alone and an http URL, need no pattern.
    head = got("head")
    rooted = head.startswith("/") & ~head.startswith("//")
    web = (head.startswith("http://") | head.startswith("https://")) & ~head.contains("\\")
    after = F.substr(head, F.instr(head, "//") + 2)
    df = df.withColumns(
        {
            name("scheme"): F.when(rooted, "")
            .when(web, F.substring_index(head, ":", 1))
            .otherwise(F.lower(F.regexp_extract(head, HIERARCHY, 1))),
            name("authority"): F.when(rooted, "")
            .when(web, F.substring_index(after, "/", 1))
            .otherwise(F.regexp_extract(head, HIERARCHY, 2)),
            name("path"): F.when(rooted, head)
            .when(web, F.substr(after, F.length(F.substring_index(after, "/", 1)) + 1))
            .otherwise(F.regexp_extract(head, HIERARCHY, 3)),
            name("query"): F.when(
                F.instr(got("plain"), "?") > 0,
                F.substr(got("plain"), F.length(head) + 2),
            ),
            name("fragment"): F.instr(got("full"), "#") > 0,
        }
    )

    df = df.withColumns(
        {
            name("normal"): got("scheme").isin("", "http", "https"),
            name("site"): F.substring_index(got("authority"), "@", -1),
            name("simple"): got("authority").rlike(r"^[A-Za-z0-9._~\-]*\z"),
        }
    )
    site = got("site")
    df = df.withColumns(
        {
            name("raw"): F.when(got("authority") == "", F.lit(None).cast("string"))
            .when(got("simple"), site)
            .otherwise(F.regexp_extract(site, HOST_AND_PORT, 1)),
            name("port"): F.when(~got("simple"), F.regexp_extract(site, HOST_AND_PORT, 2)),
        }
    )
    port_fits = F.coalesce(got("port").try_cast("int"), F.lit(0)) <= MAX_PORT
    ascii_host = ~got("normal") | got("raw").rlike(r"^[\x00-\x7f]*\z")
    df = df.withColumn(
        f"{prefix}_ok",
        F.when(got("full").isNull(), text == "").otherwise(
            got("simple") | (site.rlike(HOST_AND_PORT) & port_fits & ascii_host)
        ),
    )
    ok = F.col(f"{prefix}_ok")

    # The costly steps, for the rows that need them, in a step of their own.
    path, query, raw = got("path"), got("query"), got("raw")
    dotted = (path.contains("/.") | path.startswith(".")) & path.rlike(DOT_SEGMENT)
    untidy = dotted | ~_plain(path, PATH_CHARACTERS)
    upper = _upper_case_triplets()
    clean_path = _rarely(
        name("path"), _without_dot_segments(), upper, _percent_encoded(PATH_CHARACTERS)
    )
    clean_query = _rarely(name("query"), upper, _percent_encoded(QUERY_CHARACTERS))
    steps = {
        "path": {name("clean"): F.when(got("normal") & untidy, clean_path).otherwise(path)},
        "query": {
            name("tidy"): F.when(
                got("normal") & ~_plain(query, QUERY_CHARACTERS), clean_query
            ).otherwise(query)
        },
        "host": {
            name("name"): F.when(
                got("normal") & raw.startswith("["), _rarely(name("raw"), _normal_literal())
            )
            .when(got("normal"), F.lower(raw))
            .otherwise(raw)
        },
    }
    clean = got("clean")
    empty = F.when(query.isNotNull() | got("fragment"), "")
    rooted_path = (
        F.when(clean == "", empty)
        .when(clean.startswith("/"), clean)
        .otherwise(F.concat(F.lit("/"), clean))
    )
    results = {"host": got("name"), "path": rooted_path, "query": got("tidy")}
    parts = list(parts)
    df = df.withColumns({k: v for part in parts for k, v in steps[part].items()})
    df = df.withColumns({f"{prefix}_{part}": F.when(ok, results[part]) for part in parts})
    return df.drop(*(c for c in df.columns if c.startswith(f"__{prefix}_")))
