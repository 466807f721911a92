"""Scalar functions and name-derived columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import (
    cef_escape_extension,
    cef_escape_header,
    cef_line,
    epoch_millis,
    http_activity_id,
    integer_convertible,
    option_map,
    to_integer,
    with_command,
    with_shell_words,
    with_url_parts,
)
from eventloom.operators import naming
from eventloom.plans import adapters
from eventloom.plans.adapters import CONN_CTE, HTTP_CTE, PROC_CTE
from eventloom.plans.conversions import (
    ACTIVITY,
    COMMAND_CTE,
    DIRECTORY,
    FILENAME,
    URL_HOST,
    URL_PATH,
    URL_QUERY,
)
from eventloom.plans.registry import query


@query(
    "x01_cef_escape_header",
    r"""SELECT doc_id, replace(replace(text, '\', '\\'), '|', '\|') AS escaped FROM documents""",
)
def escape_header(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents")
    return documents.select("doc_id", cef_escape_header(F.col("text")).alias("escaped"))


@query(
    "x02_cef_escape_extension",
    r"""SELECT page_id, replace(replace(html, '\', '\\'), '=', '\=') AS escaped,
        replace(replace(replace(html, '\', '\\'), '=', '\='), chr(10), '\n') AS one_line FROM pages""",
)
def escape_extension(spark, sf_dir):
    html = F.col("html")
    return adapters.table(spark, sf_dir, "pages").select(
        "page_id",
        cef_escape_extension(html).alias("escaped"),
        cef_escape_extension(html, escape_newlines=True).alias("one_line"),
    )


@query(
    "x03_cef_line",
    r"""SELECT p_partkey, concat('CEF:0|', replace(p_brand, '|', '\|'), '|a\\b|1.0|', p_type, '|', p_name, '|5|',
        concat_ws(' ', 'size=' || p_size, 'odd=' || CASE WHEN p_partkey % 2 = 1 THEN 'k\=v' END, 'none=')) AS line
        FROM part""",
)
def line(spark, sf_dir):
    header = [F.col("p_brand"), F.lit("a\\b"), F.lit("1.0"), F.col("p_type"), F.col("p_name"), F.lit("5")]
    extensions = [
        ("size", F.col("p_size")),
        ("odd", F.when(F.col("p_partkey") % 2 == 1, "k=v")),
        ("none", F.lit("")),
    ]
    part = adapters.table(spark, sf_dir, "part")
    return part.select("p_partkey", cef_line(header, extensions).alias("line"))


@query("x04_activity_id", f"WITH {HTTP_CTE} SELECT event_id, {ACTIVITY} AS activity_id FROM http")
def activity(spark, sf_dir):
    method = F.coalesce("method", F.lit("Unknown"))
    return adapters.zeek_http(spark, sf_dir).select(
        "event_id", http_activity_id(method).alias("activity_id")
    )


@query(
    "x05_url_parts",
    f"""WITH {HTTP_CTE} SELECT event_id, {URL_HOST} AS uri_host, {URL_PATH} AS uri_path,
        {URL_QUERY} AS uri_query, true AS uri_ok FROM http""",
)
def url_parts(spark, sf_dir):
    http = adapters.zeek_http(spark, sf_dir)
    parts = with_url_parts(http, F.coalesce("uri", F.lit("-")), "uri")
    return parts.select("event_id", "uri_host", "uri_path", "uri_query", "uri_ok")


# Words of a command of the adapter: the quoted last word is one word.
_WORDS = """CASE WHEN p_partkey % 7 <> 0 THEN
  list_concat(string_split(regexp_replace("COMMAND", ' "x y"$', ''), ' '),
              CASE WHEN p_partkey % 7 = 1 THEN ['x y'] ELSE [] END) END"""


@query(
    "x06_command",
    f"""WITH {PROC_CTE}, {COMMAND_CTE}, listed AS (SELECT *, {_WORDS} AS words FROM command)
    SELECT p_partkey, cmd_ok, abspath AS cmd_abspath, {FILENAME} AS cmd_filename,
      {DIRECTORY} AS cmd_path, fullcmd AS cmd_fullcmd,
      CASE WHEN p_partkey % 5 = 0 THEN array_to_string(words[4:len(words) - 1], ',')
           ELSE array_to_string(words[2:len(words) - 1], ',') END AS cmd_args
    FROM listed""",
)
def command(spark, sf_dir):
    parsed = with_command(adapters.proc(spark, sf_dir), "COMMAND")
    return parsed.select(
        "p_partkey",
        "cmd_ok",
        "cmd_abspath",
        "cmd_filename",
        "cmd_path",
        "cmd_fullcmd",
        F.array_join("cmd_args", ",").alias("cmd_args"),
    )


@query(
    "x07_shell_words",
    f"""WITH {PROC_CTE} SELECT p_partkey, array_to_string({_WORDS}, ',') AS words,
        CAST(len({_WORDS}) AS INTEGER) AS n FROM proc""",
)
def shell_words(spark, sf_dir):
    words = with_shell_words(adapters.proc(spark, sf_dir), "COMMAND", "w")
    return words.select(
        "p_partkey", F.array_join("w", ",").alias("words"), F.array_size("w").alias("n")
    )


@query(
    "x08_x09_x10_x12_defaults",
    f"""WITH {HTTP_CTE}, h AS (SELECT event_id, coalesce(uri, '-') AS url, length(coalesce(uri, '-')) AS url_length,
        coalesce(request_body_len, 0) + coalesce(response_body_len, 0) AS bytes FROM http),
    {CONN_CTE}
    SELECT h.*, upper(coalesce(proto, '')) AS protocol FROM h JOIN conn USING (event_id)""",
)
def defaults(spark, sf_dir):
    """Defaulting, sums of defaulted counters, code-point length, upper case."""
    from eventloom.mappings.model import Mapping, apply_mapping, computed, take, total

    mapping = Mapping.of(
        [
            ("url", take("uri", "-")),
            ("url_length", computed(lambda r: F.length(r.default("uri", F.lit("-"))))),
            ("bytes", total("request_body_len", "response_body_len")),
        ]
    )
    http = apply_mapping(adapters.zeek_http(spark, sf_dir), mapping, ["event_id"], "flat")
    upper = Mapping.of([("protocol", computed(lambda r: F.upper(r.default("proto", F.lit("")))))])
    conn = apply_mapping(adapters.zeek_conn(spark, sf_dir), upper, ["event_id"], "flat")
    return http.join(conn, "event_id")


@query(
    "x10_length",
    "SELECT doc_id, length(text) AS n, length(text) = n_chars AS as_told FROM documents",
)
def code_points(spark, sf_dir):
    n = F.length("text").cast("bigint")
    documents = adapters.table(spark, sf_dir, "documents")
    return documents.select("doc_id", n.alias("n"), (n == F.col("n_chars")).alias("as_told"))


@query(
    "x13_epoch_millis",
    f"WITH {CONN_CTE} SELECT event_id, CAST(trunc(ts * 1000) AS BIGINT) AS rt FROM conn",
)
def millis(spark, sf_dir):
    conn = adapters.zeek_conn(spark, sf_dir)
    return conn.select("event_id", epoch_millis(F.col("ts")).alias("rt"))


@query(
    "x11_x14_x15_x16_small",
    f"""WITH {PROC_CTE} SELECT p_partkey, concat('uid-', "PID") AS tag, ["USER"][1] AS first_user,
        coalesce("TT", '?') <> '?' AS interactive, CAST(len(string_split("COMMAND", ' ')) AS INTEGER) AS pieces
        FROM proc""",
)
def small(spark, sf_dir):
    """Array size, concatenation, array constructor, inequality to boolean."""
    return adapters.proc(spark, sf_dir).select(
        "p_partkey",
        F.concat(F.lit("uid-"), "PID").alias("tag"),
        F.array("USER")[0].alias("first_user"),
        (F.coalesce("TT", F.lit("?")) != "?").alias("interactive"),
        F.size(F.split("COMMAND", " ")).alias("pieces"),
    )


@query(
    "x17_option_map",
    """SELECT p_partkey, CAST(p_size AS VARCHAR) AS rport, concat('host  ', p_name) AS lhost,
       CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '1' END AS twice,
       CASE WHEN p_partkey % 2 = 0 THEN 3 ELSE 3 END AS n FROM part""",
)
def options(spark, sf_dir):
    text = F.concat(
        F.lit(" set RPORT "),
        F.col("p_size").cast("string"),
        F.lit("; SET   LHOST   host  "),
        "p_name",
        F.lit(" ;exploit;set X 1;set alone;setY 2;"),
        F.when(F.col("p_partkey") % 2 == 0, "set X 2;").otherwise(""),
    )
    part = adapters.table(spark, sf_dir, "part").select("p_partkey", option_map(text).alias("m"))
    return part.select(
        "p_partkey",
        F.col("m.RPORT").alias("rport"),
        F.col("m.LHOST").alias("lhost"),
        F.col("m.X").alias("twice"),
        F.size("m").alias("n"),
    )


_INTEGER_CASES = """CASE event_id % 10 WHEN 0 THEN concat('"', event_id, '"') WHEN 1 THEN '" 1_000 "'
  WHEN 2 THEN '"5.5"' WHEN 3 THEN '""' WHEN 4 THEN 'null' WHEN 5 THEN '[1]' WHEN 6 THEN 'true'
  WHEN 7 THEN '-7.9' WHEN 8 THEN CAST(event_id AS {text}) ELSE '"1__0"' END"""


@query(
    "x18_integer_convertible",
    """SELECT event_id, event_id % 10 IN (0, 1, 6, 7, 8) AS fits,
       CASE event_id % 10 WHEN 0 THEN event_id WHEN 1 THEN 1000 WHEN 6 THEN 1 WHEN 7 THEN -7
       WHEN 8 THEN event_id END AS number FROM events""",
)
def convertible(spark, sf_dir):
    raw = F.parse_json(F.expr(_INTEGER_CASES.format(text="STRING")))
    rows = adapters.table(spark, sf_dir, "events").select("event_id", raw.alias("v"))
    return rows.select(
        "event_id",
        integer_convertible(F.col("v")).alias("fits"),
        to_integer(F.col("v")).alias("number"),
    )


@query(
    "x19_json_round_trip",
    f"""WITH {CONN_CTE} SELECT event_id, CASE WHEN "id.resp_p" IS NULL THEN 'STRING' ELSE 'BIGINT' END AS port_type,
        coalesce(CAST("id.resp_p" AS VARCHAR), '-') AS port, service FROM conn""",
)
def json_text(spark, sf_dir):
    """Rendered JSON keeps the type of a value or of its stand-in, and omits nulls."""
    from eventloom.mappings.model import Mapping, apply_mapping, take

    mapping = Mapping.of([("port", take("id.resp_p", "-")), ("service", take("service"))])
    rendered = apply_mapping(adapters.zeek_conn(spark, sf_dir), mapping, ["event_id"], "document")
    event = rendered.select("event_id", F.parse_json("event").alias("v"))
    port = F.variant_get("v", "$.port", "variant")
    return event.select(
        "event_id",
        F.schema_of_variant(port).alias("port_type"),
        port.cast("string").alias("port"),
        F.try_variant_get("v", "$.service", "string").alias("service"),
    )


# Log paths of the layout, for names that occur in it.
_PATH_SQL = """SELECT event_id,
  concat('CVE-', event_id % 20) AS run,
  CASE event_id % 6 WHEN 0 THEN 'zeek' WHEN 1 THEN 'cim' WHEN 2 THEN 'ecs' WHEN 3 THEN 'ocsf'
       WHEN 4 THEN 'cef' ELSE 'udm' END AS fmt,
  CASE event_id % 4 WHEN 0 THEN 'http' WHEN 1 THEN 'network' WHEN 2 THEN 'conn'
       ELSE concat('process_', 1700000000 + event_id, '.25') END AS kind FROM events"""
_PATHS_CTE = f"""paths AS (SELECT *, CASE WHEN kind = 'conn' THEN 'conn.log'
  ELSE concat(fmt, '_', kind, '.log') END AS file_name FROM ({_PATH_SQL}) AS named)"""


def _paths(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events")
    rows = spark.sql(_PATH_SQL.replace("FROM events", "FROM {events}"), events=events)
    name = F.when(F.col("kind") == "conn", "conn.log").otherwise(
        F.concat("fmt", F.lit("_"), "kind", F.lit(".log"))
    )
    path = F.concat(F.lit("file:/data/"), "run", F.lit("/"), "fmt", F.lit("/"), name)
    return naming.with_path_columns(rows.select("event_id", path.alias("path")), "path")


@query(
    "p01_path_columns",
    f"WITH {_PATHS_CTE} SELECT event_id, run AS cve_name, fmt AS format, file_name FROM paths",
)
def path_columns(spark, sf_dir):
    return _paths(spark, sf_dir).select("event_id", "cve_name", "format", "file_name")


@query(
    "p02_log_type",
    f"WITH {_PATHS_CTE} SELECT log_type, count(*) AS n FROM (SELECT kind AS log_type FROM paths) AS k GROUP BY 1",
)
def log_types(spark, sf_dir):
    return _paths(spark, sf_dir).groupBy("log_type").agg(F.count("*").alias("n"))


@query(
    "p03_snapshot_time",
    f"""WITH {_PATHS_CTE} SELECT event_id,
        CASE WHEN kind LIKE 'process%' THEN 'process' ELSE kind END AS log_family,
        CASE WHEN kind LIKE 'process%' THEN 1700000000 + event_id + 0.25::DOUBLE END AS snapshot_ts FROM paths""",
)
def snapshot_times(spark, sf_dir):
    return _paths(spark, sf_dir).select("event_id", "log_family", "snapshot_ts")


@query(
    "p04_routing",
    f"""WITH {_PATHS_CTE} SELECT concat(fmt, '_logs') AS target, fmt <> 'cef' AS is_json, count(*) AS events
        FROM paths GROUP BY ALL""",
)
def routing(spark, sf_dir):
    target = naming.table_of_format(F.col("format")).alias("target")
    is_json = naming.is_json_format(F.col("format")).alias("is_json")
    return _paths(spark, sf_dir).groupBy(target, is_json).agg(F.count("*").alias("events"))


@query(
    "p05_prefixed_name",
    """SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE concat('lab', s_nationkey, '-', s_name) END
       AS session_id FROM supplier""",
)
def prefixed(spark, sf_dir):
    prefix = F.when(F.col("s_suppkey") % 3 == 0, "").otherwise(F.concat(F.lit("lab"), "s_nationkey"))
    name = naming.prefixed_name(prefix, F.col("s_name")).alias("session_id")
    return adapters.table(spark, sf_dir, "supplier").select("s_suppkey", name)
