"""Conversions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.constants import PRODUCT, PRODUCT_VERSION, VENDOR
from eventloom.mappings import Mapping, apply_mapping
from eventloom.operators.convert import convert, documents, fan_out, text_documents
from eventloom.plans import adapters
from eventloom.plans.adapters import CONN_CTE, HTTP_CTE, PROC_CTE
from eventloom.plans.registry import query
from eventloom.schemas import quoted


def scalars(df: DataFrame) -> DataFrame:
    """Arrays joined to text, so that results of two engines compare."""
    arrays = [f.name for f in df.schema if f.dataType.typeName() == "array"]
    return df.withColumns({n: F.array_join(F.col(quoted(n)), ",") for n in arrays})


def _select(key: str, cte: str, source: str, fields: dict[str, str]) -> str:
    columns = ",\n  ".join(f'{sql} AS "{name}"' for name, sql in fields.items())
    return f"WITH {cte}\nSELECT {key},\n  {columns}\nFROM {source}"


def _text(column: str, default: str) -> str:
    return f"coalesce(CAST({column} AS VARCHAR), '{default}')"


NULL_TEXT = "CAST(NULL AS VARCHAR)"
ORIG_H, ORIG_P, RESP_H, RESP_P = '"id.orig_h"', '"id.orig_p"', '"id.resp_h"', '"id.resp_p"'

# URL parts of the adapter's URLs, written independently of the library.
_SEARCH = "replace(replace(replace(replace(props_text, '{', '%7B'), '\"', '%22'), ' ', '%20'), '}', '%7D')"
URL_HOST = r"""CASE WHEN uri IS NULL THEN '-' WHEN uri LIKE 'http%' THEN lower(regexp_extract(uri, '^https?://([^/?#]+)', 1)) END"""
URL_PATH = (
    r"""CASE WHEN uri IS NULL THEN NULL WHEN uri LIKE '/x/../%' THEN concat('/search/', """
    + _SEARCH.replace("props_text", r"regexp_extract(uri, '^/x/../search/([^?]*)', 1)")
    + r""") WHEN uri LIKE 'http%' THEN nullif(regexp_extract(uri, '^https?://[^/?#]+([^?#]*)', 1), '')
    ELSE regexp_extract(uri, '^([^?#]*)', 1) END"""
)
URL_QUERY = (
    r"""CASE WHEN uri LIKE '/x/../%' THEN concat('q=', """
    + _SEARCH.replace("props_text", r"regexp_extract(uri, '[?]q=(.*)$', 1)")
    + r""") WHEN uri LIKE '%?%' THEN regexp_extract(uri, '[?]([^#]*)', 1) END"""
)
REFERRER_HOST = r"""CASE WHEN referrer IS NULL THEN '-' ELSE lower(regexp_extract(referrer, '^https?://([^/?#]+)', 1)) END"""

ACTIVITY = """CASE lower(coalesce(method, 'Unknown')) WHEN 'connect' THEN 1 WHEN 'delete' THEN 2
  WHEN 'get' THEN 3 WHEN 'head' THEN 4 WHEN 'options' THEN 5 WHEN 'post' THEN 6 WHEN 'put' THEN 7
  WHEN 'trace' THEN 8 WHEN 'other' THEN 99 ELSE 0 END"""

HTTP_CIM = {
    "timestamp": "ts",
    "action": "'http'",
    "app": NULL_TEXT,
    "bytes": "coalesce(request_body_len, 0) + coalesce(response_body_len, 0)",
    "bytes_in": "coalesce(request_body_len, 0)",
    "bytes_out": "coalesce(response_body_len, 0)",
    "cached": NULL_TEXT,
    "category": "'-'",
    "cookie": "cookie_vars",
    "dest": _text(RESP_H, "-"),
    "dest_port": _text(RESP_P, "-"),
    "duration": NULL_TEXT,
    "http_content_type": _text("orig_mime_types", "-"),
    "http_method": _text("method", "-"),
    "http_referrer": _text("referrer", "-"),
    "http_referrer_domain": REFERRER_HOST,
    "http_user_agent": _text("user_agent", "-"),
    "http_user_agent_length": "length(coalesce(user_agent, '-'))",
    "host": _text("host", "-"),
    "response_time": NULL_TEXT,
    "site": NULL_TEXT,
    "src": _text(ORIG_H, "-"),
    "status": _text("status_code", "-"),
    "uri_path": URL_PATH,
    "uri_query": URL_QUERY,
    "url": _text("uri", "-"),
    "url_domain": URL_HOST,
    "url_length": "length(coalesce(uri, '-'))",
    "user": NULL_TEXT,
    "vendor_product": NULL_TEXT,
    "error_code": NULL_TEXT,
    "operation": NULL_TEXT,
    "storage_name": NULL_TEXT,
}

HTTP_ECS = {
    "@timestamp": "ts",
    "ecs.version": "'8.17'",
    "event.kind": "'event'",
    "event.category": "'web'",
    "event.type": "'protocol'",
    "http.request.method": _text("method", "-"),
    "http.response.body.bytes": _text("response_body_len", "-"),
    "http.response.status_code": _text("status_code", "-"),
    "http.version": "'1.1'",
    "http.hostname": URL_HOST,
    "user_agent.original": _text("user_agent", "-"),
    "source.ip": _text(ORIG_H, "-"),
    "destination.ip": _text(RESP_H, "-"),
    "url.path": URL_PATH,
    "url.domain": URL_HOST,
}

HTTP_OCSF = {
    "activity": _text("method", "Unknown"),
    "activity_id": ACTIVITY,
    "category_name": "'Network Activity'",
    "category_uid": "'4'",
    "class_name": "'HTTP Activity'",
    "class_uid": "'4002'",
    "time": "ts",
    "http_request.http_method": _text("method", "Unknown"),
    "http_request.url.hostname": URL_HOST,
    "http_request.url.path": URL_PATH,
    "http_request.url.port": _text(RESP_P, "-"),
    "http_request.url.scheme": "'http'",
    "http_request.url.text": _text("uri", "-"),
    "http_request.user_agent": _text("user_agent", "-"),
    "http_request.version": "'HTTP/1.1'",
    "http_response.code": _text("status_code", "-"),
    "message": "''",
    "metadata.version": "'1.4.0'",
    "metadata.product.vendor_name": "'Unknown'",
    "severity": "'Informational'",
    "severity_id": "'1'",
    "src_endpoint.ip": _text(ORIG_H, "-"),
    "src_endpoint.port": _text(ORIG_P, "-"),
    "start_time": "ts",
    "type_uid": f"concat('40020', CAST({ACTIVITY} AS VARCHAR))",
    "type_name": "concat('HTTP Activity: ', coalesce(method, 'Unknown'))",
}

MILLIS = "CAST(trunc(ts * 1000) AS BIGINT)"


def _header(value: str) -> str:
    return rf"replace(replace({value}, '\', '\\'), '|', '\|')"


def _extension(value: str) -> str:
    return rf"replace(replace(CAST({value} AS VARCHAR), '\', '\\'), '=', '\=')"


def _cef(head: str, extensions: dict[str, str]) -> dict[str, str]:
    """The line and its extensions; a null extension is left out of the line."""
    pairs = ", ".join(f"'{k}=' || {_extension(v)}" for k, v in extensions.items())
    line = {"cef": f"concat({head}, '|', concat_ws(' ', {pairs}))"}
    return line | {k: f"CAST({v} AS VARCHAR)" for k, v in extensions.items()}


HTTP_CEF = _cef(
    f"'CEF:0|{VENDOR}|{PRODUCT}|{PRODUCT_VERSION}|{VENDOR}-HTTP-', "
    + _header("coalesce(method, 'Unknown')")
    + ", '|HTTP Activity: ', "
    + _header("coalesce(method, 'Unknown')")
    + ", '|3'",
    {
        "rt": MILLIS,
        "src": _text(ORIG_H, ""),
        "spt": _text(ORIG_P, ""),
        "dst": _text(RESP_H, ""),
        "dpt": _text(RESP_P, ""),
        "dhost": _text("host", ""),
        "app": "'http'",
        "requestMethod": _text("method", ""),
        "request": _text("uri", ""),
        "requestContext": _text("referrer", ""),
        "requestClientApplication": _text("user_agent", ""),
        "in": "coalesce(request_body_len, 0)",
        "out": "coalesce(response_body_len, 0)",
        "cn1Label": "'statusCode'",
        "cn1": _text("status_code", ""),
    },
)


def _udm_metadata(kind: str) -> dict[str, str]:
    return {
        "metadata.event_timestamp": "ts",
        "metadata.event_type": f"'{kind}'",
        "metadata.vendor_name": f"'{VENDOR}'",
        "metadata.product_name": f"'{PRODUCT}'",
        "metadata.product_version": f"'{PRODUCT_VERSION}'",
    }


HTTP_UDM = _udm_metadata("NETWORK_HTTP") | {
    "principal.ip": _text(ORIG_H, ""),
    "principal.port": f"coalesce({ORIG_P}, 0)",
    "target.hostname": _text("host", ""),
    "target.ip": _text(RESP_H, ""),
    "target.port": f"coalesce({RESP_P}, 0)",
    "target.url": _text("uri", ""),
    "network.http.method": _text("method", ""),
    "network.http.responseCode": "coalesce(status_code, 0)",
    "network.http.userAgent": _text("user_agent", ""),
    "network.http.referralUrl": _text("referrer", ""),
    "network.sentBytes": "coalesce(request_body_len, 0)",
    "network.receivedBytes": "coalesce(response_body_len, 0)",
    "network.applicationProtocol": "'HTTP'",
    "security_result.action": "'ALLOW'",
}

CONN_CIM = {
    "timestamp": "ts",
    "action": "'allowed'",
    "app": _text("service", "-"),
    "bytes": "coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0)",
    "bytes_in": "coalesce(orig_bytes, 0)",
    "bytes_out": "coalesce(resp_bytes, 0)",
    "dest": _text(RESP_H, "0"),
    "dest_ip": _text(RESP_H, "0"),
    "dest_port": f"coalesce({RESP_P}, 0)",
    "packets": "coalesce(orig_pkts, 0) + coalesce(resp_pkts, 0)",
    "packets_in": "coalesce(orig_pkts, 0)",
    "packets_out": "coalesce(resp_pkts, 0)",
    "src": _text(ORIG_H, "0"),
    "src_ip": _text(ORIG_H, "0"),
    "src_port": f"coalesce({ORIG_P}, 0)",
    "transport": _text("proto", "-"),
}

CONN_ECS = {
    "@timestamp": "ts",
    "network.application": _text("service", "-"),
    "network.bytes": "coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0)",
    "source.bytes": "coalesce(orig_bytes, 0)",
    "destination.bytes": "coalesce(resp_bytes, 0)",
    "destination.ip": _text(RESP_H, "0"),
    "destination.port": f"coalesce({RESP_P}, 0)",
    "network.packets": "coalesce(orig_pkts, 0) + coalesce(resp_pkts, 0)",
    "source.packets": "coalesce(orig_pkts, 0)",
    "destination.packets": "coalesce(resp_pkts, 0)",
    "source.ip": _text(ORIG_H, "0"),
    "source.port": f"coalesce({ORIG_P}, 0)",
    "network.protocol": _text("proto", "-"),
}

CONN_OCSF = {
    "time": "ts",
    "category_uid": "'4'",
    "category_name": "'Network Activity'",
    "activity_id": "'6'",
    "type_uid": "'400106'",
    "type_name": "'Network Activity: Traffic'",
    "class_uid": "'4001'",
    "class_name": "'Network Activity'",
    "activity_name": "'Traffic'",
    "severity_id": "'1'",
    "severity": "'Informational'",
    "metadata.version": "'1.4.0'",
    "metadata.product.vendor_name": "'Unknown'",
    "dst_endpoint.port": f"coalesce({RESP_P}, 0)",
    "dst_endpoint.ip": _text(RESP_H, "0"),
    "src_endpoint.port": f"coalesce({ORIG_P}, 0)",
    "src_endpoint.ip": _text(ORIG_H, "0"),
}

CONN_CEF = _cef(
    f"'CEF:0|{VENDOR}|{PRODUCT}|{PRODUCT_VERSION}|{VENDOR}-NET-CONN|Network Activity: Traffic|3'",
    {
        "rt": MILLIS,
        "src": _text(ORIG_H, ""),
        "spt": _text(ORIG_P, ""),
        "dst": _text(RESP_H, ""),
        "dpt": _text(RESP_P, ""),
        "proto": _text("proto", ""),
        "app": _text("service", ""),
        "in": "coalesce(orig_bytes, 0)",
        "out": "coalesce(resp_bytes, 0)",
        "cn1Label": "'packetsIn'",
        "cn1": "coalesce(orig_pkts, 0)",
        "cn2Label": "'packetsOut'",
        "cn2": "coalesce(resp_pkts, 0)",
        "act": "'allowed'",
    },
)

CONN_UDM = _udm_metadata("NETWORK_CONNECTION") | {
    "principal.ip": _text(ORIG_H, ""),
    "principal.port": f"coalesce({ORIG_P}, 0)",
    "target.ip": _text(RESP_H, ""),
    "target.port": f"coalesce({RESP_P}, 0)",
    "network.ipProtocol": "upper(coalesce(proto, ''))",
    "network.applicationProtocol": _text("service", ""),
    "network.sentBytes": "coalesce(orig_bytes, 0)",
    "network.receivedBytes": "coalesce(resp_bytes, 0)",
    "security_result.action": "'ALLOW'",
}

# Commands of the adapter: an optional emulator, an untidy path in some, an open
# quote in every seventh, a quoted last word in the next.
COMMAND_CTE = r"""cmd AS (
  SELECT *, p_partkey % 7 <> 0 AS cmd_ok,
    replace(regexp_replace("COMMAND", '^/usr/libexec/rosetta ', ''), '"', '') AS tail
  FROM proc),
command AS (
  SELECT *,
    CASE WHEN cmd_ok THEN CASE
      WHEN p_partkey % 5 = 0 THEN string_split(tail, ' ')[1]
      ELSE replace(string_split(tail, ' ')[1], '/./lib/..', '') END END AS abspath,
    CASE WHEN cmd_ok THEN
      CASE WHEN p_partkey % 5 = 0 THEN substr(tail, strpos(tail, ' ') + 1) ELSE tail END END AS fullcmd
  FROM cmd)"""
FILENAME = "regexp_extract(abspath, '([^/]*)$', 1)"
DIRECTORY = "regexp_extract(abspath, '^(.*)/[^/]*$', 1)"

PROC_CIM = {
    "timestamp": "ts",
    "action": "'allowed'",
    "cpu_load_percent": '"%CPU"',
    "dest": "'unknown'",
    "mem_used": '"%MEM"',
    "original_file_name": FILENAME,
    "parent_process": "'unknown'",
    "parent_process_id": '"PPID"',
    "parent_process_name": "'unknown'",
    "parent_process_path": "'unknown'",
    "process": "fullcmd",
    "process_exec": "abspath",
    "process_id": '"PID"',
    "process_name": FILENAME,
    "process_path": DIRECTORY,
    "user": '"USER"',
}

PROC_ECS = {
    "@timestamp": "ts",
    "ecs.version": "'8.17'",
    "event.kind": "'event'",
    "event.category": "'process'",
    "event.type": "'info'",
    "process.args": "array_to_string(string_split(fullcmd, ' '), ',')",
    "process.args_count": "CAST(len(string_split(fullcmd, ' ')) AS INTEGER)",
    "process.command_line": "fullcmd",
    "process.executable": "abspath",
    "process.interactive": "coalesce(\"TT\", '?') <> '?'",
    "process.name": FILENAME,
    "process.pgid": '"PGID"',
    "process.pid": '"PID"',
    "process.start": '"TIME"',
    "process.tty": '"TT"',
    "process.uptime": '"ELAPSED"',
    "user": '"USER"',
}

PROC_OCSF = {
    "time": "ts",
    "activity_name": "'query'",
    "activity_id": "'1'",
    "category_uid": "'5'",
    "category_name": "'Discovery'",
    "class_uid": "'5015'",
    "class_name": "'Process Query'",
    "query_result": "'Exists'",
    "query_result_id": "'1'",
    "severity": "'Informational'",
    "severity_id": "'1'",
    "type_uid": "'501599'",
    "type_name": "'Process Query: Other'",
    "process.name": FILENAME,
    "process.pid": '"PID"',
    "process.session.terminal": '"TT"',
    "process.file.name": FILENAME,
    "process.file.type": "'process'",
    "process.file.path": "abspath",
    "process.file.type_id": "'99'",
    "process.file.parent_folder": DIRECTORY,
    "process.user.name": '"USER"',
    "process.cmd_line": "fullcmd",
    "process.created_time": '"TIME"',
    "metadata.version": "'1.4.0'",
    "metadata.product.name": "'docker process logs'",
}

PROC_CEF = _cef(
    f"'CEF:0|{VENDOR}|{PRODUCT}|{PRODUCT_VERSION}|{VENDOR}-PROC-SNAP|Process Activity: Snapshot|3'",
    {
        "rt": MILLIS,
        "sproc": FILENAME,
        "spid": '"PID"',
        "dpid": '"PPID"',
        "suser": '"USER"',
        "act": "'allowed'",
        "cat": "'process'",
        "cs1Label": "'commandLine'",
        "cs1": "fullcmd",
        "cs2Label": "'executablePath'",
        "cs2": "abspath",
        "cs3Label": "'tty'",
        "cs3": '"TT"',
    },
)

PROC_UDM = _udm_metadata("PROCESS_LAUNCH") | {
    "principal.user.userid": '"USER"',
    "target.process.pid": '"PID"',
    "target.process.parentProcess.pid": '"PPID"',
    "target.process.commandLine": "fullcmd",
    "target.process.file.full_path": "abspath",
    "security_result.action": "'ALLOW'",
}

SOURCES = {
    "http": (adapters.zeek_http, "event_id", HTTP_CTE, "http"),
    "network": (adapters.zeek_conn, "event_id", CONN_CTE, "conn"),
    "process": (adapters.proc, "p_partkey", f"{PROC_CTE},\n{COMMAND_CTE}", "command"),
}

_TABLE = [
    ("j01_http_cim", "http", "cim", HTTP_CIM),
    ("j02_http_ecs", "http", "ecs", HTTP_ECS),
    ("j03_http_ocsf", "http", "ocsf", HTTP_OCSF),
    ("j04_http_cef", "http", "cef", HTTP_CEF),
    ("j05_http_udm", "http", "udm", HTTP_UDM),
    ("j06_network_cim", "network", "cim", CONN_CIM),
    ("j07_network_ecs", "network", "ecs", CONN_ECS),
    ("j08_network_ocsf", "network", "ocsf", CONN_OCSF),
    ("j09_network_cef", "network", "cef", CONN_CEF),
    ("j10_network_udm", "network", "udm", CONN_UDM),
    ("j11_process_cim", "process", "cim", PROC_CIM),
    ("j12_process_ecs", "process", "ecs", PROC_ECS),
    ("j13_process_ocsf", "process", "ocsf", PROC_OCSF),
    ("j14_process_cef", "process", "cef", PROC_CEF),
    ("j15_process_udm", "process", "udm", PROC_UDM),
]

SQL = {}
for _name, _family, _format, _fields in _TABLE:
    _read, _key, _cte, _source = SOURCES[_family]
    SQL[_name] = _select(_key, _cte, _source, _fields)

    @query(_name, SQL[_name])
    def _convert(spark, sf_dir, read=_read, key=_key, family=_family, format=_format):
        return scalars(convert(read(spark, sf_dir), family, format, [key], "flat"))


@query(
    "j00_custom_mapping",
    """SELECT s_suppkey, upper(s_name) AS "who.name", CAST(NULL AS VARCHAR) AS "who.note",
       length(s_name) AS "size", s_acctbal < 0 AS "debt" FROM supplier""",
)
def custom_mapping(spark, sf_dir):
    """The mapping engine on a mapping of a user's own."""
    mapping = Mapping.of(
        {
            "who": {"name": F.upper("s_name"), "note": F.lit(None).cast("string")},
            "size": "length(s_name)",
            "debt": F.col("s_acctbal") < 0,
        }
    )
    supplier = adapters.table(spark, sf_dir, "supplier")
    return apply_mapping(supplier, mapping, ["s_suppkey"], "flat")


@query(
    "u01_custom_mapping_json",
    """SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS nation, s_name AS name,
       CAST(NULL AS VARCHAR) AS note FROM supplier""",
)
def custom_mapping_json(spark, sf_dir):
    """A user's mapping rendered to JSON and read back: nulls are left out."""
    mapping = Mapping.of(
        [
            (("a", "nation"), "s_nationkey"),
            (("a", "name"), F.col("s_name")),
            ("note", "CAST(NULL AS STRING)"),
        ]
    )
    supplier = adapters.table(spark, sf_dir, "supplier")
    rendered = apply_mapping(supplier, mapping, ["s_suppkey"], "document")
    return rendered.select(
        "s_suppkey",
        F.get_json_object("event", "$.a.nation").alias("nation"),
        F.get_json_object("event", "$.a.name").alias("name"),
        F.get_json_object("event", "$.note").alias("note"),
    )


def _fan_out_sql(source: str, family: str) -> str:
    _, key, cte, name = SOURCES[source]
    return f"""WITH {cte}, formats AS (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format)
    SELECT cve_name, format, '{family}' AS log_family, count(*) AS events
    FROM {name}, formats GROUP BY ALL"""


for _family in SOURCES:

    @query(f"j16_fan_out_{_family}", _fan_out_sql(_family, _family))
    def _fan_out(spark, sf_dir, family=_family):
        """Five formats from one scan; the rendered events are counted per run."""
        rows = fan_out(SOURCES[family][0](spark, sf_dir), family, ["cve_name"])
        return rows.groupBy("cve_name", "format", "log_family").agg(F.count("event").alias("events"))


@query(
    "j16_fan_out_values",
    f"""WITH {CONN_CTE}
    SELECT event_id, 'cim' AS format, {_text(RESP_H, "0")} AS host, {_text(RESP_P, "0")} AS port FROM conn
    UNION ALL
    SELECT event_id, 'ecs', {_text(RESP_H, "0")}, {_text(RESP_P, "0")} FROM conn
    UNION ALL
    SELECT event_id, 'ocsf', {_text(RESP_H, "0")}, {_text(RESP_P, "0")} FROM conn
    UNION ALL
    SELECT event_id, 'cef', {_text(RESP_H, "")}, {_text(RESP_P, "")} FROM conn
    UNION ALL
    SELECT event_id, 'udm', {_text(RESP_H, "")}, {_text(RESP_P, "0")} FROM conn""",
)
def fan_out_values(spark, sf_dir):
    """Destination host and port read back from the rendered events of each format."""
    rows = fan_out(adapters.zeek_conn(spark, sf_dir), "network", ["event_id"])
    event, kind = F.col("event"), F.col("format")
    paths = {
        "cim": ("$.dest", "$.dest_port"),
        "ecs": ("$['destination.ip']", "$['destination.port']"),
        "ocsf": ("$.dst_endpoint.ip", "$.dst_endpoint.port"),
        "udm": ("$.target.ip[0]", "$.target.port"),
    }
    host = F.when(kind == "cef", F.regexp_extract(event, r" dst=(\S*) ", 1))
    port = F.when(kind == "cef", F.regexp_extract(event, r" dpt=(\S*) ", 1))
    for name, (host_path, port_path) in paths.items():
        host = host.when(kind == name, F.get_json_object(event, host_path))
        port = port.when(kind == name, F.get_json_object(event, port_path))
    return rows.select("event_id", "format", host.alias("host"), port.alias("port"))


@query(
    "j17_documents",
    f"""WITH {CONN_CTE}
    SELECT cve_name, 'network' AS log_type, coalesce(proto, '-') AS transport,
      coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) AS bytes, ts AS "timestamp" FROM conn""",
)
def merged_documents(spark, sf_dir):
    """Search documents: tags and event fields side by side."""
    events = convert(adapters.zeek_conn(spark, sf_dir), "network", "cim", ["cve_name"])
    tagged = events.withColumn("log_type", F.lit("network"))
    wanted = ("cve_name", "log_type", "transport", "bytes", "timestamp")
    return documents(tagged).select(*(f"document.{name}" for name in wanted))


@query(
    "j17_documents_override",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'own' ELSE concat('CVE-', event_id % 20) END AS cve_name,
       'network' AS log_type, CAST(event_id AS VARCHAR) AS n FROM events""",
)
def document_override(spark, sf_dir):
    """An event's own key wins over the tag of the same name."""
    event_id = F.col("event_id")
    own = F.when(event_id % 3 == 0, F.lit("own"))
    rows = adapters.table(spark, sf_dir, "events").select(
        F.lit("zeek").alias("format"),
        F.concat(F.lit("CVE-"), event_id % 20).alias("cve_name"),
        F.lit("network").alias("log_type"),
        F.to_json(F.struct(own.alias("cve_name"), event_id.alias("n"))).alias("event"),
    )
    text = F.col("document")
    return text_documents(rows).select(
        F.get_json_object(text, "$.n").cast("bigint").alias("event_id"),
        F.get_json_object(text, "$.cve_name").alias("cve_name"),
        F.get_json_object(text, "$.log_type").alias("log_type"),
        F.get_json_object(text, "$.n").alias("n"),
    )
