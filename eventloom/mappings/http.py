"""HTTP log records to CIM Web, ECS, OCSF HTTP Activity, CEF and UDM.

Fixed values: field names, constants and defaults of the five target schemas.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.functions.scalars import epoch_millis, http_activity_id
from eventloom.functions.urls import with_url_parts
from eventloom.mappings.model import (
    Mapping,
    Record,
    as_text,
    computed,
    constant,
    omitted,
    or_now,
    take,
    total,
)
from eventloom.mappings.shared import (
    DEFAULT_IDENTITY,
    CefMapping,
    Identity,
    one_element,
    udm_metadata,
)


def _url_columns(df: DataFrame) -> DataFrame:
    """Parts of the request URL and of the referrer, "-" standing for an absent one,
    and the values that several fields share."""
    record = Record(df)
    df = df.withColumns(
        {
            "activity_id": http_activity_id(_method(record)),
            "uri_text": record.default("uri", F.lit("-")),
            "source_text": record.default("id.orig_h", F.lit("-")),
            "user_agent_text": record.default("user_agent", F.lit("-")),
        }
    )
    df = with_url_parts(df, "uri_text", "uri")
    return with_url_parts(df, record.default("referrer", F.lit("-")), "referrer", ["host"])


def _method(rec: Record) -> Column:
    return rec.default("method", F.lit("Unknown"))


CIM = Mapping.of(
    [
        ("timestamp", or_now("ts")),
        ("action", constant("http")),
        ("app", omitted()),
        ("bytes", total("request_body_len", "response_body_len")),
        ("bytes_in", take("request_body_len", 0)),
        ("bytes_out", take("response_body_len", 0)),
        ("cached", omitted()),
        ("category", constant("-")),
        ("cookie", take("cookie_vars")),
        ("dest", take("id.resp_h", "-")),
        ("dest_port", take("id.resp_p", "-")),
        ("duration", omitted()),
        ("http_content_type", take("orig_mime_types", "-")),
        ("http_method", take("method", "-")),
        ("http_referrer", take("referrer", "-")),
        ("http_referrer_domain", take("referrer_host")),
        ("http_user_agent", take("user_agent_text")),
        ("http_user_agent_length", computed(lambda r: F.length("user_agent_text"))),
        ("host", take("host", "-")),
        ("response_time", omitted()),
        ("site", omitted()),
        ("src", take("source_text")),
        ("status", take("status_code", "-")),
        ("uri_path", take("uri_path")),
        ("uri_query", take("uri_query")),
        ("url", take("uri_text")),
        ("url_domain", take("uri_host")),
        ("url_length", computed(lambda r: F.length("uri_text"))),
        ("user", omitted()),
        ("vendor_product", omitted()),
        ("error_code", omitted()),
        ("operation", omitted()),
        ("storage_name", omitted()),
    ],
    _url_columns,
)

ECS = Mapping.of(
    [
        ("@timestamp", or_now("ts")),
        ("ecs.version", constant("8.17")),
        ("event.kind", constant("event")),
        ("event.category", constant("web")),
        ("event.type", constant("protocol")),
        ("http.request.method", take("method", "-")),
        ("http.response.body.bytes", take("response_body_len", "-")),
        ("http.response.status_code", take("status_code", "-")),
        ("http.version", constant("1.1")),
        ("http.hostname", take("uri_host")),
        ("user_agent.original", take("user_agent_text")),
        ("source.ip", take("source_text")),
        ("destination.ip", take("id.resp_h", "-")),
        ("url.path", take("uri_path")),
        ("url.domain", take("uri_host")),
    ],
    _url_columns,
)

OCSF = Mapping.of(
    {
        "activity": take("method", "Unknown"),
        "activity_id": take("activity_id"),
        "category_name": constant("Network Activity"),
        "category_uid": constant("4"),
        "class_name": constant("HTTP Activity"),
        "class_uid": constant("4002"),
        "time": or_now("ts"),
        "http_request": {
            "http_method": take("method", "Unknown"),
            "url": {
                "hostname": take("uri_host"),
                "path": take("uri_path"),
                "port": take("id.resp_p", "-"),
                "scheme": constant("http"),
                "text": take("uri_text"),
            },
            "user_agent": take("user_agent_text"),
            "version": constant("HTTP/1.1"),
        },
        "http_response": {"code": take("status_code", "-")},
        "message": constant(""),
        "metadata": {
            "version": constant("1.4.0"),
            "product": {"vendor_name": constant("Unknown")},
        },
        "severity": constant("Informational"),
        "severity_id": constant("1"),
        "src_endpoint": {"ip": take("source_text"), "port": take("id.orig_p", "-")},
        "start_time": or_now("ts"),
        "type_uid": computed(
            lambda r: F.concat(F.lit("40020"), r.column("activity_id").cast("string"))
        ),
        "type_name": computed(lambda r: F.concat(F.lit("HTTP Activity: "), _method(r))),
    },
    _url_columns,
)

_CEF_EXTENSIONS = Mapping.of(
    [
        ("rt", computed(lambda r: epoch_millis(r.default("ts", F.lit(0.0))), digits=True)),
        ("src", as_text("id.orig_h", "")),
        ("spt", as_text("id.orig_p", "")),
        ("dst", as_text("id.resp_h", "")),
        ("dpt", as_text("id.resp_p", "")),
        ("dhost", as_text("host", "")),
        ("app", constant("http")),
        ("requestMethod", as_text("method", "")),
        ("request", as_text("uri", "")),
        ("requestContext", as_text("referrer", "")),
        ("requestClientApplication", as_text("user_agent", "")),
        ("in", as_text("request_body_len", "0")),
        ("out", as_text("response_body_len", "0")),
        ("cn1Label", constant("statusCode")),
        ("cn1", as_text("status_code", "")),
    ]
)


def cef(identity: Identity = DEFAULT_IDENTITY) -> CefMapping:
    return CefMapping(
        identity,
        lambda r: F.concat(F.lit(f"{identity.vendor}-HTTP-"), _method(r)),
        lambda r: F.concat(F.lit("HTTP Activity: "), _method(r)),
        _CEF_EXTENSIONS,
    )


def udm(identity: Identity = DEFAULT_IDENTITY) -> Mapping:
    return Mapping.of(
        [
            *udm_metadata(take("ts", 0.0), "NETWORK_HTTP", identity),
            (("principal", "ip"), one_element("id.orig_h", "")),
            (("principal", "port"), take("id.orig_p", 0)),
            (("target", "hostname"), take("host", "")),
            (("target", "ip"), one_element("id.resp_h", "")),
            (("target", "port"), take("id.resp_p", 0)),
            (("target", "url"), take("uri", "")),
            (("network", "http", "method"), take("method", "")),
            (("network", "http", "responseCode"), take("status_code", 0)),
            (("network", "http", "userAgent"), take("user_agent", "")),
            (("network", "http", "referralUrl"), take("referrer", "")),
            (("network", "sentBytes"), take("request_body_len", 0)),
            (("network", "receivedBytes"), take("response_body_len", 0)),
            (("network", "applicationProtocol"), constant("HTTP")),
            (("security_result", "action"), constant("ALLOW")),
        ]
    )
