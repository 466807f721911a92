"""Connection log records to CIM Network Traffic, ECS, OCSF Network Activity, CEF and UDM.

Fixed values: field names, constants and defaults of the five target schemas.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.scalars import epoch_millis
from eventloom.mappings.model import Mapping, as_text, computed, constant, or_now, take, total
from eventloom.mappings.shared import (
    DEFAULT_IDENTITY,
    CefMapping,
    Identity,
    one_element,
    udm_metadata,
)

CIM = Mapping.of(
    [
        ("timestamp", or_now("ts")),
        ("action", constant("allowed")),
        ("app", take("service", "-")),
        ("bytes", total("orig_bytes", "resp_bytes")),
        ("bytes_in", take("orig_bytes", 0)),
        ("bytes_out", take("resp_bytes", 0)),
        ("dest", take("id.resp_h", 0)),
        ("dest_ip", take("id.resp_h", 0)),
        ("dest_port", take("id.resp_p", 0)),
        ("packets", total("orig_pkts", "resp_pkts")),
        ("packets_in", take("orig_pkts", 0)),
        ("packets_out", take("resp_pkts", 0)),
        ("src", take("id.orig_h", 0)),
        ("src_ip", take("id.orig_h", 0)),
        ("src_port", take("id.orig_p", 0)),
        ("transport", take("proto", "-")),
    ]
)

ECS = Mapping.of(
    [
        ("@timestamp", or_now("ts")),
        ("network.application", take("service", "-")),
        ("network.bytes", total("orig_bytes", "resp_bytes")),
        ("source.bytes", take("orig_bytes", 0)),
        ("destination.bytes", take("resp_bytes", 0)),
        ("destination.ip", take("id.resp_h", 0)),
        ("destination.port", take("id.resp_p", 0)),
        ("network.packets", total("orig_pkts", "resp_pkts")),
        ("source.packets", take("orig_pkts", 0)),
        ("destination.packets", take("resp_pkts", 0)),
        ("source.ip", take("id.orig_h", 0)),
        ("source.port", take("id.orig_p", 0)),
        ("network.protocol", take("proto", "-")),
    ]
)

OCSF = Mapping.of(
    {
        "time": or_now("ts"),
        "category_uid": constant("4"),
        "category_name": constant("Network Activity"),
        "activity_id": constant("6"),
        "type_uid": constant("400106"),
        "type_name": constant("Network Activity: Traffic"),
        "class_uid": constant("4001"),
        "class_name": constant("Network Activity"),
        "activity_name": constant("Traffic"),
        "severity_id": constant("1"),
        "severity": constant("Informational"),
        "metadata": {
            "version": constant("1.4.0"),
            "product": {"vendor_name": constant("Unknown")},
        },
        "dst_endpoint": {"port": take("id.resp_p", 0), "ip": take("id.resp_h", 0)},
        "src_endpoint": {"port": take("id.orig_p", 0), "ip": take("id.orig_h", 0)},
    }
)

_CEF_EXTENSIONS = Mapping.of(
    [
        ("rt", computed(lambda r: epoch_millis(r.default("ts", F.lit(0.0))), digits=True)),
        ("src", as_text("id.orig_h", "")),
        ("spt", as_text("id.orig_p", "")),
        ("dst", as_text("id.resp_h", "")),
        ("dpt", as_text("id.resp_p", "")),
        ("proto", as_text("proto", "")),
        ("app", as_text("service", "")),
        ("in", as_text("orig_bytes", "0")),
        ("out", as_text("resp_bytes", "0")),
        ("cn1Label", constant("packetsIn")),
        ("cn1", as_text("orig_pkts", "0")),
        ("cn2Label", constant("packetsOut")),
        ("cn2", as_text("resp_pkts", "0")),
        ("act", constant("allowed")),
    ]
)


def cef(identity: Identity = DEFAULT_IDENTITY) -> CefMapping:
    return CefMapping(
        identity,
        lambda r: F.lit(f"{identity.vendor}-NET-CONN"),
        lambda r: F.lit("Network Activity: Traffic"),
        _CEF_EXTENSIONS,
    )


def udm(identity: Identity = DEFAULT_IDENTITY) -> Mapping:
    return Mapping.of(
        [
            *udm_metadata(take("ts", 0.0), "NETWORK_CONNECTION", identity),
            (("principal", "ip"), one_element("id.orig_h", "")),
            (("principal", "port"), take("id.orig_p", 0)),
            (("target", "ip"), one_element("id.resp_h", "")),
            (("target", "port"), take("id.resp_p", 0)),
            (("network", "ipProtocol"), computed(lambda r: F.upper(r.default("proto", F.lit(""))))),
            (("network", "applicationProtocol"), take("service", "")),
            (("network", "sentBytes"), take("orig_bytes", 0)),
            (("network", "receivedBytes"), take("resp_bytes", 0)),
            (("security_result", "action"), constant("ALLOW")),
        ]
    )
