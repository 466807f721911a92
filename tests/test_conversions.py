"""Conversions of the sample records, whole events compared as parsed values."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from eventloom.constants import NORMALISED, PRODUCT, VENDOR
from eventloom.mappings import Identity, Mapping, apply_mapping
from eventloom.operators import convert, documents, fan_out
from eventloom.schemas import NULL_KEYS, PROCESS_TITLES, ZEEK_CONN, ZEEK_HTTP
from eventloom.sources import parse_lines

NOW = 1.5

HTTP = {
    "ts": 1726531200.75, "uid": "Cq7dLm2rPz", "id.orig_h": "192.168.40.17", "id.orig_p": 40122,
    "id.resp_h": "172.16.9.3", "id.resp_p": 8080, "method": "post", "host": "shop.intra:8080",
    "uri": "http://Shop.intra:8080/a/../korb?artikel=7&n=2", "referrer": "https://Blog.example.org:444/x",
    "user_agent": "Pr\u00fcfer/2 (x=1)", "request_body_len": 37, "response_body_len": 4096, "status_code": 201,
    "orig_mime_types": "application/json",
}
CONN = {
    "ts": 1726531201.25, "uid": "Cw0xVb9tKe", "id.orig_h": "192.168.40.17", "id.orig_p": 40123,
    "id.resp_h": "fd00::9", "id.resp_p": 5353, "proto": "udp", "service": "dns",
    "orig_bytes": 61, "resp_bytes": 1207, "orig_pkts": 2, "resp_pkts": 3,
}
PROCESS = {
    "USER": "svc-web", "PID": "812", "PPID": "77", "PGID": "810", "SESS": "77", "JOBC": "1", "STAT": "R+", "TT": "pts/3",
    "TIME": "00:07:12", "ELAPSED": "2-03:10:00", "LOGNAME": "web", "%CPU": "12.5", "%MEM": "3.1",
    "COMMAND": '/opt/app/bin/serve --name "two words" -v',
}

# The words of the command, put together again.
JOINED = "/opt/app/bin/serve --name two words -v"

IDENTITY = {"vendor_name": VENDOR, "product_name": PRODUCT, "product_version": "1.0"}


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    """Sample and empty records, read from JSON with the declared schemas."""
    folder = tmp_path_factory.mktemp("records")

    def read(name, schema, *rows):
        path = folder / f"{name}.json"
        path.write_text("".join(json.dumps(r) + "\n" for r in rows))
        return spark.read.schema(schema).json(str(path))

    proc = ", ".join(f"`{t}` STRING" for t in PROCESS_TITLES)
    return {
        "http": read("http", ZEEK_HTTP, HTTP),
        "network": read("conn", ZEEK_CONN, CONN),
        "process": read("proc", proc, PROCESS),
        "http empty": read("http0", ZEEK_HTTP, {}),
        "network empty": read("conn0", ZEEK_CONN, {}),
        "process empty": read("proc0", proc, {}),
    }


def event(records, source, format):
    family = source.split()[0]
    text = convert(records[source], family, format, output="document", now=NOW).first().event
    return text if format == "cef" else json.loads(text)


OCSF_HTTP_SHARED = {
    "category_name": "Network Activity", "category_uid": "4", "class_name": "HTTP Activity", "class_uid": "4002",
    "message": "", "metadata": {"version": "1.4.0", "product": {"vendor_name": "Unknown"}},
    "severity": "Informational", "severity_id": "1",
}
OCSF_NETWORK_SHARED = {
    "category_uid": "4", "category_name": "Network Activity", "activity_id": "6", "type_uid": "400106",
    "type_name": "Network Activity: Traffic", "class_uid": "4001", "class_name": "Network Activity",
    "activity_name": "Traffic", "severity_id": "1", "severity": "Informational",
    "metadata": {"version": "1.4.0", "product": {"vendor_name": "Unknown"}},
}
ECS_HTTP_SHARED = {
    "ecs.version": "8.17", "event.kind": "event", "event.category": "web", "event.type": "protocol", "http.version": "1.1",
}

EXPECTED = {
    ("http", "cim"): {
        "timestamp": 1726531200.75, "action": "http", "bytes": 4133, "bytes_in": 37, "bytes_out": 4096, "category": "-",
        "dest": "172.16.9.3", "dest_port": 8080, "http_content_type": "application/json", "http_method": "post",
        "http_referrer": HTTP["referrer"], "http_referrer_domain": "blog.example.org",
        "http_user_agent": "Pr\u00fcfer/2 (x=1)", "http_user_agent_length": 14, "host": "shop.intra:8080",
        "src": "192.168.40.17", "status": 201, "uri_path": "/korb", "uri_query": "artikel=7&n=2",
        "url": HTTP["uri"], "url_domain": "shop.intra", "url_length": 46,
    },
    ("http empty", "cim"): {
        "timestamp": 1.5, "action": "http", "bytes": 0, "bytes_in": 0, "bytes_out": 0, "category": "-", "dest": "-",
        "dest_port": "-", "http_content_type": "-", "http_method": "-", "http_referrer": "-",
        "http_referrer_domain": "-", "http_user_agent": "-", "http_user_agent_length": 1, "host": "-", "src": "-",
        "status": "-", "url": "-", "url_domain": "-", "url_length": 1,
    },
    ("http", "ecs"): ECS_HTTP_SHARED | {
        "@timestamp": 1726531200.75, "http.request.method": "post", "http.response.body.bytes": 4096,
        "http.response.status_code": 201, "http.hostname": "shop.intra", "user_agent.original": "Pr\u00fcfer/2 (x=1)",
        "source.ip": "192.168.40.17", "destination.ip": "172.16.9.3", "url.path": "/korb", "url.domain": "shop.intra",
    },
    ("http empty", "ecs"): ECS_HTTP_SHARED | {
        "@timestamp": 1.5, "http.request.method": "-", "http.response.body.bytes": "-",
        "http.response.status_code": "-", "http.hostname": "-", "user_agent.original": "-", "source.ip": "-",
        "destination.ip": "-", "url.domain": "-",
    },
    ("http", "ocsf"): OCSF_HTTP_SHARED | {
        "activity": "post", "activity_id": 6, "time": 1726531200.75, "start_time": 1726531200.75, "type_uid": "400206",
        "type_name": "HTTP Activity: post", "http_response": {"code": 201},
        "http_request": {
            "http_method": "post", "user_agent": "Pr\u00fcfer/2 (x=1)", "version": "HTTP/1.1",
            "url": {
                "hostname": "shop.intra", "path": "/korb", "port": 8080, "scheme": "http", "text": HTTP["uri"],
            },
        },
        "src_endpoint": {"ip": "192.168.40.17", "port": 40122},
    },
    ("http empty", "ocsf"): OCSF_HTTP_SHARED | {
        "activity": "Unknown", "activity_id": 0, "time": 1.5, "start_time": 1.5, "type_uid": "400200",
        "type_name": "HTTP Activity: Unknown", "http_response": {"code": "-"},
        "http_request": {
            "http_method": "Unknown", "user_agent": "-", "version": "HTTP/1.1",
            "url": {"hostname": "-", "port": "-", "scheme": "http", "text": "-"},
        },
        "src_endpoint": {"ip": "-", "port": "-"},
    },
    ("http", "udm"): {
        "metadata": {"event_timestamp": 1726531200.75, "event_type": "NETWORK_HTTP"} | IDENTITY,
        "principal": {"ip": ["192.168.40.17"], "port": 40122},
        "target": {"hostname": "shop.intra:8080", "ip": ["172.16.9.3"], "port": 8080, "url": HTTP["uri"]},
        "network": {
            "http": {
                "method": "post", "responseCode": 201, "userAgent": "Pr\u00fcfer/2 (x=1)",
                "referralUrl": HTTP["referrer"],
            },
            "sentBytes": 37, "receivedBytes": 4096, "applicationProtocol": "HTTP",
        },
        "security_result": {"action": "ALLOW"},
    },
    ("http empty", "udm"): {
        "metadata": {"event_timestamp": 0, "event_type": "NETWORK_HTTP"} | IDENTITY,
        "principal": {"ip": [""], "port": 0},
        "target": {"hostname": "", "ip": [""], "port": 0, "url": ""},
        "network": {
            "http": {"method": "", "responseCode": 0, "userAgent": "", "referralUrl": ""},
            "sentBytes": 0, "receivedBytes": 0, "applicationProtocol": "HTTP",
        },
        "security_result": {"action": "ALLOW"},
    },
    ("network", "cim"): {
        "timestamp": 1726531201.25, "action": "allowed", "app": "dns", "bytes": 1268, "bytes_in": 61, "bytes_out": 1207,
        "dest": "fd00::9", "dest_ip": "fd00::9", "dest_port": 5353, "packets": 5, "packets_in": 2, "packets_out": 3,
        "src": "192.168.40.17", "src_ip": "192.168.40.17", "src_port": 40123, "transport": "udp",
    },
    ("network empty", "cim"): {
        "timestamp": 1.5, "action": "allowed", "app": "-", "bytes": 0, "bytes_in": 0, "bytes_out": 0, "dest": 0,
        "dest_ip": 0, "dest_port": 0, "packets": 0, "packets_in": 0, "packets_out": 0, "src": 0, "src_ip": 0,
        "src_port": 0, "transport": "-",
    },
    ("network", "ecs"): {
        "@timestamp": 1726531201.25, "network.application": "dns", "network.bytes": 1268, "source.bytes": 61,
        "destination.bytes": 1207, "destination.ip": "fd00::9", "destination.port": 5353, "network.packets": 5,
        "source.packets": 2, "destination.packets": 3, "source.ip": "192.168.40.17", "source.port": 40123,
        "network.protocol": "udp",
    },
    ("network empty", "ecs"): {
        "@timestamp": 1.5, "network.application": "-", "network.bytes": 0, "source.bytes": 0, "destination.bytes": 0,
        "destination.ip": 0, "destination.port": 0, "network.packets": 0, "source.packets": 0,
        "destination.packets": 0, "source.ip": 0, "source.port": 0, "network.protocol": "-",
    },
    ("network", "ocsf"): OCSF_NETWORK_SHARED | {
        "time": 1726531201.25, "dst_endpoint": {"port": 5353, "ip": "fd00::9"},
        "src_endpoint": {"port": 40123, "ip": "192.168.40.17"},
    },
    ("network empty", "ocsf"): OCSF_NETWORK_SHARED | {
        "time": 1.5, "dst_endpoint": {"port": 0, "ip": 0}, "src_endpoint": {"port": 0, "ip": 0},
    },
    ("network", "udm"): {
        "metadata": {"event_timestamp": 1726531201.25, "event_type": "NETWORK_CONNECTION"} | IDENTITY,
        "principal": {"ip": ["192.168.40.17"], "port": 40123}, "target": {"ip": ["fd00::9"], "port": 5353},
        "network": {"ipProtocol": "UDP", "applicationProtocol": "dns", "sentBytes": 61, "receivedBytes": 1207},
        "security_result": {"action": "ALLOW"},
    },
    ("network empty", "udm"): {
        "metadata": {"event_timestamp": 0, "event_type": "NETWORK_CONNECTION"} | IDENTITY,
        "principal": {"ip": [""], "port": 0}, "target": {"ip": [""], "port": 0},
        "network": {"ipProtocol": "", "applicationProtocol": "", "sentBytes": 0, "receivedBytes": 0},
        "security_result": {"action": "ALLOW"},
    },
    ("process", "cim"): {
        "timestamp": 1.5, "action": "allowed", "cpu_load_percent": "12.5", "dest": "unknown", "mem_used": "3.1",
        "original_file_name": "serve", "parent_process": "unknown", "parent_process_id": "77",
        "parent_process_name": "unknown", "parent_process_path": "unknown", "process": JOINED,
        "process_exec": "/opt/app/bin/serve", "process_id": "812", "process_name": "serve",
        "process_path": "/opt/app/bin", "user": "svc-web",
    },
    ("process", "ecs"): {
        "@timestamp": 1.5, "ecs.version": "8.17", "event.kind": "event", "event.category": "process",
        "event.type": "info", "process.args": ["/opt/app/bin/serve", "--name", "two", "words", "-v"],
        "process.args_count": 5, "process.command_line": JOINED,
        "process.executable": "/opt/app/bin/serve", "process.interactive": True, "process.name": "serve",
        "process.pgid": "810", "process.pid": "812", "process.start": "00:07:12", "process.tty": "pts/3",
        "process.uptime": "2-03:10:00", "user": "svc-web",
    },
    ("process", "ocsf"): {
        "time": 1.5, "activity_name": "query", "activity_id": "1", "category_uid": "5", "category_name": "Discovery",
        "class_uid": "5015", "class_name": "Process Query", "query_result": "Exists", "query_result_id": "1",
        "severity": "Informational", "severity_id": "1", "type_uid": "501599", "type_name": "Process Query: Other",
        "process": {
            "name": "serve", "pid": "812", "session": {"terminal": "pts/3"},
            "file": {
                "name": "serve", "type": "process", "path": "/opt/app/bin/serve", "type_id": "99",
                "parent_folder": "/opt/app/bin",
            },
            "user": {"name": "svc-web"}, "cmd_line": JOINED, "created_time": "00:07:12",
        },
        "metadata": {"version": "1.4.0", "product": {"name": "docker process logs"}},
    },
    ("process", "udm"): {
        "metadata": {"event_timestamp": 1.5, "event_type": "PROCESS_LAUNCH"} | IDENTITY,
        "principal": {"user": {"userid": "svc-web"}},
        "target": {
            "process": {
                "pid": "812", "parentProcess": {"pid": "77"}, "commandLine": JOINED,
                "file": {"full_path": "/opt/app/bin/serve"},
            }
        },
        "security_result": {"action": "ALLOW"},
    },
}

HEAD = f"CEF:0|{VENDOR}|{PRODUCT}|1.0|{VENDOR}-"
CEF_LINES = {
    "http": HEAD + r"HTTP-post|HTTP Activity: post|3|rt=1726531200750 src=192.168.40.17 spt=40122 dst=172.16.9.3 dpt=8080 "
    r"dhost=shop.intra:8080 app=http requestMethod=post request=http://Shop.intra:8080/a/../korb?artikel\=7&n\=2 "
    r"requestContext=https://Blog.example.org:444/x "
    "requestClientApplication=Pr\u00fcfer/2 (x\\=1) in=37 out=4096 cn1Label=statusCode cn1=201",
    "http empty": HEAD + "HTTP-Unknown|HTTP Activity: Unknown|3|rt=0 src= spt= dst= dpt= dhost= app=http requestMethod= "
    "request= requestContext= requestClientApplication= in=0 out=0 cn1Label=statusCode cn1=",
    "network": HEAD + "NET-CONN|Network Activity: Traffic|3|rt=1726531201250 src=192.168.40.17 spt=40123 dst=fd00::9 "
    "dpt=5353 proto=udp app=dns in=61 out=1207 cn1Label=packetsIn cn1=2 cn2Label=packetsOut cn2=3 act=allowed",
    "network empty": HEAD + "NET-CONN|Network Activity: Traffic|3|rt=0 src= spt= dst= dpt= proto= app= in=0 out=0 "
    "cn1Label=packetsIn cn1=0 cn2Label=packetsOut cn2=0 act=allowed",
    "process": HEAD + "PROC-SNAP|Process Activity: Snapshot|3|rt=1500 sproc=serve spid=812 dpid=77 suser=svc-web "
    'act=allowed cat=process cs1Label=commandLine cs1=/opt/app/bin/serve --name two words -v '
    "cs2Label=executablePath cs2=/opt/app/bin/serve cs3Label=tty cs3=pts/3",
}


@pytest.mark.parametrize("source, format", EXPECTED)
def test_whole_event(records, source, format):
    assert event(records, source, format) == EXPECTED[source, format]


@pytest.mark.parametrize("source", CEF_LINES)
def test_cef_line(records, source):
    assert event(records, source, "cef") == CEF_LINES[source]


def test_process_without_terminal_keeps_empty_session(records):
    got = event(records, "process empty", "ocsf")
    assert got["process"]["session"] == {} and got["process"]["user"] == {}


def test_typed_event_has_null_for_values_of_mixed_type(records):
    row = convert(records["http empty"], "http", "cim", now=NOW).first().event
    assert row.dest_port is None and row.dest == "-" and row.bytes == 0
    assert len(row.__fields__) == 33


def test_explicit_null_is_no_default(spark):
    line = json.dumps(HTTP | {"host": None, "id.resp_p": None, "uri": None, "method": None})
    rows = parse_lines(spark.createDataFrame([Row(value=line)]), "http")
    assert sorted(rows.first()[NULL_KEYS]) == ["host", "id.resp_p", "method", "uri"]
    got = json.loads(convert(rows, "http", "cim", output="document", now=NOW).first().event)
    assert not {"host", "dest_port", "url", "url_domain", "http_method"} & set(got)
    assert got["status"] == 201


def test_pass_through_values_of_any_json_type(spark, tmp_path):
    path = tmp_path / "http.log"
    path.write_text(json.dumps(HTTP | {"orig_mime_types": ["a", "b"], "cookie_vars": {"k": 1}}) + "\n")
    rows = spark.read.schema(ZEEK_HTTP).json(str(path))
    got = json.loads(convert(rows, "http", "cim", output="document", now=NOW).first().event)
    assert got["http_content_type"] == ["a", "b"] and got["cookie"] == {"k": 1}


def test_fan_out_equals_single_conversions(records):
    rows = fan_out(records["http"], "http", ["uid"], now=NOW).collect()
    assert [r.format for r in rows] == list(NORMALISED)
    for row in rows:
        single = convert(records["http"], "http", row.format, output="document", now=NOW)
        assert row.event == single.first().event


def test_identity_is_a_parameter(records):
    other = Identity("Acme", "probe|1", "2")
    line = convert(records["network"], "network", "cef", output="document", identity=other).first().event
    assert line.startswith("CEF:0|Acme|probe\\|1|2|Acme-NET-CONN|")


def test_now_is_one_instant(records):
    got = json.loads(convert(records["http empty"], "http", "ocsf", output="document").first().event)
    assert got["time"] == got["start_time"] > 1.7e9


def test_documents_keep_the_events_own_keys(spark):
    df = spark.sql("SELECT 'run' AS cve_name, 'http' AS log_type, named_struct('log_type', 'own', 'a', 1) AS event")
    assert documents(df).first().document.asDict() == {"cve_name": "run", "log_type": "own", "a": 1}


class TestMappingModel:
    def rendered(self, spark, fields):
        df = spark.sql("SELECT CAST(NULL AS STRING) AS gone, 'k\u00f6ln' AS town, 2.5D AS rate UNION ALL SELECT 'x', NULL, -1D")
        rows = apply_mapping(df, Mapping.of(fields), output="document").collect()
        return [json.loads(r.event) for r in rows]

    def test_levels_keep_their_order_and_lose_nulls(self, spark):
        fields = {
            "place": {"name": F.initcap("town"), "of": {"rate": "rate * 2"}},
            "a.b": F.col("gone"),
            "letters": "length(town)",
        }
        assert self.rendered(spark, fields) == [
            {"place": {"name": "K\u00f6ln", "of": {"rate": 5.0}}, "letters": 4},
            {"place": {"of": {"rate": -2.0}}, "a.b": "x"},
        ]

    def test_no_field_gives_an_empty_object(self, spark):
        assert self.rendered(spark, []) == [{}, {}]

    def test_unknown_output(self, spark):
        with pytest.raises(ValueError):
            apply_mapping(spark.range(1), Mapping.of({}), output="x")
