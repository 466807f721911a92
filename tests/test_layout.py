"""A small log layout on disk: readers, loaders, sinks and streams, end to end."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from eventloom.constants import FORMAT_TABLES, NORMALISED
from eventloom.functions import cef_escape_extension, cef_escape_header, cef_line
from eventloom.operators import (
    detect_port,
    fan_out,
    missing_artefacts,
    missing_formats,
    quiet_snapshots,
    runs_with_text,
    with_path_columns,
)
from eventloom.sinks import (
    create_log_tables,
    load_log_tables,
    write_documents,
    write_event_files,
    write_event_store,
    write_json_array,
)
from eventloom.sources import (
    document_rows,
    good_records,
    list_artefacts,
    quarantine,
    read_layout,
    read_log,
    read_process_tables,
    read_runs,
)
from eventloom.sources.documents import read_format, read_manifest, read_quarantine
from eventloom.streaming import (
    alert_once,
    monitor_layout,
    read_alerts,
    read_log_stream,
    route_batches,
)
from eventloom.operators.detect import port_match
from tests.test_conversions import CONN, HTTP


@pytest.fixture
def layout(tmp_path):
    """Two runs, one with a connection on port 4444; a broken and a comment line."""
    root = tmp_path / "data"

    def put(run, folder, name, text):
        path = root / run / folder
        path.mkdir(parents=True, exist_ok=True)
        (path / name).write_text(text)

    shell = CONN | {"id.resp_p": 4444, "ts": 1700000007.0}
    put("CVE-1", "zeek", "conn.log", "\n".join(map(json.dumps, [CONN, shell])) + "\n#comment\n\n{broken\n")
    put("CVE-1", "zeek", "http.log", json.dumps(HTTP) + "\n")
    put("CVE-1", "zeek", "dns.log", json.dumps({"query": "x"}) + "\n")
    put("CVE-2", "zeek", "conn.log", json.dumps(CONN) + "\n")
    put("CVE-1", "cim", "cim_http.log", json.dumps([{"src": "a"}, {"src": "b"}]))
    put("CVE-1", "cim", "cim_network.log", json.dumps({"dest_port": 4444}))
    put("CVE-1", "cim", "cim_process_1700000000.12.log", "[{]")
    put("CVE-1", "ecs", "ecs_http.log", '{"a": 1} {"b": 2}')
    put("CVE-1", "ocsf", "ocsf_http.log", "")
    put("CVE-1", "cef", "cef_http.log", "CEF:0|a \n\n \t\nCEF:0|b\r\n")
    put("CVE-1", "pcap", "CVE-1.pcap", "x")
    return str(root)


def test_read_by_exact_name(spark, layout):
    assert read_log(spark, layout, "http").count() == 1
    conn = read_runs(spark, layout, "network")
    assert sorted((r.cve_name, r.format, r.log_type) for r in conn.collect()) == [
        ("CVE-1", "zeek", "conn"), ("CVE-1", "zeek", "conn"), ("CVE-2", "zeek", "conn"),
    ]


def test_broken_lines(spark, layout):
    log = read_log(spark, layout, "network")
    assert sorted(r._corrupt_record for r in quarantine(log).collect()) == ["#comment", "{broken"]
    assert good_records(log).count() == 3
    with pytest.raises(Exception, match="MALFORMED_RECORD_IN_PARSING"):
        read_log(spark, layout, "network", strict=True).collect()


def test_port_detection(spark, layout):
    got = {r.cve_name: r for r in detect_port(read_runs(spark, layout, "network"), 4444).collect()}
    assert (got["CVE-1"].detected, got["CVE-1"].connections, got["CVE-1"].first_ts) == (True, 1, 1700000007.0)
    assert (got["CVE-2"].detected, got["CVE-2"].connections, got["CVE-2"].first_ts) == (False, 0, None)


def test_layout_events(spark, layout):
    events = read_layout(spark, layout)
    assert set(events) == {"zeek", "cim", "ecs", "ocsf", "cef"}
    counts = {name: df.count() for name, df in events.items()}
    assert counts == {"zeek": 5, "cim": 3, "ecs": 0, "ocsf": 0, "cef": 2}
    assert {r.log_type for r in events["zeek"].collect()} == {"conn", "http", "dns"}
    assert sorted(r.event for r in events["cef"].collect()) == ["CEF:0|a", "CEF:0|b"]


def test_artefacts_and_gaps(spark, layout):
    files = list_artefacts(spark, layout).filter("length > 0")
    gaps = {(r.cve_name, r.format) for r in missing_formats(files, expected=("zeek", "cim", "ecs", "ocsf")).collect()}
    assert gaps == {("CVE-1", "ocsf"), ("CVE-2", "cim"), ("CVE-2", "ecs"), ("CVE-2", "ocsf")}


def test_complete_runs(spark, layout):
    files = list_artefacts(spark, layout)
    assert {(r.cve_name, r.format) for r in missing_artefacts(files).collect()} == {
        ("CVE-1", "ocsf"), ("CVE-2", "pcap"), ("CVE-2", "cim"), ("CVE-2", "ecs"), ("CVE-2", "ocsf"),
    }
    runs = spark.createDataFrame([("CVE-1",), ("CVE-3",)], "cve_name string")
    gaps = {(r.cve_name, r.format) for r in missing_artefacts(files, runs).collect()}
    assert {f for run, f in gaps if run == "CVE-3"} == {"pcap", "zeek", "cim", "ecs", "ocsf"}


def test_log_tables(spark, layout):
    spark.sql("CREATE DATABASE IF NOT EXISTS logs")
    create_log_tables(spark, "logs.")
    create_log_tables(spark, "logs.")
    events = read_layout(spark, layout)
    load_log_tables(events, "logs.")
    counts = {f: spark.table(f"logs.{t}").count() for f, t in FORMAT_TABLES.items()}
    assert counts == {"zeek": 5, "cim": 3, "ecs": 0, "ocsf": 0, "cef": 2, "udm": 0}
    load_log_tables(events, "logs.")
    assert spark.table("logs.cim_logs").count() == 6
    load_log_tables(events, "logs.", replace_runs=True)
    assert spark.table("logs.cim_logs").count() == 3
    found = spark.sql("SELECT cve_name FROM logs.cim_logs WHERE variant_get(event, '$.dest_port', 'int') = 4444")
    assert [r.cve_name for r in found.collect()] == ["CVE-1"]
    assert spark.table("logs.cef_logs").schema["event"].dataType.typeName() == "string"


def events_of(spark, layout):
    conn = read_runs(spark, layout, "network")
    return fan_out(conn.drop("format", "log_family"), "network", ["cve_name", "log_type"])


def test_text_search(spark, layout):
    got = {(r.cve_name, r.format): r.events for r in runs_with_text(events_of(spark, layout), "4444").collect()}
    assert got == {("CVE-1", f): 1 for f in NORMALISED}


@pytest.mark.parametrize("rebalance", [False, True])
def test_event_files(spark, layout, tmp_path, rebalance):
    path = str(tmp_path / "files")
    write_event_files(events_of(spark, layout), path, rebalance)
    lines = spark.read.text(path)
    assert lines.count() == 15
    cef = lines.filter("format = 'cef'").collect()
    assert all(r.value.startswith("CEF:0|") and r.log_family == "network" for r in cef)
    assert all(json.loads(r.value) for r in lines.filter("format <> 'cef'").collect())


def test_event_store_and_arrays(spark, layout, tmp_path):
    store = str(tmp_path / "store")
    write_event_store(events_of(spark, layout), store)
    events = spark.read.parquet(store)
    assert events.count() == 15
    arrays = str(tmp_path / "arrays")
    write_json_array(events.filter("format = 'cim'"), arrays, most=2)
    documents = spark.read.text(arrays, wholetext=True)
    assert all(isinstance(json.loads(r.value), list) for r in documents.collect())
    assert document_rows(documents).count() == 3


def test_search_documents(spark, layout, tmp_path):
    path = str(tmp_path / "index")
    write_documents(events_of(spark, layout), path)
    rows = [json.loads(r.value) for r in spark.read.text(f"{path}/format=ecs").collect()]
    assert len(rows) == 3 and all(r["log_type"] == "conn" and "destination.port" in r for r in rows)
    rows = [json.loads(r.value) for r in spark.read.text(f"{path}/format=cef").collect()]
    assert all(set(r) == {"cve_name", "log_type", "event"} for r in rows)


def test_process_tables(spark, tmp_path):
    path = tmp_path / "top.json"
    tables = [
        {"Titles": ["USER", "PID", "USER", "COMMAND"], "Processes": [["a", "1", "b", "x y"], ["c", "2"]]},
        {"Titles": None, "Processes": None},
    ]
    path.write_text("\n".join(map(json.dumps, tables)))
    rows = [(r.USER, r.PID, r.COMMAND, r.TT) for r in read_process_tables(spark, str(path)).collect()]
    assert rows == [("b", "1", "x y", None), ("c", "2", None, None)]
    snapshot = tmp_path / "process_1700000000.25.json"
    snapshot.write_text(json.dumps(tables[0]))
    rows = read_process_tables(spark, str(snapshot))
    events = fan_out(rows, "process", formats=["cim"]).collect()
    assert [json.loads(r.event)["timestamp"] for r in events] == [1700000000.25] * 2


def test_stream_equals_batch(spark, layout, tmp_path):
    log = read_log_stream(spark, layout, "network")
    stream = with_path_columns(good_records(log), "source_path").drop("format", "log_family")
    events = fan_out(stream, "network", ["cve_name", "log_type"], now=1.0)
    target = str(tmp_path / "routed")
    route_batches(events, target, str(tmp_path / "state")).awaitTermination()
    got = sorted((r.cve_name, r.format, r.event) for r in spark.read.parquet(target).collect())
    assert got == sorted((r.cve_name, r.format, r.event) for r in events_of(spark, layout).collect())
    # Nothing new: nothing more is written.
    route_batches(events, target, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(target).count() == len(got)


def test_monitor_sees_new_files_once(spark, layout, tmp_path):
    def run():
        for q in monitor_layout(spark, layout, lambda f: str(tmp_path / "seen" / f), str(tmp_path / "cp"), ("cim", "cef")):
            q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "seen" / "cim")).count()

    assert run() == 3
    assert run() == 3
    (tmp_path / "data" / "CVE-2" / "cim").mkdir()
    (tmp_path / "data" / "CVE-2" / "cim" / "cim_http.log").write_text('[{"src": "c"}]')
    assert run() == 4
    assert spark.read.parquet(str(tmp_path / "seen" / "cef")).count() == 2


def test_alert_once_per_run(spark, layout, tmp_path):
    target = str(tmp_path / "alerts")

    def alerts():
        stream = with_path_columns(good_records(read_log_stream(spark, layout, "network")), "source_path")
        alert_once(stream, port_match(4444), target, str(tmp_path / "cp")).awaitTermination()
        return sorted((r.cve_name, r.ts) for r in read_alerts(spark, target).collect())

    assert alerts() == [("CVE-1", 1700000007.0)]
    # Runs that are years older alert as well, and an earlier record corrects.
    for run, folder, ts in (
        ("CVE-3", "zeek", 1500000000.0), ("CVE-1", "pcap", 1600000000.0), ("CVE-3", "pcap", 1800000000.0)
    ):
        late = tmp_path / "data" / run / folder
        late.mkdir(parents=True, exist_ok=True)
        (late / "conn.log").write_text(json.dumps(CONN | {"id.resp_p": 4444, "ts": ts}) + "\n")
        alerts()
    assert alerts() == [("CVE-1", 1600000000.0), ("CVE-3", 1500000000.0)]


def test_records_of_other_types_are_kept(spark, tmp_path):
    folder = tmp_path / "a b+%" / "zeek"
    folder.mkdir(parents=True)
    lines = [
        '{"uid": "1", "id.resp_p": "443", "orig_bytes": 10}',
        '{"uid": "2", "id.resp_p": 443, "orig_bytes": 1.5}',
        '{"uid": "3", "id.resp_p": 80, "id.resp_p": 443, "ts": 1.0}',
        '{"uid": "4", "id.resp_p": 443, "ts": 1e17, "orig_bytes": 9223372036854775807, "resp_bytes": 1}',
        '{"uid": "5", "id.resp_p": [443]}',
        "[1]", "7", "#comment", '{"uid": "6", "id.re', "  ",
    ]
    (folder / "conn.log").write_text("\n".join(lines))
    log = read_log(spark, str(tmp_path), "network")
    good = read_runs(spark, str(tmp_path), "network")
    assert good.count() == good.select("uid").count() == len(good.collect()) == 5
    assert quarantine(log).count() == 4 and log.count() == 9
    found = {r.uid: (r["id.resp_p"], r.orig_bytes) for r in good.collect()}
    assert found == {
        "1": (443, 10), "2": (443, 1), "3": (443, None), "4": (443, 9223372036854775807), "5": (None, None),
    }
    assert {r.cve_name for r in good.collect()} == {"a b+%"}
    assert detect_port(good, 443).first().connections == 4
    events = fan_out(good.drop("format", "log_family"), "network", ["uid"])
    assert len(events.collect()) == 25


def test_one_run_with_most_of_the_rows(spark):
    """Answers stay whole when one run holds nearly everything."""
    ids = spark.range(30000)
    run = F.when(F.col("id") % 100 < 90, F.lit("hot")).otherwise(F.concat(F.lit("r"), F.col("id") % 7))
    conn = ids.select(
        run.alias("cve_name"), F.col("id").cast("double").alias("ts"),
        (F.col("id") % 500).alias("id.orig_p"), F.lit(80).cast("bigint").alias("id.resp_p"),
    )
    got = {r.cve_name: r for r in detect_port(conn, 42).collect()}
    assert got["hot"].connections == 60 and got["hot"].first_ts == 42.0
    assert len(got) == 8 and not got["r1"].detected
    rows = conn.select(F.lit("t").alias("target"), "ts", (F.floor(F.col("ts") / 2) % 2).cast("string").alias("log"))
    quiet = quiet_snapshots(rows, "target", ["ts"], "log", F.floor(F.col("ts") / 1001))
    assert quiet.count() == 15000 and quiet.filter("ts % 2 <> 1").count() == 0


def test_quiet_snapshots_across_buckets(spark):
    rows = [("t", i, c) for i, c in enumerate("aabbbcacc")] + [("u", 0, "a"), ("u", 9, "a")]
    df = spark.createDataFrame(rows, "target string, seq int, log string")
    for width in (1, 2, 3, 100):
        quiet = quiet_snapshots(df, "target", ["seq"], "log", F.floor(F.col("seq") / width))
        assert sorted((r.target, r.seq) for r in quiet.collect()) == [("t", 1), ("t", 3), ("t", 4), ("t", 8), ("u", 9)]


def test_cef_escapes(spark):
    def value(column):
        return spark.range(1).select(column.alias("v")).first().v

    assert value(cef_escape_header(F.lit("a|b"))) == "a\\|b"
    assert value(cef_escape_header(F.lit("a\\b"))) == "a\\\\b"
    assert value(cef_escape_header(F.lit("a\\|b"))) == "a\\\\\\|b"
    assert value(cef_escape_extension(F.lit("key=val"))) == "key\\=val"
    assert value(cef_escape_extension(F.lit("a\nb"), escape_newlines=True)) == "a\\nb"
    header = [F.lit(x) for x in ("Ven|dor", "Pro\\duct", "1.0", "100", "Test", "5")]
    assert value(cef_line(header, [])) == "CEF:0|Ven\\|dor|Pro\\\\duct|1.0|100|Test|5|"
    extensions = [("src", F.lit("10.0.0.1")), ("none", F.lit(None).cast("string")), ("kept", F.lit(""))]
    assert value(cef_line(header, extensions)).endswith("|5|src=10.0.0.1 kept=")


def test_documents_and_manifests_over_several_lines(spark, tmp_path):
    folder = tmp_path / "layout" / "CVE-1" / "ecs"
    folder.mkdir(parents=True)
    (folder / "a.json").write_text('[\n  {"n": 1},\n  {"n": 2}\n]\n')
    (folder / "b.json").write_text('{\n  "n": 3\n}\n')
    events = read_format(spark.read, str(tmp_path / "layout"), "ecs")
    found = events.select(F.variant_get("event", "$.n", "int")).collect()
    assert sorted(r[0] for r in found) == [1, 2, 3]
    manifest = tmp_path / "runs.json"
    manifest.write_text('[\n  {\n    "name": "one"\n  },\n  {\n    "name": "two"\n  }\n]\n')
    assert read_manifest(spark, str(manifest)).count() == 2


def test_no_document_or_line_is_lost_without_a_word(spark, tmp_path):
    layout = tmp_path / "layout"
    for name, text in {
        "ecs/a.json": '[{"k": 1, "k": 2}, {"k": 3}]',
        "ecs/b.json": '{"k": 4, "k": "5"}',
        "ecs/c.json": '{"k": {"a": 1, "a": 2}}',
        "ecs/d.json": "[1, 2",
        "zeek/conn.log": '# comment\n\n{"k": 6, "k": 7}\nbroken\n{"k": 8}',
    }.items():
        file = layout / "run" / name
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_text(text)
    got = {
        x: sorted(
            r.k for r in read_format(spark.read, str(layout), x)
            .select(F.variant_get("event", "$.k", "bigint").alias("k")).collect()
        )
        for x in ("ecs", "zeek")
    }
    assert got == {"ecs": [2, 3, 5], "zeek": [7, 8]}
    lost = {
        x: sorted(r.value for r in read_quarantine(spark.read, str(layout), x).collect())
        for x in ("ecs", "zeek")
    }
    assert lost == {"ecs": ["[1, 2", '{"k": {"a": 1, "a": 2}}'], "zeek": ["broken"]}
    place = lambda kind: lambda x: str(tmp_path / kind / x)
    jobs = monitor_layout(
        spark, str(layout), place("out"), str(tmp_path / "seen"), ("ecs", "zeek"), place("bad")
    )
    for job in jobs:
        job.awaitTermination()
    assert [spark.read.parquet(place("out")(x)).count() for x in ("ecs", "zeek")] == [3, 2]
    assert [spark.read.parquet(place("bad")(x)).count() for x in ("ecs", "zeek")] == [2, 1]


def test_an_array_above_the_size_of_a_variant_keeps_its_events(spark):
    elements = F.expr("sequence(1, 140000)")
    text = F.transform(elements, lambda i: F.concat(
        F.lit('{"k":'), i.cast("string"), F.lit(',"p":"'), F.repeat(F.lit("x"), 1000), F.lit('"}')))
    big = spark.range(1).select(F.concat(F.lit("["), F.array_join(text, ","), F.lit("]")).alias("value"))
    k = F.variant_get("event", "$.k", "bigint")
    assert tuple(document_rows(big).agg(F.count(k), F.sum(k)).first()) == (140_000, 9_800_070_000)
