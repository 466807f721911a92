"""Event files written here are found again by the layout reader."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.sinks import write_event_files
from eventloom.sources import read_layout


def test_every_event_comes_back(spark, tmp_path):
    rows = [
        ("cim", "http", "007", '{"a": 1}'), ("cim", "network", "a b=c%/é", '{"a": 2}'),
        ("ecs", "http", "007", '{"x": [1, {"y": "}"}]}'), ("cef", "http", "007", "CEF:0|a|b| x=1"),
        ("cef", "http", "007", "CEF:0|a|b| x=1"), ("udm", "process", "r", '{"k":null}'),
    ]
    df = spark.createDataFrame(rows, "format string, log_family string, cve_name string, event string")
    write_event_files(df, str(tmp_path))
    found = read_layout(spark, str(tmp_path))
    assert set(found) == {"cim", "ecs", "cef", "udm"}
    got = []
    for name, events in found.items():
        text = F.col("event") if name == "cef" else F.to_json("event")
        got += [tuple(r) for r in events.select("format", "log_family", "cve_name", text).collect()]
    assert sorted(got) == sorted(
        (f, k, r, e if f == "cef" else e.replace(" ", "")) for f, k, r, e in rows
    )
    assert {r.log_type for r in found["cim"].collect()} == {"http", "network"}


def test_event_files_are_gzipped_and_none_is_sorted_into_place(spark, tmp_path):
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        run = F.concat(F.lit("r"), (F.col("id") % 20).cast("string"))
        events = spark.range(20_000).select(
            F.lit("cim").alias("format"), F.lit("http").alias("log_family"), run.alias("cve_name"),
            F.concat(F.lit('{"a name that every event has":'), "id", F.lit("}")).alias("event"),
        )
        write_event_files(events, str(tmp_path))
        assert spark.conf.get(key) == "0"
    finally:
        spark.conf.set(key, before)
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    text = events.select(F.sum(F.length("event") + 1)).first()[0]
    assert sum(f.stat().st_size for f in files) < text / 4
    lines = spark.read.text(str(tmp_path)).select("cve_name", F.col("value").alias("event"))
    want = events.select("cve_name", "event")
    assert lines.exceptAll(want).isEmpty() and want.exceptAll(lines).isEmpty()
