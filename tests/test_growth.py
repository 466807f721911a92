"""What must not grow faster than the input: arrays, files, settings looked at again."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from eventloom.functions import option_map
from eventloom.functions.scalars import STRIP_CHARACTERS
from eventloom.operators import cluster_by_run
from eventloom.plans import QUERIES
from eventloom.session import setting
from eventloom.sinks import (
    write_documents,
    write_event_files,
    write_event_store,
    write_json_array,
)
from eventloom.sources import document_rows
from tests.test_queries import SF_DIR


def events(spark, count):
    run = F.concat(F.lit("r"), (F.col("id") % 20).cast("string"))
    return spark.range(0, count, 1, 1).select(
        F.lit("cim").alias("format"), run.alias("cve_name"), F.lit("http").alias("log_type"),
        F.concat(F.lit('{"a name that every event has":'), "id", F.lit("}")).alias("event"),
    )


@pytest.mark.parametrize(
    "name",
    ["k03_process_snapshots", "k01_clustered_by_run", "s09_k06_stream_routing", "t01_stream_cim"],
)
def test_events_are_not_sorted_into_their_folders(spark, name, monkeypatch):
    """With as many writers as folders, a task's events need no memory of their own."""
    key = "spark.sql.maxConcurrentOutputFileWriters"
    seen = []
    for kind in ("parquet", "text"):
        write = getattr(DataFrameWriter, kind)

        def told(self, path, *a, write=write, **b):
            seen.append(int(self._spark.conf.get(key)))
            return write(self, path, *a, **b)

        monkeypatch.setattr(DataFrameWriter, kind, told)
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        QUERIES[name](spark, SF_DIR)
        assert seen and min(seen) >= 100 and spark.conf.get(key) == "0"
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("write", [write_event_files, write_event_store])
def test_a_task_renders_a_small_share_of_clustered_records(spark, write, tmp_path):
    """Many runs are more folders than a task keeps open: it sorts the events of its share."""
    key, shares = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    records = spark.range(0, 200_000, 1, 16).select(
        F.concat(F.lit("r"), (F.col("id") % 60).cast("string")).alias("cve_name"),
        F.sha2(F.col("id").cast("string"), 512).alias("text"),
    )
    rendered = cluster_by_run(records).select(
        F.explode(F.array(F.lit("cim"), F.lit("cef"), F.lit("udm"))).alias("format"),
        F.lit("http").alias("log_family"), "cve_name",
        F.concat(F.spark_partition_id().cast("string"), F.lit(" "), "text").alias("event"),
    )
    with setting(spark, shares, "2"):
        write(rendered, str(tmp_path))
    assert spark.conf.get(key) == before
    files = spark.read.text if write is write_event_files else spark.read.parquet
    rows = files(str(tmp_path)).withColumnRenamed("value", "event")
    tasks = rows.groupBy(F.split("event", " ")[0].alias("task")).agg(
        F.count("*").alias("events"), F.count_distinct("cve_name", "format").alias("folders")
    )
    found = tasks.collect()
    assert sum(t.events for t in found) == 600_000
    # 28 MB or so are moved, in two parts.
    assert max(t.events for t in found) < 200_000
    assert rows.select("cve_name", "format").distinct().count() == 180


def test_process_records_are_clustered_before_they_are_rendered(spark, monkeypatch):
    from eventloom.plans import storage

    found = []
    render = storage.fan_out

    def told(df, *a, **b):
        found.append(df._jdf.queryExecution().optimizedPlan().toString())
        return render(df, *a, **b)

    monkeypatch.setattr(storage, "fan_out", told)
    QUERIES["k03_process_snapshots"](spark, SF_DIR)
    assert len(found) == 1 and "RebalancePartitions [cve_name" in found[0]


def test_option_map_against_a_model(spark):
    rng = random.Random(4)
    bits = ["set ", "SET ", "set", ";", ";", " ", "　", "\n", "a", "B", "é", "k v", "x", "\x00"]
    texts = ["".join(rng.choices(bits, k=rng.randrange(14))) for _ in range(3000)] + [None]
    space = "[" + STRIP_CHARACTERS + "]"
    part = re.compile(f"(?is)^set {space}*([^{STRIP_CHARACTERS}]+){space}+(.+)$")

    def model(text):
        if text is None:
            return None
        parts = (part.match(p.strip(STRIP_CHARACTERS)) for p in text.split(";"))
        return {m[1]: m[2] for m in parts if m}

    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", option_map(F.col("t")).alias("m")).collect():
        assert row.m == model(row.t), repr(row.t)


def test_option_map_looks_at_each_setting_once(spark):
    text = ";".join(f"set K{i % 1500} {i}" for i in range(3000))
    began = time.monotonic()
    got = spark.createDataFrame([(text,)], "t string").select(option_map(F.col("t"))).first()[0]
    assert time.monotonic() - began < 10
    assert len(got) == 1500 and got["K7"] == "1507"


def test_arrays_are_full_where_runs_take_turns(spark, tmp_path):
    path = str(tmp_path / "arrays")
    write_json_array(events(spark, 4000), path, most=100)
    documents = spark.read.text(path, wholetext=True)
    assert documents.count() == 40  # 200 events of each of twenty runs
    rows = document_rows(documents).select("cve_name", F.to_json("event").alias("event"))
    assert rows.distinct().count() == 4000
    sizes = documents.select(F.json_array_length("value").alias("n")).distinct().collect()
    assert [r.n for r in sizes] == [100]


def test_search_documents_are_gzipped(spark, tmp_path):
    write_documents(events(spark, 5000), str(tmp_path))
    files = [f for f in tmp_path.rglob("part-*") if f.is_file()]
    assert files and all(f.name.endswith(".txt.gz") for f in files)
    rows = spark.read.json(f"{tmp_path}/format=cim")
    assert rows.count() == 5000 and set(rows.columns) >= {"cve_name", "log_type"}
