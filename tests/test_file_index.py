"""File indexes: the same answers as a scan, after appends and replaced runs."""

from __future__ import annotations

import random

import pyarrow as pa

from eventloom.operators import detect, file_index
from eventloom.sinks import write_event_store

WORDS = ["alpha", "beta", "gamma", 'quote"d', "é😀x", "10.0.0.1", "zz"]


def event_rows(seed, runs, count=60):
    rng = random.Random(seed)
    return [
        (rng.choice(["cim", "cef"]), "http", run, "http", " ".join(rng.choices(WORDS[i % 3 :: 3], k=5)))
        for i, run in enumerate(runs) for _ in range(count)
    ]


def events(spark, rows):
    return spark.createDataFrame(
        rows + [("cim", "http", "none", "http", None)],
        "format string, log_family string, cve_name string, log_type string, event string",
    ).repartition(3)


def counted(df):
    return sorted(map(tuple, df.select("cve_name", "format", "log_type", "events").collect()))


def agree(spark, store):
    whole = spark.read.parquet(store)
    files = whole.select("_metadata.file_path").distinct().count()
    opened = {}
    for pattern in ["alpha", "😀x ", "not there", "ga"]:
        want = counted(detect.runs_with_text(whole, pattern))
        found = file_index.events_with_text(spark, store, pattern)
        assert counted(detect.runs_with_text(found, pattern)) == want
        opened[pattern] = file_index.files_with_text(spark, store, pattern).count()
    assert opened["not there"] == 0 and opened["ga"] == files
    assert 0 < opened["alpha"] < files
    return files


def test_texts_after_append_and_replaced_run(spark, tmp_path):
    store = str(tmp_path / "store")
    write_event_store(events(spark, event_rows(1, ["a b", "c%d", "e=f"])), store)
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        first = file_index.update_text_index(spark, store)
        assert first == spark.read.parquet(store).select("_metadata.file_path").distinct().count()
        assert file_index.update_text_index(spark, store) == 0
        write_event_store(events(spark, event_rows(2, ["a b", "new"])), store)
        more = file_index.files_with_text(spark, store, "not there").count()
        assert more > 0  # files not indexed yet are opened
        assert file_index.update_text_index(spark, store) == more
        replaced = [r for r in event_rows(9, ["c%d"]) if r[0] == "cim"]
        write_event_store(events(spark, replaced), store, mode="overwrite")
        file_index.update_text_index(spark, store)
        agree(spark, store)
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def connections(spark, seed, runs):
    rng = random.Random(seed)
    ports = [None, 0, 1, 80, 4444, 32768, 32769, 65535]
    rows = [
        (run, rng.choice(ports[i:]), rng.choice(ports[: i + 1]), rng.random())
        for i, run in enumerate(runs) for _ in range(4)
    ]
    schema = "cve_name string, `id.orig_p` bigint, `id.resp_p` bigint, ts double"
    return spark.createDataFrame(rows, schema).repartition(2)


def same_detection(spark, store, port):
    found = file_index.detect_port_indexed(spark, store, port)
    want = detect.detect_port(spark.read.parquet(store), port)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_ports_after_append_and_replaced_run(spark, tmp_path):
    store = str(tmp_path / "store")
    for step, runs in enumerate([["a", "b", "c"], ["b", "d"], ["c"]]):
        rows = connections(spark, step, runs)
        writer = rows.write.mode("overwrite" if step == 2 else "append")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("cve_name").parquet(store)
        file_index.update_port_index(spark, store)
        whole = spark.read.parquet(store)
        found = file_index.ports_seen_indexed(spark, store, ["cve_name"])
        want = detect.ports_seen(whole, ["cve_name"])
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
        same_detection(spark, store, 4444)
        for port in (0, 32768, 7):
            hit = whole.filter(detect.port_match(port)).select("_metadata.file_path").distinct()
            assert file_index.files_with_port(spark, store, port).count() == hit.count()


def test_a_store_that_is_not_indexed_is_scanned(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = connections(spark, 5, ["a", "b", "c"])
    rows.write.partitionBy("cve_name").parquet(store)
    same_detection(spark, store, 80)


def test_bits_of_a_file_are_those_of_the_bytes_of_its_texts():
    rng = random.Random(3)
    texts = [None, "", "a", "ab", "é", "x" * (1 << 20), "the end"]
    texts += ["".join(rng.choices("ab é😀\0", k=rng.randrange(9))) for _ in range(300)]
    files = [7] * 100 + [8] * 207
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array(files[i : i + 50]), pa.array(["r"] * len(files[i : i + 50])),
             pa.array(texts[i : i + 50], pa.string())], ["file_id", "cve_name", "text"],
        ) for i in range(0, len(files), 50)
    ]
    found = [r for b in file_index._text_bits(iter(batches)) for r in b.to_pylist()]
    assert [r["file_id"] for r in found] == [7, 8]  # a row a file, not one a trigram
    for row in found:
        said = [t.encode() for t, f in zip(texts, files) if f == row["file_id"] and t]
        want = {file_index._bit(t[i : i + 3]) for t in set(said) for i in range(len(t) - 2)}
        bits = int.from_bytes(row["bits"], "little")
        assert {i for i in range(file_index.BITS) if bits >> i & 1} == want
