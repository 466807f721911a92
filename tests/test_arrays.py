"""The range-split reader of JSON arrays against the reader of whole documents."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from eventloom.sources import array_quarantine, document_rows, read_array_files

TEXTS = ["", "a", '"', "\\", '\\"', "}", "{", "]", "[", "},{", '}]"', "é😀", "\n", "\t", ",", "x" * 90]


def value(rng, depth=0):
    kind = rng.randint(0, 6 if depth < 3 else 3)
    if kind < 2:
        return "".join(rng.choices(TEXTS, k=rng.randint(0, 4)))
    if kind < 4:
        return rng.choice([None, True, 0, -1.5, 12345678901])
    if kind == 4:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return {f"k{i}{rng.choice(TEXTS)}": value(rng, depth + 1) for i in range(rng.randint(0, 3))}


def documents():
    """Arrays written in several ways, and texts that are no single array."""
    rng = random.Random(11)
    found = []
    for n in (0, 1, 2, 5, 40):
        array = [value(rng) if rng.random() < 0.3 else {"n": i, "v": value(rng)} for i in range(n)]
        for style in ({}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False}):
            found.append(rng.choice(["", " \n"]) + json.dumps(array, **style) + rng.choice(["", "\n "]))
    good = json.dumps([{"a": 1}, {"b": {"c": "}"}}, 7])
    found += [
        good + good, good[:-1], good[:-5], good + "]", good[1:], good.replace("7", "7,"), "[,]", "[1,,2]",
        '[{"a":1}{"b":2}]', '[{"a":1}],[{"b":2}]', '[{"a":1},]', '[{"a":"}', "]", '[{"a":1}', '[1,{"a":2}, 3 ,"}"]',
        '[{"a":1,"a":2},{"b":1}]', '[{"a":[1,{"x":1}]},[{"y":2}],{"z":3}]', "[]", " [ ] ", '["a}b"]', "[}", "[{]}",
    ]
    return found


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("arrays")
    for i, text in enumerate(documents()):
        (root / f"d{i:03}.json").write_bytes(text.encode())
    return str(root)


@pytest.fixture(params=[5, 200, 1 << 27])
def range_bytes(spark, request):
    """Ranges of this many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    spark.conf.set(keys[0], str(request.param))
    spark.conf.set(keys[1], "0")
    yield request.param
    for k, v in before.items():
        spark.conf.set(k, v)


def listed(rows):
    text = F.to_json("event").alias("event")
    return sorted((r.name, r.event) for r in rows.select(F.substring_index("path", "/", -1).alias("name"), text).collect())


def whole(spark, folder):
    texts = spark.read.text(folder, wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    texts = texts.filter(F.col("value").rlike(r"^\s*\["))
    return document_rows(texts)


def test_every_range_size_gives_the_same_events(spark, folder, range_bytes):
    want = listed(whole(spark, folder))
    assert len(want) > 100
    assert listed(read_array_files(spark.read, folder)) == want


def test_broken_files_are_in_quarantine(spark, folder, range_bytes):
    held = {name for name, _ in listed(whole(spark, folder))}
    empty = {
        f"d{i:03}.json" for i, t in enumerate(documents()) if t.split() in (["[]"], ["[", "]"])
    }
    broken = {r.path.rsplit("/", 1)[1] for r in array_quarantine(spark.read, folder).collect()}
    assert broken == {f"d{i:03}.json" for i in range(len(documents()))} - held - empty
    kept = {name for name, _ in listed(read_array_files(spark.read, folder, salvage=True))}
    assert kept > held


def test_many_tasks_share_one_file(spark, tmp_path):
    events = [{"n": i, "text": "}{" * (i % 9) + '\\"' * (i % 3)} for i in range(20_000)]
    (tmp_path / "big.json").write_text(json.dumps(events))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        rows = read_array_files(spark.read, str(tmp_path))
        found = rows.select(F.variant_get("event", "$.n", "bigint").alias("n")).agg(
            F.count("*"), F.sum("n")
        )
        assert spark.read.text(str(tmp_path), lineSep="}").rdd.getNumPartitions() > 8
        assert tuple(found.first()) == (20_000, sum(range(20_000)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
