"""Manifest rules, defaults and option strings."""

from __future__ import annotations

import json

import pytest

from eventloom.functions import option_map
from eventloom.operators import read_entries, resolve_runs, valid_runs, validate_manifest
from eventloom.sources import read_manifest
from pyspark.sql import functions as F


def docker(**settings):
    base = {"description": "A test", "exploit": "exploit/test", "target_image": "img:latest"}
    return {"name": "run-1", "settings": base | settings}


def compose(**settings):
    base = {"description": "A test", "exploit": "exploit/test", "yml_file": "c.yml", "target_name": "web"}
    return {"name": "run-2", "settings": base | settings}


def without(entry, key):
    return entry | {"settings": {k: v for k, v in entry["settings"].items() if k != key}}


def errors(spark, document, strict=False):
    text = document if isinstance(document, str) else json.dumps(document)
    entries = read_entries(spark.createDataFrame([(text,)], "value string"))
    rows = validate_manifest(entries, strict).orderBy("entry_no", "seq").collect()
    return [(r.rule, r.message) for r in rows]


INTEGER_SETTINGS = [
    "target_delay", "exploit_retries", "exploit_check_delay", "exploit_check_count", "ready_delay", "ready_retries",
]


def test_valid_entries(spark):
    good = [
        docker(), compose(), without(docker(), "exploit"), docker(exploit=""), docker(target_delay="5"),
        docker(exploit_mode="cli"), docker(exploit_mode="rpc"), docker(**{k: 10 for k in INTEGER_SETTINGS}),
    ]
    assert errors(spark, good) == []


@pytest.mark.parametrize(
    "document, rule, text",
    [
        ([], "V1", "non-empty"),
        ({"name": "x"}, "V1", "non-empty"),
        ("[{]", "V0", "Invalid JSON"),
        ("[] []", "V0", "Invalid JSON"),
        (["not a dict"], "V2", "Entry 1: must be a JSON object, got str."),
        ([None], "V2", "got NoneType."),
        ([{"settings": docker()["settings"]}], "V3", "missing required field 'name'"),
        ([docker() | {"name": 123}], "V4", "Entry 1: 'name' must be a string."),
        ([{"name": "x"}], "V5", "Entry 1 ('x'): missing required field 'settings'."),
        ([{"name": "x", "settings": [1]}], "V6", "'settings' must be a JSON object."),
        ([without(docker(), "description")], "V7", "missing required setting 'description'."),
        ([docker(description=None)], "V7", "setting 'description' must be a string."),
        ([docker(exploit=123)], "V8", "setting 'exploit' must be a string."),
        ([docker(yml_file="c.yml")], "V9", "not both"),
        ([without(docker(), "target_image")], "V10", "must specify either"),
        ([docker(target_image=1)], "V11", "'target_image' must be a string."),
        ([compose(yml_file=1)], "V11", "'yml_file' must be a string."),
        ([without(compose(), "target_name")], "V12", "'target_name' is required"),
        ([compose(target_name=1)], "V12", "'target_name' must be a string."),
        ([docker(exploit_options=42)], "V14", "'exploit_options' must be a string."),
        ([docker(exploit_success_pattern=[])], "V14", "'exploit_success_pattern' must be a string."),
        ([docker(exploit_mode="foo")], "V15", "'exploit_mode' must be 'cli' or 'rpc'."),
        ([docker(exploit_mode=123)], "V15", "'exploit_mode'"),
        *(([docker(**{k: "abc"})], "V13", f"'{k}' must be convertible") for k in INTEGER_SETTINGS),
    ],
)
def test_single_error(spark, document, rule, text):
    found = errors(spark, document)
    assert len(found) == 1
    assert found[0][0] == rule and text in found[0][1]


def test_errors_come_in_order(spark):
    entry = {"settings": {"exploit": 1, "exploit_mode": "x", "ready_delay": "5.5"}}
    assert [r for r, _ in errors(spark, [docker(), entry])] == ["V3", "V7", "V8", "V10", "V13", "V15"]


def test_schema_only_rules_are_off_by_default(spark):
    entry = docker(ready_delay=-1, exploit_retries="-3") | {"more": 1}
    assert errors(spark, [entry]) == []
    assert [r for r, _ in errors(spark, [entry], strict=True)] == ["V16", "V16"]


def test_defaults_and_conversion(spark, tmp_path):
    path = tmp_path / "runs.json"
    path.write_text(json.dumps([docker(), compose(exploit="", target_delay=" 1_0 ", exploit_retries=2.9, ready_delay=True)]))
    first, second = resolve_runs(read_manifest(spark, str(path))).orderBy("entry_no").collect()
    assert (first.target_delay, first.exploit_retries, first.exploit_check_delay) == (0, 4, 3)
    assert (first.exploit_check_count, first.ready_delay, first.ready_retries) == (7, 5, 5)
    assert (first.exploit_mode, first.exploit_success_pattern, first.exploit_options) == ("cli", "4444", "")
    assert (first.manual, first.target_kind, first.options) == (False, "docker", {})
    assert (second.target_delay, second.exploit_retries, second.ready_delay) == (10, 2, 1)
    assert (second.manual, second.target_kind) == (True, "compose")


@pytest.mark.parametrize(
    "text, want",
    [
        ("set RPORT 9080;", {"RPORT": "9080"}),
        ("set PAYLOAD cmd/unix/reverse_bash;set RPORT 9080;", {"PAYLOAD": "cmd/unix/reverse_bash", "RPORT": "9080"}),
        ("", {}),
        ("set RPORT 9080", {"RPORT": "9080"}),
        ("exploit;set RPORT 80;", {"RPORT": "80"}),
        ("SET a  b  c ;set a d", {"a": "d"}),
        ("set\tA b;set A", {}),
    ],
)
def test_option_map(spark, text, want):
    assert spark.range(1).select(option_map(F.lit(text)).alias("m")).first().m == want


def test_strict_types_of_integers(spark):
    entry = docker(target_delay=5.9, ready_delay=True, ready_retries=3.0, exploit_retries="12", exploit_check_count=1e300)
    text = "must be an integer or a string."
    assert errors(spark, [entry]) == []
    found = errors(spark, [entry], strict=True)
    assert [rule for rule, _ in found] == ["V16", "V16"]
    assert all(message.endswith(text) for _, message in found)
    assert "'target_delay'" in found[0][1] and "'ready_delay'" in found[1][1]


def test_integer_beyond_64_bits_is_not_the_default(spark):
    document = json.dumps([docker(exploit_retries="99999999999999999999", ready_delay=10**20, ready_retries=9)])
    run = resolve_runs(read_entries(spark.createDataFrame([(document,)], "value string"))).first()
    assert (run.exploit_retries, run.ready_delay, run.ready_retries, run.target_delay) == (None, None, 9, 0)


def test_valid_runs_are_the_entries_without_errors(spark):
    ok = {"name": "n1", "settings": {"description": "d", "target_image": "i"}}
    texts = [
        json.dumps([ok, {"name": 3}, ok | {"name": "n2", "extra": 1}]),
        json.dumps([7, None, ok | {"settings": {"description": "d", "ready_delay": "x"}}]),
        "[]",
        "{broken",
        None,
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, value string")
    entries = read_entries(df)
    for strict in (False, True):
        bad = validate_manifest(entries, strict).select("id", "entry_no")
        real = entries.filter("entry_no IS NOT NULL")
        expected = resolve_runs(real.join(bad, ["id", "entry_no"], "left_anti")).select("id", "entry_no")
        found = valid_runs(entries, strict).select("id", "entry_no", "cve_name").collect()
        assert sorted((r.id, r.entry_no) for r in found) == sorted(map(tuple, expected.collect()))
        assert [r.cve_name for r in found] == (["n1"] if strict else ["n1", "n2"])
