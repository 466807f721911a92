"""Manifest checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators.manifest import read_entries, valid_runs, validate_manifest
from eventloom.plans import adapters
from eventloom.plans.adapters import MANIFEST_CTE
from eventloom.plans.registry import query

# What is wrong with the documents of the adapter: (key, entry, rule, message),
# {n} standing for the run's name in the message.
_ANONYMOUS, _NAMED, _SECOND = "Entry 1: ", "Entry 1 ({n}): ", "Entry 2 (''b''): "
_EXPECTED = [
    (1, None, "V1", "Config must be a non-empty JSON array of objects."),
    (2, None, "V1", "Config must be a non-empty JSON array of objects."),
    *(
        (3, i, "V2", f"Entry {i}: must be a JSON object, got {kind}.")
        for i, kind in enumerate(("str", "int", "float", "bool", "NoneType", "list"), 1)
    ),
    (4, 1, "V3", _ANONYMOUS + "missing required field ''name''."),
    (5, 1, "V4", _ANONYMOUS + "''name'' must be a string."),
    (6, 1, "V5", _NAMED + "missing required field ''settings''."),
    (7, 1, "V6", _NAMED + "''settings'' must be a JSON object."),
    (8, 1, "V7", _NAMED + "missing required setting ''description''."),
    (9, 1, "V7", _NAMED + "setting ''description'' must be a string."),
    (9, 1, "V8", _NAMED + "setting ''exploit'' must be a string."),
    (10, 1, "V9", _NAMED + "specify only one of ''target_image'' or ''yml_file'', not both."),
    (11, 1, "V10", _NAMED + "must specify either ''target_image'' or ''yml_file''."),
    (12, 1, "V11", _NAMED + "''target_image'' must be a string."),
    (13, 1, "V11", _NAMED + "''yml_file'' must be a string."),
    (13, 1, "V12", _NAMED + "''target_name'' is required when ''yml_file'' is used."),
    (14, 1, "V12", _NAMED + "''target_name'' must be a string."),
    *(
        (15, 1, "V13", _NAMED + f"''{key}'' must be convertible to an integer.")
        for key in (
            "target_delay",
            "exploit_retries",
            "exploit_check_delay",
            "exploit_check_count",
            "ready_delay",
            "ready_retries",
        )
    ),
    (17, 1, "V14", _NAMED + "''exploit_options'' must be a string."),
    (17, 1, "V14", _NAMED + "''exploit_success_pattern'' must be a string."),
    (18, 1, "V15", _NAMED + "''exploit_mode'' must be ''cli'' or ''rpc''."),
    (19, 1, "V15", _NAMED + "''exploit_mode'' must be ''cli'' or ''rpc''."),
    (21, None, "V0", "Invalid JSON in configuration file."),
    (23, None, "V0", "Invalid JSON in configuration file."),
    *(
        (key, 2, rule, _SECOND + message)
        for key in (0, 24, 25)
        for rule, message in (
            ("V7", "missing required setting ''description''."),
            ("V10", "must specify either ''target_image'' or ''yml_file''."),
        )
    ),
]
_STRICT = [
    (16, 1, "V16", _NAMED + "''exploit_retries'' must be an integer or a string."),
    (16, 1, "V16", _NAMED + "''exploit_check_delay'' must be an integer or a string."),
    (16, 1, "V16", _NAMED + "''ready_delay'' must not be negative."),
    (20, 1, "V16", _NAMED + "unknown fields: extra."),
]


def _sql(expected: list) -> str:
    rows = []
    seen: dict[tuple, int] = {}
    for key, entry, rule, message in expected:
        seq = seen.get((key, entry), 0)
        seen[key, entry] = seq + 1
        number = "NULL" if entry is None else entry
        rows.append(f"({key}, CAST({number} AS INTEGER), {seq}, '{rule}', '{message}')")
    values = ",\n    ".join(rows)
    return f"""WITH expected(k, entry_no, seq, rule, message) AS (VALUES {values})
    SELECT c_custkey, entry_no, seq, rule,
      replace(message, '{{n}}', concat('''run', c_custkey, '''')) AS message
    FROM customer JOIN expected ON k = c_custkey % 26"""


@query("v01_v15_manifest_rules", _sql(_EXPECTED))
def rules(spark, sf_dir):
    return validate_manifest(read_entries(adapters.manifests(spark, sf_dir)))


@query("v16_manifest_schema_rules", _sql(_EXPECTED + _STRICT))
def strict_rules(spark, sf_dir):
    return validate_manifest(read_entries(adapters.manifests(spark, sf_dir)), strict=True)


@query(
    "g06_errors_per_rule",
    f"SELECT rule, count(*) AS errors FROM ({_sql(_EXPECTED)}) AS e GROUP BY 1",
)
def errors_per_rule(spark, sf_dir):
    errors = validate_manifest(read_entries(adapters.manifests(spark, sf_dir)))
    return errors.groupBy("rule").agg(F.count("*").alias("errors"))


@query(
    "s07_manifest_entries",
    f"""WITH {MANIFEST_CTE}, n AS (SELECT c_custkey, c_custkey % 26 AS k FROM manifest)
    SELECT c_custkey, k NOT IN (21, 23) AS valid_json,
      CAST(CASE WHEN k IN (1, 2, 21, 23) THEN 0 WHEN k = 3 THEN 6 WHEN k IN (0, 24, 25) THEN 2 ELSE 1 END AS BIGINT) AS entries
    FROM n""",
)
def entries(spark, sf_dir):
    rows = read_entries(adapters.manifests(spark, sf_dir))
    return rows.groupBy("c_custkey", "valid_json").agg(F.count("entry_no").alias("entries"))


@query(
    "r01_resolved_defaults",
    """SELECT c_custkey, concat('run', c_custkey) AS cve_name,
      CASE c_custkey % 26 WHEN 16 THEN 5 WHEN 22 THEN 0 WHEN 20 THEN 0 ELSE c_nationkey END AS target_delay,
      CASE c_custkey % 26 WHEN 16 THEN 5 ELSE 4 END AS exploit_retries,
      CASE c_custkey % 26 WHEN 16 THEN 1 ELSE 3 END AS exploit_check_delay,
      CASE c_custkey % 26 WHEN 16 THEN 1000 ELSE 7 END AS exploit_check_count,
      CASE c_custkey % 26 WHEN 16 THEN -2 ELSE 5 END AS ready_delay,
      CASE c_custkey % 26 WHEN 16 THEN 7 ELSE 5 END AS ready_retries,
      CASE c_custkey % 26 WHEN 20 THEN 'rpc' ELSE 'cli' END AS exploit_mode,
      '4444' AS exploit_success_pattern
    FROM customer WHERE c_custkey % 26 IN (0, 16, 20, 22, 24, 25)""",
)
def defaults(spark, sf_dir):
    """Settings of the first entry of every document that has no error in it."""
    return _valid_runs(spark, sf_dir).select(
        "c_custkey",
        "cve_name",
        "target_delay",
        "exploit_retries",
        "exploit_check_delay",
        "exploit_check_count",
        "ready_delay",
        "ready_retries",
        "exploit_mode",
        "exploit_success_pattern",
    )


@query(
    "r02_run_table",
    """SELECT c_custkey, c_custkey % 26 IN (16, 20) AS manual,
      CASE c_custkey % 26 WHEN 22 THEN 'compose' ELSE 'docker' END AS target_kind,
      CASE c_custkey % 26 WHEN 22 THEN '1' END AS rport,
      CASE c_custkey % 26 WHEN 22 THEN 'a b' END AS lhost
    FROM customer WHERE c_custkey % 26 IN (0, 16, 20, 22, 24, 25)""",
)
def run_table(spark, sf_dir):
    return _valid_runs(spark, sf_dir).select(
        "c_custkey",
        "manual",
        "target_kind",
        F.col("options.RPORT").alias("rport"),
        F.col("options.LHOST").alias("lhost"),
    )


def _valid_runs(spark, sf_dir):
    return valid_runs(read_entries(adapters.manifests(spark, sf_dir)))
