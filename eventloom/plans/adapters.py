"""Sensor logs, process tables and manifests seen in the driver's tables.

Each view is the same SQL for Spark and for the checking engine, but for the
quoting of names and a few functions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.schemas import PROCESS_TITLES, quoted

_CONN = """
SELECT event_id,
  concat('CVE-', event_id % 20) AS cve_name,
  {epoch} AS ts,
  concat('C', event_id) AS uid,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('10.0.', user_id % 256, '.1') END AS {q}id.orig_h{q},
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1024 + event_id % 60000 END AS {q}id.orig_p{q},
  CASE WHEN event_id % 19 = 0 THEN NULL
       ELSE concat('192.168.', event_id % 7, '.', user_id % 200) END AS {q}id.resp_h{q},
  CAST(CASE event_type WHEN 'error' THEN 4444 WHEN 'click' THEN 443
       WHEN 'signup' THEN NULL ELSE 80 END AS BIGINT) AS {q}id.resp_p{q},
  CASE event_id % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'udp' WHEN 2 THEN 'icmp' END AS proto,
  CASE event_type WHEN 'click' THEN 'ssl' WHEN 'view' THEN 'a=b|c' END AS service,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS orig_bytes,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 1500 END AS resp_bytes,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id % 50 END AS orig_pkts,
  CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_id % 40 END AS resp_pkts
FROM events
"""

_HTTP = """
SELECT event_id,
  concat('CVE-', event_id % 20) AS cve_name,
  {epoch} AS ts,
  concat('C', event_id) AS uid,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE concat('10.0.', user_id % 256, '.1') END AS {q}id.orig_h{q},
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE 1024 + event_id % 60000 END AS {q}id.orig_p{q},
  CASE WHEN event_id % 19 = 0 THEN NULL
       ELSE concat('192.168.', event_id % 7, '.', user_id % 200) END AS {q}id.resp_h{q},
  CAST(CASE event_type WHEN 'error' THEN 4444 WHEN 'click' THEN 443
       WHEN 'signup' THEN NULL ELSE 80 END AS BIGINT) AS {q}id.resp_p{q},
  CASE event_id % 11 WHEN 0 THEN 'CONNECT' WHEN 1 THEN 'DELETE' WHEN 2 THEN 'GET' WHEN 3 THEN 'head'
       WHEN 4 THEN 'OPTIONS' WHEN 5 THEN 'POST' WHEN 6 THEN 'Put' WHEN 7 THEN 'TRACE'
       WHEN 8 THEN 'OTHER' WHEN 9 THEN 'PATCH|x' END AS method,
  CASE WHEN event_id % 8 = 0 THEN NULL ELSE concat('host', user_id % 100, '.example.com') END AS host,
  CASE WHEN event_id % 9 = 0 THEN NULL
       WHEN event_id % 10 = 3 THEN concat('/x/../search/', props, '?q=', props)
       WHEN event_id % 2 = 1 THEN url
       ELSE regexp_replace(url, '^https?://[^/]+', '') END AS uri,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE url END AS referrer,
  CASE WHEN event_id % 12 = 0 THEN NULL ELSE concat('Agent/', user_id % 50, '.0') END AS user_agent,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 900 END AS request_body_len,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE CAST(floor(value) AS BIGINT) END AS response_body_len,
  CAST(CASE event_id % 4 WHEN 0 THEN 200 WHEN 1 THEN 404 WHEN 2 THEN 500 END AS BIGINT) AS status_code,
  CASE event_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'application/json' END AS orig_mime_types,
  CASE WHEN event_id % 6 = 0 THEN 'sid' END AS cookie_vars
FROM (SELECT *, event_id % (SELECT count(*) FROM pages) AS page_no FROM events) AS e
JOIN pages ON page_id = page_no
"""

_PROC = """
SELECT p_partkey,
  concat('CVE-', p_partkey % 20) AS cve_name,
  CAST(1700000000 + p_partkey AS DOUBLE) + 0.5 AS ts,
  concat('user', p_partkey % 10) AS {q}USER{q},
  CAST(p_partkey AS {text}) AS {q}PID{q},
  CAST(p_partkey % 100 AS {text}) AS {q}PPID{q},
  CAST(p_partkey % 50 AS {text}) AS {q}PGID{q},
  CASE p_partkey % 3 WHEN 1 THEN '?' WHEN 2 THEN 'pts/0' END AS {q}TT{q},
  concat('00:00:', p_partkey % 60) AS {q}TIME{q},
  concat(p_partkey % 24, ':00:00') AS {q}ELAPSED{q},
  concat('0.', p_size) AS {q}%CPU{q},
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE concat('1.', p_size) END AS {q}%MEM{q},
  concat(CASE WHEN p_partkey % 5 = 0 THEN '/usr/libexec/rosetta ' ELSE '' END,
         CASE WHEN p_partkey % 8 = 1 THEN '/usr/./lib/../bin/' ELSE '/usr/bin/' END,
         lower(p_type), ' --name ', p_name,
         CASE p_partkey % 7 WHEN 0 THEN ' it''s' WHEN 1 THEN ' "x y"' ELSE '' END) AS {q}COMMAND{q}
FROM part
"""

# One entry per customer; the key decides what is wrong with it.
_MANIFEST = """
SELECT c_custkey, CASE c_custkey % 26
  WHEN 1 THEN '{{"name": "x"}}'
  WHEN 2 THEN '[]'
  WHEN 3 THEN '["text", 7, 1.5, true, null, [1]]'
  WHEN 4 THEN '[{{"settings": {{"description": "d", "target_image": "i"}}}}]'
  WHEN 5 THEN '[{{"name": 123, "settings": {{"description": "d", "target_image": "i"}}}}]'
  WHEN 6 THEN concat('[{{"name": "run', c_custkey, '"}}]')
  WHEN 7 THEN concat('[{{"name": "run', c_custkey, '", "settings": "s"}}]')
  WHEN 8 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"target_image": "i"}}}}]')
  WHEN 9 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": 5, "exploit": 123, "target_image": "i"}}}}]')
  WHEN 10 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "yml_file": "f"}}}}]')
  WHEN 11 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d"}}}}]')
  WHEN 12 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": 1}}}}]')
  WHEN 13 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "yml_file": 1}}}}]')
  WHEN 14 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "yml_file": "f", "target_name": null}}}}]')
  WHEN 15 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "target_delay": "abc", "exploit_retries": "5.5", "exploit_check_delay": null, "exploit_check_count": [1], "ready_delay": "", "ready_retries": {{}}}}}}]')
  WHEN 16 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "target_delay": " 5 ", "exploit_retries": 5.9, "exploit_check_delay": true, "exploit_check_count": "1_000", "ready_delay": -2, "ready_retries": "+7"}}}}]')
  WHEN 17 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "exploit_options": 42, "exploit_success_pattern": []}}}}]')
  WHEN 18 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "exploit_mode": "foo"}}}}]')
  WHEN 19 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "target_image": "i", "exploit_mode": 123}}}}]')
  WHEN 20 THEN concat('[{{"name": "run', c_custkey, '", "extra": 1, "settings": {{"description": "d", "target_image": "i", "exploit": "", "exploit_mode": "rpc"}}}}]')
  WHEN 21 THEN concat('[{{"name": "run', c_custkey, '"')
  WHEN 22 THEN concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "d", "yml_file": "f", "target_name": "web", "exploit": "multi/x", "exploit_options": "set RPORT ', c_custkey, ';SET LHOST a b; exploit;set RPORT 1;"}}}}]')
  WHEN 23 THEN concat('[{{"name": "run', c_custkey, '"}}] [1]')
  ELSE concat('[{{"name": "run', c_custkey, '", "settings": {{"description": "', c_mktsegment, '", "exploit": "multi/', c_custkey, '", "target_image": "img:', c_nationkey, '", "target_delay": "', c_nationkey, '"}}}}, {{"name": "b", "settings": {{}}}}]')
  END AS value
FROM customer
"""

_SPARK = {
    "q": "`",
    "text": "STRING",
    "epoch": "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) / 1000000D",
}
_CHECK = {"q": '"', "text": "VARCHAR", "epoch": "CAST(epoch_us(ts) AS DOUBLE) / 1000000"}

# Common table expressions for the checks.
CONN_CTE = f"conn AS ({_CONN.format(**_CHECK)})"
HTTP_CTE = f"http AS ({_HTTP.format(**_CHECK)})"
PROC_CTE = f"proc AS ({_PROC.format(**_CHECK)})"
MANIFEST_CTE = f"manifest AS ({_MANIFEST.format(**_CHECK)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    # Named arguments keep the tables out of the session's catalog. They are put
    # in with braces, so braces of the text itself are doubled.
    text = sql.format(**_SPARK).replace("{", "{{").replace("}", "}}")
    for name in tables:
        text = text.replace(f"FROM {name}", f"FROM {{{name}}}").replace(f"JOIN {name}", f"JOIN {{{name}}}")
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in tables})


def zeek_conn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connection records of twenty runs, from ``events``."""
    return _view(spark, sf_dir, _CONN, "events")


def zeek_http(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HTTP records from ``events`` with the URLs of ``pages``.

    Every page is used; whether it is broadcast is left to Spark, which looks at
    its size.
    """
    df = _view(spark, sf_dir, _HTTP, "events", "pages")
    loose = ("orig_mime_types", "cookie_vars")
    return df.withColumns({name: F.col(name).cast("variant") for name in loose})


def proc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Process rows from ``part``; titles it lacks are null."""
    df = _view(spark, sf_dir, _PROC, "part")
    absent = [t for t in PROCESS_TITLES if t not in df.columns]
    return df.select("*", *(F.lit(None).cast("string").alias(t) for t in absent))


def process_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot tables from ``part``: the process itself, and a row cut short."""
    df = proc(spark, sf_dir)
    titles = ["USER", "PID", "PPID", "TT", "%CPU", "USER", "COMMAND"]
    full = F.array(*(F.col(quoted(t)) for t in titles[:5]), F.lit("last"), F.col("COMMAND"))
    short = F.array(F.col("USER"), F.concat(F.lit("9"), F.col("PID")))
    return df.select(
        "p_partkey",
        F.array(*(F.lit(t) for t in titles)).alias("Titles"),
        F.array(full, short).alias("Processes"),
    )


def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest documents, one per customer."""
    return _view(spark, sf_dir, _MANIFEST, "customer")
