"""Detection and completeness over all runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.operators import detect, file_index
from eventloom.operators.convert import fan_out
from eventloom.plans import adapters
from eventloom.plans.adapters import CONN_CTE
from eventloom.plans.registry import query
from eventloom.session import work_folder
from eventloom.sinks.files import write_event_store
from eventloom.sources.documents import text_line_rows

_HIT = '(coalesce("id.resp_p" = 4444, false) OR coalesce("id.orig_p" = 4444, false))'


@query(
    "f01_port_match",
    f"WITH {CONN_CTE} SELECT event_id, cve_name, ts FROM conn WHERE {_HIT}",
)
def port_match(spark, sf_dir):
    conn = adapters.zeek_conn(spark, sf_dir).filter(detect.port_match(4444))
    return conn.select("event_id", "cve_name", "ts")




@query(
    "f02_text_contains",
    f"""WITH {CONN_CTE} SELECT event_id FROM conn WHERE contains(concat_ws(' ', "id.orig_h", "id.resp_h",
        coalesce("id.resp_p", 0), coalesce("id.orig_p", 0), coalesce(orig_bytes, 0), coalesce(resp_bytes, 0),
        coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0), coalesce(orig_pkts, 0), coalesce(resp_pkts, 0),
        coalesce(orig_pkts, 0) + coalesce(resp_pkts, 0), proto, service), '4444')""",
)
def text_contains(spark, sf_dir):
    """Text search in rendered events that carry no time of their own."""
    from eventloom.mappings import Mapping, apply_mapping, mapping_for

    cim = mapping_for("network", "cim")
    timeless = Mapping(tuple(f for f in cim.fields if f[0] != ("timestamp",)))
    rows = apply_mapping(adapters.zeek_conn(spark, sf_dir), timeless, ["event_id"], "document")
    return rows.filter(detect.text_contains("event", "4444")).select("event_id")


@query(
    "f03_established_lines",
    """SELECT doc_id, count(*) AS lines FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS l
       WHERE contains(line, 'the') AND contains(line, 'ESTABLISHED') GROUP BY 1
       UNION ALL
       SELECT doc_id, count(*) FROM (
         SELECT doc_id, unnest(string_split(replace(text, ' and ', ' ESTABLISHED '), chr(10))) AS line
         FROM documents) AS l
       WHERE contains(line, 'the') AND contains(line, 'ESTABLISHED') GROUP BY 1""",
)
def established(spark, sf_dir):
    """Two-substring line match on the texts as they are, and with one word swapped in."""
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    swapped = documents.withColumn("text", F.replace("text", F.lit(" and "), F.lit(" ESTABLISHED ")))

    def count(texts):
        lines = text_line_rows(texts, "text").filter(detect.established_line("event", "the"))
        return lines.groupBy("doc_id").agg(F.count("*").alias("lines"))

    return count(documents).unionByName(count(swapped))


@query(
    "f03_established_patterns",
    """SELECT doc_id, count(*) AS lines FROM (
         SELECT doc_id, unnest(string_split(replace(text, ' and ', ' ESTABLISHED '), chr(10))) AS line
         FROM documents) AS l
       WHERE regexp_matches(line, '[Tt]h[[:alpha:]]{2,3}[^[:alpha:]]+[b-t]+(e|ing)')
         AND contains(line, 'ESTABLISHED') GROUP BY 1""",
)
def established_patterns(spark, sf_dir):
    """Lines that match a basic regular expression, one word of the texts swapped."""
    swapped = F.replace("text", F.lit(" and "), F.lit(" ESTABLISHED "))
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", swapped.alias("text"))
    pattern = r"[Tt]h[[:alpha:]]\{2,3\}[^[:alpha:]]\+[b-t]\+\(e\|ing\)"
    lines = text_line_rows(documents, "text").filter(detect.established_match("event", pattern))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"))


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(8195), chr(12288))"


@query(
    "f04_not_blank",
    f"""SELECT doc_id, count(*) AS lines FROM (
         SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS l
       WHERE length(trim(line, {_BLANKS})) > 0 GROUP BY 1""",
)
def not_blank(spark, sf_dir):
    lines = adapters.table(spark, sf_dir, "documents").select(
        "doc_id", F.explode(F.split("text", "\n")).alias("line")
    )
    return lines.filter(detect.not_blank("line")).groupBy("doc_id").agg(F.count("*").alias("lines"))


@query(
    "f06_null_omission",
    f"""WITH {CONN_CTE} SELECT event_id, (proto IS NOT NULL)::INT + (service IS NOT NULL)::INT
        + ("id.resp_p" IS NOT NULL)::INT AS kept FROM conn""",
)
def null_omission(spark, sf_dir):
    """How many of three nullable fields remain in the rendered event."""
    from eventloom.mappings import Mapping, apply_mapping
    from eventloom.mappings.model import take

    mapping = Mapping.of([(n, take(n)) for n in ("proto", "service", "id.resp_p")])
    rows = apply_mapping(adapters.zeek_conn(spark, sf_dir), mapping, ["event_id"], "document")
    return rows.select("event_id", F.size(F.json_object_keys("event")).alias("kept"))


PORT_DETECT_SQL = f"""WITH {CONN_CTE} SELECT cve_name, bool_or({_HIT}) AS detected,
    count(*) FILTER (WHERE {_HIT}) AS connections, min(ts) FILTER (WHERE {_HIT}) AS first_ts
    FROM conn GROUP BY 1"""


@query("g01_port_detect", PORT_DETECT_SQL)
def port_detect(spark, sf_dir):
    """Which runs show a connection on port 4444, how many, and when first."""
    return detect.detect_port(adapters.zeek_conn(spark, sf_dir), 4444)


def _conn_events(spark, sf_dir):
    conn = adapters.zeek_conn(spark, sf_dir)
    return fan_out(conn, "network", ["cve_name"]).withColumn("log_type", F.col("log_family"))


@query(
    "g02_runs_with_text",
    f"""WITH {CONN_CTE}, formats AS (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format),
    shown AS (SELECT cve_name, format, CASE format
        WHEN 'cim' THEN '"transport":"' || coalesce(proto, '-') || '"'
        WHEN 'ecs' THEN '"network.protocol":"' || coalesce(proto, '-') || '"'
        WHEN 'cef' THEN 'proto=' || coalesce(proto, '')
        WHEN 'udm' THEN '"ipProtocol":"' || upper(coalesce(proto, '')) || '"' ELSE '' END AS event
      FROM conn, formats)
    SELECT cve_name, format, 'network' AS log_type, count(*) AS events FROM shown
    WHERE contains(event, 'icmp') GROUP BY ALL""",
)
def with_text(spark, sf_dir):
    return detect.runs_with_text(_conn_events(spark, sf_dir), "icmp")


@query(
    "g02_text_found",
    f"WITH {CONN_CTE} SELECT cve_name, bool_or(coalesce(proto = 'icmp', false)) AS found FROM conn GROUP BY 1",
)
def found(spark, sf_dir):
    return detect.text_found(_conn_events(spark, sf_dir), "icmp")


@query(
    "g03_ports_seen",
    f"""WITH {CONN_CTE} SELECT DISTINCT port FROM (
        SELECT "id.resp_p" AS port FROM conn UNION SELECT "id.orig_p" FROM conn) AS p
        WHERE port IS NOT NULL ORDER BY port""",
)
def ports(spark, sf_dir):
    return detect.ports_seen(adapters.zeek_conn(spark, sf_dir)).orderBy("port")


@query(
    "g04_ports_seen_per_run",
    f"""WITH {CONN_CTE} SELECT cve_name, port FROM (
        SELECT cve_name, "id.resp_p" AS port FROM conn
        UNION SELECT cve_name, "id.orig_p" FROM conn) AS p WHERE port IS NOT NULL""",
)
def ports_per_run(spark, sf_dir):
    return detect.ports_seen(adapters.zeek_conn(spark, sf_dir), ["cve_name"])


def _conn_store(spark, sf_dir):
    """Connection records by run, written in two steps with an index update after each."""
    store = work_folder(spark, "conn-store")
    conn = adapters.zeek_conn(spark, sf_dir)
    for rest in (0, 1):
        part = conn.filter(F.pmod("event_id", F.lit(2)) == rest)
        part.write.mode("append").partitionBy("cve_name").parquet(store)
        file_index.update_port_index(spark, store)
    return store


@query("g01_port_detect_indexed", PORT_DETECT_SQL)
def port_detect_indexed(spark, sf_dir):
    """The same from port bitmaps, reading rows of the files with the port only."""
    return file_index.detect_port_indexed(spark, _conn_store(spark, sf_dir), 4444)


@query(
    "g03_ports_seen_indexed",
    f"""WITH {CONN_CTE} SELECT cve_name, port FROM (
        SELECT cve_name, "id.resp_p" AS port FROM conn
        UNION SELECT cve_name, "id.orig_p" FROM conn) AS p WHERE port IS NOT NULL""",
)
def ports_indexed(spark, sf_dir):
    return file_index.ports_seen_indexed(spark, _conn_store(spark, sf_dir), ["cve_name"])


@query(
    "f02_g02_text_indexed",
    f"""WITH {CONN_CTE} SELECT cve_name, format, 'network' AS log_type, count(*) AS events FROM (
      SELECT cve_name, unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format FROM conn
      WHERE "id.resp_h" = '192.168.3.77') GROUP BY ALL""",
)
def text_indexed(spark, sf_dir):
    """One host's address, looked for in an event store through its trigram index."""
    store = work_folder(spark, "event-store")
    write_event_store(_conn_events(spark, sf_dir), store)
    file_index.update_text_index(spark, store)
    rows = file_index.events_with_text(spark, store, "192.168.3.77")
    return detect.runs_with_text(rows, "192.168.3.77")


_FORMAT_OF = """CASE event_id % 5 WHEN 0 THEN 'cim' WHEN 1 THEN 'ecs' WHEN 2 THEN 'ocsf' WHEN 3 THEN 'cef'
  ELSE 'udm' END"""


@query(
    "g05_missing_formats",
    f"""WITH artefacts AS (SELECT concat('CVE-', user_id % 37) AS cve_name, {_FORMAT_OF} AS format
           FROM events WHERE user_id % 37 > event_id % 5),
    runs AS (SELECT DISTINCT concat('CVE-', user_id % 37) AS cve_name FROM events),
    expected AS (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format)
    SELECT cve_name, format FROM runs, expected
    EXCEPT SELECT cve_name, format FROM artefacts""",
)
def missing(spark, sf_dir):
    """Runs that lack a format, from an artefact table with gaps."""
    events = adapters.table(spark, sf_dir, "events")
    run = F.concat(F.lit("CVE-"), F.col("user_id") % 37).alias("cve_name")
    left = F.col("user_id") % 37 > F.col("event_id") % 5
    artefacts = events.filter(left).select(run, F.expr(_FORMAT_OF).alias("format"))
    return detect.missing_formats(artefacts, runs=events.select(run))


QUIET_SQL = """SELECT user_id, ts, event_id FROM (
    SELECT user_id, ts, event_id, event_type,
      lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events) AS s
    WHERE before = event_type"""


def _quiet(spark, sf_dir):
    events = adapters.table(spark, sf_dir, "events")
    day = F.to_date("ts")
    return detect.quiet_snapshots(events, "user_id", ["ts", "event_id"], "event_type", day)


@query("t03_quiet_snapshots", QUIET_SQL)
def quiet(spark, sf_dir):
    return _quiet(spark, sf_dir)


@query(
    "t03_first_quiet",
    f"""SELECT user_id, ts, event_id FROM ({QUIET_SQL}) AS q
        QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) = 1""",
)
def first_quiet(spark, sf_dir):
    return detect.first_quiet(_quiet(spark, sf_dir), "user_id", ["ts", "event_id"])
