"""Reading, writing, loading and streaming.

What is read back here was written by Spark from the driver's tables just before,
into a new shared folder.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions.jsontext import document_events
from eventloom.operators.convert import cluster_by_run, fan_out, text_documents
from eventloom.operators.detect import missing_artefacts as missing_run_artefacts
from eventloom.operators.detect import missing_formats, port_match
from eventloom.operators.naming import with_path_columns
from eventloom.plans import adapters, conversions
from eventloom.plans.adapters import CONN_CTE, HTTP_CTE, PROC_CTE
from eventloom.plans.registry import query
from eventloom.session import many_writers, work_folder
from eventloom.sinks.files import (
    write_documents,
    write_event_files,
    write_event_store,
    write_json_array,
)
from eventloom.sinks.tables import log_table_rows
from eventloom.sources.arrays import read_array_files
from eventloom.sources.documents import (
    document_rows,
    json_line_rows,
    list_artefacts,
    read_layout,
    text_line_rows,
)
from eventloom.sources.logs import good_records, parse_lines, quarantine, read_log
from eventloom.sources.process import process_rows
from eventloom.streaming.jobs import alert_once, read_alerts, read_log_stream, route_batches
from eventloom.streaming.state import STATE_STORE, alert_from_state

LOG_COLUMNS = (
    "ts",
    "uid",
    "`id.orig_h`",
    "`id.orig_p`",
    "`id.resp_h`",
    "`id.resp_p`",
    "proto",
    "service",
    "orig_bytes",
    "resp_bytes",
    "orig_pkts",
    "resp_pkts",
)


def _lines(conn):
    """JSON lines of connection records, the way a sensor writes them."""
    return F.to_json(F.struct(*LOG_COLUMNS), {"ignoreNullFields": "true"})


def _log_folder(spark, sf_dir, damaged=False):
    """Logs of all runs in a layout, with files of another kind beside them.

    With ``damaged`` some lines are comments, blank or cut off.
    """
    root = work_folder(spark, "logs")
    conn = adapters.zeek_conn(spark, sf_dir)
    value = _lines(conn)
    if damaged:
        cut = F.col("event_id") % 7
        value = (
            F.when(cut == 3, F.concat(F.lit("#"), value))
            .when(cut == 4, F.lit("  "))
            .when(cut == 5, F.substr(value, F.lit(1), F.length(value) - 3))
            .otherwise(value)
        )
    lines = conn.select("cve_name", F.lit("zeek").alias("format"), value.alias("value"))
    other = conn.select("cve_name", F.lit("cef").alias("format"), F.col("uid"))
    with many_writers(spark):
        lines.write.partitionBy("cve_name", "format").option("compression", "none").text(root)
        other.write.mode("append").partitionBy("cve_name", "format").parquet(root)
    return root


_ROUND_TRIP = """SELECT uid, ts, "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", proto, service,
    orig_bytes, resp_bytes, orig_pkts, resp_pkts FROM conn"""


@query("s01_recursive_scan", f"WITH {CONN_CTE} {_ROUND_TRIP}")
def recursive_scan(spark, sf_dir):
    """All logs below a root, by file name; files of other kinds stay unread."""
    log = read_log(spark, _log_folder(spark, sf_dir), "network", "part-*.txt", strict=True)
    return log.drop("source_path")


@query(
    "s02_quarantine",
    f"""WITH {CONN_CTE} SELECT cve_name, count(*) FILTER (WHERE event_id % 7 NOT IN (3, 4, 5)) AS good,
        count(*) FILTER (WHERE event_id % 7 IN (3, 5)) AS bad FROM conn GROUP BY 1""",
)
def quarantined(spark, sf_dir):
    """Good and broken lines per run; blank lines are neither."""
    log = read_log(spark, _log_folder(spark, sf_dir, damaged=True), "network", "part-*.txt")
    good = good_records(log).select("source_path", F.lit(1).alias("good"))
    bad = quarantine(log).select("source_path", F.lit(0).alias("good"))
    rows = with_path_columns(good.unionByName(bad), "source_path")
    return rows.groupBy("cve_name").agg(
        F.count_if(F.col("good") == 1).alias("good"), F.count_if(F.col("good") == 0).alias("bad")
    )


@query(
    "s03_f05_tolerant_read",
    f"WITH {CONN_CTE} {_ROUND_TRIP} WHERE event_id % 7 NOT IN (3, 4, 5)",
)
def tolerant(spark, sf_dir):
    log = read_log(spark, _log_folder(spark, sf_dir, damaged=True), "network", "part-*.txt")
    return good_records(log).drop("source_path")


@query(
    "s02_explicit_null",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN NULL WHEN 1 THEN '-' ELSE 'ssl' END AS app FROM events""",
)
def explicit_null(spark, sf_dir):
    """Exact mode: an explicit null stays away, an absent key gets the default."""
    key = F.col("event_id") % 3
    line = F.concat(
        F.lit('{"uid":"'),
        F.col("event_id").cast("string"),
        F.when(key == 0, '","service":null}').when(key == 1, '"}').otherwise('","service":"ssl"}'),
    )
    lines = adapters.table(spark, sf_dir, "events").select("event_id", line.alias("value"))
    records = parse_lines(lines, "network")
    rendered = conversions.convert(records, "network", "cim", ["event_id"], "document", now=0.0)
    return rendered.select("event_id", F.get_json_object("event", "$.app").alias("app"))


_DOCUMENT_TEXT = """CASE event_id % 6 WHEN 0 THEN props WHEN 1 THEN concat(' [', props, ', ', props, ']')
  WHEN 2 THEN concat(props, ' ', props) WHEN 3 THEN concat('[', props) WHEN 4 THEN '[]' ELSE concat(props, '],[', props) END"""


@query(
    "s04_json_documents",
    """SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events WHERE event_id % 6 = 0
       UNION ALL SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) FROM events WHERE event_id % 6 = 1
       UNION ALL SELECT event_id, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) FROM events WHERE event_id % 6 = 1""",
)
def json_documents(spark, sf_dir):
    """Documents that are an object, an array, or no single document at all."""
    rows = adapters.table(spark, sf_dir, "events").select(
        "event_id", F.expr(_DOCUMENT_TEXT).alias("value")
    )
    return document_rows(rows).select(
        "event_id", F.variant_get("event", "$.k", "bigint").alias("k")
    )


@query(
    "s04_array_files",
    f"WITH {CONN_CTE} SELECT uid, ts, service, resp_bytes FROM conn",
)
def array_files(spark, sf_dir):
    """Array documents in files, read by byte ranges."""
    root = work_folder(spark, "array-files")
    events = adapters.zeek_conn(spark, sf_dir).select(
        F.lit("zeek").alias("format"), "cve_name", F.lit("conn").alias("log_type"),
        _lines(None).alias("event"),
    )
    write_json_array(events, root)
    return read_array_files(spark.read, root).select(
        F.variant_get("event", "$.uid", "string").alias("uid"),
        F.variant_get("event", "$.ts", "double").alias("ts"),
        F.try_variant_get("event", "$.service", "string").alias("service"),
        F.try_variant_get("event", "$.resp_bytes", "bigint").alias("resp_bytes"),
    )


@query(
    "s04_broken_documents",
    "SELECT event_id % 6 AS kind, count(*) AS n, event_id % 6 IN (0, 1, 4) AS parsed FROM events GROUP BY ALL",
)
def broken_documents(spark, sf_dir):
    rows = adapters.table(spark, sf_dir, "events").select(
        (F.col("event_id") % 6).alias("kind"),
        document_events(F.expr(_DOCUMENT_TEXT)).isNotNull().alias("parsed"),
    )
    return rows.groupBy("kind", "parsed").agg(F.count("*").alias("n"))


_STRIP = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160), chr(8195), chr(12288))"


@query(
    "s05_text_lines",
    f"""SELECT doc_id, trim(line, {_STRIP}) AS event FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) AS l
        WHERE length(trim(line, {_STRIP})) > 0""",
)
def text_lines(spark, sf_dir):
    documents = adapters.table(spark, sf_dir, "documents").select("doc_id", "text")
    return text_line_rows(documents, "text")


@query(
    "s06_process_table",
    f"""WITH {PROC_CTE} SELECT p_partkey, 'last' AS "USER", "PID", "PPID", "TT", "%CPU", "COMMAND" FROM proc
    UNION ALL SELECT p_partkey, "USER", '9' || "PID", NULL, NULL, NULL, NULL FROM proc""",
)
def process_table(spark, sf_dir):
    """Titles zipped with rows: repeated titles, and rows that end early."""
    rows = process_rows(adapters.process_tables(spark, sf_dir))
    return rows.select("p_partkey", "USER", "PID", "PPID", "TT", "`%CPU`", "COMMAND")


def _store(spark, sf_dir):
    """Events of all families in an event store."""
    root = work_folder(spark, "store")
    write_event_store(_all_events(spark, sf_dir), root)
    return root


def _all_events(spark, sf_dir, clustered=False):
    def tagged(df, family, log_type):
        events = fan_out(cluster_by_run(df) if clustered else df, family, ["cve_name", "ts"])
        return events.withColumn("log_type", log_type).drop("ts")

    http = tagged(adapters.zeek_http(spark, sf_dir), "http", F.lit("http"))
    conn = tagged(adapters.zeek_conn(spark, sf_dir), "network", F.lit("network"))
    snapshot = F.concat(F.lit("process_"), F.col("ts").cast("string"))
    return http.unionByName(conn).unionByName(
        tagged(adapters.proc(spark, sf_dir), "process", snapshot)
    )


_EVENT_COUNTS = f"""WITH {CONN_CTE}, {HTTP_CTE}, {PROC_CTE},
    formats AS (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format),
    runs AS (SELECT cve_name, 'network' AS log_family FROM conn UNION ALL SELECT cve_name, 'http' FROM http
      UNION ALL SELECT cve_name, 'process' FROM proc)
    SELECT format, log_family, cve_name, count(*) AS events FROM runs, formats GROUP BY ALL"""


@query("k01_k02_event_files", _EVENT_COUNTS)
def event_files(spark, sf_dir):
    """JSON lines and CEF lines in files, read back as text and counted."""
    root = work_folder(spark, "files")
    write_event_files(_all_events(spark, sf_dir), root)
    lines = spark.read.text(root).filter(F.length("value") > 0)
    return lines.groupBy("format", "log_family", "cve_name").agg(F.count("*").alias("events"))


@query("k01_s08_read_layout", _EVENT_COUNTS)
def event_files_again(spark, sf_dir):
    """Event files of all formats, written and found again by the layout reader."""
    root = work_folder(spark, "files")
    write_event_files(_all_events(spark, sf_dir), root)
    columns = ["format", "log_family", "cve_name"]
    rows = None
    for events in read_layout(spark, root).values():
        events = events.select(*columns)
        rows = events if rows is None else rows.unionByName(events)
    return rows.groupBy(*columns).agg(F.count("*").alias("events"))


@query(
    "g05_run_artefacts",
    f"""WITH {CONN_CTE} SELECT DISTINCT cve_name, format FROM conn,
        (SELECT unnest(['pcap', 'zeek', 'cim', 'ecs', 'ocsf']) AS format) AS f""",
)
def run_artefacts(spark, sf_dir):
    """What every run should have left; none has a capture, or a connection log by name."""
    return missing_run_artefacts(list_artefacts(spark, _log_folder(spark, sf_dir)))


@query("k01_event_files_rebalanced", _EVENT_COUNTS)
def event_files_rebalanced(spark, sf_dir):
    """The same for input that is not clustered by run: its records are, before they are
    rendered."""
    root = work_folder(spark, "files")
    write_event_files(_all_events(spark, sf_dir, clustered=True), root)
    lines = spark.read.text(root).filter(F.length("value") > 0)
    return lines.groupBy("format", "log_family", "cve_name").agg(F.count("*").alias("events"))


@query(
    "k01_clustered_by_run",
    f"""WITH {CONN_CTE} SELECT cve_name, format, count(*) AS events FROM conn,
        (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format) AS f GROUP BY ALL""",
)
def clustered_files(spark, sf_dir):
    """Records brought together by run before they fan out into files."""
    root = work_folder(spark, "files")
    conn = cluster_by_run(adapters.zeek_conn(spark, sf_dir))
    write_event_files(fan_out(conn, "network", ["cve_name"]), root)
    lines = spark.read.text(root).filter(F.length("value") > 0)
    return lines.groupBy("cve_name", "format").agg(F.count("*").alias("events"))


@query(
    "k03_process_snapshots",
    f"""WITH {PROC_CTE} SELECT cve_name, count(DISTINCT ts) AS snapshots, min(ts) AS first_ts, 5 * count(*) AS events
        FROM proc GROUP BY 1""",
)
def process_snapshots(spark, sf_dir):
    """Process events keep the time of their snapshot."""
    root = work_folder(spark, "snapshots")
    proc = cluster_by_run(adapters.proc(spark, sf_dir))
    rows = fan_out(proc, "process", ["cve_name", "ts"]).withColumnRenamed("ts", "snapshot_ts")
    write_event_store(rows, root)
    return spark.read.parquet(root).groupBy("cve_name").agg(
        F.count_distinct("snapshot_ts").alias("snapshots"),
        F.min("snapshot_ts").alias("first_ts"),
        F.count("*").alias("events"),
    )


@query(
    "k04_log_tables",
    f"""WITH {CONN_CTE} SELECT cve_name, CAST(sum(coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0)) AS BIGINT) AS bytes,
        count(*) AS events FROM conn GROUP BY 1""",
)
def log_tables(spark, sf_dir):
    """Rows of the CIM log table, with VARIANT events, written and queried."""
    root = work_folder(spark, "table")
    conn = adapters.zeek_conn(spark, sf_dir).withColumn("log_type", F.lit("network"))
    events = conversions.convert(conn, "network", "cim", ["cve_name", "log_type"], "document")
    with many_writers(spark):
        log_table_rows(events, "cim").write.partitionBy("cve_name").parquet(root)
    return spark.read.parquet(root).groupBy("cve_name").agg(
        F.sum(F.variant_get("event", "$.bytes", "bigint")).alias("bytes"),
        F.count("created_at").alias("events"),
    )


@query(
    "k05_search_documents",
    f"""WITH {CONN_CTE} SELECT cve_name, 'network' AS log_type, count(*) AS documents,
        CAST(sum(coalesce(orig_bytes, 0)) AS BIGINT) AS bytes_in FROM conn GROUP BY 1""",
)
def search_documents(spark, sf_dir):
    """Documents exported as JSON lines, one folder per index; the CIM index is read."""
    root = work_folder(spark, "index")
    conn = adapters.zeek_conn(spark, sf_dir)
    events = fan_out(conn, "network", ["cve_name"]).withColumn("log_type", F.col("log_family"))
    write_documents(events, root)
    schema = "cve_name STRING, log_type STRING, bytes_in BIGINT"
    documents = spark.read.schema(schema).json(f"{root}/format=cim")
    return documents.groupBy("cve_name", "log_type").agg(
        F.count("*").alias("documents"), F.sum("bytes_in").alias("bytes_in")
    )


@query(
    "k05_cef_documents",
    f"WITH {CONN_CTE} SELECT cve_name, count(*) AS documents FROM conn GROUP BY 1",
)
def cef_documents(spark, sf_dir):
    """A CEF line becomes a document with the line in field ``event``."""
    conn = adapters.zeek_conn(spark, sf_dir)
    events = fan_out(conn, "network", ["cve_name"], formats=["cef"])
    text = F.col("document")
    documents = text_documents(events.withColumn("log_type", F.col("log_family"))).select(
        F.get_json_object(text, "$.cve_name").alias("cve_name"),
        F.get_json_object(text, "$.event").alias("event"),
    )
    lines = documents.filter(F.col("event").startswith("CEF:0|"))
    return lines.groupBy("cve_name").agg(F.count("*").alias("documents"))


@query(
    "g07_json_arrays",
    f"""WITH {CONN_CTE} SELECT cve_name, count(*) AS events, CAST(sum(coalesce(resp_bytes, 0)) AS BIGINT) AS bytes_out
        FROM conn GROUP BY 1""",
)
def json_arrays(spark, sf_dir):
    """Array documents written, and read back by the document reader."""
    root = work_folder(spark, "arrays")
    conn = adapters.zeek_conn(spark, sf_dir).withColumn("log_type", F.lit("network"))
    events = conversions.convert(conn, "network", "cim", ["cve_name", "log_type"], "document")
    write_json_array(events.withColumn("format", F.lit("cim")), root, most=1000)
    rows = document_rows(spark.read.text(root, wholetext=True))
    return rows.groupBy("cve_name").agg(
        F.count("*").alias("events"),
        F.sum(F.variant_get("event", "$.bytes_out", "bigint")).alias("bytes_out"),
    )


@query(
    "s08_g05_artefacts",
    f"""WITH {CONN_CTE} SELECT DISTINCT cve_name, 'zeek' AS format FROM conn
        UNION SELECT DISTINCT cve_name, 'cef' FROM conn""",
)
def artefacts(spark, sf_dir):
    """Non-empty files of a layout per run and format, without reading them."""
    files = list_artefacts(spark, _log_folder(spark, sf_dir))
    return files.filter(F.col("length") > 0).select("cve_name", "format").distinct()


@query(
    "g05_missing_artefacts",
    f"""WITH {CONN_CTE} SELECT DISTINCT cve_name, format FROM conn,
        (SELECT unnest(['cim', 'ecs', 'ocsf', 'udm']) AS format) AS f""",
)
def missing_artefacts(spark, sf_dir):
    """Formats without a non-empty file; only raw and CEF files were left."""
    files = list_artefacts(spark, _log_folder(spark, sf_dir)).filter(F.col("length") > 0)
    return missing_formats(files)


@query(
    "s08_json_lines",
    f"WITH {CONN_CTE} SELECT uid, service FROM conn",
)
def json_lines(spark, sf_dir):
    """Raw log lines as VARIANT events, no field lost."""
    lines = adapters.zeek_conn(spark, sf_dir).select(_lines(None).alias("value"))
    return json_line_rows(lines).select(
        F.variant_get("event", "$.uid", "string").alias("uid"),
        F.try_variant_get("event", "$.service", "string").alias("service"),
    )


def _stream_all_formats(spark, sf_dir, purpose):
    log = read_log_stream(spark, _log_folder(spark, sf_dir), "network", "part-*.txt")
    stream = with_path_columns(good_records(log), "source_path").drop("format")
    events = fan_out(stream, "network", ["cve_name", "uid"])
    target, checkpoint = work_folder(spark, purpose), work_folder(spark, "checkpoint")
    route_batches(events, target, checkpoint).awaitTermination()
    return spark.read.parquet(target)


@query(
    "t01_stream_cim",
    f"""WITH {CONN_CTE} SELECT uid, cve_name, coalesce(orig_bytes, 0) + coalesce(resp_bytes, 0) AS bytes,
        coalesce(CAST("id.resp_p" AS VARCHAR), '0') AS dest_port FROM conn""",
)
def stream_cim(spark, sf_dir):
    """A file stream through the batch conversions; one format of the result."""
    rows = _stream_all_formats(spark, sf_dir, "stream").filter(F.col("format") == "cim")
    return rows.select(
        "uid",
        "cve_name",
        F.get_json_object("event", "$.bytes").cast("bigint").alias("bytes"),
        F.get_json_object("event", "$.dest_port").alias("dest_port"),
    )


@query(
    "s09_k06_stream_routing",
    f"""WITH {CONN_CTE} SELECT format, cve_name, count(*) AS events FROM conn,
        (SELECT unnest(['cim', 'ecs', 'ocsf', 'cef', 'udm']) AS format) AS f GROUP BY ALL""",
)
def stream_routing(spark, sf_dir):
    """A monitored directory, routed to a folder per format."""
    rows = _stream_all_formats(spark, sf_dir, "routed")
    return rows.groupBy("format", "cve_name").agg(F.count("*").alias("events"))


T02_SQL = f"""WITH {CONN_CTE} SELECT cve_name, min(ts) AS ts FROM conn
        WHERE coalesce("id.resp_p" = 4444, false) OR coalesce("id.orig_p" = 4444, false) GROUP BY 1"""


def _alerts(spark, sf_dir, batches, raise_alerts):
    """Alerts on port 4444 of records that come in so many batches, older or not."""
    root = work_folder(spark, "alert-logs")
    target, checkpoint = work_folder(spark, "alerts"), work_folder(spark, "checkpoint")
    conn = adapters.zeek_conn(spark, sf_dir).withColumn("value", _lines(None))
    for rest in range(batches):
        part = conn.filter(F.pmod("event_id", F.lit(batches)) == rest)
        lines = part.select("cve_name", F.lit("zeek").alias("format"), "value")
        with many_writers(spark):
            lines.write.mode("append").partitionBy("cve_name", "format").text(root)
        log = read_log_stream(spark, root, "network", "part-*.txt")
        stream = with_path_columns(good_records(log), "source_path")
        raise_alerts(stream, port_match(4444), target, checkpoint).awaitTermination()
    return read_alerts(spark, target)


@query("t02_stream_alerts", T02_SQL)
def stream_alerts(spark, sf_dir):
    """One alert per run with a connection on port 4444, from a file stream."""
    return _alerts(spark, sf_dir, 2, alert_once)


@query("t02_state_alerts", T02_SQL)
def state_alerts(spark, sf_dir):
    """The same alerts from keyed state, over three batches and a restart before each."""
    key, provider = STATE_STORE
    before = spark.conf.get(key)
    spark.conf.set(key, provider)
    try:
        return _alerts(spark, sf_dir, 3, alert_from_state)
    finally:
        spark.conf.set(key, before)
