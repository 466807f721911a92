"""Headline queries, timed; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the number of cores. The tables
come in one small file each, which Spark cannot split; they are copied into one
file per core first, the way a large table is laid out. Every query then runs in
full into a sink that drops the rows, twice, and the better time counts: the first
run pays for compiling. Two end-to-end rows convert JSON log files into event files
of all five formats, read and write included.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from eventloom.operators import fan_out, with_path_columns  # noqa: E402
from eventloom.plans import QUERIES, adapters  # noqa: E402
from eventloom.session import local_session  # noqa: E402
from eventloom.sinks import write_event_files  # noqa: E402
from eventloom.sources import good_records, read_log  # noqa: E402

HEADLINE = [
    "g01_port_detect",
    "g02_runs_with_text",
    "g03_ports_seen",
    "g05_missing_formats",
    "t03_quiet_snapshots",
    "x05_url_parts",
    "x06_command",
    "j01_http_cim",
    "j02_http_ecs",
    "j03_http_ocsf",
    "j04_http_cef",
    "j05_http_udm",
    "j06_network_cim",
    "j07_network_ecs",
    "j08_network_ocsf",
    "j09_network_cef",
    "j10_network_udm",
    "j11_process_cim",
    "j12_process_ecs",
    "j13_process_ocsf",
    "j14_process_cef",
    "j15_process_udm",
    "j16_fan_out_http",
    "j16_fan_out_network",
    "j16_fan_out_process",
    "v01_v15_manifest_rules",
    "s05_text_lines",
]


def timed(action) -> float:
    start = time.perf_counter()
    action()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    work = tempfile.mkdtemp(prefix="eventloom-bench-")
    spark = local_session(
        cpus,
        **{"spark.sql.shuffle.partitions": str(cpus), "spark.checkpoint.dir": f"{work}/shared"},
    )
    results, rates = {}, {}

    def drop_rows(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    tables = f"{work}/tables"
    for name in ("customer", "documents", "events", "pages", "part"):
        table = adapters.table(spark, sf_dir, name)
        table.repartition(cpus).write.parquet(f"{tables}/{name}.parquet")

    for name in HEADLINE:
        results[name] = min(
            timed(lambda: drop_rows(QUERIES[name](spark, tables))) for _ in range(2)
        )

    sources = {"http": adapters.zeek_http, "network": adapters.zeek_conn}
    for family, source in sources.items():
        logs = f"{work}/logs/{family}"
        records = source(spark, tables)
        fields = [f"`{c}`" for c in records.columns if c != "event_id"]
        lines = records.select(
            "cve_name", F.lit("zeek").alias("format"), F.to_json(F.struct(*fields)).alias("value")
        )
        # One folder per run, as the sensor leaves them.
        lines.repartition(cpus, "cve_name").write.partitionBy("cve_name", "format").text(logs)
        rows = records.count()

        def convert_all(run: int, family=family, logs=logs) -> None:
            log = good_records(read_log(spark, logs, family, "part-*.txt"))
            tagged = with_path_columns(log, "source_path").drop("format", "log_family")
            events = fan_out(tagged, family, ["cve_name"])
            write_event_files(events, f"{work}/out{run}/{family}")

        name = f"e2e_convert_{family}"
        results[name] = min(timed(lambda: convert_all(run)) for run in range(2))
        rates[name] = round(rows / results[name])
    spark.stop()
    shutil.rmtree(work, ignore_errors=True)

    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(results.values()), 3),
                "unit": "sec",
                "queries": {name: round(seconds, 3) for name, seconds in results.items()},
                "records_per_sec": rates,
                "sf": float(scale.group(1)) if scale else None,
            }
        )
    )


if __name__ == "__main__":
    main()
