"""Event files and the event store.

Both are partitioned by format, log family and run. Input that comes from a run
layout is already clustered by run, so writing needs no shuffle. Records in another
order are best brought together before they are rendered
(:func:`eventloom.operators.convert.cluster_by_run`). For events that are rendered
already, ``rebalance`` evens out the files: Spark then splits a run that holds much
of the data over many tasks and joins small ones, and moves all text once.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventloom.operators.convert import text_documents
from eventloom.session import many_writers, small_shares

PARTITIONS = ("format", "log_family", "cve_name")

# Most of the text is names of fields, which gzip takes out at its fastest. Such files do
# not split, so that none is large.
_LINES = {
    "compression": "gzip",
    "zlib.compress.level": "BEST_SPEED",
    "maxRecordsPerFile": 250_000,
}


def _clustered(events: DataFrame, rebalance: bool, keys: tuple[str, ...]) -> DataFrame:
    return events.hint("rebalance", *keys) if rebalance else events


@contextmanager
def _writing(spark: SparkSession, rebalance: bool) -> Iterator[None]:
    """Events that are moved themselves are not made any larger in their task."""
    with many_writers(spark):
        if rebalance:
            yield
        else:
            with small_shares(spark):
                yield


def write_event_files(
    events: DataFrame, path: str, rebalance: bool = False, mode: str = "append"
) -> None:
    """Events as text files, gzipped: one JSON object, or one CEF line, per line.

    Columns ``format``, ``log_family``, ``cve_name``, ``event``.
    """
    lines = events.select(*PARTITIONS, F.col("event").alias("value"))
    writer = _clustered(lines, rebalance, PARTITIONS).write.mode(mode).options(**_LINES)
    with _writing(events.sparkSession, rebalance):
        writer.partitionBy(*PARTITIONS).text(path)


def write_event_store(
    events: DataFrame, path: str, rebalance: bool = False, mode: str = "append"
) -> None:
    """Events as Parquet, with every other column (log type, snapshot time …) kept.

    Nothing is written for an empty snapshot.
    """
    writer = _clustered(events, rebalance, PARTITIONS).write.mode(mode)
    with _writing(events.sparkSession, rebalance):
        writer.partitionBy(*PARTITIONS).parquet(path)


def write_json_array(events: DataFrame, path: str, most: int = 10_000) -> None:
    """JSON array documents of at most ``most`` events for each run, format and log type.

    A loader gets the same events from several arrays as from one, and no group is
    ever gathered whole.
    """
    keys = ("format", "cve_name", "log_type")
    # A group's rows of one task are numbered, so that all its arrays but one are full.
    rows = events.select(
        *keys, "event", F.spark_partition_id().alias("_task"),
        F.monotonically_increasing_id().alias("_row"),
    )
    number = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy("_row"))
    array = F.concat(F.lit("["), F.array_join(F.collect_list("event"), ","), F.lit("]"))
    arrays = (
        rows.withColumn("_chunk", F.floor((number - 1) / most))
        .groupBy(*keys, "_task", "_chunk")
        .agg(array.alias("value"))
        .select(*keys, "value")
    )
    # One document to a file, as its readers expect.
    writer = arrays.write.option("maxRecordsPerFile", 1).mode("append")
    with many_writers(events.sparkSession):
        writer.partitionBy(*keys).text(path)


def write_documents(events: DataFrame, path: str, mode: str = "append") -> None:
    """Search documents as JSON lines, gzipped, one directory per index.

    Columns ``format``, ``cve_name``, ``log_type``, ``event``. Loading them into a
    search cluster is the connector's work; its format name and options go in
    place of ``text``.
    """
    lines = text_documents(events).select("format", F.col("document").alias("value"))
    with many_writers(events.sparkSession):
        lines.write.mode(mode).options(**_LINES).partitionBy("format").text(path)
