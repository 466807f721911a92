"""Directory monitor, routing to per-format targets, and detection alerts.

The conversions keep no state, so a stream runs the very functions a batch does.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.constants import FORMAT_TABLES
from eventloom.session import many_writers
from eventloom.sources.documents import read_format, read_quarantine
from eventloom.sources.logs import LOG_FILES, by_name, log_records


def read_log_stream(
    spark: SparkSession, root: str, family: str, file_name: str | None = None
) -> DataFrame:
    """New files of a log family below ``root``, as they appear.

    The rows are those of :func:`eventloom.sources.read_log`: ``good_records`` and
    ``quarantine`` tell them apart here too.
    """
    name = LOG_FILES[family] if file_name is None else file_name
    return log_records(by_name(spark.readStream, name).text(root), family)


def monitor_layout(
    spark: SparkSession,
    root: str,
    target: Callable[[str], str],
    checkpoint: str,
    formats: tuple[str, ...] = tuple(FORMAT_TABLES),
    quarantine: Callable[[str], str] | None = None,
) -> list[StreamingQuery]:
    """One monitor per format directory: events of new files go to ``target(format)``.

    Runs over what is there now and stops; the checkpoint remembers the files
    seen. Start it again, or on a schedule, for what has come since. What cannot be
    read goes to ``quarantine(format)``, if that is given.
    """

    def start(rows: DataFrame, path: str, seen: str) -> StreamingQuery:
        return (
            rows.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", f"{checkpoint}/{seen}")
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )

    found = [start(read_format(spark.readStream, root, x), target(x), x) for x in formats]
    if quarantine is not None:
        for x in formats:
            broken = read_quarantine(spark.readStream, root, x)
            found.append(start(broken, quarantine(x), f"{x}-quarantine"))
    return found


def route_batches(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Write a stream of events of all formats to one folder per format.

    A batch is one write to ``target/batch_id=N/format=…``. A batch that runs again
    after a failure replaces its own output, so every event is there once; reading
    ``target`` with a filter on ``format`` opens that format's folders only.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        with many_writers(batch.sparkSession):
            batch.write.mode("overwrite").partitionBy("format").parquet(
                f"{target}/batch_id={batch_id}"
            )

    return (
        events.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


_ALERTS = "cve_name STRING, ts DOUBLE, corrects BOOLEAN, batch_id LONG"


def alert_once(
    records: DataFrame, condition: Column, target: str, checkpoint: str
) -> StreamingQuery:
    """Keep an alert table with the earliest matching record of each run.

    Needs ``cve_name`` and ``ts`` (epoch seconds). What a batch adds is written to
    ``target/batch_id=N``: a row for each run that has raised no alert before, however
    old its records are, and one that ``corrects`` it if an earlier record comes later.
    A batch that runs again replaces its own rows. :func:`read_alerts` gives one row a
    run. Matches are combined by run before they are shuffled.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = batch.filter(condition).groupBy("cve_name").agg(F.min("ts").alias("ts"))
        try:
            earlier = spark.read.schema(_ALERTS).parquet(target)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            earlier = spark.createDataFrame([], _ALERTS)
        known = (
            earlier.filter(F.col("batch_id") < batch_id)
            .groupBy("cve_name")
            .agg(F.min("ts").alias("known_ts"), F.lit(True).alias("corrects"))
        )
        same_run = found["cve_name"].eqNullSafe(known["cve_name"])
        new = found.join(known, same_run, "left").filter(
            F.col("corrects").isNull() | F.coalesce(F.col("ts") < F.col("known_ts"), F.lit(False))
        )
        new.select(
            found["cve_name"], "ts", F.coalesce("corrects", F.lit(False)).alias("corrects")
        ).write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    return (
        records.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, target: str) -> DataFrame:
    """``cve_name`` and the earliest ``ts`` of every run that raised an alert."""
    alerts = spark.read.schema(_ALERTS).parquet(target)
    return alerts.groupBy("cve_name").agg(F.min("ts").alias("ts"))
