"""Alerts from keyed state: what a run has raised is kept with the stream itself."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

# Keyed state needs this state store; a session that runs these streams has to set it.
STATE_STORE = (
    "spark.sql.streaming.stateStore.providerClass",
    "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
)
_RAISED = "cve_name STRING, ts DOUBLE, corrects BOOLEAN"


def _earliest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each run of a batch, so that a busy run costs few rows in the shuffle."""
    for batch in batches:
        # A time that is no number comes after all others, and a missing one after those.
        ts = batch.column("ts")
        number = pc.and_kleene(pc.is_valid(ts), pc.invert(pc.is_nan(ts)))
        rows = pa.table(
            {
                "cve_name": batch.column("cve_name"),
                "number": pc.if_else(number, ts, pa.scalar(None, pa.float64())),
                "nan": pc.fill_null(pc.is_nan(ts), False),
            }
        )
        least = rows.group_by("cve_name").aggregate([("number", "min"), ("nan", "max")])
        ts = pc.if_else(
            pc.and_(pc.is_null(least["number_min"]), least["nan_max"]),
            pa.scalar(float("nan")),
            least["number_min"],
        )
        for part in pa.table({"cve_name": least["cve_name"], "ts": ts}).to_batches():
            yield part


def _before(ts: float | None, other: float | None) -> bool:
    """Is a time earlier than another: numbers, then what is no number, then nothing."""

    def place(x: float | None) -> tuple:
        return (2, 0.0) if x is None else (1, 0.0) if x != x else (0, x)

    return place(ts) < place(other)


class EarliestMatch(StatefulProcessor):
    """Keeps one value a run: the time of its earliest match so far."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.raised = handle.getValueState("raised", "ts DOUBLE")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        first = next(rows).ts
        for row in rows:
            if _before(row.ts, first):
                first = row.ts
        known = self.raised.exists()
        if known and not _before(first, self.raised.get()[0]):
            return
        self.raised.update((first,))
        yield Row(cve_name=key[0], ts=first, corrects=known)

    def close(self) -> None:
        pass


def raised_alerts(records: DataFrame, condition: Column) -> DataFrame:
    """A stream of alerts: the earliest match of each run, and of it each correction.

    Needs ``cve_name`` and ``ts`` (epoch seconds). A run raises one alert in the batch
    that brings its first match, however old its records are, and a row that
    ``corrects`` it when an earlier match comes later. Records without a run are one
    run; a match without a time alerts with none, and a later one with a time corrects
    it. State is one number a run and is kept for good, since a late record may correct
    any alert. Matches are combined by run before they are shuffled.
    """
    found = records.filter(condition).select(
        F.col("cve_name").cast("string").alias("cve_name"), F.col("ts").cast("double").alias("ts")
    )
    least = found.mapInArrow(_earliest, "cve_name STRING, ts DOUBLE")
    return least.groupBy("cve_name").transformWithState(
        statefulProcessor=EarliestMatch(),
        outputStructType=_RAISED,
        outputMode="Append",
        timeMode="None",
    )


def alert_from_state(
    records: DataFrame, condition: Column, target: str, checkpoint: str
) -> StreamingQuery:
    """Keep the alert table of :func:`alert_once` without reading it in every batch.

    Rows go to ``target/batch_id=N``, where a batch that runs again replaces its own;
    :func:`eventloom.streaming.read_alerts` gives one row a run. The session has to
    use the state store of ``STATE_STORE``.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch_id={batch_id}")

    key, provider = STATE_STORE
    if records.sparkSession.conf.get(key) != provider:
        raise ValueError(f"set {key} to {provider}")
    return (
        raised_alerts(records, condition)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
