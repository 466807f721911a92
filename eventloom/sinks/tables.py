"""Relational log tables, one per format."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.constants import FORMAT_TABLES, TEXT_FORMAT


def _event_type(format: str) -> str:
    return "STRING" if format == TEXT_FORMAT else "VARIANT"


def table_name(format: str, prefix: str = "") -> str:
    """Table of a format; ``prefix`` may name a catalog and schema, ending in a dot."""
    return f"{prefix}{FORMAT_TABLES[format]}"


def create_log_tables(spark: SparkSession, prefix: str = "") -> None:
    """Create the six tables that are not there yet, partitioned by run."""
    for format in FORMAT_TABLES:
        spark.sql(
            f"""CREATE TABLE IF NOT EXISTS {table_name(format, prefix)} (
                log_type STRING NOT NULL,
                event {_event_type(format)} NOT NULL,
                created_at TIMESTAMP,
                cve_name STRING NOT NULL
            ) USING PARQUET PARTITIONED BY (cve_name)"""
        )


def log_table_rows(events: DataFrame, format: str) -> DataFrame:
    """Rows for a format's table from ``cve_name``, ``log_type``, ``event``.

    JSON text is parsed; an event that is VARIANT already stays as it is.
    """
    event = F.col("event")
    if format != TEXT_FORMAT and events.schema["event"].dataType.typeName() == "string":
        event = F.parse_json(event)
    return events.select(
        "log_type",
        event.alias("event"),
        F.current_timestamp().alias("created_at"),
        "cve_name",
    )


def load_log_tables(
    events: Mapping[str, DataFrame], prefix: str = "", replace_runs: bool = False
) -> None:
    """Add events, given by format, to the log tables.

    Rows are appended, twice loaded is twice there. With ``replace_runs`` the runs
    that come are replaced as a whole, so a repeated load changes nothing.
    """
    for format, rows in events.items():
        writer = log_table_rows(rows, format).write
        if replace_runs:
            writer = writer.option("partitionOverwriteMode", "dynamic")
        writer.insertInto(table_name(format, prefix), overwrite=replace_runs)
