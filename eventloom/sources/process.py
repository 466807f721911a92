"""Process-table snapshots to one row per process."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.naming import file_of_path, file_path, log_type, snapshot_time
from eventloom.schemas import PROCESS_TABLE, PROCESS_TITLES


def process_rows(tables: DataFrame) -> DataFrame:
    """One row per process of tables ``Titles``, ``Processes``.

    Every known title becomes a text column, null where the row is shorter or has
    no such title; of repeated titles the last one counts. Other columns are
    carried along. A null table, as left by a failed capture, gives no rows.
    """
    others = [c for c in tables.columns if c not in ("Titles", "Processes")]
    rows = tables.select(*others, "Titles", F.explode("Processes").alias("_row"))
    # Titles beyond the row's end do not count, and the last of equals wins.
    rows = rows.withColumn("_back", F.reverse(F.slice("Titles", F.lit(1), F.size("_row"))))

    def value(title: str):
        back = F.array_position("_back", title)
        place = F.size("_back") + 1 - back
        return F.when(back > 0, F.try_element_at("_row", place.cast("int"))).alias(title)

    return rows.select(*others, *(value(title) for title in PROCESS_TITLES))


def read_process_tables(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Process rows of snapshot documents (JSON lines), with their ``path``.

    ``ts`` is the time in the name of a file ``process_<epoch seconds>.…``, else null.
    """
    tables = spark.read.schema(PROCESS_TABLE).json(path).withColumn("path", file_path())
    taken = snapshot_time(log_type(file_of_path(F.col("path"))))
    return process_rows(tables.withColumn("ts", taken))
