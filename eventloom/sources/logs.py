"""Readers for network-sensor logs (NDJSON)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from eventloom.functions.scalars import strip
from eventloom.operators.naming import file_path, with_path_columns
from eventloom.schemas import CORRUPT, NULL_KEYS, ZEEK_CONN, ZEEK_HTTP, quoted

LOG_SCHEMAS = {"http": ZEEK_HTTP, "network": ZEEK_CONN}

# File name of the log each family is converted from.
LOG_FILES = {"http": "http.log", "network": "conn.log"}

SOURCE_PATH = "source_path"


def by_name(reader, file_name: str):
    """A reader, batch or stream, of all files of a name below its root."""
    # A pattern on the file name leaves the other logs unlisted and unread.
    return reader.option("recursiveFileLookup", "true").option("pathGlobFilter", file_name)


def read_log(
    spark: SparkSession,
    root: str | list[str],
    family: str,
    file_name: str | None = None,
    strict: bool = False,
) -> DataFrame:
    """Records of one log family from every matching file below ``root``.

    Files are matched by exact name (or glob). A broken line gives a row with its
    text in ``_corrupt_record``; with ``strict`` it fails the job, and so does a value
    of another type. ``source_path`` tells the file. Run and format columns come from
    :func:`eventloom.operators.with_path_columns`.
    """
    name = LOG_FILES[family] if file_name is None else file_name
    if strict:
        reader = by_name(spark.read, name).option("mode", "FAILFAST")
        df = reader.schema(LOG_SCHEMAS[family]).json(root)
        return df.withColumn(SOURCE_PATH, file_path())
    return log_records(by_name(spark.read, name).text(root), family)


def log_records(lines: DataFrame, family: str) -> DataFrame:
    """Typed records out of the lines of a text source, batch or stream.

    A line is good when it is a JSON object, whatever columns are asked for later. A
    value of another type is converted where that is possible, with fractions of whole
    numbers cut off, and null otherwise. Of a repeated key the last value counts. The
    text of any other line is in ``_corrupt_record``; blank lines give no row.
    """
    schema = LOG_SCHEMAS[family]
    lines = lines.select("value", file_path().alias(SOURCE_PATH)).filter(
        F.length(strip(F.col("value"))) > 0
    )
    parsed = lines.withColumn("_record", F.try_parse_json("value"))
    # VARIANT refuses repeated keys and numbers such as NaN.
    options = {"columnNameOfCorruptRecord": CORRUPT}
    again = F.from_json("value", f"{schema}, {CORRUPT} STRING", options)
    parsed = parsed.withColumn("_again", F.when(F.col("_record").isNull(), again))
    read_again = F.col("_again").isNotNull() & F.col("_again").getField(CORRUPT).isNull()
    good = strip(F.col("value")).startswith("{") & (F.col("_record").isNotNull() | read_again)
    typed = [
        F.coalesce(
            F.try_variant_get("_record", f"$['{f.name}']", f.dataType.simpleString()),
            F.col("_again").getField(f.name),
        ).alias(f.name)
        for f in StructType.fromDDL(schema).fields
    ]
    broken = F.when(~good, F.col("value"))
    return parsed.select(*typed, broken.alias(CORRUPT), SOURCE_PATH)


def good_records(log: DataFrame) -> DataFrame:
    """Rows the reader could parse. Comment lines are not JSON and fall out too."""
    return log.filter(F.col(CORRUPT).isNull()).drop(CORRUPT)


def quarantine(log: DataFrame) -> DataFrame:
    """Text and file of the lines that could not be parsed."""
    return log.filter(F.col(CORRUPT).isNotNull()).select(SOURCE_PATH, CORRUPT)


def read_runs(
    spark: SparkSession, root: str, family: str, file_name: str | None = None
) -> DataFrame:
    """Good records of a log layout with run, format and log-type columns."""
    return with_path_columns(good_records(read_log(spark, root, family, file_name)), SOURCE_PATH)


def parse_lines(lines: DataFrame, family: str, text: str = "value") -> DataFrame:
    """Typed records from a column of JSON lines, telling null from absent.

    For inputs where an explicit null must not be replaced by a default: the keys
    that were null are listed in ``_null_keys``, which the mappings honour. Lines
    that are no JSON object are dropped. Other columns are carried along.
    """
    others = [c for c in lines.columns if c != text]
    record = F.try_parse_json(F.col(text))
    parsed = lines.select(*others, record.alias("_record")).filter(
        F.schema_of_variant("_record").startswith("OBJECT")
    )
    fields = StructType.fromDDL(LOG_SCHEMAS[family]).fields

    def path(name: str) -> str:
        return f"$['{name}']"

    typed = [
        F.try_variant_get(F.col("_record"), path(f.name), f.dataType.simpleString()).alias(f.name)
        for f in fields
    ]
    nulls = F.array_compact(
        F.array(
            *(
                F.when(
                    F.is_variant_null(F.variant_get(F.col("_record"), path(f.name), "variant")),
                    F.lit(f.name),
                )
                for f in fields
            )
        )
    )
    return parsed.select(*(quoted(c) for c in others), *typed, nulls.alias(NULL_KEYS))
