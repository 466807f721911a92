"""What several operators share: words, lines, stored tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.session import work_folder

# The white space between words (space, tab to carriage return).
BLANKS = " \t\n\x0b\x0c\r"
# The same as a regular expression writes them.
BLANK_CLASS = r"\x20\x09-\x0D"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words(text: Column) -> Column:
    """Words of a text in order, as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{BLANK_CLASS}]+"), "")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def lines(text: Column) -> Column:
    """Lines between line feeds; null and empty texts are one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def no_rows(spark: SparkSession, schema: str) -> DataFrame:
    """An empty table that Spark plans as such.

    One made of a Python list is an RDD, for which every executor starts Python workers
    of another kind, beside those that it has.
    """
    columns = (part.split() for part in schema.split(", "))
    empty = spark.range(0).select(*(F.lit(None).cast(kind).alias(name) for name, kind in columns))
    return empty.filter(F.lit(False))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a table in the shared folder, which ends their lineage.

    What reads it later depends on those files alone, so a lost executor costs no
    more than the tasks it was running.
    """
    spark = df.sparkSession
    path = work_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
