"""Detection and completeness questions over all runs at once.

Every per-run answer is an aggregate that Spark combines before the shuffle, so a
run that holds most of the rows costs one row per map task.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.constants import NORMALISED
from eventloom.functions.patterns import basic_pattern
from eventloom.functions.scalars import strip
from eventloom.schemas import CORRUPT

def port_match(port: int) -> Column:
    """True when either side of a connection has the port; never null."""
    either = (F.col("`id.resp_p`") == port) | (F.col("`id.orig_p`") == port)
    return F.coalesce(either, F.lit(False))


def text_contains(column: str, pattern: str) -> Column:
    """True when rendered text contains the pattern."""
    return F.col(column).contains(pattern)


def established_line(column: str, pattern: str) -> Column:
    """True when a text line has the pattern and the word ESTABLISHED."""
    return F.col(column).contains(pattern) & F.col(column).contains("ESTABLISHED")


def established_match(column: str, pattern: str) -> Column:
    """True when a text line matches a basic regular expression and has the word
    ESTABLISHED: the line filter alone, without the search for the pattern's own text."""
    return F.col(column).rlike(basic_pattern(pattern)) & F.col(column).contains("ESTABLISHED")


def not_blank(column: str) -> Column:
    return F.length(strip(F.col(column))) > 0


def parseable() -> Column:
    """True for records the tolerant reader could parse."""
    return F.col(CORRUPT).isNull()


def detect_port(conn: DataFrame, port: int, run: str = "cve_name") -> DataFrame:
    """Per run: was there a connection on the port, how many, and when first."""
    hit = port_match(port)
    return conn.groupBy(run).agg(
        F.bool_or(hit).alias("detected"),
        F.count_if(hit).alias("connections"),
        F.min(F.when(hit, F.col("ts"))).alias("first_ts"),
    )


def runs_with_text(events: DataFrame, pattern: str) -> DataFrame:
    """Which runs, formats and log types contain a text, and in how many events."""
    return (
        events.filter(text_contains("event", pattern))
        .groupBy("cve_name", "format", "log_type")
        .agg(F.count("*").alias("events"))
    )


def text_found(events: DataFrame, pattern: str) -> DataFrame:
    """Per run: is the text in any event."""
    return events.groupBy("cve_name").agg(
        F.coalesce(F.bool_or(text_contains("event", pattern)), F.lit(False)).alias("found")
    )


def ports_seen(conn: DataFrame, per: Iterable[str] = ()) -> DataFrame:
    """Distinct ports on either side, one row each, from one scan; optionally per run."""
    sides = F.array("`id.resp_p`", "`id.orig_p`")
    return (
        conn.select(*per, F.explode(sides).alias("port"))
        .filter(F.col("port").isNotNull())
        .distinct()
    )


def missing_formats(
    artefacts: DataFrame, runs: DataFrame | None = None, expected: Iterable[str] = NORMALISED
) -> DataFrame:
    """(run, format) pairs without a single event or non-empty file.

    ``artefacts`` has ``cve_name`` and ``format``; ``runs`` adds runs that left
    nothing at all. One aggregate, no join.
    """
    expected = list(expected)
    seen = artefacts.select("cve_name", "format")
    if runs is not None:
        seen = seen.unionByName(
            runs.select("cve_name", F.lit(None).cast("string").alias("format"))
        )
    counts = seen.groupBy("cve_name").agg(
        *(F.count_if(F.col("format") == name).alias(f"n_{name}") for name in expected)
    )
    gaps = F.array_compact(
        F.array(*(F.when(F.col(f"n_{name}") == 0, F.lit(name)) for name in expected))
    )
    return counts.select("cve_name", F.explode(gaps).alias("format"))


# What a complete run leaves behind.
ARTEFACTS = ("pcap", "zeek", "cim", "ecs", "ocsf")


def missing_artefacts(files: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """(run, format) pairs a run should have left and has not.

    ``files`` is a listing with ``cve_name``, ``format``, ``file_name``; Spark lists
    no empty files, so what is there holds something. Of the sensor's logs the
    connection log has to be among them, of the normalised formats any file.
    """
    there = (F.col("format") != "zeek") | (F.col("file_name") == "conn.log")
    # Runs known from the listing alone count as well.
    known = files.select("cve_name") if runs is None else runs.select("cve_name")
    return missing_formats(files.filter(there), known, ARTEFACTS)


def quiet_snapshots(
    snapshots: DataFrame,
    target: str,
    order: Iterable[str],
    content: str,
    bucket: Column,
    keep: Iterable[str] = (),
) -> DataFrame:
    """Snapshots whose content equals that of the snapshot just before.

    ``order`` gives the sequence within a target, and ``bucket`` a value that
    grows with it (a day, say). Each (target, bucket) is sorted on its own, and
    only its first and last snapshots are put in sequence over the buckets, so a
    single busy target is spread over many tasks.
    """
    order = list(order)
    carried = list(dict.fromkeys([*order, *keep]))
    # A digest, not the log itself, goes through the shuffle.
    rows = snapshots.select(
        F.col(target),
        bucket.alias("_bucket"),
        *(F.col(c) for c in carried),
        F.unhex(F.sha2(F.col(content), 256)).alias("_digest"),
    )
    within = Window.partitionBy(target, "_bucket").orderBy(*order)
    sorted_rows = rows.select(
        "*",
        F.row_number().over(within).alias("_number"),
        F.lag("_digest").over(within).alias("_before"),
        F.lead(F.lit(False), 1, True).over(within).alias("_last"),
    )
    inner = sorted_rows.filter(F.col("_before") == F.col("_digest")).select(target, *carried)
    # The ends of the buckets, few against all rows, are put in sequence; both
    # branches read the same shuffle.
    ends = sorted_rows.filter((F.col("_number") == 1) | F.col("_last"))
    across = Window.partitionBy(target).orderBy(*order)
    edges = (
        ends.withColumn("_before", F.lag("_digest").over(across))
        .filter((F.col("_number") == 1) & (F.col("_before") == F.col("_digest")))
        .select(target, *carried)
    )
    return inner.unionByName(edges)


def first_quiet(quiet: DataFrame, target: str, order: Iterable[str]) -> DataFrame:
    """The first quiet snapshot of each target."""
    first = F.min(F.struct(*order)).alias("_first")
    return quiet.groupBy(target).agg(first).select(target, "_first.*")
