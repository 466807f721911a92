"""Conversions of parsed records into the five event formats."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import NORMALISED
from eventloom.mappings import DEFAULT_IDENTITY, Identity, Record, apply_mapping, mapping_for
from eventloom.schemas import quoted


def convert(
    df: DataFrame,
    family: str,
    format: str,
    keep: Iterable[str] = (),
    output: str = "event",
    now: float | None = None,
    identity: Identity = DEFAULT_IDENTITY,
) -> DataFrame:
    """Convert ``http``, ``network`` or ``process`` records to one format.

    See :func:`eventloom.mappings.apply_mapping` for ``keep``, ``output`` and
    ``now``. A CEF event is a text line in every output; ``flat`` adds its
    extensions as columns.
    """
    return apply_mapping(df, mapping_for(family, format, identity), keep, output, now)


def fan_out(
    df: DataFrame,
    family: str,
    keep: Iterable[str] = (),
    formats: Iterable[str] = NORMALISED,
    now: float | None = None,
    identity: Identity = DEFAULT_IDENTITY,
) -> DataFrame:
    """All formats of every record from one scan, in long form.

    One row per record and format: the kept columns, ``format``, ``log_family``
    and ``event`` as text. Narrow: no shuffle, whatever the input size.
    """
    mappings = {name: mapping_for(family, name, identity) for name in formats}
    for prepare in dict.fromkeys(m.prepare for m in mappings.values()):
        df = prepare(df)
    record = Record(df, now)
    rows = F.array(
        *(
            F.struct(F.lit(name).alias("format"), mapping.document(record).alias("event"))
            for name, mapping in mappings.items()
        )
    )
    kept = [F.col(quoted(name)) for name in keep]
    return df.select(*kept, F.lit(family).alias("log_family"), F.inline(rows))


def cluster_by_run(records: DataFrame, run: str = "cve_name") -> DataFrame:
    """Bring the records of a run together before they are converted and written.

    For input that is not laid out by run. It moves the records once, not their
    five events; Spark splits a run that is too large for one task and joins small
    ones.
    """
    return records.hint("rebalance", run)


def document(cve_name: Column, log_type: Column, event: Column, keys: Iterable[str] = ()) -> Column:
    """A search-index document: run and log type, then the fields of the event.

    ``event`` is a struct column and ``keys`` its field names. A field of the
    event that is called like one of the two tags wins over the tag.
    """
    keys = list(keys)
    tags = {"cve_name": cve_name, "log_type": log_type}
    own = [event[key].alias(key) for key in keys]
    return F.struct(*(c.alias(n) for n, c in tags.items() if n not in keys), *own)


def documents(df: DataFrame, event: str = "event") -> DataFrame:
    """Documents for struct events, from columns ``cve_name``, ``log_type``, ``event``."""
    keys = df.schema[event].dataType.fieldNames()
    return df.select(
        document(F.col("cve_name"), F.col("log_type"), F.col(quoted(event)), keys).alias("document")
    )


def text_documents(df: DataFrame) -> DataFrame:
    """Documents as JSON text for events that are JSON text or, for CEF, lines.

    Columns ``cve_name``, ``log_type``, ``format``, ``event``. The tags are put in
    front of the event's own fields, less those the event has itself. Events of the
    loader, which are VARIANT, are rendered first.
    """
    if df.schema["event"].dataType.typeName() == "variant":
        df = df.withColumn("event", F.to_json("event"))
    tag = F.to_json(F.struct("cve_name", "log_type"))
    # The top-level keys decide whether a tag is overridden; almost never.
    keys = F.json_object_keys("event")
    free = F.to_json(
        F.struct(
            F.when(~F.array_contains(keys, "cve_name"), F.col("cve_name")).alias("cve_name"),
            F.when(~F.array_contains(keys, "log_type"), F.col("log_type")).alias("log_type"),
        ),
        {"ignoreNullFields": "true"},
    )
    clash = F.col("event").contains('"cve_name"') | F.col("event").contains('"log_type"')
    head = F.when(clash, free).otherwise(tag)
    body = F.substr(F.ltrim(F.col("event")), F.lit(2))
    inner = F.substr(head, F.lit(1), F.length(head) - 1)
    # A comma goes between the two only when both hold something.
    comma = F.when((inner == "{") | body.rlike(r"^\s*\}"), "").otherwise(",")
    merged = F.concat(inner, comma, body)
    line = F.to_json(F.struct("cve_name", "log_type", "event"))
    return df.select(
        "format", F.when(F.col("format") == "cef", line).otherwise(merged).alias("document")
    )
