"""Readers for event files: JSON documents, JSON lines, text lines, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.errors import AnalysisException

from eventloom.constants import FORMAT_TABLES, TEXT_FORMAT
from eventloom.functions.jsontext import document_events, line_event
from eventloom.functions.scalars import strip
from eventloom.operators.manifest import read_entries
from eventloom.operators.naming import file_path, with_event_file_columns, with_path_columns

# Readers take a batch session's `read` or a stream's `readStream` alike.


def _text(reader, path: str | list[str], **options: object) -> DataFrame:
    # As arguments: the reader's own defaults for them override its options.
    return reader.text(path, **options).select("value", file_path().alias("path"))


def document_rows(documents: DataFrame, text: str = "value") -> DataFrame:
    """One row per event of each document, as VARIANT column ``event``.

    An array gives its elements, any other value itself, broken text nothing.
    """
    others = [c for c in documents.columns if c != text]
    return documents.select(*others, F.explode(document_events(F.col(text))).alias("event"))


def broken_documents(documents: DataFrame, text: str = "value") -> DataFrame:
    """The documents :func:`document_rows` passes over."""
    return documents.filter(document_events(F.col(text)).isNull())


def json_line_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """One VARIANT event per JSON line; blank, comment and broken lines fall out."""
    others = [c for c in lines.columns if c != text]
    return lines.select(*others, line_event(F.col(text)).alias("event")).filter(
        F.col("event").isNotNull()
    )


def broken_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """The lines :func:`json_line_rows` passes over, without blank and comment lines."""
    said = strip(F.col(text))
    return lines.filter(
        line_event(F.col(text)).isNull() & (F.length(said) > 0) & ~said.startswith("#")
    )


def text_line_rows(lines: DataFrame, text: str = "value") -> DataFrame:
    """Trimmed, non-blank lines of a text column as ``event``.

    The column may hold single lines or whole texts; only line feeds split.
    """
    others = [c for c in lines.columns if c != text]
    return (
        lines.select(*others, F.explode(F.split(F.col(text), "\n")).alias("_line"))
        .select(*others, strip(F.col("_line")).alias("event"))
        .filter(F.length("event") > 0)
    )


def layout_glob(root: str, format: str) -> str:
    return f"{root.rstrip('/')}/*/{format}/*"


def read_format(reader, root: str, format: str) -> DataFrame:
    """Events of one format directory over all runs of a layout.

    Columns ``cve_name``, ``format``, ``file_name``, ``log_type``, ``log_family``,
    ``snapshot_ts`` and ``event``: text for CEF, else VARIANT. Sensor logs are
    JSON lines, the normalised formats whole documents. What cannot be read is in
    :func:`read_quarantine`. A missing directory is the caller's to leave out in batch;
    see :func:`read_layout`.
    """
    path = layout_glob(root, format)
    if format == TEXT_FORMAT:
        rows = text_line_rows(_text(reader, path, lineSep="\n"))
    elif format == "zeek":
        rows = json_line_rows(_text(reader, path))
    else:
        rows = document_rows(_text(reader, path, wholetext=True))
    return with_path_columns(rows, "path").drop("path")


def read_quarantine(reader, root: str, format: str) -> DataFrame:
    """``path`` and ``value`` of the documents or lines of a format directory that
    :func:`read_format` gives no event of; none for CEF, where every line is one."""
    path = layout_glob(root, format)
    if format == TEXT_FORMAT:
        return _text(reader, path, lineSep="\n").filter(F.lit(False)).select("path", "value")
    if format == "zeek":
        return broken_lines(_text(reader, path)).select("path", "value")
    return broken_documents(_text(reader, path, wholetext=True)).select("path", "value")


def read_event_files(reader, root: str, format: str) -> DataFrame:
    """Events of one format out of :func:`eventloom.sinks.write_event_files`.

    The columns are those of :func:`read_format`. JSON formats are JSON lines there, so
    their files split; CEF is lines of text.
    """
    rows = _text(reader, f"{root.rstrip('/')}/format={format}/*/*", lineSep="\n")
    rows = text_line_rows(rows) if format == TEXT_FORMAT else json_line_rows(rows)
    return with_event_file_columns(rows, "path").drop("path")


def read_layout(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Events of every format that has files, by format.

    Knows folders by run, then format, and the event files this library writes; a root
    may hold both.
    """
    found: dict[str, DataFrame] = {}
    for name in FORMAT_TABLES:
        for read in (read_format, read_event_files):
            try:
                rows = read(spark.read, root, name)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
            else:
                found[name] = found[name].unionByName(rows) if name in found else rows
    return found


def list_artefacts(spark: SparkSession, root: str) -> DataFrame:
    """Files of a layout with run, format, log type and length; contents stay unread.

    Spark leaves empty files out of every listing.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(root)
        .select("path", "length")
    )
    return with_path_columns(files, "path").filter(F.col("format").isNotNull())


def read_manifest(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of manifest files, with ``path``; see :func:`read_entries`."""
    return read_entries(_text(spark.read, path, wholetext=True))
