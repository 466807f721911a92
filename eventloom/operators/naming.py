"""Columns derived from paths and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.constants import FORMAT_TABLES, TEXT_FORMAT

_FORMATS = "|".join(FORMAT_TABLES)
# <root>/<run>/<format>/<file>, or the same with "column=" in front of the names;
# the capture itself has a folder too.
_LAYOUT = f"/(?:cve_name=)?([^/]+)/(?:format=)?({_FORMATS}|pcap)/[^/]+$"


def _unescaped(text: Column) -> Column:
    """Text with its percent escapes undone; a plus sign is one."""
    plain = F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text.contains("%"), F.coalesce(plain, text)).otherwise(text)


def file_path() -> Column:
    """Path of the file a row was read from, as it is called in the file system."""
    return _unescaped(F.col("_metadata.file_path"))


def run_of_path(path: Column) -> Column:
    """Run name from a log path; null when the path has another layout.

    Spark escapes some characters of a value in the name of a partition folder.
    """
    name = F.nullif(F.regexp_extract(path, _LAYOUT, 1), F.lit(""))
    return F.when(path.contains("/cve_name="), _unescaped(name)).otherwise(name)


def format_of_path(path: Column) -> Column:
    """Format directory from a log path."""
    return F.nullif(F.regexp_extract(path, _LAYOUT, 2), F.lit(""))


def file_of_path(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def log_type(file_name: Column) -> Column:
    """File name without its last extension and without one leading format name."""
    stem = F.regexp_replace(file_name, r"(?s)\.[^.]*\z", "")
    return F.regexp_replace(stem, f"^(?:{_FORMATS})_", "")


def log_family(kind: Column) -> Column:
    """The part of a log type before the first underscore (``process_170…`` → ``process``)."""
    return F.substring_index(kind, "_", 1)


def snapshot_time(kind: Column) -> Column:
    """Epoch seconds in the log type of a process snapshot, else null."""
    return F.regexp_extract(kind, "^process_(.+)$", 1).try_cast("double")


def table_of_format(format: Column) -> Column:
    """Relational table of a format; null for an unknown one."""
    target = None
    for name, table in FORMAT_TABLES.items():
        target = (F if target is None else target).when(format == name, table)
    return target


def is_json_format(format: Column) -> Column:
    return F.when(format.isin(*FORMAT_TABLES), format != TEXT_FORMAT)


def prefixed_name(prefix: Column, name: Column) -> Column:
    """``prefix-name``, or the name alone when the prefix is empty or null."""
    bare = F.coalesce(prefix, F.lit("")) == ""
    return F.when(bare, name).otherwise(F.concat_ws("-", prefix, name))


def with_path_columns(df: DataFrame, path: Column | str) -> DataFrame:
    """Add ``cve_name``, ``format``, ``file_name``, ``log_type``, ``log_family``
    and ``snapshot_ts`` for a path column."""
    path = F.col(path) if isinstance(path, str) else path
    df = df.withColumns(
        {
            "cve_name": run_of_path(path),
            "format": format_of_path(path),
            "file_name": file_of_path(path),
        }
    )
    df = df.withColumn("log_type", log_type(F.col("file_name")))
    return df.withColumns(
        {
            "log_family": log_family(F.col("log_type")),
            "snapshot_ts": snapshot_time(F.col("log_type")),
        }
    )


# What :func:`eventloom.sinks.write_event_files` lays out.
_EVENT_FILE = f"/format=({_FORMATS})/log_family=([^/]+)/cve_name=([^/]+)/[^/]+$"


def with_event_file_columns(df: DataFrame, path: Column | str) -> DataFrame:
    """The columns of :func:`with_path_columns` for event files of this library, whose
    folders name format, log family and run; the family stands for the log type too."""
    path = F.col(path) if isinstance(path, str) else path
    part = lambda group: F.nullif(F.regexp_extract(path, _EVENT_FILE, group), F.lit(""))
    family = _unescaped(part(2))
    return df.withColumns(
        {
            "cve_name": _unescaped(part(3)),
            "format": part(1),
            "file_name": file_of_path(path),
            "log_type": family,
            "log_family": family,
            "snapshot_ts": F.lit(None).cast("double"),
        }
    )
