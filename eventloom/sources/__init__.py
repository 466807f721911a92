"""Readers."""

from eventloom.sources.arrays import array_quarantine, read_array_files
from eventloom.sources.documents import (
    document_rows,
    json_line_rows,
    list_artefacts,
    read_event_files,
    read_format,
    read_layout,
    read_quarantine,
    read_manifest,
    text_line_rows,
)
from eventloom.sources.logs import good_records, parse_lines, quarantine, read_log, read_runs
from eventloom.sources.process import process_rows, read_process_tables

__all__ = [
    "array_quarantine",
    "document_rows",
    "good_records",
    "json_line_rows",
    "list_artefacts",
    "parse_lines",
    "process_rows",
    "quarantine",
    "read_array_files",
    "read_event_files",
    "read_format",
    "read_layout",
    "read_quarantine",
    "read_log",
    "read_manifest",
    "read_process_tables",
    "read_runs",
    "text_line_rows",
]
