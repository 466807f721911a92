"""Operators: conversions, naming, detection, manifest checks."""

from eventloom.operators.convert import (
    cluster_by_run,
    convert,
    documents,
    fan_out,
    text_documents,
)
from eventloom.operators.detect import (
    detect_port,
    first_quiet,
    missing_artefacts,
    missing_formats,
    ports_seen,
    quiet_snapshots,
    runs_with_text,
    text_found,
)
from eventloom.operators.manifest import read_entries, resolve_runs, valid_runs, validate_manifest
from eventloom.operators.naming import with_path_columns

__all__ = [
    "cluster_by_run",
    "convert",
    "detect_port",
    "documents",
    "fan_out",
    "first_quiet",
    "missing_artefacts",
    "missing_formats",
    "ports_seen",
    "quiet_snapshots",
    "read_entries",
    "resolve_runs",
    "valid_runs",
    "runs_with_text",
    "text_documents",
    "text_found",
    "validate_manifest",
    "with_path_columns",
]
