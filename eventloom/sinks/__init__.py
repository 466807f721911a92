"""Writers: event files, event store, relational log tables, search documents."""

from eventloom.sinks.files import (
    write_documents,
    write_event_files,
    write_event_store,
    write_json_array,
)
from eventloom.sinks.tables import create_log_tables, load_log_tables

__all__ = [
    "create_log_tables",
    "load_log_tables",
    "write_documents",
    "write_event_files",
    "write_event_store",
    "write_json_array",
]
