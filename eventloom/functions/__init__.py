"""Column functions and column-adding DataFrame transforms, all native Spark."""

from eventloom.functions.cef import cef_escape_extension, cef_escape_header, cef_line
from eventloom.functions.commands import with_command, with_shell_words
from eventloom.functions.options import option_map
from eventloom.functions.scalars import (
    epoch_millis,
    http_activity_id,
    integer_convertible,
    strip,
    to_integer,
)
from eventloom.functions.urls import with_url_parts

__all__ = [
    "cef_escape_extension",
    "cef_escape_header",
    "cef_line",
    "epoch_millis",
    "http_activity_id",
    "integer_convertible",
    "option_map",
    "strip",
    "to_integer",
    "with_command",
    "with_shell_words",
    "with_url_parts",
]
