"""Common Event Format text: escaping and line assembly."""

from __future__ import annotations

from collections.abc import Collection, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

CEF_PREFIX = "CEF:0"


def _escape(value: Column, mark: str) -> Column:
    # The backslash goes first, or it would double the ones added for the mark.
    doubled = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    return F.replace(doubled, F.lit(mark), F.lit("\\" + mark))


def cef_escape_header(value: Column) -> Column:
    """Escape backslash and pipe for a header field."""
    return _escape(value.cast("string"), "|")


def cef_escape_extension(value: Column, escape_newlines: bool = False) -> Column:
    """Escape backslash and equals sign for an extension value.

    Line feeds stay as they are unless ``escape_newlines`` is set; then they
    become the two characters ``\\n``, so that one event stays one line.
    """
    escaped = _escape(value.cast("string"), "=")
    if escape_newlines:
        escaped = F.replace(escaped, F.lit("\n"), F.lit("\\n"))
    return escaped


def cef_line(
    header: Sequence[Column],
    extensions: Sequence[tuple[str, Column]],
    escape_newlines: bool = False,
    numbers: Collection[str] = (),
) -> Column:
    """One CEF line from six header columns and (key, value) extensions.

    The header is vendor, product, version, event class id, name, severity; all
    but the severity are escaped. A null extension is left out, an empty string
    is kept as ``key=``. A null header field makes the whole line null. Extensions
    named in ``numbers`` hold numbers and are not looked through for escapes.
    """
    *escaped, severity = header
    parts = [F.lit(CEF_PREFIX)]
    for column in escaped:
        parts += [F.lit("|"), cef_escape_header(column)]
    head = F.concat(*parts, F.lit("|"), severity.cast("string"), F.lit("|"))
    if not extensions:
        return head
    # concat() of a null is null, and concat_ws() leaves nulls out.
    pairs = []
    for key, value in extensions:
        plain = value.cast("string")
        text = plain if key in numbers else cef_escape_extension(plain, escape_newlines)
        pairs.append(F.concat(F.lit(key + "="), text))
    return F.concat(head, F.concat_ws(" ", *pairs))
