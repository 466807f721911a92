"""Small scalar functions shared by the mappings and the manifest checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# OCSF HTTP activity id per request method.
HTTP_ACTIVITY_IDS = {
    "connect": 1,
    "delete": 2,
    "get": 3,
    "head": 4,
    "options": 5,
    "post": 6,
    "put": 7,
    "trace": 8,
    "other": 99,
}

# The characters a Unicode text strip removes at both ends.
STRIP_CHARACTERS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The same characters as a regular-expression class.
SPACE_CLASS = "[" + STRIP_CHARACTERS + "]"


def strip(value: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` knows only blanks)."""
    return F.trim(value, F.lit(STRIP_CHARACTERS))


def http_activity_id(method: Column) -> Column:
    """OCSF activity id of an HTTP method, any case; 0 when unknown."""
    pairs = [F.lit(x) for pair in HTTP_ACTIVITY_IDS.items() for x in pair]
    found = F.try_element_at(F.create_map(*pairs), F.lower(method))
    return F.when(method.isNotNull(), F.coalesce(found, F.lit(0)))


def epoch_millis(seconds: Column) -> Column:
    """Epoch seconds to whole milliseconds, cut off rather than rounded; null for
    what is no time a bigint can hold."""
    return (seconds * 1000).try_cast("bigint")


def _integer_text() -> str:
    # Unicode digits with single underscores between them, an optional sign, and
    # white space around.
    return f"(?U)^{SPACE_CLASS}*[+-]?\\d+(?:_\\d+)*+{SPACE_CLASS}*$"


def integer_convertible(value: Column, kind: Column | None = None) -> Column:
    """True when a VARIANT can be turned into an integer.

    Numbers and booleans can, text when it is a whole number; null, lists and
    objects cannot. An absent value (SQL null) gives null. ``kind`` is the
    value's ``schema_of_variant`` where that is at hand.
    """
    kind = F.schema_of_variant(value) if kind is None else kind
    text = F.try_variant_get(value, "$", "string")
    return (
        F.when(value.isNull(), F.lit(None).cast("boolean"))
        .when(kind == "STRING", text.rlike(_integer_text()))
        .otherwise(kind.rlike("^(BIGINT|DOUBLE|BOOLEAN|DECIMAL.*)$"))
    )


def to_integer(value: Column, kind: Column | None = None) -> Column:
    """The integer a convertible VARIANT stands for, else null; fractions are cut off."""
    kind = F.schema_of_variant(value) if kind is None else kind
    digits = F.replace(strip(F.try_variant_get(value, "$", "string")), F.lit("_"), F.lit(""))
    return (
        F.when(~integer_convertible(value, kind), F.lit(None).cast("bigint"))
        .when(kind == "STRING", digits.try_cast("bigint"))
        .when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean").cast("bigint"))
        .when(kind == "DOUBLE", F.try_variant_get(value, "$", "double").try_cast("bigint"))
        .otherwise(F.try_variant_get(value, "$", "decimal(38,18)").try_cast("bigint"))
    )
