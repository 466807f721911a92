"""Whole JSON documents held as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks JSON allows around a value.
JSON_BLANKS = " \t\r\n"
_BAD = {"columnNameOfCorruptRecord": "_bad"}


def parse_document(text: Column) -> Column:
    """VARIANT of a text that is exactly one JSON document, else null.

    ``try_parse_json`` alone stops after the first document of several. Put
    inside an array and inside an object, only a text that is one value parses
    both times: what would close the one early breaks the other.
    """
    in_object = F.try_parse_json(F.concat(F.lit('{"d":'), text, F.lit("}")))
    in_array = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.when(in_array.isNotNull(), F.variant_get(in_object, "$.d", "variant"))


def is_array_text(text: Column) -> Column:
    return F.ltrim(text, F.lit(JSON_BLANKS)).startswith("[")


def _is_one_document(text: Column) -> Column:
    """Whether a text is exactly one JSON document, of any size and with any keys."""
    in_object = F.from_json(F.concat(F.lit('{"d":'), text, F.lit("}")), "d STRING, _bad STRING", _BAD)
    in_array = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>")
    return in_object["_bad"].isNull() & in_object["d"].isNotNull() & (F.size(in_array) == 1)


def _object(keys: Column) -> Column:
    """VARIANT object of a map with repeated keys, of which the last value counts."""
    entries = F.map_entries(keys)
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(
            F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]
        ),
    )
    return F.to_variant_object(F.map_from_entries(last))


def again_events(text: Column) -> Column:
    """Events of a document that :func:`parse_document` refuses although it is one.

    A VARIANT has a limit of size and refuses repeated keys. Elements of an array are
    read one by one here, and objects key by key; of a repeated key of an event the last
    value counts. Null where that does not help: one value above the limit, or a
    repeated key deeper inside.
    """
    elements = F.from_json(text, "array<variant>")
    objects = F.from_json(text, "array<map<string,variant>>")
    objects = F.when(F.forall(objects, lambda x: x.isNotNull()), F.transform(objects, _object))
    good = F.when(F.forall(elements, lambda x: x.isNotNull()), elements)
    one = F.from_json(text, "map<string,variant>")
    found = F.when(is_array_text(text), F.coalesce(good, objects)).when(
        F.ltrim(text, F.lit(JSON_BLANKS)).startswith("{") & one.isNotNull(), F.array(_object(one))
    )
    return F.when(_is_one_document(text), found)


def line_event(text: Column) -> Column:
    """VARIANT of a JSON line; an object with repeated keys is read as in a document."""
    first = F.try_parse_json(text)
    again = F.when(~is_array_text(text), again_events(text)[0])
    return F.coalesce(first, F.when(first.isNull(), again))


def document_events(text: Column) -> Column:
    """Events of a document as ``array<variant>``: the elements of an array, or
    the one value itself. Null when the text is no JSON document."""
    parsed = parse_document(text)
    elements = F.try_variant_get(parsed, "$", "array<variant>")
    first = F.when(is_array_text(text), elements).when(parsed.isNotNull(), F.array(parsed))
    return F.coalesce(first, F.when(parsed.isNull(), again_events(text)))
