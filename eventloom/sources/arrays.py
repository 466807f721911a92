"""Large JSON array documents, read by byte ranges.

Spark's text reader cuts a file at every closing brace, range by range, so no task
reads more than its range and no row holds more than one object. Whether a brace or a
bracket counts depends on what stands before it in the file: is there an open string,
and how deep are we. Both add up. A piece has a number of quotes, and a change of depth
for either case, so the state where a range begins is a sum over the ranges before it,
one small row for each, and the state of a piece a running sum inside its range.

An element that is an object ends at a closing brace at the array's own depth. What
lies between two such ends is read on its own. Only the two ends of a range can belong
to an element that other ranges share; these fragments are joined in file order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.functions.jsontext import JSON_BLANKS, document_events
from eventloom.operators.naming import file_path

_RANGE = ("path", "block")
_END = "}"


def _outside(text: Column, inside: bool) -> Column:
    """The text without its strings; ``inside``: it begins within one."""
    if inside:
        text = F.regexp_replace(text, '^[^"]*("|$)', "")
    return F.regexp_replace(text, '"[^"]*("|$)', "")


def _depth_change(text: Column, inside: bool) -> Column:
    rest = _outside(text, inside)
    return F.regexp_count(rest, F.lit(r"[\[{]")) - F.regexp_count(rest, F.lit(r"[\]}]"))


def _pieces(reader, path: str | list[str]) -> DataFrame:
    """Texts up to every closing brace, in order of ``place`` within a range."""
    rows = reader.text(path, lineSep=_END)
    return rows.select(
        file_path().alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    )


def _marks(text: Column) -> list[Column]:
    """Quotes, and changes of depth for a text that begins outside and inside a string."""
    # Pairs with a backslash hold neither quotes nor brackets that count.
    plain = F.regexp_replace(text, r"(?s)\\.", "")
    return [
        F.regexp_count(plain, F.lit('"')).alias("quotes"),
        _depth_change(plain, False).alias("change_outside"),
        _depth_change(plain, True).alias("change_inside"),
    ]


def _ranges(pieces: DataFrame) -> DataFrame:
    """One row a range: quotes and depth before it, its last place, whether the file's
    last piece lacks its brace."""
    ordered = Window.partitionBy(*_RANGE).orderBy("place")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = pieces.select(
        *_RANGE, "size", "place", F.octet_length("value").alias("bytes"),
        *_marks(F.concat("value", F.lit(_END))),
    )
    odd = F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2
    rows = rows.withColumn("odd", odd)
    change = lambda flip: F.when(F.col("odd") == flip, F.col("change_outside")).otherwise(
        F.col("change_inside")
    )
    found = rows.groupBy(*_RANGE).agg(
        F.first("size").alias("size"),
        F.sum(F.col("bytes") + 1).alias("bytes"),
        F.max("place").alias("last_place"),
        F.sum("quotes").alias("quotes"),
        F.sum(change(0)).alias("change_outside"),
        F.sum(change(1)).alias("change_inside"),
    )
    in_file = Window.partitionBy("path").orderBy("block")
    earlier = in_file.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    found = found.withColumn("odd_before", F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2)
    found = found.withColumn(
        "change", F.when(F.col("odd_before") == 0, F.col("change_outside")).otherwise(F.col("change_inside"))
    )
    # The reader takes the separator off; a file that ends without one is a byte short.
    last = F.col("block") == F.max("block").over(whole)
    unclosed = last & (F.sum("bytes").over(whole) > F.col("size"))
    return found.select(
        *_RANGE,
        "last_place",
        "odd_before",
        F.coalesce(F.sum("change").over(earlier), F.lit(0)).alias("depth_before"),
        unclosed.alias("unclosed"),
        last.alias("last_range"),
    )


def _fragments(reader, path: str | list[str]) -> DataFrame:
    """``text`` between two ends of elements, with what a range's borders cut apart:
    ``number`` counts them in a range, ``last_number`` is the range's last."""
    pieces = _pieces(reader, path)
    rows = pieces.join(_ranges(pieces), list(_RANGE))
    closed = ~(F.col("unclosed") & (F.col("place") == F.col("last_place")))
    text = F.when(closed, F.concat("value", F.lit(_END))).otherwise(F.col("value"))
    rows = rows.select(*_RANGE, "place", "odd_before", "depth_before", "last_range", text.alias("text"))
    rows = rows.select("*", *_marks(F.col("text")))
    ordered = Window.partitionBy(*_RANGE).orderBy("place")
    so_far = ordered.rowsBetween(Window.unboundedPreceding, 0)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(
        "odd", (F.col("odd_before") + F.coalesce(F.sum("quotes").over(before), F.lit(0))) % 2
    ).withColumn(
        "change", F.when(F.col("odd") == 0, F.col("change_outside")).otherwise(F.col("change_inside"))
    )
    depth = F.col("depth_before") + F.sum("change").over(so_far)
    in_string = (F.col("odd") + F.col("quotes")) % 2 == 1
    rows = rows.withColumn(
        "ends", (~in_string & (depth == 1) & F.col("text").endswith(_END)).cast("int")
    )
    rows = rows.withColumn("number", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    # By range first: the rows lie together already.
    in_order = F.sort_array(F.collect_list(F.struct("place", "text")))
    held = rows.groupBy(*_RANGE, "number").agg(
        F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"),
        F.max("ends").alias("complete"),
        F.first("last_range").alias("last_range"),
    )
    return held.withColumn("last_number", F.max("number").over(Window.partitionBy(*_RANGE)))


def _stretches(reader, path: str | list[str]) -> DataFrame:
    """``path``, ``block``, ``number`` and ``text`` from one end of an element to the
    next; the ``first`` of a file, and the ``last`` behind all ends, are marked."""
    held = _fragments(reader, path)
    inner = (F.col("number") > 0) & (F.col("complete") == 1)
    whole = held.filter(inner).select(
        *_RANGE, "number", "text", F.lit(False).alias("first"), F.lit(False).alias("last")
    )
    # A range's first fragment goes on from the range before if that one ends open. The
    # others left here, open ends, follow an end of their own range.
    in_file = Window.partitionBy("path").orderBy("block", "number")
    before = F.lag("complete").over(in_file)
    begins = (F.col("number") > 0) | before.isNull() | (before == 1)
    edges = held.filter(~inner).withColumn("begins", begins.cast("int"))
    edges = edges.withColumn("stretch", F.sum("begins").over(in_file))
    in_order = F.sort_array(F.collect_list(F.struct("block", "number", "text")))
    joined = edges.groupBy("path", "stretch").agg(
        F.array_join(F.transform(in_order, lambda x: x["text"]), "").alias("text"),
        F.min(F.struct("block", "number")).alias("at"),
        F.max("complete").alias("complete"),
    )
    final = F.col("stretch") == F.max("stretch").over(Window.partitionBy("path"))
    joined = joined.select(
        "path", "at.block", "at.number", "text", (F.col("stretch") == 1).alias("first"),
        (final & (F.col("complete") == 0)).alias("last"),
    )
    return whole.unionByName(joined)


def _stretch_events() -> Column:
    """Events of a stretch as ``array<variant>``; null if it does not fit its place."""
    blanks = F.lit(JSON_BLANKS)
    body = F.trim(F.col("text"), blanks)
    closed = ~F.col("last") | body.endswith("]")
    body = F.when(F.col("last"), F.left(body, F.length(body) - 1)).otherwise(body)
    opening = F.when(F.col("first"), F.lit("[")).otherwise(F.lit(","))
    inner = F.trim(F.substring(body, F.lit(2), F.length(body)), blanks)
    # Nothing may stand before the closing bracket only if no comma does.
    nothing = F.when(F.col("first"), inner == "").otherwise(F.trim(body, blanks) == "")
    some = body.startswith(opening) & (inner != "")
    found = document_events(F.concat(F.lit("["), inner, F.lit("]")))
    none = F.array().cast("array<variant>")
    empty = F.col("last") & nothing & (~F.col("first") | body.startswith("["))
    return F.when(closed & empty, none).when(closed & some, found)


def read_array_files(reader, path: str | list[str], salvage: bool = False) -> DataFrame:
    """``path`` and ``event`` (VARIANT) of the elements of JSON array files, one array to
    a file, each file read by as many tasks as it has ranges.

    The events are those of :func:`eventloom.sources.document_rows`: none of a file that
    is not one array as a whole, unless ``salvage`` asks for what can be read of it; of a
    repeated key of an event the last value counts. Elements other than objects are read
    with the object that follows them. A single element has to fit a row. Files that hold
    no array are in :func:`array_quarantine`. Batch only: what a range means depends on
    the ranges before it.
    """
    rows = _stretches(reader, path).select("path", _stretch_events().alias("events"))
    if not salvage:
        rows = rows.join(_broken(reader, path).select("path").distinct(), "path", "left_anti")
    return rows.select("path", F.explode("events").alias("event"))


def _broken(reader, path: str | list[str]) -> DataFrame:
    rows = _stretches(reader, path)
    bad = rows.filter(_stretch_events().isNull())
    open_end = rows.groupBy("path").agg(F.max("last").alias("last")).filter(~F.col("last"))
    none = F.lit(None).cast("long")
    return bad.select("path", "block", "number", "text").unionByName(
        open_end.select("path", none.alias("block"), none.alias("number"), F.lit("").alias("text"))
    )


def array_quarantine(reader, path: str | list[str]) -> DataFrame:
    """What cannot be read of array files: ``path``, ``text`` and the range (``block``)
    and ``number`` where it begins; an array that never ends has a row with neither."""
    return _broken(reader, path)
