"""Indexes of the files of a store: which may hold a text, which hold a port.

An index is a table beside the files, in the store's folder ``_byte_index`` or
``_port_index`` (readers of the store pass over such names): for each file a few bitmaps
of 4 KB, a file's rows combined in the tasks that read them: of ports by Spark's own bitmap
functions, of trigrams, which are as many as the texts have bytes, by NumPy on the bytes of
Arrow batches. An update indexes the files that have come since;
entries of files that are gone are passed over, so appends and replaced runs need no
more than another update. A file that is not indexed yet is always opened.

A search gets the paths of the files to open from the index, and only these are listed
and read by Spark; the paths are all that the driver sees.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.operators.detect import detect_port, text_contains
from eventloom.operators.naming import file_path

TEXT_INDEX, PORT_INDEX = "_byte_index", "_port_index"
# Bits of one bitmap of Spark's; trigrams of bytes are hashed into so many.
BITS = 32_768

_INDEX = "file STRING, cve_name STRING, bucket LONG, bits BINARY"


def _plain(path: Column) -> Column:
    """One spelling of local paths."""
    return F.regexp_replace(path, "^file:/+", "file:/")


def _files(spark: SparkSession, store: str) -> DataFrame:
    """The store's files, from a listing; contents stay unread."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
    listed = reader.option("recursiveFileLookup", "true").load(store)
    return listed.select(_plain(F.col("path")).alias("file"))


def _index(spark: SparkSession, store: str, name: str) -> DataFrame:
    try:
        return spark.read.schema(_INDEX).parquet(f"{store}/{name}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _INDEX)


def _read(spark: SparkSession, store: str, files: DataFrame) -> DataFrame | None:
    """The rows of some of the store's files, with its partition columns."""
    paths = [r.file for r in files.select("file").collect()]
    return spark.read.option("basePath", store).parquet(*paths) if paths else None


def _new(spark: SparkSession, store: str, name: str) -> tuple[DataFrame | None, int]:
    """The rows of the store's files that have no entry yet, and how many files these are."""
    known = _index(spark, store, name).select("file").distinct()
    rows = _read(spark, store, _files(spark, store).join(known, "file", "left_anti"))
    return rows, 0 if rows is None else len(rows.inputFiles())


def _has(number: Column) -> Column:
    """Whether a bitmap has a number's bit."""
    place = F.bitmap_bit_position(number)
    byte = F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1)))
    bit = F.call_function("shiftright", F.conv(byte, 16, 10).cast("int"), (place % 8).cast("int"))
    here = F.col("bucket") == F.bitmap_bucket_number(number)
    return F.coalesce(here & (bit.bitwiseAND(F.lit(1)) == 1), F.lit(False))


def _current(spark: SparkSession, store: str, name: str) -> DataFrame:
    """The store's files with their bitmaps; ``bits`` is null for files without any, and
    ``bucket`` and ``cve_name`` too for files that are not indexed."""
    entries = _index(spark, store, name).withColumn("indexed", F.lit(True))
    return _files(spark, store).join(entries, "file", "left")


# -------------------------------------------------------------------------- texts


# Hashes multiply by an odd number and keep the upper 15 of 32 bits.
_FACTOR, _SHIFT = 2_654_435_761, 17
# Bytes looked at together.
_PIECE = 1 << 20


def _bit(trigram: bytes) -> int:
    """The bit of three bytes in a row."""
    return (int.from_bytes(trigram, "big") * _FACTOR & 0xFFFFFFFF) >> _SHIFT


def _mark(seen: np.ndarray, texts: pa.Array) -> None:
    """Set ``seen`` at all three bytes in a row of each text; the last place is for others."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1]
    if len(texts) == 0 or offsets[0] == offsets[-1]:
        return
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    # Of three bytes that begin in the last two places of a text, some are the next one's.
    ends = (offsets[1:] - offsets[0]).astype(np.int64)
    ends = np.concatenate([ends - 1, ends - 2])
    ends = np.sort(ends[ends >= 0])
    for at in range(0, len(data) - 2, _PIECE):
        part = data[at : at + _PIECE + 2].astype(np.int32)
        codes = (part[:-2] << 16) | (part[1:-1] << 8) | part[2:]
        own = ends[np.searchsorted(ends, at) : np.searchsorted(ends, at + len(codes))]
        codes[own - at] = len(seen) - 1
        seen[codes] = True


def _text_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for every file of a task's rows, which come file by file."""
    seen = np.zeros((1 << 24) + 1, bool)
    at: tuple | None = None

    def row() -> pa.RecordBatch:
        codes = np.flatnonzero(seen[:-1]).astype(np.uint64)
        bits = np.zeros(BITS, bool)
        bits[(codes * np.uint64(_FACTOR) & np.uint64(0xFFFFFFFF)) >> np.uint64(_SHIFT)] = True
        seen[:] = False
        found = np.packbits(bits, bitorder="little").tobytes()
        columns = [[at[0]], [at[1]], [found]]
        types = [pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, x) for c, x in zip(columns, types)], ["file_id", "cve_name", "bits"]
        )

    for batch in batches:
        ids = batch.column("file_id").to_numpy()
        begins = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]]) if len(ids) else []
        for a, b in zip(begins, [*begins[1:], len(ids)]):
            file = (int(ids[a]), batch.column("cve_name")[int(a)].as_py())
            if at is not None and at != file:
                yield row()
            at = file
            _mark(seen, batch.column("text").slice(a, b - a).cast(pa.string()))
    if at is not None:
        yield row()


def update_text_index(spark: SparkSession, store: str, text: str = "event") -> int:
    """Index the files that have come to a store of :func:`write_event_store` since, by
    the trigrams of a text column; the number of files indexed."""
    rows, count = _new(spark, store, TEXT_INDEX)
    if rows is None:
        return 0
    # Rows have a number in place of their file's path, which is as long as the text.
    number = F.xxhash64(_plain(file_path()))
    held = rows.select(
        number.alias("file_id"),
        F.col("cve_name").cast("string"),
        F.col(text).cast("string").alias("text"),
    ).mapInArrow(_text_bits, "file_id long, cve_name string, bits binary")
    bits = held.groupBy("file_id", "cve_name").agg(F.bitmap_or_agg("bits").alias("bits"))
    files = _files(spark, store).withColumn("file_id", F.xxhash64("file"))
    # Bits are numbered from 1 in a bitmap's first bucket.
    entries = files.join(bits, "file_id").select(
        "file", "cve_name", F.lit(1).cast("long").alias("bucket"), "bits"
    )
    entries.write.mode("append").parquet(f"{store}/{TEXT_INDEX}")
    return count


def files_with_text(spark: SparkSession, store: str, pattern: str) -> DataFrame:
    """``file`` of the files that may hold a text: all that have each of its trigrams, and
    those that are not indexed. A text below three bytes may be in any."""
    files = _current(spark, store, TEXT_INDEX)
    said = pattern.encode()
    may = F.lit(True)
    for bit in sorted({_bit(said[i : i + 3]) for i in range(len(said) - 2)}):
        may = may & _has(F.lit(bit + 1).cast("long"))
    return files.filter(may | F.col("indexed").isNull()).select("file").distinct()


def events_with_text(
    spark: SparkSession, store: str, pattern: str, text: str = "event"
) -> DataFrame:
    """Events of a store that hold a text, out of the files that may.

    The rows are those of a scan of the whole store with :func:`text_contains`; give them
    to :func:`runs_with_text` for counts by run.
    """
    rows = _read(spark, store, files_with_text(spark, store, pattern))
    if rows is None:
        rows = spark.read.parquet(store).filter(F.lit(False))
    return rows.filter(text_contains(text, pattern))


# -------------------------------------------------------------------------- ports

_SIDES = ("id.resp_p", "id.orig_p")


def update_port_index(spark: SparkSession, store: str) -> int:
    """Index the files of a store of connection records that have come since, by the
    ports of both sides; the number of files indexed."""
    rows, count = _new(spark, store, PORT_INDEX)
    if rows is None:
        return 0
    sides = F.array_compact(F.array(*(F.col(f"`{c}`") for c in _SIDES)))
    # An entry for every file, also where no row has a port; distinct in each task first.
    held = rows.select(
        _plain(file_path()).alias("file"),
        F.col("cve_name").cast("string"),
        F.explode_outer(F.array_distinct(sides.cast("array<bigint>"))).alias("n"),
    ).distinct()
    bits = held.groupBy("file", "cve_name", F.bitmap_bucket_number("n").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("n")).alias("bits")
    )
    bits.write.mode("append").parquet(f"{store}/{PORT_INDEX}")
    return count


def files_with_port(spark: SparkSession, store: str, port: int) -> DataFrame:
    """``file`` of the files that hold a port, and of those that are not indexed."""
    found = _current(spark, store, PORT_INDEX)
    may = _has(F.lit(port).cast("long")) | F.col("indexed").isNull()
    return found.filter(may).select("file").distinct()


def detect_port_indexed(spark: SparkSession, store: str, port: int) -> DataFrame:
    """What :func:`detect_port` says of the whole store: rows are read of the files that
    hold the port, for the number and time of its connections; of all others only the run
    is known, from the index."""
    runs = _current(spark, store, PORT_INDEX).filter("indexed").select("cve_name").distinct()
    none = runs.select(
        "cve_name", F.lit(False).alias("detected"), F.lit(0).cast("long").alias("connections"),
        F.lit(None).cast("double").alias("first_ts"),
    )
    rows = _read(spark, store, files_with_port(spark, store, port))
    if rows is None:
        return none
    found = detect_port(rows.withColumn("cve_name", F.col("cve_name").cast("string")), port)
    both = none.unionByName(found)
    return both.groupBy("cve_name").agg(
        F.bool_or("detected").alias("detected"),
        F.sum("connections").alias("connections"),
        F.min("first_ts").alias("first_ts"),
    )


def ports_seen_indexed(spark: SparkSession, store: str, per: Iterable[str] = ()) -> DataFrame:
    """What :func:`ports_seen` says of the files indexed, from the bitmaps' unions alone;
    ``per`` may name ``cve_name``."""
    per = list(per)
    held = _current(spark, store, PORT_INDEX).filter("bits IS NOT NULL AND bucket IS NOT NULL")
    united = held.groupBy(*per, "bucket").agg(F.hex(F.bitmap_or_agg("bits")).alias("bits"))
    # Two hexadecimal digits are eight bits; most of them are empty.
    bytes_ = F.regexp_extract_all("bits", F.lit("(..)"), F.lit(1))
    filled = united.select(*per, "bucket", F.posexplode(bytes_).alias("byte", "value"))
    filled = filled.filter("value <> '00'").select(
        *per, "bucket", "byte", F.conv("value", 16, 10).cast("int").alias("value"),
        F.explode(F.array(*map(F.lit, range(8)))).alias("bit"),
    )
    shifted = F.call_function("shiftright", F.col("value"), F.col("bit"))
    set_ = filled.filter(shifted.bitwiseAND(F.lit(1)) == 1)
    place = F.col("byte") * 8 + F.col("bit")
    # Bucket 0 has the numbers that are not above zero, in descending order.
    port = F.when(F.col("bucket") > 0, (F.col("bucket") - 1) * BITS + place + 1).otherwise(
        F.col("bucket") * BITS - place
    )
    return set_.select(*per, port.alias("port"))
