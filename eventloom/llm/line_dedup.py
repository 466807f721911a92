"""Incremental, reversible line deduplication.

An index keeps which document holds which line key (exact references), how many
documents hold a key and which of them owns it (exact counts), and for each shard of
the key space a cuckoo filter of the keys that several documents share. Lines are
looked up in the filters first; only those that may be shared meet the exact table.
Cuckoo filters forget what is deleted from them, so taking a document out of the index
brings back the lines that it alone had taken from others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventloom.llm.registry import query
from eventloom.llm.text import BLANKS, ascii_lower, lines, no_rows, read_table, stored

LEAST_CHARS = 10
# Salts part the lines of one shard, so that a key in every document is looked up in
# several tasks; each gets a copy of the shard's filter.
SALTS = 8
SHARDS = 64
LAST_ID = 2**63 - 1

SLOTS, KICKS = 4, 400


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four. A block that is full is followed by
    another of the same size, so nothing is refused. ``keys`` are 16-byte digests."""

    def __init__(self, data: bytes = b"", buckets: int = 1 << 12):
        self.buckets = buckets
        size = buckets * SLOTS
        table = np.frombuffer(data, np.uint16).reshape(-1, size).copy()
        self.blocks = [block.tolist() for block in table]

    def places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Fingerprint and both buckets of each key."""
        both = np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)
        prints = (both[:, 0] & np.uint64(0xFFFF)).astype(np.int64)
        prints[prints == 0] = 1
        first = (both[:, 1] % np.uint64(self.buckets)).astype(np.int64)
        return prints, first, self.other(first, prints)

    def other(self, bucket, fingerprint):
        """The other bucket of a fingerprint; applied twice it leads back."""
        return bucket ^ ((fingerprint * 0x5BD1) % self.buckets)

    def insert(self, keys: list[bytes]) -> None:
        for fingerprint, *buckets in zip(*(a.tolist() for a in self.places(keys))):
            if not self.blocks:
                self.blocks.append([0] * (self.buckets * SLOTS))
            block = self.blocks[-1]
            bucket = buckets[0]
            if not (self._put(block, bucket, fingerprint)
                    or self._put(block, buckets[1], fingerprint)):
                for kick in range(KICKS):
                    at = bucket * SLOTS + (fingerprint + kick) % SLOTS
                    fingerprint, block[at] = block[at], fingerprint
                    bucket = self.other(bucket, fingerprint)
                    if self._put(block, bucket, fingerprint):
                        break
                else:
                    self.blocks.append([0] * (self.buckets * SLOTS))
                    self._put(self.blocks[-1], bucket, fingerprint)

    @staticmethod
    def _put(block: list[int], bucket: int, fingerprint: int) -> bool:
        for at in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if not block[at]:
                block[at] = fingerprint
                return True
        return False

    def delete(self, keys: list[bytes]) -> None:
        """Takes out keys that were inserted."""
        for fingerprint, *buckets in zip(*(a.tolist() for a in self.places(keys))):
            places = [b * SLOTS + s for b in buckets for s in range(SLOTS)]
            block, at = next(
                (block, at) for block in self.blocks for at in places if block[at] == fingerprint
            )
            block[at] = 0

    def tables(self) -> list[np.ndarray]:
        return [np.array(b, np.uint16).reshape(self.buckets, SLOTS) for b in self.blocks]

    def data(self) -> bytes:
        return b"".join(np.array(block, np.uint16).tobytes() for block in self.blocks)


def line_key(line: Column) -> Column:
    """The line without white space around it, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def references(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    """``doc`` and ``key`` (a digest) of every line key that counts, once a document."""
    keys = F.filter(
        F.transform(lines(F.col(f"`{text}`")), line_key),
        lambda key: F.char_length(key) >= LEAST_CHARS,
    )
    digests = F.transform(F.array_distinct(keys), lambda key: F.unhex(F.md5(key)))
    rows = docs.select(_id(doc_id).alias("doc"), F.explode(digests).alias("key"))
    return rows.distinct()


def _id(doc_id: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LAST_ID))


def _shard(shards: int) -> Column:
    return F.pmod(F.xxhash64("key"), F.lit(shards)).cast("int")


_EVENTS = "shard int, salt int, kind int, doc long, key binary"


def _by_shard(rows: DataFrame) -> DataFrame:
    return rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], int, pa.Table]]:
    """Rows of one shard, salt and kind, as far as they lie in one batch."""
    for batch in batches:
        marks = np.stack([batch.column(n).to_numpy() for n in ("shard", "salt", "kind")])
        cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
        for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            if end > start:
                shard, salt, kind = (int(x) for x in marks[:, start])
                yield (shard, salt), kind, batch.slice(start, end - start)


def _updated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Filter rows (kind 0) with the changes that follow (1 in, 2 out) applied."""
    current, filter_ = None, None

    def row() -> pa.RecordBatch:
        columns = [pa.array([current[0]], pa.int32()), pa.array([filter_.data()], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["shard", "filter"])

    for place, kind, rows in _runs(batches):
        if place != current:
            if current is not None:
                yield row()
            current, filter_ = place, CuckooFilter()
        keys = rows.column("key").to_pylist()
        if kind == 0:
            filter_ = CuckooFilter(keys[0])
        elif kind == 1:
            filter_.insert(keys)
        else:
            filter_.delete(keys)
    if current is not None:
        yield row()


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """References (kind 1) whose key may be in the filter (kind 0) before them."""
    current, filter_, tables = None, None, []
    for place, kind, rows in _runs(batches):
        if place != current:
            current, tables = place, []
        if kind == 0:
            filter_ = CuckooFilter(rows.column("key")[0].as_py())
            tables = filter_.tables()
        elif tables:
            prints, first, second = filter_.places(rows.column("key").to_pylist())
            prints = prints[:, None]
            hit = np.zeros(rows.num_rows, bool)
            for table in tables:
                hit |= (table[first] == prints).any(1) | (table[second] == prints).any(1)
            found = rows.filter(pa.array(hit))
            yield pa.RecordBatch.from_arrays(
                [found.column("doc"), found.column("key")], ["doc", "key"]
            )


@dataclass(frozen=True)
class LineIndex:
    """One state of the index; every change gives a new one.

    ``refs``: ``doc``, ``key``. ``counts``: ``key``, ``n_docs``, ``owner``.
    ``filters``: ``shard``, ``filter``. All three are tables in the shared folder.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def empty(spark: SparkSession, shards: int = SHARDS) -> LineIndex:
        return LineIndex(
            no_rows(spark, "doc long, key binary"),
            no_rows(spark, "key binary, n_docs long, owner long"),
            no_rows(spark, "shard int, filter binary"),
            shards,
        )

    def _with(self, refs: DataFrame, counts: DataFrame) -> LineIndex:
        """The next state. ``counts`` has ``before`` beside its columns, and keeps keys
        that no document holds any more until here."""
        counts = stored(counts, "line-counts")
        was, is_ = F.col("before") > 1, F.col("n_docs") > 1
        changes = counts.filter(was != is_).select(
            _shard(self.shards).alias("shard"),
            F.lit(0).alias("salt"),
            F.when(is_, 1).otherwise(2).alias("kind"),
            F.lit(None).cast("long").alias("doc"),
            "key",
        )
        known = self.filters.select(
            "shard",
            F.lit(0).alias("salt"),
            F.lit(0).alias("kind"),
            F.lit(None).cast("long").alias("doc"),
            F.col("filter").alias("key"),
        )
        filters = _by_shard(known.unionAll(changes)).mapInArrow(
            _updated, "shard int, filter binary"
        )
        return LineIndex(
            refs,
            counts.filter("n_docs > 0").select("key", "n_docs", "owner"),
            stored(filters, "line-filters"),
            self.shards,
        )

    def insert(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> LineIndex:
        """With the lines of ``docs``; what a document already holds is not counted again."""
        new = references(docs, text, doc_id).join(self.refs, ["doc", "key"], "left_anti")
        new = stored(new, "line-refs")
        # One row a key and task reaches the shuffle, however many documents share it.
        changed = new.groupBy("key").agg(F.count("*").alias("n_docs"), F.min("doc").alias("owner"))
        counts = (
            self.counts.select("*", F.col("n_docs").alias("before"))
            .unionAll(changed.select("*", F.lit(0).cast("long").alias("before")))
            .groupBy("key")
            .agg(
                F.sum("n_docs").alias("n_docs"),
                F.min("owner").alias("owner"),
                F.sum("before").alias("before"),
            )
        )
        return self._with(self.refs.unionAll(new), counts)

    def delete(self, ids: DataFrame, doc_id: str = "doc_id") -> LineIndex:
        """Without the documents whose ids are given."""
        gone = ids.select(_id(doc_id).alias("doc")).distinct()
        refs = stored(self.refs.join(gone, "doc", "left_anti"), "line-refs")
        touched = self.refs.join(gone, "doc", "left_semi").select("key").distinct()
        left = refs.join(touched, "key", "left_semi").groupBy("key")
        left = left.agg(F.count("*").alias("n_left"), F.min("doc").alias("new_owner"))
        touched = touched.join(left, "key", "left").withColumn("touched", F.lit(True))
        counts = self.counts.join(touched, "key", "left").select(
            "key",
            F.when(F.col("touched"), F.coalesce("n_left", F.lit(0))).otherwise(F.col("n_docs"))
            .cast("long").alias("n_docs"),
            F.when(F.col("touched"), F.col("new_owner")).otherwise(F.col("owner")).alias("owner"),
            F.col("n_docs").alias("before"),
        )
        return self._with(refs, counts)

    def shared_lines(self, docs: DataFrame, text: str, doc_id: str) -> DataFrame:
        """``doc`` and ``key`` of the lines of ``docs`` that another document owns."""
        looked_up = references(docs, text, doc_id).select(
            _shard(self.shards).alias("shard"),
            F.pmod(F.xxhash64("doc"), F.lit(SALTS)).cast("int").alias("salt"),
            F.lit(1).alias("kind"),
            "doc",
            "key",
        )
        filters = self.filters.select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"),
            F.lit(0).alias("kind"),
            F.lit(None).cast("long").alias("doc"),
            F.col("filter").alias("key"),
        )
        possible = _by_shard(filters.unionAll(looked_up)).mapInArrow(
            _possible, "doc long, key binary"
        )
        exact = self.counts.filter("n_docs > 1").select("key", "owner")
        return possible.join(exact, "key").filter("owner <> doc").select("doc", "key")

    def deduplicate(
        self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id"
    ) -> DataFrame:
        """Columns ``row`` (all of the input), ``n_lines``, ``n_dropped`` and ``kept``,
        the text of the lines that stay.

        Keys shorter than ten characters are never dropped. Null and empty texts are
        one empty line, which stays. Rows with one id are one document; rows without
        an id are one, ordered last. Repeated lines of an owner all stay. An empty
        table has no rows. Documents meet their dropped keys by id; a document's keys
        are as many as its lines at most.
        """
        dropped = (
            self.shared_lines(docs, text, doc_id)
            .groupBy("doc")
            .agg(F.collect_set("key").alias("dropped"))
        )
        whole = docs.select(
            F.struct("*").alias("row"),
            _id(doc_id).alias("doc"),
            F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
        )
        found = whole.join(dropped, "doc", "left").withColumn(
            "left",
            _kept_lines(F.when(F.col("dropped").isNotNull(), F.col("text")), F.col("dropped")),
        )
        n_lines = F.size(lines(F.col("text"))).cast("long")
        return found.select(
            "row",
            n_lines.alias("n_lines"),
            F.coalesce(n_lines - F.size("left"), F.lit(0)).cast("long").alias("n_dropped"),
            F.coalesce(F.array_join("left", "\n"), F.col("text")).alias("kept"),
        )


@F.arrow_udf(T.ArrayType(T.StringType()))
def _kept_lines(texts: pa.Array, dropped: pa.Array) -> pa.Array:
    """Lines whose key is not among the dropped ones; null stays null."""
    blanks = BLANKS.encode()
    found = []
    for text, keys in zip(texts, dropped):
        if not text.is_valid:
            found.append(None)
            continue
        out = set(keys.as_py())
        found.append(
            [
                line
                for line in text.as_py().split("\n")
                if hashlib.md5(line.encode().strip(blanks).lower()).digest() not in out
            ]
        )
    return pa.array(found, pa.list_(pa.string()))


def deduplicate_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """:meth:`LineIndex.deduplicate` of a table against itself."""
    index = LineIndex.empty(docs.sparkSession).insert(docs, text, doc_id)
    return index.deduplicate(docs, text, doc_id)


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), exploded AS (
  SELECT doc_id, n, l[n] AS line, translate(
    trim(l[n], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM d)
), shared AS (
  SELECT key, min(doc_id) AS owner FROM exploded WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT e.*, s.owner IS NOT NULL AND s.owner <> e.doc_id AS gone
  FROM exploded e LEFT JOIN shared s USING (key)
)
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), ''))
    AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query("op2_line_dedup", OP2_SQL)
def op2_line_dedup(spark, sf_dir):
    return deduplicate_lines(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256")
    )
