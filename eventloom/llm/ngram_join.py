"""Documents whose sets of word shingles are similar, by T-occurrence search.

Two sets of sizes m and n are similar enough if they share T(m, n) shingles. Each
document goes into the inverted lists of its first shingles (in the order of their
hashes), so many that a similar pair meets in more lists than one. Short lists are
merged: a heap gives, document by document, how many of its short lists hold each
other document. Long lists are not merged but probed: what they may add is allowed for
when candidates are chosen, and looked up in the other document's sorted set when they
are decided. A document with so many long lists that a partner could hide in them
alone is searched once more over all of its shingles among documents like it, and what
only long lists hold even then, large groups of near copies, is linked around one
document of each list first; what is still apart after that meets in its rarest lists,
and bits of both sets rule out most pairs there.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.components import components
from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored
from eventloom.session import setting

WORDS = 5
# Two sets are similar when 100 * intersection >= PERCENT * union.
PERCENT = 75
# Lists with more members are probed, not merged.
SHORT = 32
# How many lists more than needed a document goes into: one for so many shingles.
SPARE = 16
# Words of 64 bits that show what sets of long lists differ in.
BIT_WORDS = 16
# Members of a long list that stand for others and meet all its members in one task.
BLOCK = 1024
# Rows without an id are told apart by a number of their text from here on.
NO_ID = 1 << 62

# Bytes of texts or sets that a Python worker is sent at a time; by rows they would be many.
BATCH_BYTES = "4m"
# Bytes of texts whose words are hashed at a time.
CHUNK_BYTES = 1 << 18
_ONE = np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def overlap_needed(m, n):
    """T(m, n): i / (m + n - i) >= PERCENT / 100, so i >= PERCENT (m + n) / (100 + PERCENT)."""
    return -(-PERCENT * (m + n) // (100 + PERCENT))


def least_overlap(n):
    """Shared shingles with any partner: it has at least PERCENT % as many."""
    return -(-PERCENT * n // 100)


def spare_lists(n):
    return n // SPARE


def prefix_length(n):
    """A pair shares its first 1 + s shingles in prefixes that are s longer than needed:
    only n - T follow none that are shared."""
    return min(n, n - least_overlap(n) + 1 + spare_lists(n))


def tolerated_lists(n):
    """Long lists that cannot hide a partner: partners spare so many at least."""
    return spare_lists(least_overlap(n))


# ---------------------------------------------------------------------- shingles

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)
_POWERS: dict[str, np.ndarray] = {}


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    if len(_POWERS.get("up", ())) < size:
        base = int(_BASE)
        for name, factor in (("up", base), ("down", pow(base, -1, 1 << 64))):
            row = np.full(max(size, 1 << 16), factor, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _word_hashes(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word in bytes that hold several texts, and the word at which each
    text begins. ``borders`` are the places where texts begin, and the end."""
    filled = ~_BLANK[data]
    begins = filled.copy()
    begins[1:] &= ~filled[:-1]
    inner = borders[:-1][borders[:-1] < len(data)]
    begins[inner] = filled[inner]
    ends = filled.copy()
    ends[:-1] &= ~filled[1:]
    last = inner[inner > 0] - 1
    ends[last] = filled[last]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER[data] + _ONE) * up[: len(data)], dtype=np.uint64, out=sums[1:])
    hashes = (sums[ends] - sums[begins]) * down[begins]
    hashes = _mixed(hashes + (ends - begins).astype(np.uint64) * _BASE)
    return hashes, np.searchsorted(begins, borders)


def _pieces(data: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts that end between words."""
    while len(data) > CHUNK_BYTES:
        blanks = np.flatnonzero(_BLANK[data[:CHUNK_BYTES]])
        if not len(blanks):
            blanks = np.flatnonzero(_BLANK[data])
            if not len(blanks):
                break
            blanks = blanks[:1]
        cut = int(blanks[-1]) + 1
        yield data[:cut]
        data = data[cut:]
    yield data


def _shingles(words: np.ndarray) -> np.ndarray:
    if not len(words):
        return words
    count = min(WORDS, len(words))
    total = np.full(len(words) - count + 1, np.uint64(count), np.uint64)
    for k in range(count):
        total = _mixed(total * _BASE + words[k : len(words) - count + 1 + k])
    return np.unique(total)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; none for null or no words."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    start = 0
    while start < len(texts):
        end = int(np.searchsorted(offsets, offsets[start] + CHUNK_BYTES, "right")) - 1
        if end <= start:  # a text longer than a chunk
            own = data[offsets[start] : offsets[start + 1]]
            parts = [_word_hashes(p, np.array([0, len(p)]))[0] for p in _pieces(own)]
            yield _shingles(np.concatenate(parts))
            start += 1
            continue
        borders = offsets[start : end + 1] - offsets[start]
        hashes, firsts = _word_hashes(data[offsets[start] : offsets[end]], borders)
        for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist()):
            yield _shingles(hashes[a:b])
        start = end


# ------------------------------------------------------------------- inverted lists

# n and the place of the shingle in its document's set share one long.
_POSTINGS = "s long, doc long, at long"
_PLACE_BITS = np.int64(32)


def _postings(length: Callable) -> Callable:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column("doc").to_numpy(), []
            for doc, found in zip(docs.tolist(), shingle_sets(batch.column("text"))):
                n = len(found)
                if not n:
                    continue
                used = int(length(n))
                at = np.arange(used, dtype=np.int64) + (np.int64(n) << _PLACE_BITS)
                rows.append((found[:used].view(np.int64), np.full(used, doc, np.int64), at))
                if sum(len(r[0]) for r in rows[-200:]) > 1 << 18:
                    yield _posting_batch(rows)
                    rows = []
            if rows:
                yield _posting_batch(rows)

    return make


def _posting_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate(column)) for column in zip(*rows)]
    return pa.RecordBatch.from_arrays(columns, ["s", "doc", "at"])


# What a document gets from its lists. From a short list (``at`` is its own place
# there) the members before it in the order of (n, doc): ``partners`` has their doc
# and ``at``. From a long list (``s``) nothing but that it exists.
_SHARES = "doc long, at long, s long, partners binary"


def _shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of postings in order of ``s``, of which lists go on from batch to batch."""
    names = [part.split()[0] for part in _SHARES.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    rest = [np.empty(0, np.int64)] * 3
    long_list: int | None = None

    def split(s, doc, at, final: bool):
        nonlocal rest, long_list
        out: list[list] = [[], [], [], []]
        begins = np.flatnonzero(np.r_[True, s[1:] != s[:-1]]) if len(s) else np.empty(0, int)
        ends = np.r_[begins[1:], len(s)]
        rest = [np.empty(0, np.int64)] * 3
        many = np.flatnonzero((ends - begins > 1) | (s[begins] == long_list)).tolist()
        if len(s) and not final and (not many or many[-1] != len(begins) - 1):
            many.append(len(begins) - 1)
        for k in many:
            a, b = int(begins[k]), int(ends[k])
            if b - a > SHORT or s[a] == long_list:
                long_list = int(s[a])
                out[0] += doc[a:b].tolist()
                out[1] += at[a:b].tolist()
                out[2] += s[a:b].tolist()
                out[3] += [None] * (b - a)
            elif b == len(s) and not final:
                rest = [s[a:b], doc[a:b], at[a:b]]
            else:
                order = np.lexsort((doc[a:b], at[a:b] >> _PLACE_BITS))
                docs, ats = doc[a:b][order], at[a:b][order]
                pairs = np.stack([docs, ats], 1)
                sizes = ats >> _PLACE_BITS
                for i in range(1, len(docs)):
                    near = sizes[:i] >= least_overlap(int(sizes[i]))
                    if near.any():
                        out[0].append(int(docs[i]))
                        out[1].append(int(ats[i]))
                        out[2].append(None)
                        chosen = pairs[:i][near]
                        out[3].append(chosen[np.argsort(chosen[:, 0], kind="stable")].tobytes())
        if out[0]:
            columns = [pa.array(c, t) for c, t in zip(out, types)]
            return pa.RecordBatch.from_arrays(columns, names)
        return None

    for batch in batches:
        own = [batch.column(i).to_numpy() for i in range(3)]
        found = split(*(np.concatenate([r, o]) for r, o in zip(rest, own)), False)
        if found is not None:
            yield found
    found = split(*rest, True)
    if found is not None:
        yield found


def _candidates(everything: bool) -> Callable:
    """Out of a document's shares in a row, its candidates; and with ``partner`` null,
    the documents whose partners may be in long lists alone."""

    def merged(rows: list[tuple]) -> Iterator[tuple[int, int | None]]:
        doc = rows[0][0]
        n = rows[0][1] >> 32
        long_lists = sum(row[3] is None for row in rows)
        hidden = least_overlap(n) - 1 if everything else tolerated_lists(n)
        if long_lists > hidden:
            yield doc, None

        def members(at: int, partners: bytes):
            for other, other_at in np.frombuffer(partners, np.int64).reshape(-1, 2).tolist():
                yield other, at, other_at

        # By document, and within one by place, so that the last place comes last.
        lists = [members(row[1], row[3]) for row in rows if row[3] is not None]
        for other, met in groupby(heapq.merge(*lists), itemgetter(0)):
            met = list(met)
            _, at, other_at = met[-1]
            m = other_at >> 32
            most = len(met) + long_lists
            if not everything:
                # Behind the last common place all may be common; and the prefix of one
                # of the two lies within the hashes of the other's, so that all that is
                # common to it has been met.
                behind = min(n - (at & 0xFFFFFFFF), m - (other_at & 0xFFFFFFFF)) - 1
                most += min(behind, max(n - prefix_length(n), m - prefix_length(m)))
            if other != doc and most >= overlap_needed(m, n):
                yield doc, other

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []
        for batch in batches:
            found = []
            for row in zip(*(column.to_pylist() for column in batch.columns)):
                if pending and pending[0][0] != row[0]:
                    found += merged(pending)
                    pending = []
                pending.append(row)
            yield _pairs(found)
        yield _pairs(list(merged(pending)) if pending else [])

    return find


def _pairs(found: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array([f[i] for f in found], pa.int64()) for i in range(2)]
    return pa.RecordBatch.from_arrays(columns, ["doc", "partner"])


def search_lists(postings: DataFrame, everything: bool) -> tuple[DataFrame, DataFrame]:
    """Candidates (``doc``, ``partner``; partner null: look further) of postings, and
    the shares they come from."""
    shares = stored(
        postings.repartition("s").sortWithinPartitions("s").mapInArrow(_shares, _SHARES), "shares"
    )
    found = (
        shares.repartition("doc")
        .sortWithinPartitions("doc")
        .mapInArrow(_candidates(everything), "doc long, partner long")
    )
    return stored(found, "candidates"), shares


# --------------------------------------------------------------------- verification


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [s.tobytes() for s in shingle_sets(batch.column("text"))]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), pa.array(found, pa.binary())], ["doc", "shingles"]
        )


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A document's set (``partner`` null), followed by those of its candidates."""
    doc, own = None, []
    for batch in batches:
        found = []
        for row, partner, data in zip(*(column.to_pylist() for column in batch.columns)):
            other = np.frombuffer(data, np.uint64)
            if row != doc:
                doc, own = row, []
            if partner is None:
                own.append(other)
                continue
            for mine in own:
                if not len(mine) or not len(other):
                    continue
                # Binary probes of the larger set.
                few, many = (mine, other) if len(mine) < len(other) else (other, mine)
                at = np.minimum(np.searchsorted(many, few), len(many) - 1)
                common = int((many[at] == few).sum())
                if common >= overlap_needed(len(mine), len(other)):
                    found.append((doc, partner))
                    break
        yield _pairs(found)


def verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The links among candidate pairs (``doc``, ``partner``), as ``a`` and ``b``."""
    pairs = stored(pairs.distinct(), "pairs")
    ids = pairs.select("doc").unionAll(pairs.select("partner")).distinct()
    sets = stored(
        docs.join(stored(ids, "pair-docs"), "doc", "left_semi").mapInArrow(
            _sets, "doc long, shingles binary"
        ),
        "sets",
    )
    left = pairs.select("doc").distinct().join(sets, "doc")
    left = left.select("doc", F.lit(None).cast("long").alias("partner"), "shingles")
    right = pairs.join(sets.withColumnRenamed("doc", "partner"), "partner")
    found = (
        left.unionAll(right.select("doc", "partner", "shingles"))
        .repartition("doc")
        .sortWithinPartitions("doc", F.col("partner").asc_nulls_first())
        .mapInArrow(_links, "a long, b long")
    )
    return stored(found, "links")


# ------------------------------------------------------------------------ the join


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc"),
                batch.column("id"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(digests, pa.binary()),
            ],
            ["doc", "id", "n", "digest"],
        )


_SIGNATURES = "doc long, id long, n long, digest binary"


def text_number(text: str) -> Column:
    return F.xxhash64(F.col(f"`{text}`")).bitwiseAND(F.lit(NO_ID - 1)) + F.lit(NO_ID)


def doc_key(doc_id: str, text: str) -> Column:
    return F.coalesce(F.col(f"`{doc_id}`").cast("long"), text_number(text))


def _size(at: str) -> Column:
    return F.shiftright(at, 32)


def _across(docs: DataFrame, shares: DataFrame, hidden: DataFrame, links: DataFrame):
    """Links among documents that meet in long lists alone (``hidden``).

    Of these only such pairs are still unknown as share no shingle of a short list. Of
    documents with the same long lists the one of fewest shingles stands for all: a
    document that links with any of them has as much in common with that one and a
    union that is no larger, so it links with it too; and so do the ones that stand for
    two linked documents with each other. Documents are therefore compared with those
    that stand for others, not with each other.

    Lists are taken in the order of their lengths, so that a pair meets in the rarest
    that it shares. Large groups are joined around one document each first; what is
    still apart meets in its lists, if the bits of the pair allow a link.
    """
    long_lists = stored(
        shares.filter("partners IS NULL")
        .join(hidden, "doc", "left_semi")
        .select("s", "doc", _size("at").alias("n"))
        .distinct(),
        "long-lists",
    )
    # The shorter lists first, after those that are short: they hold no unknown pair.
    lengths = long_lists.groupBy("s").agg(F.count("*").alias("length"))
    in_order = Window.partitionBy("doc").orderBy("length", "s")
    ranked = long_lists.join(lengths, "s").select(
        "s",
        "doc",
        "n",
        F.row_number().over(in_order).alias("place"),
        F.count("*").over(Window.partitionBy("doc")).alias("lists"),
    )
    # Enough lists for a pair to meet in one; nothing to spare.
    enough = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    rows = stored(
        ranked.filter(F.col("n") - F.col("lists") + F.col("place") <= enough), "first-lists"
    )
    word = F.shiftright("s", 6).bitwiseAND(F.lit(BIT_WORDS - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("s").bitwiseAND(F.lit(63)).cast("int"))
    none = F.lit(0).cast("long")
    held = long_lists.groupBy("doc").agg(
        F.min("n").alias("n"),
        F.count("*").alias("lists"),
        F.array(
            *(F.coalesce(F.bit_xor(F.when(word == k, bit)), none) for k in range(BIT_WORDS))
        ).alias("bits"),
        F.sha2(F.to_binary(F.array_join(F.sort_array(F.collect_list("s")), ","), F.lit("utf-8")), 256)
        .alias("same"),
    )
    least = F.min(F.struct("n", "doc")).over(Window.partitionBy("same"))
    held = stored(held.withColumn("stands", least["doc"] == F.col("doc")).drop("same"), "held")
    members = stored(rows.select("s", "doc").join(held, "doc"), "members")
    for turn in range(2):
        placed = _mixed_lists(members, links)
        # Around the one that holds least besides long lists, then around any other.
        draw = [F.lit(0) if turn else F.col("n") - F.col("lists"), F.xxhash64("doc", F.lit(turn))]
        first = placed.groupBy("s").agg(
            F.min_by(F.struct("doc", "n", "lists", "bits", "part"), F.struct(*draw, "doc")).alias("y")
        )
        around = (
            placed.alias("x")
            .join(first, "s")
            .filter("x.part <> y.part")
            .filter(_may_link("x", "y"))
            .groupBy("x.doc", F.col("y.doc").alias("partner"))
            .agg(F.count("*").alias("common"))
            .groupBy("doc")
            .agg(F.max_by("partner", F.struct("common", "partner")).alias("partner"))
        )
        links = links.unionAll(verified(docs, around))
    placed = _mixed_lists(members, links)
    # Members of a list meet in blocks, each of so many of those that stand for others.
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = placed.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    other = placed.filter("stands").withColumn("block", F.expr("pmod(xxhash64(doc), blocks)"))
    apart = (
        every.repartition(tasks, "s", "block")
        .alias("x")
        .join(
            other.repartition(tasks, "s", "block").alias("y"),
            F.expr("x.s = y.s AND x.block = y.block AND x.part <> y.part"),
        )
        .filter("NOT (x.stands AND x.doc > y.doc)")
        .filter(_may_link("x", "y"))
        .select("x.doc", F.col("y.doc").alias("partner"))
    )
    return links.unionAll(verified(docs, apart))


def _mixed_lists(members: DataFrame, links: DataFrame) -> DataFrame:
    """Members, with the component (``part``) that links put them in, of those lists
    that hold more components than one."""
    known = components(links).withColumnRenamed("node", "doc")
    placed = members.join(known, "doc", "left").withColumn("part", F.coalesce("component", "doc"))
    mixed = placed.groupBy("s").agg(
        F.min("part").alias("low"),
        F.max("part").alias("high"),
        F.ceil(F.count("*") / BLOCK).alias("blocks"),
    )
    mixed = mixed.filter("low < high").select("s", "blocks")
    return stored(placed.drop("component").join(mixed, "s"), "mixed-lists")


def _may_link(x: str, y: str) -> Column:
    """By sizes and by how much at least is in one of two sets only.

    That is all that is in no long list, and of the long lists at least as many as bits
    differ: each bit tells whether an odd number of them fell on it. Linked sets of m and
    n shingles have m + n - 2 T(m, n) such shingles at most.
    """

    def of(side: str, name: str) -> Column:
        return F.col(f"{side}.{name}")

    m, n = of(x, "n"), of(y, "n")
    differ = m - of(x, "lists") + n - of(y, "lists")
    may = F.lit(True)
    for k in range(BIT_WORDS):
        differ = differ + F.bit_count(of(x, "bits")[k].bitwiseXOR(of(y, "bits")[k]))
        if k in (BIT_WORDS // 4 - 1, BIT_WORDS - 1):  # most pairs are told by a quarter
            may &= (m + n - differ) * (100 + PERCENT) >= (m + n) * (2 * PERCENT)
    return may


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc``, ``n`` (size of the shingle set) and ``component`` of every row.

    ``component`` is the smallest id that links lead to. Texts with equal sets are one
    class and are compared once. A text without words, or null, has n 0 and is linked
    with nothing. Rows with one id are one document, which links as any of its texts
    does; each row has the size of its own text. Rows without an id take part under :func:`doc_key`, above all ids. An empty
    table has no rows. Shingles are compared by 64-bit hashes of whole words.
    """
    docs = docs.select(doc_key(doc_id, text).alias("id"), F.col(f"`{text}`").alias("text"))
    # Every step that sends texts or sets to Python is stored in here.
    with setting(docs.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES):
        return _grouped(docs.select(F.col("id").alias("doc"), "id", "text"))


def _grouped(docs: DataFrame) -> DataFrame:
    rows = stored(docs.mapInArrow(_signatures, _SIGNATURES), "signatures")
    # Texts that share an id are compared each by itself, under a number of its own.
    several = rows.groupBy("doc").agg(F.count_distinct("digest").alias("k")).filter("k > 1")
    several = stored(several.select("doc"), "several-texts")
    shared = not several.isEmpty()
    if shared:
        apart = docs.join(several, "doc", "left_semi").select(
            text_number("text").alias("doc"), "id", "text"
        )
        rest = docs.join(several, "doc", "left_anti")
        rows = rows.join(several, "doc", "left_anti").unionByName(
            stored(apart.mapInArrow(_signatures, _SIGNATURES), "signatures-of-shared")
        )
        docs = rest.unionByName(apart)
    filled = rows.filter("n > 0")
    classes = stored(filled.groupBy("digest").agg(F.min("doc").alias("first")), "classes")
    copies = filled.select("doc").distinct().join(
        classes.select(F.col("first").alias("doc")).distinct(), "doc", "left_anti"
    )
    single = docs.join(stored(copies, "copies"), "doc", "left_anti")

    postings = single.mapInArrow(_postings(prefix_length), _POSTINGS)
    found, _ = search_lists(postings, everything=False)
    pairs = found.filter("partner IS NOT NULL")
    links = verified(docs, pairs)
    further = stored(found.filter("partner IS NULL").select("doc").distinct(), "further")
    if not further.isEmpty():
        again = docs.join(further, "doc", "left_semi")
        found, shares = search_lists(
            again.mapInArrow(_postings(lambda n: n), _POSTINGS), everything=True
        )
        links = links.unionAll(verified(docs, found.filter("partner IS NOT NULL")))
        hidden = found.filter("partner IS NULL").select("doc").distinct()
        hidden = stored(hidden, "hidden")
        if not hidden.isEmpty():
            links = _across(docs, shares, hidden, links)
    if shared:  # an id with several texts holds their classes together
        held = filled.filter("doc <> id").join(classes, "digest")
        links = links.unionAll(held.select(F.col("id").alias("a"), F.col("first").alias("b")))
    known = components(links).withColumnRenamed("node", "first")
    grouped = rows.join(classes, "digest", "left").withColumn("first", F.coalesce("first", "id"))
    grouped = grouped.join(known, "first", "left")
    return grouped.select(
        F.col("id").alias("doc"), "n", F.coalesce("component", "first").alias("component")
    )


def one_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without all but the smallest id of each group.

    Rows that share an id and a text count once. Of rows that share an id alone, the one
    whose text has the smallest hash has the id; the others take part as rows without
    one do, so that each goes or stays for its own text.
    """
    given = F.col(f"`{doc_id}`").cast("long")
    marked = docs.select(
        F.struct("*").alias("row"), given.alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("mark")
    )
    several = marked.groupBy("id").agg(F.min("mark").alias("least"), F.max("mark").alias("most"))
    several = stored(several.filter("id IS NOT NULL AND least <> most").select("id", "least"), "shared-ids")
    keyed = marked.join(several, "id", "left").select(
        "row",
        F.col(f"row.`{text}`").alias("text"),
        F.when(F.col("least").isNull() | (F.col("mark") == F.col("least")), F.col("id")).alias("id"),
    )
    keyed = keyed.select("row", "text", doc_key("id", "text").alias("doc"))
    groups = similar_groups(keyed, "text", "doc")
    gone = stored(groups.filter("component <> doc").select("doc").distinct(), "near-copies")
    rows = keyed.join(gone, "doc", "left_anti").groupBy("doc").agg(F.min("row").alias("row"))
    return rows.select("row.*")


OP4_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d
        WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM shingles a JOIN shingles b USING (s)
  WHERE a.doc_id <> b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM common JOIN sizes m ON m.doc_id = x JOIN sizes n ON n.doc_id = y
  WHERE 100 * c >= 75 * (m.n + n.n - c)
), reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION
  SELECT r.doc_id, l.y FROM reach r JOIN links l ON l.x = r.other
)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(other) AS component_id
FROM d JOIN reach USING (doc_id) LEFT JOIN sizes USING (doc_id) GROUP BY d.doc_id, n
"""


@query("op4_ngram_jaccard", OP4_SQL)
def op4_ngram_jaccard(spark, sf_dir):
    groups = similar_groups(read_table(spark, sf_dir, "documents"))
    return groups.select(
        F.when(F.col("doc") < NO_ID, F.col("doc")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("component") < NO_ID, F.col("component")).alias("component_id"),
    )
