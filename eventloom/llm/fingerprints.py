"""Document fingerprints by winnowing, in DataFrame functions only.

A text is a row of words; white space separates them and longer runs are cut after
every sixteen characters. Every five words in a row are a gram with a polynomial
(rolling) hash; of every four grams in a row the one of the smallest hash is chosen,
the rightmost of equal ones, and kept with its place. So any eight words in a row that
two texts share leave a common fingerprint in both, and its places say where.

All of a text is worked on inside its row: no shuffle, no Python. Words are found in
blocks of characters and grams chosen in blocks of words, so that only one number a
word is held for a long text as a whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import BLANK_CLASS, read_table

GRAM_WORDS = 5
WINDOW_GRAMS = 4
# Shared runs of so many words leave a common fingerprint.
GUARANTEED_WORDS = GRAM_WORDS + WINDOW_GRAMS - 1
WORD_CHARS = 16
BLOCK_CHARS = 1 << 16
BLOCK_GRAMS = 4096

# Base and modulus of the hash.
BASE = 1_000_003
MODULUS = (1 << 31) - 1

_WORD = f"[^{BLANK_CLASS}]{{1,{WORD_CHARS}}}"
# Up to a blank or the end; a longer run is cut between its words.
_BLOCK = (
    rf"(?s).{{1,{BLOCK_CHARS}}}(?=[{BLANK_CLASS}]|\z)|[{BLANK_CLASS}]*[^{BLANK_CLASS}]{{{BLOCK_CHARS}}}"
)
_PLACES = 2 * BLOCK_GRAMS
_SHARDS = 1 << 16
_SHARD_BYTES = 1 << 22


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _code(word: Column) -> Column:
    """A number of 28 bits for a word, so that five times a power fit a long."""
    return F.shiftright(F.crc32(word), 4)


def word_codes(text: Column) -> Column:
    """The numbers of a text's words in order."""
    words = lambda part: F.transform(
        F.regexp_extract_all(part, F.lit(_WORD), F.lit(0)), _code
    )
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))
    return F.when(F.octet_length(text) <= BLOCK_CHARS, words(text)).otherwise(
        F.flatten(F.transform(blocks, words))
    )


def _gram_hashes(codes: Column) -> Column:
    """A hash for every gram; fewer words than a gram has are one gram."""
    powers = [pow(BASE, k, MODULUS) for k in range(GRAM_WORDS)]

    def rolled(code: Column, at: Column) -> Column:
        total = code * F.lit(powers[-1])
        for k in range(1, GRAM_WORDS):
            total = total + F.get(codes, at + k) * F.lit(powers[GRAM_WORDS - 1 - k])
        return total % F.lit(MODULUS)

    short = F.aggregate(
        codes, F.lit(0).cast("long"), lambda h, code: (h * F.lit(BASE) + code) % F.lit(MODULUS)
    )
    grams = F.transform(F.slice(codes, F.lit(1), F.size(codes) - F.lit(GRAM_WORDS - 1)), rolled)
    return F.when(F.size(codes) < GRAM_WORDS, F.array(short)).otherwise(grams)


def _chosen(hashes: Column, first: Column) -> Column:
    """``hash * 2^32 + place`` of the minima of all windows, in order of places."""
    # Of equal hashes the rightmost is the smallest.
    packed = F.transform(
        hashes, lambda h, at: h * F.lit(_PLACES) + (F.lit(_PLACES - 1) - at).cast("long")
    )

    def minima(row: Column) -> Column:
        windows = F.greatest(F.size(row) - F.lit(WINDOW_GRAMS - 1), F.lit(1))
        return F.transform(
            F.slice(row, F.lit(1), windows),
            lambda x, at: F.least(x, *(F.get(row, at + k) for k in range(1, WINDOW_GRAMS))),
        )

    return F.transform(
        F.array_distinct(_let(packed, minima)),
        lambda x: F.shiftleft(F.shiftright(x, _PLACES.bit_length() - 1), 32)
        + (F.lit(_PLACES - 1) - x % F.lit(_PLACES))
        + first.cast("long"),
    )


def winnowed(text: Column) -> Column:
    """Fingerprints of a text: structs of ``hash`` and ``at``, the number of the gram's
    first word, in order of places. A text without words, or null, has none."""

    def of_block(codes: Column, number: Column) -> Column:
        first = number * F.lit(BLOCK_GRAMS)
        part = F.slice(codes, first + 1, F.lit(BLOCK_GRAMS + GUARANTEED_WORDS - 1))
        return _let(part, lambda p: _let(_gram_hashes(p), lambda h: _chosen(h, first)))

    def of_codes(codes: Column) -> Column:
        windows = F.size(codes) - F.lit(GUARANTEED_WORDS - 1)
        blocks = F.greatest(F.ceil(windows / F.lit(BLOCK_GRAMS)), F.lit(1)).cast("int")
        found = F.flatten(
            F.transform(F.sequence(F.lit(0), blocks - 1), lambda n: of_block(codes, n))
        )
        return F.when(F.size(codes) > 0, F.array_distinct(found)).otherwise(
            F.array().cast("array<long>")
        )

    packed = _let(word_codes(F.coalesce(text, F.lit(""))), of_codes)
    return F.transform(
        packed,
        lambda x: F.struct(
            F.shiftright(x, 32).alias("hash"), x.bitwiseAND(F.lit(0xFFFFFFFF)).alias("at")
        ),
    )


def distinct_hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda e: e["hash"]))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints' distinct hashes the share that both have; 1 for none at all."""

    def share(both: Column) -> Column:
        every = F.size(a) + F.size(b) - both
        return F.when(every > 0, both / every).otherwise(F.lit(1.0))

    return _let(F.size(F.array_intersect(a, b)), share)


def as_text(fingerprint: Column) -> Column:
    """``hash@place`` of every element, with blanks between."""
    return F.array_join(F.transform(fingerprint, lambda e: F.concat_ws("@", e["hash"], e["at"])), " ")


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of the input) and ``fingerprint`` (see :func:`winnowed`).

    One row for every row: repeated rows have equal fingerprints, as have all equal
    texts. Texts of fewer than five words are one gram
    and texts of up to four grams one window, so both have one element. A null text is
    an empty one and has no element; an empty table gives no rows. A text's words take
    24 bytes each while it is worked on.
    """
    return docs.select(F.struct("*").alias("row"), winnowed(F.col(f"`{text}`")).alias("fingerprint"))


def _searched(bounds: list[int], doc_id: Column) -> Column:
    """How many of the descending ``bounds`` are above an id, by bisection."""
    if not bounds:
        return F.lit(0)
    table = _numbers(bounds)
    steps = [1 << k for k in reversed(range(len(bounds).bit_length()))]
    above = lambda at: F.coalesce(F.get(table, at) > doc_id, F.lit(False))
    return F.aggregate(
        F.array(*map(F.lit, steps)),
        F.lit(0),
        lambda found, step: F.when(above(found + step - 1), found + step).otherwise(found),
    )


def _numbers(values: list[int]) -> Column:
    """A constant array, as one value however long."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<long>")


def followed(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Fingerprints of every document beside those of the next one by descending id.

    Columns ``doc_id``, ``text``, ``fingerprint``, its distinct ``hashes``, ``next_text``
    and ``next_hashes``.
    The smallest id is followed by the largest, an only document by itself. Documents
    without an id come last, rows with the same id in the order of a hash of their
    texts. A null text is an empty one; an empty table gives no rows.

    Documents are dealt out once, by ranges of ids of about equal counts; the first of
    every range goes along to the range before it. The ranges' bounds and first keys,
    two numbers for each of at most 65,536 ranges, are all that the driver gets.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"),
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    wanted = min(max(size // _SHARD_BYTES, 2 * tasks), _SHARDS)
    cuts = [k / wanted for k in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("doc_id", cuts, max(10_000, 8 * wanted))).first()[0]
    bounds = sorted(set(bounds or []), reverse=True)
    placed = rows.select(
        F.when(F.col("doc_id").isNull(), len(bounds))
        .otherwise(_searched(bounds, F.col("doc_id")))
        .alias("shard"),
        F.bitwise_not("doc_id").alias("down"),
        F.xxhash64("text").alias("mark"),
        "doc_id",
        "text",
    )
    firsts = sorted(
        placed.groupBy("shard")
        .agg(F.min(F.struct(F.col("down").isNull(), "down", "mark")).alias("first"))
        .select("shard", "first.down", "first.mark")
        .collect()
    )
    before = {row.shard: firsts[k - 1].shard for k, row in enumerate(firsts)}
    first = {row.shard: row for row in firsts}
    every = range(len(bounds) + 1)
    of = lambda values: F.get(_numbers(values), F.col("shard"))
    is_first = (F.col("mark") == of([first[s].mark if s in first else 0 for s in every])) & (
        # The last range alone may have rows without an id, and begin with one.
        F.col("down").eqNullSafe(
            F.when(
                of([int(s in first and first[s].down is not None) for s in every]) == 1,
                of([(first[s].down if s in first else None) or 0 for s in every]),
            )
        )
    )
    here = F.struct("shard", F.lit(0).alias("copy"))
    there = F.struct(of([before.get(s, 0) for s in every]).cast("int").alias("shard"), F.lit(1).alias("copy"))
    dealt = placed.select(
        F.explode(F.when(is_first, F.array(here, there)).otherwise(F.array(here))).alias("to"),
        "down", "mark", "doc_id", "text",
    )
    dealt = dealt.select("to.*", "down", "mark", "doc_id", "text").repartition("shard")
    order = Window.partitionBy("shard").orderBy("copy", F.col("down").asc_nulls_last(), "mark")
    return (
        dealt.withColumn("fingerprint", winnowed(F.col("text")))
        .withColumn("hashes", distinct_hashes(F.col("fingerprint")))
        .withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_hashes", F.lead("hashes").over(order))
        .filter("copy = 0")
        .select("doc_id", "text", "fingerprint", "hashes", "next_text", "next_hashes")
    )


OP11_SQL = rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents
), following AS (
  SELECT doc_id, text, n, coalesce(lead(doc_id) OVER down, first_value(doc_id) OVER down) AS next_id,
    coalesce(lead(text) OVER down, first_value(text) OVER down) AS next_text
  FROM d WINDOW down AS (ORDER BY doc_id DESC)
), edited AS (
  SELECT doc_id, text, n, next_id,
    substr(text, 1, n - n // 3) || substr(next_text, 1, n // 3) AS edited
  FROM following
), texts AS (
  SELECT doc_id, 0 AS kind, text FROM edited UNION ALL SELECT doc_id, 1, edited FROM edited
), split AS (
  SELECT doc_id, kind, regexp_extract_all(text, '{_WORD}') AS w FROM texts
), word_list AS (
  SELECT DISTINCT unnest(w) AS word FROM split
), bits AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), numbered AS (
  SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(
    range(0, len(hex(encode(word))), 2), lambda k: ('0x' || substr(hex(encode(word)), k + 1, 2))::BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) >> 4 AS code
  FROM word_list, bits
), codes AS (
  SELECT s.doc_id, s.kind, coalesce(list(n.code ORDER BY s.i) FILTER (n.code IS NOT NULL), []) AS c
  FROM (SELECT doc_id, kind, unnest(w) AS word, unnest(range(len(w))) AS i FROM split) s
  JOIN numbered n ON n.word = s.word GROUP BY s.doc_id, s.kind
), grams AS (
  SELECT doc_id, kind, i, CASE
    WHEN len(c) < {GRAM_WORDS}
    THEN list_reduce(list_prepend(0::BIGINT, c), lambda h, x: (h * {BASE} + x) % {MODULUS})
    ELSE ({' + '.join(
        f"c[i + {k + 1}] * {pow(BASE, GRAM_WORDS - 1 - k, MODULUS)}"
        for k in range(GRAM_WORDS))}) % {MODULUS} END AS h
  FROM (SELECT *, unnest(range(0, greatest(len(c) - {GRAM_WORDS - 1}, 1))) AS i FROM codes
        WHERE len(c) > 0)
), minima AS (
  SELECT doc_id, kind, i, min({{'h': h, 'back': -i}}) OVER w AS least, count(*) OVER w AS held,
    first_value(i) OVER (PARTITION BY doc_id, kind ORDER BY i) AS first
  FROM grams
  WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW_GRAMS - 1} FOLLOWING)
), chosen AS (
  SELECT DISTINCT doc_id, kind, least.h AS h, -least.back AS place FROM minima
  WHERE held = {WINDOW_GRAMS} OR i = 0
), prints AS (
  SELECT doc_id, kind, string_agg(h || '@' || place, ' ' ORDER BY place) AS print,
    list_distinct(list(h)) AS hashes FROM chosen GROUP BY doc_id, kind
), own AS (
  SELECT e.doc_id, e.n, e.edited, e.next_id, coalesce(a.print, '') AS fingerprint,
    coalesce(b.print, '') AS edited_fingerprint, coalesce(a.hashes, []) AS ha,
    coalesce(b.hashes, []) AS hb
  FROM edited e LEFT JOIN prints a ON a.doc_id = e.doc_id AND a.kind = 0
  LEFT JOIN prints b ON b.doc_id = e.doc_id AND b.kind = 1
), pairs AS (
  SELECT o.*, f.ha AS hn, len(list_intersect(o.ha, o.hb)) AS ab, len(list_intersect(o.ha, f.ha)) AS an
  FROM own o JOIN own f ON f.doc_id = o.next_id
)
SELECT doc_id, n::BIGINT AS n_chars, sha256(edited) AS edited_sha256, fingerprint,
  edited_fingerprint,
  CASE WHEN len(ha) + len(hb) > 0 THEN ab / (len(ha) + len(hb) - ab) ELSE 1.0 END::DOUBLE
    AS near_edited,
  CASE WHEN len(ha) + len(hn) > 0 THEN an / (len(ha) + len(hn) - an) ELSE 1.0 END::DOUBLE
    AS near_next
FROM pairs
"""


@query("op11_fingerprints", OP11_SQL)
def op11_fingerprints(spark, sf_dir):
    """Likeness of every document to its edited text and to the next document."""
    both = followed(read_table(spark, sf_dir, "documents"))
    n = F.char_length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.left("text", n - third), F.left("next_text", third))
    rows = both.select("*", n.cast("long").alias("n_chars"), edited.alias("edited"))
    rows = rows.withColumn("edited_marks", winnowed(F.col("edited")))
    rows = rows.withColumn("edited_hashes", distinct_hashes(F.col("edited_marks")))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("fingerprint")).alias("fingerprint"),
        as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
