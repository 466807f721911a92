"""Quality rules as a short-circuit cascade.

The rules of a cascade are ordered by what they reject for their cost, both measured
on a bounded sample. A text is tried against one rule after another and stops at the
first that rejects it. The order changes what a run costs, never which rows stay.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import BLANK_CLASS, lines, read_table, stored, words

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50


class Measures:
    """What rules look at. Built on a text column every measure is an expression over
    the text; given columns stand in for those already computed."""

    def __init__(self, text: Column, **known: Column):
        self.text = F.coalesce(text, F.lit(""))
        self.__dict__.update(known)

    def __getattr__(self, name: str) -> Column:
        if name not in MEASURES:
            raise AttributeError(name)
        return MEASURES[name](self)


# Whole texts always; a null text counts as empty.
MEASURES = {
    "words": lambda m: words(m.text),
    # Lines with a word.
    "lines": lambda m: F.filter(lines(m.text), lambda x: x.rlike(f"[^{BLANK_CLASS}]")),
    "n_words": lambda m: F.size(m.words).cast("long"),
    "word_chars": lambda m: F.char_length(F.array_join(m.words, "")).cast("long"),
    "n_symbols": lambda m: F.regexp_count(m.text, F.lit(f"[{SYMBOLS}]")).cast("long"),
    "n_dup_lines": lambda m: (F.size(m.lines) - F.size(F.array_distinct(m.lines))).cast("long"),
    "n_unlettered": lambda m: F.regexp_count(
        m.text, F.lit(rf"(?<![^{BLANK_CLASS}])[^\p{{L}}{BLANK_CLASS}]+(?![^{BLANK_CLASS}])")
    ),
    "n_dotted": lambda m: F.size(F.filter(m.lines, lambda x: x.rlike(r"(\.\.\.|…) *$"))),
    "n_bullets": lambda m: F.size(F.filter(m.lines, lambda x: x.rlike("^ *[-*•]"))),
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` makes the condition out of :class:`Measures`."""

    name: str
    rejects: Callable[[Measures], Column]


def _above(part: Column, whole: Column, percent: int) -> Column:
    return part * 100 > whole * percent


# The limits are those that published web-text pipelines use.
RULES = (
    Rule("symbols", lambda m: _above(m.n_symbols, m.n_words, 10)),
    Rule(
        "word_length",
        lambda m: (m.word_chars < m.n_words * 2) | (m.word_chars > m.n_words * 15),
    ),
    Rule("duplicate_lines", lambda m: _above(m.n_dup_lines, F.size(m.lines), 30)),
    Rule("letters", lambda m: _above(m.n_unlettered, m.n_words, 20)),
    Rule("dots", lambda m: _above(m.n_dotted, F.size(m.lines), 30)),
    Rule("bullets", lambda m: _above(m.n_bullets, F.size(m.lines), 90)),
)


def order_rules(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    sample_rows: int = 2000,
    seed: int = 7,
) -> list[Rule]:
    """The rules, the best rejection per second first.

    Cost and rejection rate come from about ``sample_rows`` rows, whatever the size
    of ``docs``; each rule runs over them on its own. Rules that reject nothing there
    come last, the cheapest first. An empty table leaves the order as it is.
    """
    total = docs.count()
    if not total:
        return list(rules)
    share = min(1.0, sample_rows / total)
    sample = stored(docs.select(F.col(f"`{text}`").alias("text")).sample(share, seed), "rules")

    def run(condition: Column) -> tuple[float, int]:
        start = time.perf_counter()
        hits = sample.agg(F.count_if(condition)).first()[0]
        return time.perf_counter() - start, hits

    idle = min(run(F.col("text").isNull())[0] for _ in range(2))
    ranks = {}
    for rule in rules:
        condition = rule.rejects(Measures(F.col("text")))
        seconds, hits = min(run(condition) for _ in range(2))
        cost = max(seconds - idle, 1e-3)
        ranks[rule.name] = (-hits / cost, cost)
    return sorted(rules, key=lambda rule: ranks[rule.name])


def first_rejection(measures: Measures, rules: Sequence[Rule]) -> Column:
    """Name of the first rule that rejects, null if none does; later ones do not run."""
    chain = F
    for rule in rules:
        chain = chain.when(rule.rejects(measures), F.lit(rule.name))
    return chain.otherwise(F.lit(None).cast("string")) if rules else F.lit(None).cast("string")


# n_repeat_words in steps, each a column of its own. First a hash for each window.
_WINDOW_HASHES = (
    "transform(slice(_words, 1, greatest(size(_words) - 2, 0)), "
    "(w, i) -> xxhash64(w, _words[i + 1], _words[i + 2]))"
)
# Then, for texts in which a hash comes twice, the places of windows whose upper 40 bits
# do: hash and place share a long, and longs sort fast. It may find too many, never too
# few. Above 2^24 words, where a place needs more bits, every place is taken.
_PACKED = (
    "CASE WHEN size(_hashes) > size(array_distinct(_hashes)) AND size(_hashes) <= 16777216 "
    "THEN sort_array(transform(_hashes, (h, i) -> shiftleft(shiftright(h, 24), 24) + i)) END"
)
# get() gives null beyond both ends, and null is no match.
_PLACES = (
    "CASE WHEN size(_hashes) > 16777216 THEN sequence(0, size(_hashes) - 1) ELSE "
    "transform(filter(_packed, (x, k) -> "
    "coalesce(shiftright(x, 24) = shiftright(get(_packed, k - 1), 24), false) OR "
    "coalesce(shiftright(x, 24) = shiftright(get(_packed, k + 1), 24), false)), "
    "x -> cast(x & 16777215 AS int)) END"
)
# At last the words themselves: sorting puts equal windows side by side.
_SORTED = (
    "sort_array(transform(_places, i -> "
    "struct(concat_ws(' ', _words[i], _words[i + 1], _words[i + 2]) AS g, i AS i)))"
)
_REPEATED = (
    "sort_array(transform(filter(_sorted, (x, k) -> "
    "coalesce(x.g = get(_sorted, k - 1).g, false) OR "
    "coalesce(x.g = get(_sorted, k + 1).g, false)), x -> x.i))"
)
_COVERED = (
    "coalesce(aggregate(_repeated, named_struct('last', -3, 'n', 0L), (a, p) -> "
    "named_struct('last', p, 'n', a.n + least(3, p - a.last)), a -> a.n), 0L)"
)


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Columns ``row`` (all of the input), ``text``, ``_words``, ``_lines``, ``n_words``,
    ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words``, all over
    whole texts.

    A null text has no words. Nothing is shuffled.
    """
    value = F.col(f"`{text}`")
    known = Measures(value)
    found = docs.select(
        F.struct("*").alias("row"),
        value.alias("text"),
        known.words.alias("_words"),
        known.lines.alias("_lines"),
        known.n_symbols.alias("n_symbols"),
    )
    known = Measures(F.col("text"), words=F.col("_words"), lines=F.col("_lines"))
    found = found.select(
        "*",
        known.n_words.alias("n_words"),
        known.word_chars.alias("word_chars"),
        known.n_dup_lines.alias("n_dup_lines"),
        F.expr(_WINDOW_HASHES).alias("_hashes"),
    )
    found = found.withColumn("_packed", F.expr(_PACKED))
    found = found.withColumn("_places", F.expr(_PLACES)).drop("_packed", "_hashes")
    found = found.withColumn("_sorted", F.expr(_SORTED)).drop("_places")
    found = found.withColumn("_repeated", F.expr(_REPEATED)).drop("_sorted")
    return found.withColumn("n_repeat_words", F.expr(_COVERED)).drop("_repeated")


def base_fails() -> Column:
    """On the columns of :func:`text_statistics`."""
    return (F.col("n_words") < LEAST_WORDS) | _above(
        F.col("n_repeat_words"), F.col("n_words"), MOST_REPEATED_PERCENT
    )


def judge(
    docs: DataFrame,
    rules: Sequence[Rule] = RULES,
    text: str = "text",
    sample_rows: int = 2000,
) -> DataFrame:
    """The columns of :func:`text_statistics`, ``base_failed`` and ``rejected_by``.

    A text that fails the base check runs no rule at all. Null and empty texts fail
    it. Equal rows get equal verdicts, an empty table none. ``rejected_by`` is
    ``base``, a rule's name or null; which of several rules is named hangs on the
    measured order, whether one is named does not.
    """
    ordered = order_rules(docs, rules, text, sample_rows)
    found = text_statistics(docs, text).withColumn("base_failed", base_fails())
    have = ("n_words", "word_chars", "n_symbols", "n_dup_lines")
    known = {name: F.col(name) for name in have}
    known |= {"words": F.col("_words"), "lines": F.col("_lines")}
    verdict = F.when(F.col("base_failed"), F.lit("base")).otherwise(
        first_rejection(Measures(F.col("text"), **known), ordered)
    )
    return found.withColumn("rejected_by", verdict).drop("_words", "_lines")


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that no rule rejects, with all their columns."""
    # Spark would copy the statistics into a condition that it moves below them, and run
    # them anew for every element of a lambda; it moves none past a row number.
    judged = judge(docs, rules, text).withColumn("_n", F.monotonically_increasing_id())
    return judged.filter(F.col("rejected_by").isNull() & (F.col("_n") >= 0)).select("row.*")


OP1_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), tokens AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM base
), split AS (
  SELECT r, list_filter(string_split(t, chr(10)),
    lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM base
), windows AS (
  SELECT r, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM tokens)
), twice AS (
  SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, g) > 1
), repeats AS (
  SELECT r, count(*) AS n FROM (
    SELECT DISTINCT r, i + k AS p FROM twice, (VALUES (0), (1), (2)) AS o(k)) GROUP BY r
), counts AS (
  SELECT b.doc_id, b.t, t.w, s.l, len(t.w)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(t.w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(b.t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(s.l) - len(list_distinct(s.l)))::BIGINT AS n_dup_lines,
    coalesce(p.n, 0)::BIGINT AS n_repeat_words
  FROM base b JOIN tokens t USING (r) JOIN split s USING (r) LEFT JOIN repeats p USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > 10 * n_words
    OR word_chars < 2 * n_words OR word_chars > 15 * n_words
    OR 100 * n_dup_lines > 30 * len(l)
    OR 100 * len(list_filter(w, lambda x: NOT regexp_matches(x, '\p{L}'))) > 20 * n_words
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…) *$'))) > 30 * len(l)
    OR 100 * len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) > 90 * len(l) AS rejected
  FROM counts
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT rejected AS kept
FROM judged
"""


@query("op1_quality_rules", OP1_SQL)
def op1_quality_rules(spark, sf_dir):
    return judge(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.col("rejected_by").isNull().alias("kept"),
    )
