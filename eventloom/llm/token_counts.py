"""Token counts without tokens: the best path's length under a unigram vocabulary.

An Aho-Corasick automaton finds every piece in a text, by the place where it ends;
dynamic programming carries the best score and the number of pieces to each place and
keeps no path. Ties go as in encoding: of equal scores the piece that begins first.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table
from eventloom.llm.unigram import MODEL_PATH, Segments, Vocabulary, read_vocabulary


class Counter:
    """Counts for one vocabulary; made once in each worker."""

    def __init__(self, vocabulary: Vocabulary):
        self.automaton = ahocorasick.Automaton()
        for piece, _, score in vocabulary.usable():
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown_score = vocabulary.unknown_score
        self.byte_fallback = vocabulary.byte_fallback
        self.segments = Segments(vocabulary, lambda words: map(self.solve, words))

    def solve(self, segment: str) -> int:
        size = len(segment)
        ending: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
        for last, piece in self.automaton.iter(segment):
            ending[last + 1].append(piece)
        best, count = [0.0] * (size + 1), [0] * (size + 1)
        for end in range(1, size + 1):
            top, number, single = None, 0, False
            # The longest piece comes first, so one that begins later must beat it.
            for length, score in ending[end]:
                single = single or length == 1
                score += best[end - length]
                if top is None or score > top:
                    top, number = score, count[end - length] + 1
            if not single:
                score = best[end - 1] + self.unknown_score
                if top is None or score > top:
                    char = segment[end - 1]
                    taken = len(char.encode("utf-8", "surrogatepass")) if self.byte_fallback else 1
                    top, number = score, count[end - 1] + taken
            best[end], count[end] = top, number
        return count[size]

    def count_all(self, texts: Iterable[str | None]) -> Iterator[int]:
        total = 0
        for answers, ends in self.segments.answers(texts):
            total += sum(answers)
            if ends:
                yield total
                total = 0

    def count(self, text: str | None) -> int:
        return next(self.count_all([text]))


_COUNTERS: dict[str, Counter] = {}


def _counter(key: str, vocabulary: Vocabulary) -> Counter:
    """The worker's counter, which serves all its tasks; the last vocabulary's is kept."""
    if key not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[key] = Counter(vocabulary)
    return _COUNTERS[key]


def counter(vocabulary: Vocabulary):
    """A function of a text column that gives the number of tokens."""
    make = partial(_counter, vocabulary.key, vocabulary)

    @F.arrow_udf("bigint")
    def count(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = make()
        for batch in texts:
            yield pa.array(own.count_all(text.as_py() for text in batch), pa.int64())

    return count


def count_tokens(docs: DataFrame, text: str = "text", model_path: str = MODEL_PATH) -> DataFrame:
    """Columns ``row`` (all of the input) and ``n_tokens``.

    Whole texts are counted in one pass without a shuffle. Null and empty texts have
    0 tokens, equal rows equal counts, an empty table no rows.
    """
    count = counter(read_vocabulary(model_path))
    return docs.select(F.struct("*").alias("row"), count(F.col(f"`{text}`")).alias("n_tokens"))


@query("op8_token_counts")
def op8_token_counts(spark, sf_dir):
    return count_tokens(read_table(spark, sf_dir, "documents")).select("row.doc_id", "n_tokens")
