"""All queries of this package."""

from eventloom.llm import (  # noqa: F401
    chat,
    fingerprints,
    hard_negatives,
    line_dedup,
    main_text,
    mixing,
    neighbours,
    ngram_join,
    prefix_trie,
    quality,
    sentencepieces,
    token_counts,
    warc,
)
from eventloom.llm.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
