"""From raw documents to training text in five stages.

Every stage works on all rows that the one before it kept, and is written as a table
before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import line_dedup, mixing, ngram_join, quality, sentencepieces
from eventloom.llm.text import stored
from eventloom.session import setting


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.keep_good(docs)


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that a document of a smaller id holds."""
    found = line_dedup.deduplicate_lines(docs)
    changed = {"text": F.col("kept"), "n_chars": F.char_length("kept").cast("long")}
    return found.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones, the one of the smallest id."""
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the pieces of every text, and the text they decode to."""
    found = sentencepieces.encode_documents(docs).select(
        "row.doc_id", "row.source", F.size("ids").cast("long").alias("n_pieces"), "ids", "decoded"
    )
    # The size of a batch is that of the session when the texts are sent.
    with setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", ngram_join.BATCH_BYTES):
        return stored(found, "pieces")


STAGES = [
    ("quality rules", good_documents),
    ("line dedup", without_shared_lines),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed_sources),
    ("SentencePiece", encoded),
]

# SQL has no way to encode.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
