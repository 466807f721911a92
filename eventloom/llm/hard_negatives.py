"""Hard negatives for anchors: near rows of another label, below a positive's score.

Scores are integer inner products of quantised vectors. Every anchor's scores are put in
order by the shuffle: a key of 25 bytes packs the anchor, the score in descending order
and the row's id, and the rows of a partition arrive sorted by it. One pass over them
opens a window at each positive, emits negatives while their scores lie inside, and
closes it; no anchor's rows are ever held together.

What goes into that shuffle is combined first. Rows are scored in blocks against all
anchors, and of a block only what can be in an answer goes on: an anchor's best rows of
its own label, and, once its positives are known, the best negatives of each window.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored

POSITIVES = 5
NEGATIVES = 10
# A negative's score is at least LOW % and at most HIGH % of the positive's.
LOW = 30
HIGH = 90
STEPS = 256
# Bytes of a block of rows, as doubles, which one task holds.
BLOCK_BYTES = 1 << 24
# Anchors that are scored at a time.
TOGETHER = 128
# Beyond these, quantised components and scores count as the bound itself.
_MOST_STEP = 1 << 62
_MOST_SCORE = (1 << 63) - 1

_POSITIVE, _NEGATIVE = 0, 1
_KEY = struct.Struct(">QQBQ")
_SIGN = 1 << 63


def pack(anchor: int, score: int, row: int, kind: int) -> bytes:
    """A key whose order is: anchor, descending score, id. Of equal scores positives come
    first, so that a window is open when what may lie in it arrives."""
    return _KEY.pack(anchor + _SIGN, _SIGN - 1 - score, kind, row + _SIGN)


def unpack(key: bytes) -> tuple[int, int, int, int]:
    anchor, score, kind, row = _KEY.unpack(key)
    return anchor - _SIGN, _SIGN - 1 - score, row - _SIGN, kind


def windows(
    keys: Iterator[bytes], positives: int, negatives: int, low: int, high: int
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """Negatives of every window out of sorted keys, in one pass.

    State is the open windows of the current anchor: at most ``positives`` of them.
    """
    current, met, opened = None, 0, []
    for key in keys:
        anchor, score, row, kind = unpack(key)
        if anchor != current:
            current, met, opened = anchor, 0, []
        if kind == _POSITIVE:
            if met < positives:
                met += 1
                opened.append([row, score, 0])
            continue
        for window in opened:
            positive, positive_score, found = window
            if low * positive_score <= 100 * score <= high * positive_score:
                window[2] = found + 1
                yield anchor, positive, found + 1, row, positive_score, score
        # Scores only fall from here on.
        opened = [w for w in opened if w[2] < negatives and 100 * score >= low * w[1]]


def quantised(vectors: np.ndarray, steps: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(steps * vectors), -float(_MOST_STEP), float(_MOST_STEP))


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products of whole-numbered doubles, in doubles while these are exact."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0))
    most *= max(1, rows.shape[1])
    if most < 1 << 53:
        return (anchors @ rows.T).astype(np.int64)
    if most < 1 << 62:
        return anchors.astype(np.int64) @ rows.astype(np.int64).T
    exact = np.vectorize(int, otypes=[object])
    product = np.dot(exact(anchors), exact(rows).T)
    return np.clip(product, -_MOST_SCORE, _MOST_SCORE).astype(np.int64)


def _best(score: np.ndarray, places: np.ndarray, most: int) -> np.ndarray:
    """The places of the highest scores; places are in order of ids, which breaks ties."""
    if len(places) > most:
        own = score[places]
        places = places[own >= np.partition(own, len(own) - most)[len(own) - most]]
    # Scores are above the smallest long, so that negation is safe.
    return places[np.argsort(-score[places], kind="stable")][:most]


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class _Block:
    """Rows of one block in order of ids, with their labels as numbers."""

    def __init__(self, parts: list[pa.RecordBatch], steps: int):
        ids = np.concatenate([p.column("vec_id").to_numpy() for p in parts])
        order = np.argsort(ids, kind="stable")
        labels = pa.chunked_array([p.column("label") for p in parts]).combine_chunks()
        labels = labels.dictionary_encode()
        self.ids = ids[order]
        self.codes = {v: k for k, v in enumerate(labels.dictionary.to_pylist())}
        self.labels = labels.indices.to_numpy()[order]
        self.rows = quantised(np.concatenate([_matrix(p.column("vector")) for p in parts])[order], steps)


_SCORED = "part int, kind int, vec_id long, label string, vector array<double>, bounds array<long>"
_FOUND = "anchor_id long, vec_id long, score long"


def _scored(choose: Callable, steps: int) -> Callable:
    """Blocks of rows (kind 0), each followed by the anchors it is scored against.
    ``choose`` gives the places of the block's rows that go on for one anchor."""

    def of_run(block: _Block, run: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[np.ndarray]] = [[], [], []]
        ids = run.column("vec_id").to_numpy()
        labels, bounds = run.column("label").to_pylist(), run.column("bounds").to_pylist()
        product = scores(quantised(_matrix(run.column("vector")), steps), block.rows)
        for k, anchor in enumerate(ids.tolist()):
            same = block.labels == block.codes.get(labels[k], -1)
            chosen = choose(product[k], same, block.ids != anchor, bounds[k])
            out[0].append(np.full(len(chosen), anchor))
            out[1].append(block.ids[chosen])
            out[2].append(product[k][chosen])
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in out]
        return pa.RecordBatch.from_arrays(columns, ["anchor_id", "vec_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("part", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if end == start:
                    continue
                if marks[0, start] != place:
                    place, held, block = marks[0, start], [], None
                part = batch.slice(start, end - start)
                if marks[1, start] == 0:
                    held.append(part)
                elif held:
                    block = block or _Block(held, steps)
                    for at in range(0, part.num_rows, TOGETHER):
                        yield of_run(block, part.slice(at, TOGETHER))

    return run


def valid_rows(table: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """``vec_id``, ``label`` (as text) and ``vector`` of the rows that take part."""
    known = table.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"),
        F.col(f"`{label}`").cast("string").alias("label"),
        F.col(f"`{embedding}`").cast("array<double>").alias("vector"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    known = known.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite)
    return known.filter(F.size("vector") > 0)


def mine(
    table: DataFrame,
    is_anchor,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low: int = LOW,
    high: int = HIGH,
    steps: int = STEPS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and
    ``negative_score``: for each anchor and positive the first negatives of its window.

    ``is_anchor`` is a condition on ``vec_id``. A row's score is the inner product of the
    vectors' components, each times ``steps`` and rounded down; higher scores come first,
    then smaller ids. An anchor's positives are its first other rows of the same label.

    Rows without an id or a label, and vectors that are null, empty or hold null, NaN or
    infinite components take no part, neither do vectors of another length than most have
    (of equally frequent lengths the shortest counts). Rows with one id are one row, that
    of the smallest label and vector, so repeated rows count once. Scores beyond 64 bits
    count as the largest. An empty table gives no rows.

    A block is a bounded number of rows by a hash of their ids, whatever label they have;
    the anchors visit every block. Each block sends at most ``positives`` rows for an
    anchor, then ``negatives`` for each of its windows.
    """
    spark = table.sparkSession
    result = (
        "anchor_id long, positive_id long, rank int, negative_id long, "
        "positive_score long, negative_score long"
    )
    rows = valid_rows(table, vec_id, embedding, label)
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").first()
    if usual is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("vector") == usual["length"])
    rows = rows.groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    rows = stored(rows.select("vec_id", "row.label", "row.vector"), "negatives-rows")
    parts = -(-usual["count"] * usual["length"] * 8 // block_bytes)
    none = F.lit(None).cast("array<long>")
    blocks = rows.select(
        F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part"),
        F.lit(0).alias("kind"), "vec_id", "label", "vector", none.alias("bounds"),
    )

    def visits(anchors: DataFrame) -> DataFrame:
        return blocks.unionAll(
            anchors.select(
                F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"),
                F.lit(1).alias("kind"), "vec_id", "label", "vector", "bounds",
            )
        ).repartition("part").sortWithinPartitions("part", "kind")

    def near(score, same, other, bounds):
        return _best(score, np.flatnonzero(same & other), positives)

    def between(score, same, other, bounds):
        chosen = []
        for positive in set(bounds):
            # In whole numbers: low * positive <= 100 * score <= high * positive.
            least, most = -(-low * positive // 100), high * positive // 100
            if least <= most:
                inside = (score >= least) & (score <= most) & ~same
                chosen.append(_best(score, np.flatnonzero(inside), negatives))
        return np.unique(np.concatenate(chosen)) if chosen else np.empty(0, int)

    anchors = rows.filter(is_anchor(F.col("vec_id")))
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")
    best = visits(anchors.withColumn("bounds", none)).mapInArrow(_scored(near, steps), _FOUND)
    best = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= positives)
    best = stored(best.drop("n"), "positives")
    bounds = best.groupBy("anchor_id").agg(F.collect_list("score").alias("bounds"))
    asking = anchors.join(bounds.withColumnRenamed("anchor_id", "vec_id"), "vec_id")
    below = visits(asking).mapInArrow(_scored(between, steps), _FOUND)

    keyed = best.withColumn("kind", F.lit(_POSITIVE)).unionAll(
        below.withColumn("kind", F.lit(_NEGATIVE))
    )
    sorted_keys = keyed.rdd.map(lambda r: (pack(r[0], r[2], r[1], r[3]), None))
    sorted_keys = sorted_keys.repartitionAndSortWithinPartitions(
        int(spark.conf.get("spark.sql.shuffle.partitions")), lambda key: crc32(key[:8])
    )
    mined = sorted_keys.mapPartitions(
        lambda pairs: windows((key for key, _ in pairs), positives, negatives, low, high)
    )
    return spark.createDataFrame(mined, result)


OP13_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
    list_sum(list_transform(list_zip(a.v, b.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id,
  (row_number() OVER best)::INTEGER AS rank,
  vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scored USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW best AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 10
"""


@query("op13_hard_negatives", OP13_SQL)
def op13_hard_negatives(spark, sf_dir):
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    table = read_table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return mine(table, lambda vec_id: vec_id % 100 == 0)
