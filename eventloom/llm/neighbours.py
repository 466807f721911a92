"""Approximate nearest neighbours over learned partitions.

On a bounded sample the neighbour graph is cut into balanced partitions with few edges
between them, and a small classifier learns which partition a vector belongs to. Every
row is indexed under its most probable partition; a query visits its several most
probable ones, and what lies there is ranked by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored

SAMPLE_ROWS = 8192
PARTITIONS = 16
PROBES = 13
NEAREST = 10
# Rows of a partition that one task ranks at a time.
BLOCK_ROWS = 8192


def neighbour_graph(vectors: np.ndarray, degree: int = 10) -> np.ndarray:
    """The nearest ``degree`` others of each vector, in blocks."""
    squares = (vectors**2).sum(1)
    degree = min(degree, len(vectors) - 1)
    found = []
    for start in range(0, len(vectors), 64):
        block = vectors[start : start + 64]
        distance = squares[None, :] - 2 * block @ vectors.T
        distance[np.arange(len(block)), np.arange(start, start + len(block))] = np.inf
        nearest = np.argpartition(distance, degree - 1, axis=1)[:, :degree]
        found.append(nearest.astype(np.int32))
    return np.concatenate(found)


def balanced_partition(
    vectors: np.ndarray, graph: np.ndarray, parts: int, slack: float = 0.1, rounds: int = 15
) -> np.ndarray:
    """A part for each vector: none larger than its fair share and ``slack`` more, with
    as few graph edges between parts as moving vectors one by one can reach.

    Starts from halves of halves along the widest direction.
    """
    part = np.zeros(len(vectors), int)

    def halve(rows: np.ndarray, first: int, count: int) -> None:
        if count == 1:
            part[rows] = first
            return
        own = vectors[rows] - vectors[rows].mean(0)
        axis = np.linalg.eigh(own.T @ own)[1][:, -1]
        order = np.argsort(own @ axis, kind="stable")
        cut = len(rows) * (count // 2) // count
        halve(rows[order[:cut]], first, count // 2)
        halve(rows[order[cut:]], first + count // 2, count - count // 2)

    halve(np.arange(len(vectors)), 0, parts)
    edges = [[] for _ in range(len(vectors))]
    for own, others in enumerate(graph.tolist()):
        for other in others:
            edges[own].append(other)
            edges[other].append(own)
    sizes = np.bincount(part, minlength=parts)
    most = int(len(vectors) / parts * (1 + slack)) + 1
    for _ in range(rounds):
        moved = 0
        for own, others in enumerate(edges):
            votes = np.bincount(part[others], minlength=parts)
            votes[(sizes >= most) & (np.arange(parts) != part[own])] = -1
            best = int(votes.argmax())
            if votes[best] > votes[part[own]]:
                sizes[part[own]] -= 1
                sizes[best] += 1
                part[own] = best
                moved += 1
        if not moved:
            break
    return part


@dataclass(frozen=True)
class Router:
    """One hidden layer and a softmax over partitions."""

    mean: np.ndarray
    scale: float
    hidden: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def scores(self, vectors: np.ndarray) -> np.ndarray:
        x = (vectors - self.mean) / self.scale
        return np.maximum(x @ self.hidden + self.bias, 0) @ self.out + self.out_bias

    def ranked(self, vectors: np.ndarray, most: int) -> np.ndarray:
        """The most probable partitions of each vector, best first."""
        return np.argsort(-self.scores(vectors), axis=1, kind="stable")[:, :most]

    @property
    def parts(self) -> int:
        return len(self.out_bias)


def fit_router(
    vectors: np.ndarray, part: np.ndarray, parts: int, seed: int = 3, width: int = 128,
    epochs: int = 40,
) -> Router:
    """Learns the parts by Adam steps over shuffled batches, the same for equal input."""
    random = np.random.default_rng(seed)
    mean = vectors.mean(0)
    scale = float((vectors - mean).std()) or 1.0
    x = (vectors - mean) / scale
    dims = x.shape[1]
    weights = [
        random.normal(0, np.sqrt(2 / dims), (dims, width)), np.zeros(width),
        random.normal(0, np.sqrt(2 / width), (width, parts)), np.zeros(parts),
    ]
    means, squares = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step = 0
    for _ in range(epochs):
        order = random.permutation(len(x))
        for start in range(0, len(x), 256):
            rows = order[start : start + 256]
            pre = x[rows] @ weights[0] + weights[1]
            act = np.maximum(pre, 0)
            logits = act @ weights[2] + weights[3]
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), part[rows]] -= 1
            p /= len(rows)
            back = (p @ weights[2].T) * (pre > 0)
            slopes = [x[rows].T @ back, back.sum(0), act.T @ p, p.sum(0)]
            step += 1
            for i, slope in enumerate(slopes):
                slope = slope + 1e-4 * weights[i]
                means[i] = 0.9 * means[i] + 0.1 * slope
                squares[i] = 0.999 * squares[i] + 0.001 * slope**2
                rate = 2e-3 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                weights[i] = weights[i] - rate * means[i] / (np.sqrt(squares[i]) + 1e-8)
    return Router(mean, scale, *weights)


def valid_vectors(table: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """``vec_id`` and ``vector`` of the rows that take part."""
    vector = F.col(f"`{embedding}`").cast("array<double>")
    known = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), vector.alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    return known.filter(F.col("vec_id").isNotNull() & finite & some)


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def nearest(block: np.ndarray, ids: np.ndarray, queries: np.ndarray, own: np.ndarray, most: int):
    """For each query ids and exact distances of its nearest rows, ties to smaller ids.

    Products choose who may be among them, with room for their rounding; differences
    of the vectors themselves decide.
    """
    squares = (block**2).sum(1)
    for vector, query_id in zip(queries, own):
        rough = squares - 2 * (block @ vector) + vector @ vector
        others = ids != query_id
        places = np.flatnonzero(others)
        if len(places) > most:
            limit = np.partition(rough[places], most - 1)[most - 1]
            room = 1e-9 * (squares.max() + vector @ vector)
            places = places[rough[places] <= limit + room]
        exact = np.sqrt(((block[places] - vector) ** 2).sum(1))
        order = np.lexsort((ids[places], exact))
        chosen = places[order]
        # A row that is there twice counts once.
        _, first = np.unique(ids[chosen], return_index=True)
        kept = np.sort(first)[:most]
        yield query_id, ids[chosen[kept]], exact[order[kept]]


_VISIT = "part int, block int, kind int, vec_id long, vector array<double>"


def search(
    table: DataFrame,
    is_query,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    most: int = NEAREST,
    parts: int = PARTITIONS,
    probes: int = PROBES,
    sample_rows: int = SAMPLE_ROWS,
    seed: int = 5,
) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id`` and ``score``: the nearest rows of each query.

    ``is_query`` is a condition on ``vec_id``; those rows are searched for among all
    rows but themselves. Nearness is Euclidean distance in double precision, ties go to
    the smaller id. Rows without an id, and vectors that are null, zero, or hold null,
    NaN or infinite components take no part, neither do vectors of another length than
    most have. A row that is there twice counts once, and of rows with one id the smallest
    vector. An empty table gives no rows. Fewer than 64 rows are one partition.

    The graph and the classifier are fitted on about ``sample_rows`` rows, on the
    driver, whatever the size of the table; every row is indexed. A partition is
    ranked in blocks of bounded size, so one with a third of all rows is ranked in
    many tasks; each gives a query's ``most`` nearest at most.
    """
    spark = table.sparkSession
    rows = valid_vectors(table, vec_id, embedding)
    lengths = rows.groupBy(F.size("vector").alias("length")).count()
    usual = lengths.orderBy(F.desc("count"), "length").first()
    result = "query_id long, rank int, vec_id long, score double"
    if usual is None:
        return spark.createDataFrame([], result)
    rows = rows.filter(F.size("vector") == usual["length"])
    total = usual["count"]

    # The rows of smallest hash, at most sample_rows of them.
    share = min(1.0, sample_rows / total)
    drawn = F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.filter(drawn).limit(sample_rows) if share < 1 else rows
    # As Arrow, not as rows of Python numbers: the driver holds the sample once.
    learnt = _matrix(sample.orderBy("vec_id").select("vector").toArrow().column("vector"))
    parts = max(1, min(parts, len(learnt) // 32))
    if parts > 1:
        graph = neighbour_graph(learnt)
        router = fit_router(learnt, balanced_partition(learnt, graph, parts), parts)
        probes = min(probes, parts)
    else:
        router, probes = None, 1

    def route(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column("vector"))
            if router is None:
                best = np.zeros((len(vectors), 1), np.int32)
            else:
                best = router.ranked(vectors, count).astype(np.int32)
            places = pa.array(list(best), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("vector"), places],
                ["vec_id", "vector", "places"],
            )

    routed = "vec_id long, vector array<double>, places array<int>"
    # A row that is there several times takes one place among the nearest.
    distinct = rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    indexed = stored(
        distinct.mapInArrow(lambda b: route(b, 1), routed).select(
            F.get("places", F.lit(0)).alias("part"), "vec_id", "vector"
        ),
        "vector-index",
    )
    # One count for each partition comes to the driver.
    counts = {r[0]: r[1] for r in indexed.groupBy("part").count().collect()}
    blocks = F.element_at(
        F.create_map(*(F.lit(x) for p, n in counts.items() for x in (p, -(-n // BLOCK_ROWS)))),
        F.col("part"),
    )
    stored_rows = indexed.select(
        "part",
        F.pmod(F.xxhash64("vec_id"), blocks).cast("int").alias("block"),
        F.lit(0).alias("kind"),
        "vec_id",
        "vector",
    )
    asking = rows.filter(is_query(F.col("vec_id"))).groupBy("vec_id").agg(
        F.min("vector").alias("vector")
    )
    visits = (
        asking.mapInArrow(lambda b: route(b, probes), routed)
        .select("vec_id", "vector", F.explode("places").alias("part"))
        .filter(F.col("part").isin(*counts))
        .select(
            "part",
            F.explode(F.sequence(F.lit(0), (blocks - 1).cast("int"))).alias("block"),
            F.lit(1).alias("kind"),
            "vec_id",
            "vector",
        )
    )

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows (kind 0), each followed by the queries that visit it."""
        place, held, block, ids = None, [], None, None
        for batch in batches:
            marks = np.stack([batch.column(n).to_numpy() for n in ("part", "block", "kind")])
            cuts = np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(0)) + 1
            for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
                if end == start:
                    continue
                here, kind = tuple(marks[:2, start]), marks[2, start]
                run = batch.slice(start, end - start)
                if here != place:
                    place, held, block = here, [], None
                if kind == 0:
                    held.append((run.column("vec_id").to_numpy(), _matrix(run.column("vector"))))
                    continue
                if not held:
                    continue
                if block is None:
                    ids = np.concatenate([x[0] for x in held])
                    block = np.concatenate([x[1] for x in held])
                found = list(
                    nearest(
                        block, ids, _matrix(run.column("vector")),
                        run.column("vec_id").to_numpy(), most,
                    )
                )
                owners = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(owners.astype(np.int64)),
                        pa.array(np.concatenate([f[1] for f in found])),
                        pa.array(np.concatenate([f[2] for f in found])),
                    ],
                    ["query_id", "vec_id", "score"],
                )

    ranked = (
        stored_rows.unionAll(visits)
        .repartition("part", "block")
        .sortWithinPartitions("part", "block", "kind")
        .mapInArrow(rank, "query_id long, vec_id long, score double")
        .groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        ranked.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= most)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )


@query("op9_nearest_vectors")
def op9_nearest_vectors(spark, sf_dir):
    return search(read_table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 100 == 0)
