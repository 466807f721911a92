"""A trie of conversation prefixes, from ternary search trees over shards.

Turns get numbers from a dictionary of all distinct (role, text) pairs, so that a
conversation is a row of numbers. Distinct rows are dealt out by ranges in their own
order. A task puts its range, in bounded runs, into ternary search trees; the median of
a run is inserted first, then the medians of its halves, which keeps them balanced. A
pass over a tree from its youngest node to its oldest adds up members, leaves and
savings.

Runs are cut from one sorted order, so a prefix lies in two of them only if the last row
of one and the first row of the next share it. Such boundary nodes are written in parts
and merged; all others are whole. For that the parts must add up: the run in which a
node comes first owns it, and only the owner counts it as a child or takes its size off
the savings.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored

# Turn numbers in one search tree; a single longer conversation is a run of its own.
RUN_TURNS = 1 << 17
# Ids that are joined before they are hashed.
IDS_TOGETHER = 4096

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


class TernaryTree:
    """Nodes as columns: the number that a node stands for, its lower, equal and higher
    links, and the trie node above. Node 0 is the root, which has no number."""

    def __init__(self):
        self.number = [0]
        self.lower, self.equal, self.higher = [0], [0], [0]
        self.above, self.depth, self.size = [-1], [0], [0]

    def _new(self, number: int, size: int, above: int) -> int:
        self.number.append(number)
        for links in (self.lower, self.equal, self.higher):
            links.append(0)
        self.above.append(above)
        self.depth.append(self.depth[above] + 1)
        self.size.append(size)
        return len(self.number) - 1

    def insert(self, numbers: list[int], sizes: list[int]) -> list[int]:
        """The nodes on the way from the root to the row's last turn."""
        path, node = [0], 0
        for number, size in zip(numbers, sizes):
            links, at, child = self.equal, node, self.equal[node]
            while child and self.number[child] != number:
                links = self.lower if number < self.number[child] else self.higher
                at, child = child, links[child]
            if not child:
                child = links[at] = self._new(number, size, node)
            node = child
            path.append(node)
        return path


def medians(count: int) -> Iterator[int]:
    """All places below ``count``, each median before its halves'."""
    spans = [(0, count)]
    while spans:
        low, high = spans.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            spans += [(middle + 1, high), (low, middle)]


def shared(a: list[int] | None, b: list[int] | None) -> int:
    """Turns at the beginning that two rows share; -1 if one is not there."""
    if a is None or b is None:
        return -1
    for at, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return at
    return min(len(a), len(b))


def _digest(numbers: list[int]) -> list[bytes]:
    """A key for every prefix, the empty one first."""
    state = hashlib.blake2b(digest_size=16)
    keys = [state.digest()]
    for number in numbers:
        state.update(number.to_bytes(8, "big", signed=True))
        keys.append(state.digest())
    return keys


# A node or a part of one. ``key`` is null for whole nodes; ``parent_key`` is set where
# the parent is a boundary node, whose smallest member is not known yet.
_NODES = (
    "run long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
)
_NODE_TYPES = pa.schema(
    [("run", pa.int64()), ("key", pa.binary()), ("parent_key", pa.binary())]
    + [(n, pa.int64()) for n in ("depth", "conv_id", "parent_conv_id", "n_convs", "n_children",
                                 "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string())]
)


def run_nodes(run: int, rows: list[tuple], before: list[int] | None, after: list[int] | None):
    """Nodes of a run of sorted distinct rows (numbers, sizes, members, smallest member,
    digest of the members). ``before`` and ``after`` are the rows next to the run."""
    tree = TernaryTree()
    paths: dict[int, list[int]] = {}
    ends: dict[int, int] = {}
    for at in medians(len(rows)):
        path = tree.insert(*rows[at][:2])
        ends[path[-1]] = at
        if at in (0, len(rows) - 1):
            paths[at] = path
    count = len(tree.number)
    members, least = [0] * count, [1 << 63] * count
    leaves, children, saved = [0] * count, [0] * count, [0] * count
    for node, at in ends.items():
        members[node], least[node] = rows[at][2], rows[at][3]
    first, last = paths[0], paths[len(rows) - 1]
    shared_before, shared_after = shared(before, rows[0][0]), shared(rows[-1][0], after)
    foreign = set(first[: shared_before + 1])
    keys: dict[int, bytes] = {}
    for path, most, row in ((first, shared_before, rows[0]), (last, shared_after, rows[-1])):
        if most >= 0:
            keys.update(zip(path[: most + 1], _digest(row[0][:most])))
    # The last row goes on in the next run: its end is no leaf here.
    open_end = last[-1] if after is not None and shared_after == len(rows[-1][0]) else -1
    for node in range(count - 1, -1, -1):
        own = node not in foreign
        if own and not tree.equal[node] and node != open_end:
            leaves[node] = 1
        saved[node] += (members[node] - own) * tree.size[node]
        above = tree.above[node]
        if above >= 0:
            members[above] += members[node]
            least[above] = min(least[above], least[node])
            leaves[above] += leaves[node]
            saved[above] += saved[node]
            children[above] += own
    for node in range(count):
        above = tree.above[node]
        at = ends.get(node)
        yield (
            run,
            keys.get(node),
            keys.get(above),
            tree.depth[node],
            least[node],
            least[above] if above >= 0 and above not in keys else None,
            members[node],
            children[node],
            leaves[node],
            saved[node],
            rows[at][4] if at is not None else None,
        )


_BEFORE, _ROW, _AFTER = 0, 1, 2
_RUN_NUMBERS = 1 << 32


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, shard by shard: the last row before the shard, its own rows, the
    first one after it."""

    def emit(nodes: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for node in nodes:
            out.append(node)
            if len(out) == 8192:
                yield _node_batch(out)
                out = []
        if out:
            yield _node_batch(out)

    shard, number, before, held, turns = None, 0, None, [], 0

    def close(after: list[int] | None) -> Iterator[pa.RecordBatch]:
        nonlocal number, before, held, turns
        if held:
            yield from emit(run_nodes(shard * _RUN_NUMBERS + number, held, before, after))
            number, before, held, turns = number + 1, held[-1][0], [], 0

    for batch in batches:
        for row in zip(*(column.to_pylist() for column in batch.columns)):
            if row[0] != shard:
                yield from close(None)
                shard, number, before = row[0], 0, None
            kind, numbers = row[1], row[2]
            if kind == _BEFORE:
                before = numbers
            elif kind == _AFTER:
                yield from close(numbers)
            else:
                if held and turns + len(numbers) > RUN_TURNS:
                    yield from close(numbers)
                held.append(row[2:])
                turns += len(numbers) + 1
    yield from close(None)


def _node_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _NODE_TYPES.types)]
    return pa.RecordBatch.from_arrays(columns, schema=_NODE_TYPES)


# ----------------------------------------------------------------------- sequences


def encoded(
    turns: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``numbers`` and ``sizes`` (bytes of the texts) of all conversations.

    Turns are ordered by ``turn``, null first; of equal ones by role, then text. A null
    role or text is an empty one, rows without ``conv_id`` take no part, repeated rows
    are turns of their own. Turns are told apart by SHA-256 digests. A conversation is
    one row, so its turns (16 bytes each, whatever their texts) meet in one task.
    """
    rows = turns.select(
        F.col(f"`{conv_id}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
    ).filter("conv_id IS NOT NULL")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    placed = stored(
        rows.select(
            "conv_id",
            F.row_number().over(order).alias("place"),
            F.unhex(F.sha2(whole, 256)).alias("key"),
            F.octet_length("text").cast("long").alias("size"),
        ),
        "turns",
    )
    # The number is a row's place in this table, which is written once.
    numbers = placed.select("key").distinct().withColumn("number", F.monotonically_increasing_id())
    found = placed.join(stored(numbers, "turn-numbers"), "key")
    inner = F.sort_array(F.collect_list(F.struct("place", "number", "size")))
    return (
        found.groupBy("conv_id")
        .agg(inner.alias("turns"))
        .select(
            "conv_id",
            F.col("turns.number").alias("numbers"),
            F.col("turns.size").alias("sizes"),
        )
    )


def _joined_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of sorted (key, conv_id, numbers, sizes) one row for up to ``IDS_TOGETHER`` ids
    of a key: their decimals, joined."""
    key, row, ids, latest = None, None, [], None

    def out():
        if not ids:
            return
        columns = [[key], [ids[0]], [len(ids)], [",".join(map(str, ids))], [row[0]], [row[1]]]
        arrays = [pa.array(c, t) for c, t in zip(columns, _PART.types)]
        yield pa.RecordBatch.from_arrays(arrays, schema=_PART)

    for batch in batches:
        for own_key, conv_id, *rest in zip(*(c.to_pylist() for c in batch.columns)):
            if (own_key, conv_id) == latest:
                continue
            if own_key != key or len(ids) == IDS_TOGETHER:
                yield from out()
                key, row, ids = own_key, rest, []
            ids.append(conv_id)
            latest = own_key, conv_id
    yield from out()


_PART = pa.schema(
    [("key", pa.binary()), ("conv_id", pa.int64()), ("n", pa.int64()), ("ids", pa.string()),
     ("numbers", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)
_WHOLE = pa.schema(
    [("key", pa.binary()), ("n", pa.int64()), ("least", pa.int64()), ("sha", pa.string()),
     ("numbers", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
)
_MEMBERS = "key binary, n long, least long, sha string, numbers array<long>, sizes array<long>"


def _hashed_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Out of a key's parts in order of ids its count, smallest id and SHA-256."""
    key, state, row = None, None, None
    out: list[list] = []

    def close():
        if key is not None:
            out.append([key, row[0], row[1], state.hexdigest(), row[2], row[3]])

    def batch_of(rows):
        arrays = [pa.array(c, t) for c, t in zip(zip(*rows), _WHOLE.types)]
        return pa.RecordBatch.from_arrays(arrays, schema=_WHOLE)

    for batch in batches:
        for own, conv_id, n, ids, numbers, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            if own != key:
                close()
                key, state, row = own, hashlib.sha256(ids.encode()), [n, conv_id, numbers, sizes]
            else:
                state.update(b"," + ids.encode())
                row[0] += n
        if len(out) > 4096:
            yield batch_of(out)
            out.clear()
    close()
    if out:
        yield batch_of(out)


def members(sequences: DataFrame) -> DataFrame:
    """Distinct rows of ``sequences`` with ``n`` conversations, the ``least`` id and the
    SHA-256 of all ids in order, joined by commas.

    Ranges over (row, id) share out a row that very many conversations have; what then
    comes together is a string for some thousands of ids, hashed as it arrives.
    """
    key = F.unhex(F.sha2(F.to_binary(F.array_join("numbers", ","), F.lit("utf-8")), 256))
    rows = sequences.select(key.alias("key"), "conv_id", "numbers", "sizes")
    tasks = int(sequences.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = (
        stored(rows, "sequences")
        .repartitionByRange(tasks, "key", "conv_id")
        .sortWithinPartitions("key", "conv_id")
        .mapInArrow(
            _joined_ids,
            "key binary, conv_id long, n long, ids string, numbers array<long>, sizes array<long>",
        )
    )
    return parts.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_hashed_ids, _MEMBERS)


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """Nodes of the trie of ``sequences`` (``conv_id``, ``numbers``, ``sizes``).

    Columns ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's
    smallest member; null for the root), ``n_convs``, ``n_children``, ``n_leaves``,
    ``saved_tokens`` and ``ends_sha256``. A conversation without turns ends at the root.
    Equal rows of one id count once; an id with different rows is a member of each. No
    sequences give no nodes, not even a root.

    A task holds a run of about ``RUN_TURNS`` turns, or one longer conversation.
    """
    spark = sequences.sparkSession
    distinct = stored(members(sequences), "members")
    total = distinct.agg(F.sum(F.size("numbers") + 1)).first()[0]
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), (total or 0) // max(RUN_TURNS, 1))
    ranged = distinct.repartitionByRange(shards, "numbers")
    ranged = stored(
        ranged.select(F.spark_partition_id().alias("shard"), "numbers", "sizes", "n", "least", "sha"),
        "trie-shards",
    )
    # One row a shard: its neighbours' nearest rows.
    ends = ranged.groupBy("shard").agg(F.min("numbers").alias("low"), F.max("numbers").alias("high"))
    in_order = Window.orderBy("shard")
    borders = ends.select(
        "shard",
        F.lag("high").over(in_order).alias("before"),
        F.lead("low").over(in_order).alias("after"),
    )
    empty = [
        F.lit(None).cast(t).alias(n)
        for n, t in (("sizes", "array<long>"), ("n", "long"), ("least", "long"), ("sha", "string"))
    ]
    laid = ranged.select("shard", F.lit(_ROW).alias("kind"), "numbers", "sizes", "n", "least", "sha")
    for kind, name in ((_BEFORE, "before"), (_AFTER, "after")):
        laid = laid.unionAll(
            borders.filter(F.col(name).isNotNull()).select(
                "shard", F.lit(kind).alias("kind"), F.col(name).alias("numbers"), *empty
            )
        )
    nodes = stored(
        laid.repartition("shard")
        .sortWithinPartitions("shard", "kind", "numbers")
        .mapInArrow(_trees, _NODES),
        "trie-nodes",
    )
    parts = nodes.filter("key IS NOT NULL")
    sums = ("n_convs", "n_children", "n_leaves", "saved_tokens")
    merged = stored(
        parts.groupBy("key").agg(
            F.first("parent_key").alias("parent_key"),
            F.first("depth").alias("depth"),
            F.min("conv_id").alias("conv_id"),
            *(F.sum(c).alias(c) for c in sums),
            F.max("ends_sha256").alias("ends_sha256"),
        ),
        "trie-merged",
    )
    # What a run's nodes need of the boundary nodes above them, run by run.
    known = merged.select("key", F.col("conv_id").alias("least"))
    above = parts.select("run", "key").join(known, "key")
    above = above.select("run", F.col("key").alias("parent_key"), "least")
    columns = ["conv_id", "depth", "parent_conv_id", *sums]
    ends_at = F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256")
    whole = nodes.filter("key IS NULL")
    inner = whole.filter("parent_key IS NULL")
    below = whole.filter("parent_key IS NOT NULL").drop("parent_conv_id")
    below = below.join(above.withColumnRenamed("least", "parent_conv_id"), ["run", "parent_key"])
    border = merged.join(
        known.select(F.col("key").alias("parent_key"), F.col("least").alias("parent_conv_id")),
        "parent_key",
        "left",
    )
    return (
        inner.select(*columns, ends_at)
        .unionAll(below.select(*columns, ends_at))
        .unionAll(border.select(*columns, ends_at))
    )


def conversation_trie(conversations: DataFrame, *names: str) -> DataFrame:
    """The trie of whole conversations; see :func:`encoded` and :func:`prefix_trie`."""
    return prefix_trie(encoded(conversations, *names))


OP12_SQL = """
WITH bits AS (
  SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)
), ids AS (
  SELECT conv_id, conv_id - conv_id % 5 AS base,
    xor(list_reduce(list_prepend(4294967295::BIGINT,
      list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), bits
), numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id
      ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT i.conv_id, 0 AS part, n, role, text FROM ids i JOIN numbered b ON b.conv_id = i.base AND n <= h
  UNION ALL
  SELECT i.conv_id, 1, n, role, text FROM ids i JOIN numbered o ON o.conv_id = i.conv_id AND n > h
), sequences AS (
  SELECT i.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY part, n)
    FILTER (part IS NOT NULL), []) AS turns
  FROM ids i LEFT JOIN rebuilt r ON r.conv_id = i.conv_id GROUP BY i.conv_id
), prefixes AS (
  SELECT conv_id, len(turns) AS length, d, turns[1:d] AS prefix
  FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM sequences)
), nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN d = 0 THEN 0 ELSE octet_length(encode(prefix[d].text)) END AS bytes,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (length = d), ''))
      AS ends_sha256
  FROM prefixes GROUP BY prefix, d
), children AS (
  SELECT prefix[1 : depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT prefix[1:k] AS prefix, count(*) FILTER (leaf) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM (SELECT n.*, c.n IS NULL AS leaf, unnest(range(0, depth + 1)) AS k
        FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix) GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children,
  b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1 : n.depth - 1]
"""


def rebuilt(sequences: DataFrame) -> DataFrame:
    """Every conversation behind the first turns of the first one of its five."""
    base = sequences.select(
        F.col("conv_id").alias("base"),
        F.slice("numbers", 1, 8).alias("base_numbers"),
        F.slice("sizes", 1, 8).alias("base_sizes"),
    )
    taken = (F.crc32(F.col("conv_id").cast("string")) % 9).cast("int")
    rows = sequences.select("*", (F.col("conv_id") - F.col("conv_id") % 5).alias("base"), taken.alias("h"))
    rows = rows.join(base, "base", "left")

    def joined(name: str) -> Column:
        none = F.array().cast("array<long>")
        own = F.slice(name, F.col("h") + 1, F.size(name))
        head = F.slice(f"base_{name}", F.lit(1), F.col("h"))
        return F.concat(F.coalesce(head, none), own).alias(name)

    return rows.select("conv_id", joined("numbers"), joined("sizes"))


@query("op12_prefix_trie", OP12_SQL)
def op12_prefix_trie(spark, sf_dir):
    return prefix_trie(rebuilt(encoded(read_table(spark, sf_dir, "conversations"))))
