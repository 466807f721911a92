"""Mixing sources to target weights by repetition.

Sizes are summed per source, every source gets a target, and the rate target / size
says how often its documents are taken: floor(rate) times, and once more with the
rate's fraction as probability. That draw is a hash of the document and a seed, so a
rerun takes the same copies and no order of rows matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from eventloom.llm.registry import query
from eventloom.llm.text import read_table, stored, words

MOST_REPEATS = 3
SEED = 17


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds inclusive running totals of a table in a total order, without one task
    holding it: totals run within each range, and the sums of the ranges (one row for
    each partition) are carried over."""
    ranges = df.orderBy(*order).select(
        F.struct("*").alias("row"),
        F.spark_partition_id().alias("range"),
        F.monotonically_increasing_id().alias("at"),
        *(value.alias(name) for name, value in sums.items()),
    )
    ranges = stored(ranges, "ranges")
    before = ranges.groupBy("range").agg(*(F.sum(name).alias(f"{name}_all") for name in sums))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select(
        "range",
        *(F.coalesce(F.sum(f"{name}_all").over(earlier), F.lit(0)).alias(f"{name}_before")
          for name in sums),
    )
    within = Window.partitionBy("range").orderBy("at")
    return ranges.join(before, "range").select(
        "row.*",
        *((F.sum(name).over(within) + F.col(f"{name}_before")).alias(name) for name in sums),
    )


def source_targets(sizes: DataFrame, most: int = MOST_REPEATS, weights: int = 3) -> DataFrame:
    """``sizes`` has one row per ``source`` with ``source_size``; adds ``target``.

    Sources by code point, null last, weigh 1, 2, ... ``weights``, repeating. Targets
    share the sum of all sizes by weight, none above ``most`` times its source's size.
    Giving the excess of full sources to the others until none is above ends where
    all others stand at one level per weight. In order of the level at which a source
    is full, the full ones come first: the level after k of them is what they leave
    over the weight they leave, and it holds if the next source is not full there.
    """
    ranked = running_totals(sizes, [F.col("source").asc_nulls_last()], {"place": F.lit(1)})
    ranked = ranked.select(
        "source",
        F.col("source_size"),
        ((F.col("place") - 1) % weights + 1).cast("long").alias("weight"),
        (F.col("source_size") * most).alias("room"),
    )
    levels = running_totals(
        ranked,
        [(F.col("room") / F.col("weight")).asc(), F.col("source").asc_nulls_last()],
        {"room_to": F.col("room"), "weight_to": F.col("weight")},
    )
    levels = stored(levels, "levels")
    whole, heavy = levels.agg(F.sum("source_size"), F.sum("weight")).first()
    # What is left for this source and all later ones.
    left = F.lit(whole) - (F.col("room_to") - F.col("room"))
    weight_left = F.lit(heavy) - (F.col("weight_to") - F.col("weight"))
    open_ = F.col("room") * weight_left >= left * F.col("weight")
    level = (
        levels.filter(open_)
        .agg(F.min_by(F.struct(left.alias("left"), weight_left.alias("weight")), "weight_to"))
        .first()[0]
    )
    target = F.col("room").cast("double")
    if level is not None:
        share = (F.col("weight") * level["left"]).cast("double") / F.lit(float(level["weight"]))
        target = F.when(open_, share).otherwise(target)
    return levels.select("source", "source_size", target.alias("target"))


def draw(key: Column, seed: int) -> Column:
    """A number from 0 up to 1, of the key and the seed alone."""
    digest = F.md5(F.concat(F.lit(f"{seed}|"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def plan_copies(
    docs: DataFrame,
    text: str = "text",
    source: str = "source",
    doc_id: str = "doc_id",
    most: int = MOST_REPEATS,
    seed: int = SEED,
) -> DataFrame:
    """Columns ``row`` (all of the input), ``size``, ``source_size``, ``target`` and
    ``copies``.

    Null texts have size 0, null sources are a source of their own. Rows with equal
    ids are drawn alike; rows without one are drawn by their text. A source of no
    words gets target 0 and no copies. Sources meet once, after being summed in each
    task; a source with a third of all rows costs one row a task there, and the
    targets come back by a join that Spark broadcasts or splits by size.
    """
    sized = docs.select(
        F.struct("*").alias("row"),
        F.size(words(F.col(f"`{text}`"))).cast("long").alias("size"),
        F.col(f"`{source}`").alias("source"),
        F.coalesce(
            F.col(f"`{doc_id}`").cast("string"),
            F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))),
        ).alias("key"),
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = stored(source_targets(stored(sizes, "sources"), most), "targets")
    targets = targets.withColumnRenamed("source", "of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    extra = draw(F.col("key"), seed) < F.col("rate") - F.floor("rate")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .select(
            "row",
            "size",
            "source_size",
            "target",
            (F.floor("rate") + extra.cast("long")).alias("copies"),
        )
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` as often as :func:`plan_copies` says, all their columns."""
    taken = plan_copies(docs, **options).filter(F.col("copies") > 0)
    repeated = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select("row.*")


OP6_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, (row_number() OVER (ORDER BY source COLLATE C NULLS LAST) - 1) % 3 + 1 AS weight,
    3 * source_size AS room FROM sources
), levels AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(room) OVER (o ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER () - coalesce(sum(weight) OVER (o ROWS BETWEEN
      UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_rest,
    row_number() OVER o AS n
  FROM ranked
  WINDOW o AS (ORDER BY room / weight, source COLLATE C NULLS LAST)
), level AS (
  SELECT rest, weight_rest, n FROM levels WHERE room * weight_rest >= rest * weight
  ORDER BY n LIMIT 1
), targets AS (
  SELECT l.source, l.source_size, CASE WHEN l.n < v.n THEN CAST(room AS DOUBLE)
    ELSE CAST(l.weight * v.rest AS DOUBLE) / CAST(v.weight_rest AS DOUBLE) END AS target
  FROM levels l, level v
), rated AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5('17|' || coalesce(doc_id::VARCHAR, md5(t))), 1, 13))::BIGINT
      / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query("op6_source_mixing", OP6_SQL)
def op6_source_mixing(spark, sf_dir):
    return plan_copies(read_table(spark, sf_dir, "documents")).select(
        "row.doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
