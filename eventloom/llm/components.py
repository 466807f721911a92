"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.text import stored


def _large_star(links: DataFrame) -> DataFrame:
    """Larger neighbours of every node are linked to the smallest one."""
    both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("least"))
    least = least.select("a", F.least("a", "least").alias("least"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), "least")


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = down.filter("a > b").distinct()
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").filter("b > least").select(F.col("b").alias("a"), "least")
    return moved.unionAll(least).distinct().withColumnRenamed("least", "b")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component``, the smallest node it is linked with, for every node
    of ``links`` (columns ``a`` and ``b``) but the smallest ones themselves.

    Both steps keep the components and pull nodes towards the smallest; when a round
    changes nothing, every node is linked to it alone. Rounds grow with the logarithm
    of the longest path. Minima are taken in each task first, so a node with very many
    links costs one row a task there.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    before = None
    while True:
        mark = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 30))).first()
        if mark == before or not mark[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = mark
        links = stored(_small_star(_large_star(links).withColumnRenamed("least", "b")), "links")
