"""Connected components of a link table, by alternating star contractions.

Every step is a grouping and a join over links; nothing but a checksum reaches the
driver. A node with very many links is combined before the shuffle (the minimum) and
split by adaptive execution (the join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest node of its neighbourhood."""
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. In links (a, b), a < b."""
    least = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(least, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.unionAll(least.select(F.col("m").alias("a"), "b")).distinct()


def components(links: DataFrame, rounds: int = 50) -> DataFrame:
    """(id, component) of every node of links (a, b); the component is its smallest node.

    Links may repeat and point either way; links with a null end or of a node to itself
    are ignored. An empty table has no components.
    """
    now = written(links.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    mark = None
    for _ in range(rounds):
        now = written(_small_star(_large_star(now)), "links")
        seen = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("id"), F.col("a").alias("component")).unionAll(now.select(F.col("a").alias("id"), F.col("a").alias("component")).distinct())
