"""Connected components of an edge table by large-star / small-star contraction.

Every round replaces a node's edges by edges to the smallest id it knows; the published
algorithm needs O(log^2 n) rounds and ends with one star per component.  A round is two
partial aggregates (smallest neighbour) and two joins; a node with very many neighbours is pre-aggregated
before the shuffle and its join partition is one that adaptive execution splits.  Each round is
written to the shared folder, so lineage does not grow and lost executors cost one round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from blendwise.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def _is_stars(edges: DataFrame) -> bool:
    """Does every node either point at one smaller node or is pointed at?"""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("points")).unionAll(edges.select(F.col("v").alias("x"), F.lit(0).alias("points")))
    per_node = ends.groupBy("x").agg(F.sum("points").alias("n"), F.count("*").alias("all"))
    return per_node.filter("n > 1 or (n = 1 and `all` > 1)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``edges(u bigint, v bigint)`` -> ``(id, label)`` for every node that is not the smallest of its component."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    while not _is_stars(now):
        now = materialize(_small_star(_large_star(now)), "edges")
    return now.select(F.col("u").alias("id"), F.col("v").alias("label"))
