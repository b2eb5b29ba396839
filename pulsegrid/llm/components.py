"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulsegrid.llm.storage import dropped, written


def _pairs(df: DataFrame) -> DataFrame:
    return df.where("a <> b").distinct()


def large_star(edges: DataFrame) -> DataFrame:
    """Links every larger neighbour of a node to the smallest of them all."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    return _pairs(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")))


def small_star(edges: DataFrame) -> DataFrame:
    """Links the smaller neighbours of a node, and itself, to the smallest."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    return _pairs(down.join(least, "a").select("b", "m").unionByName(least.select(F.col("a").alias("b"), "m")).select(F.col("b").alias("a"), F.col("m").alias("b")))


def _loose(edges: DataFrame) -> int:
    """Nodes that keep the edges (larger, smaller) from being stars."""
    roles = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return roles.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up > 0 and down > 0)").count()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its smallest node) of every node on an edge (a, b).

    Neighbour lists are never gathered: a round is two grouped minima and two joins,
    written to the shared folder, until all edges point at the smallest node of their
    component.  The number of rounds grows with the logarithm of the longest chain.
    Self-loops and repeated edges do no harm."""
    now = written(_pairs(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    while _loose(now):
        before, now = now, written(small_star(large_star(now)), "edges")
        dropped(before)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
