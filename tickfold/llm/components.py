"""Connected components of a table of links, by alternating star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickfold.llm.common import stored


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node are tied to its smallest neighbour."""
    both = _both_ways(edges)
    least = stored(
        both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star"
    )
    return (
        both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = stored(edges.groupBy("u").agg(F.min("v").alias("m")), "star")
    around = edges.join(least, "u").where("v > m").select(
        F.col("v").alias("u"), F.col("m").alias("v")
    )
    return around.union(least.select("u", F.col("m").alias("v")))


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return row.n, row.h


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all nodes with a link.

    ``edges`` has the numbers ``u`` and ``v``; direction, repeats and loops do not
    matter. Rounds of a large and a small star step run until nothing changes,
    logarithmically many. Each round starts from a written table, and both sides of
    its joins are shuffled anew, so a node with very many links is split by AQE.
    """
    edges = stored(
        edges.where("u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct(),
        "edges",
    )
    before = _digest(edges)
    while before[0]:
        edges = stored(_small_star(stored(_large_star(edges).distinct(), "edges")).distinct(), "edges")
        now = _digest(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
