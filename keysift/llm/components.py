"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keysift.llm.common import attach
from keysift.session import delete_paths, stage


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _towards_least(edges: DataFrame, larger: bool, paths: list[str]) -> DataFrame:
    """Link the neighbours of each node to the least of them and itself.

    ``larger``: only neighbours above the node move (large star); else those below it, and the
    node itself (small star).  The least neighbour is a partial aggregate, and a node with many neighbours is served
    by a broadcast (see ``attach``): nothing of a hot node meets in one task.
    """
    links = _both(edges) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = stage(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("n")), "least", paths)
    joined = attach(links, least, "a", "n", ["m"], F.xxhash64("b", "a"))
    if larger:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of an edge; root is the least node of its component.

    ``edges`` has columns a and b, longs.  Large and small stars in turn, each
    round a written table, until nothing changes; what a round has written goes when the next one is.
    """
    spark = edges.sparkSession
    old: list[str] = []
    edges = stage(edges.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "edges", old)
    before = None
    while True:
        now: list[str] = []
        large = _towards_least(edges, larger=True, paths=now)
        large = stage(large, "stars", now)
        written: list[str] = []
        edges = stage(_towards_least(large, larger=False, paths=now), "edges", written)
        delete_paths(spark, [*old, *now])
        old = written
        after = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if after == before:
            break
        before = after
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
