"""Connected components of a distributed table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, settle


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of the links (a, b) but the smallest ones. The links
    should be a written table: they are counted first.
    Each round is written to the shared folder, in files that follow the number of links; a node with very many links meets one row of its minimum,
    so adaptive execution can split it. Self-links and repeated links don't matter."""
    oriented = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    edges = settle(oriented, "links", links.count())
    sign = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("a", "b"), F.lit(1 << 31)))).first()
        if now == sign or not now[0]:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
        sign = now
        following = settle(_small_star(_large_star(edges)), "links", now[0])
        forget(edges)
        edges = following
