"""Connected components of a link table, by alternating large-star and small-star steps in Spark.

Links stay distributed; the driver sees only counts. Each step replaces links by links to smaller neighbours
and is written to the shared folder. So are the smallest neighbours before their join, whose sides are then plain
shuffles: Spark can split the part of a node that has very many links. It ends when only stars are left: each node
points at the smallest id that it can reach.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: each node's larger neighbours move to its smallest neighbour (or itself); small: the smaller ones and itself."""
    both = links.select("u", "v")
    if large:
        both = both.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("m", "u").alias("m")), "links-low")
    moved = both.join(low, F.col("u") == F.col("w"))
    if large:
        moved = moved.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("w").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node either is a centre or has one link, to a centre."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("in"))
    ends = ends.union(links.select("v", F.lit(0), F.lit(1))).groupBy("node").agg(F.sum("out").alias("out"), F.max("in").alias("in"))
    return ends.filter("out + in > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links (u, v) -> (node, component) for every node that has a link to another."""
    now = links.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(now, "links")
    while not _stars(now):
        now = written(_star(_star(now, True), False), "links")
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
