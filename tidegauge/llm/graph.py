"""Connected components of a table of links, by alternating large and small stars.

Each round hangs the neighbours of every node on the least of them; links only ever point to smaller nodes, and
after a number of rounds that grows with the logarithm of the graph every component is a star around its least
node. A round is a grouped minimum, which is combined before the shuffle, and a join that Spark splits at hubs;
it is written in the shared folder before the next reads it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import written


def _hung(edges: DataFrame, least: DataFrame) -> DataFrame:
    """(u, v) and the least neighbour m of u: v linked to m."""
    return edges.join(written(least, "least"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _hung(both.where("v > u"), least).distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _hung(down, least).unionAll(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and component, its least node, of all nodes that have a link (u, v) to another."""
    edges = written(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    mark = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if now == mark or not now[0]:
            break
        mark = now
        edges = written(_small(written(_large(edges), "large")), "links")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
