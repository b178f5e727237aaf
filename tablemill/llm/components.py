"""Connected components of a graph given as edges, without collecting links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablemill.session import materialize


def _star(links: DataFrame, both_ways: bool) -> DataFrame:
    """One contraction step on links (u > v): every neighbour is hung on the smallest one."""
    ends = links.union(links.select("v", "u").toDF("u", "v")) if both_ways else links
    least = ends.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    joined = ends.join(least, "u")
    if both_ways:  # larger neighbours go to the smallest node in reach
        moved = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:  # smaller neighbours, and the node itself, go to the smallest of them
        moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return moved.distinct()


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) for every node of an edge; component is the smallest node reachable.

    Alternating large-star and small-star steps: rows stay of the order of the edges, long
    chains end after logarithmically many rounds, and a hub costs one row per neighbour.
    Each round is a written table in the shared folder, so lost executors cost one round at
    most. Edges with a null end and loops are ignored; without edges the result is empty.
    """
    links = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v"))
    links = materialize(links.where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col("u") > F.col("v"))).distinct(), "links")
    mark = None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if tuple(now) == mark or not now[0]:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component")).union(links.select("v", "v").distinct())
        mark = tuple(now)
        links = materialize(_star(_star(links, True), False), "links")
