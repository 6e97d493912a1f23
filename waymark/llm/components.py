"""Connected components by alternating large-star and small-star, as DataFrame joins and partial aggregates.

Edges stay a distributed table; every round is written to the shared folder, so lost executors cost one
round at most. A hub is never gathered: its minimum is a partial aggregate, and the minima of hubs with many
spokes, which can only be few, are broadcast to them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import drop, materialize, spread_join


def _least(arcs: DataFrame) -> DataFrame:
    return arcs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))


def large_star(edges: DataFrame, n: int) -> DataFrame:
    """Each neighbour above u goes to the least of u and its neighbours; n: how many edges there are."""
    arcs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(arcs).select("u", F.least("u", "m").alias("m"), "size")
    return spread_join(arcs.where("v > u"), least, "u", 2 * n, "inner").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, n: int) -> DataFrame:
    """u and each neighbour below it go to the least of them. Expects u > v."""
    joined = spread_join(edges, _least(edges), "u", n, "inner")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(joined.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex that has an edge; component is the least id reachable.

    edges: columns u and v, long; loops, repeated and reversed rows are allowed.
    """
    spark = edges.sparkSession
    now, path = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark, n = None, now.count()
    while True:
        stars, stars_path = materialize(large_star(now, n), "large")
        new, new_path = materialize(small_star(stars, stars.count()), "stars")
        drop(spark, stars_path)
        got = new.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        drop(spark, path)
        now, path = new, new_path
        if (got["n"], got["s"]) == mark:
            break
        mark, n = (got["n"], got["s"]), got["n"]
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
