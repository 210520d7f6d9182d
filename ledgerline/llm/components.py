"""Connected components of a graph whose edges are rows, by alternating large-star and small-star steps.

A step moves every node's links to the smallest node that it sees; after O(log^2 n) steps, in practice a handful, each
component is a star around its smallest node. Minima are aggregated before the shuffle, so a hub costs one row per
task there, and the joins that follow put a hub's many edges against one row, which adaptive execution can split. Each
round is written to the shared folder; nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, materialise


def _star(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Links u's neighbours v (all are smaller, or with ``larger_only`` the larger ones) to u's smallest neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = edges.join(least, "u")
    if larger_only:
        return linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``edges`` has u and v, longs without nulls. Returns node, root for every node that isn't the smallest of its
    component; no rows for an empty graph."""
    spark = edges.sparkSession
    oriented = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, path = materialise(oriented, "edges")
    seen = _summary(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large, large_path = materialise(_star(both, larger_only=True), "large-star")
        new, new_path = materialise(_star(large, larger_only=False), "small-star")
        after = _summary(new)
        for old in (path, large_path):
            drop_table(spark, old)
        now, path = new, new_path
        if after == seen:
            break
        seen = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
