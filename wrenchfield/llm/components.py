"""Connected components by alternating large and small stars: no vertex's neighbours ever meet in one task's memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of every node of edges (u, v: long)."""
    now = shared.save(_small(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v").distinct()), "cc")
    state = None
    while True:
        then = shared.save(_small(_large(now)), "cc")
        new = tuple(then.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        settled = new == state and then.join(now, ["u", "v"], "left_anti").isEmpty()  # as many edges, and none of them new
        shared.drop(now)
        now, state = then, new
        if settled:
            break
    star = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())
