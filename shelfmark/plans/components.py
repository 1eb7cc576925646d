"""Connected components of an edge table by alternating large-star and small-star rounds.

Every step is a grouped minimum and an equi-join of two stored tables, so a hub with a
third of all edges is summed before the shuffle and split by the skew join; no edge list
reaches the driver. Each round is stored in the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import discard, durable


def components(edges: DataFrame, a: str = "a", b: str = "b", tag: str = "cc") -> DataFrame:
    """One row per node that has an edge to another: node, component (the smallest node reachable).
    Repeated edges, both directions and self-loops are allowed; no edges give no rows."""
    e = durable(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), f"{tag}-edges"
    )
    while not _stars(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = durable(both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w")), f"{tag}-low")
        large = durable(_moved(both.where("v > u"), least).where("u <> v").distinct(), f"{tag}-large")
        discard(e, least)
        low = durable(large.groupBy("u").agg(F.min("v").alias("w")), f"{tag}-low")
        e = durable(_moved(large, low).where("u <> v").union(low.select("u", F.col("w").alias("v"))).distinct(), f"{tag}-small")
        discard(large, low)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _moved(e: DataFrame, least: DataFrame) -> DataFrame:
    """Each edge (u, v) as (v, w), w being the smallest neighbour of u."""
    return e.join(least.withColumnRenamed("u", "u2"), F.col("u") == F.col("u2")).select(F.col("v").alias("u"), F.col("w").alias("v"))


def _stars(e: DataFrame) -> bool:
    """True if every node that points down points once, and to a node that points nowhere."""
    # Per node: how many edges leave it downwards, and whether any arrives from above.
    sides = e.select("u", F.lit(1).alias("down"), F.lit(0).alias("up")).union(e.select(F.col("v").alias("u"), F.lit(0), F.lit(1)))
    per = sides.groupBy("u").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return per.where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()
