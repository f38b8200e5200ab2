"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands the smallest id around it to its larger neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest one
    (``edges``: u > v)."""
    least = edges.groupBy("u").agg(F.min("v").alias("low"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return moved.unionByName(least.select("u", F.col("low").alias("v"))).where("u <> v").distinct()


def _print(edges: DataFrame):
    total = F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    return tuple(edges.agg(F.count("*"), total).first())


def connected_components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """``node, component`` of every node with a link; the component is its
    smallest node.  ``edges``: two integer columns ``u, v``.  Runs until the
    edge set stands still; each round is written to the shared folder."""
    now = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = scratch.put(now, f"{name}0")
    seen, step = _print(now), 0
    while seen[0]:
        now = scratch.put(_small_star(_large_star(now)), f"{name}{step + 1}")
        scratch.drop(f"{name}{step}")
        step, last, seen = step + 1, seen, _print(now)
        if seen == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
