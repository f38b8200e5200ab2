"""Consecutive row numbers over a distributed sort."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch


def number_rows(df: DataFrame, order: list, scratch: Scratch, name: str, out: str = "rank") -> DataFrame:
    """``df`` with its rows numbered from 1 in the given order.  The sort deals
    rows into ranges; a row's number is its place in its range plus the sizes
    of the ranges before it.  ``df`` is read twice (the sort samples it), so
    give a written table.  Only one row per range is seen by a single task."""
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = scratch.put(placed, name)
    part, place = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)   # a row per range
    start = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = placed.withColumn("__part", part).join(F.broadcast(start), "__part")
    return numbered.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__start") + place + 1).cast("long").alias(out))
