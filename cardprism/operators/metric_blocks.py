"""Blocks of points that lie together, with bounds on their distances.

Up to ``PIVOTS`` points are chosen far from each other.  Points are ordered by
their nearest pivot and the distance to it, and each pivot's points cut into
blocks of equal size, so a block is an annulus around a pivot or a part of one.  A block keeps the least and the largest distance of its members to
*every* pivot.  By the triangle inequality two blocks are at least as far apart
as these ranges are, and at most as far as the ranges' ends add up to.  All
bounds hold whatever the pivots; they are taken from a sample of about
``SAMPLE`` points, which decides about speed only.

A pass forms the block pairs that its bounds can't rule out.  The table of
blocks is bounded (about ``MAX_BLOCKS`` rows of ``2 * PIVOTS`` numbers, 17 MB): larger
inputs get larger blocks."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.operators.blocks import block_count, row_numbers, vectors
from cardprism.session import cut_lineage

PIVOTS, SAMPLE, MAX_BLOCKS = 32, 2048, 1 << 15


def far_points(X: np.ndarray, n: int) -> np.ndarray:
    """Up to n points, each the farthest from those before it."""
    chosen, away = [0], np.full(len(X), np.inf)
    while len(chosen) < min(n, len(X)):
        away = np.minimum(away, ((X - X[chosen[-1]]) ** 2).sum(1))
        if away.max() == 0:
            break
        chosen.append(int(away.argmax()))
    return X[chosen]


def pivot_distances(X: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((X - p) ** 2).sum(1) for p in pivots], axis=1))


@dataclass
class Ranges:
    """Least and largest distances of each block's members to each pivot."""
    lo: np.ndarray
    hi: np.ndarray

    def lower(self, i: int) -> np.ndarray:
        """Least possible distances from block i to all blocks, a little less
        than computed so that rounding can't rule out a pair."""
        gap = np.maximum(self.lo[i] - self.hi, self.lo - self.hi[i]).max(axis=1)
        return np.maximum(gap - 1e-9 * self.hi.max(initial=0), 0.0)

    def upper(self, i: int) -> np.ndarray:
        """Largest possible distances from block i to all blocks."""
        return (self.hi[i] + self.hi).min(axis=1) * (1 + 1e-9)


@dataclass
class MetricBlocks:
    points: DataFrame   # id, v, block
    ranges: Ranges
    rows: int           # points in a block (each pivot's last one may have fewer)

    def __len__(self) -> int:
        return len(self.ranges.lo)

    def each(self, fn, schema: str) -> DataFrame:
        """``fn(block)`` (a frame) for all blocks."""
        def run(batches):
            for pdf in batches:
                for i in pdf["id"]:
                    yield fn(int(i))
        spark = self.points.sparkSession
        return spark.range(0, len(self), 1, max(1, min(len(self), spark.sparkContext.defaultParallelism))).mapInPandas(run, schema)

    def pairs(self, wanted) -> DataFrame:
        """Block pairs bi <= bj with their lower bound; ``wanted(i, lower)``
        says to which blocks i has to be compared (in one direction at least)."""
        ranges = self.ranges

        def form(i):
            lower = ranges.lower(i)
            j = np.flatnonzero(wanted(i, lower))
            j = j[j >= i]
            return pd.DataFrame({"bi": i, "bj": j, "lower": lower[j]})
        return self.each(form, "bi long, bj long, lower double")

    @staticmethod
    def meet(points: DataFrame, pairs: DataFrame) -> DataFrame:
        """``points`` (with ``block``) once for each pair of their block; group
        by (bi, bj), see ``blocks.sides``."""
        left = pairs.select(F.col("bi").alias("block"), "bi", "bj", "lower", F.lit(False).alias("side"))
        right = pairs.where("bi < bj").select(F.col("bj").alias("block"), "bi", "bj", "lower", F.lit(True).alias("side"))
        return points.join(left.unionByName(right), "block").drop("block")


def metric_blocks(points: DataFrame, block_rows: int | None = None, pivots: int = PIVOTS) -> MetricBlocks:
    """Blocks of ``points`` (id, v: finite vectors of one length)."""
    points = points.select("id", "v")
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    if not n:
        return MetricBlocks(points.withColumn("block", F.lit(0).cast("long")), Ranges(np.zeros((0, 1)), np.zeros((0, 1))), 1)
    blocks = min(MAX_BLOCKS, block_count(n, d or 1, points.sparkSession.sparkContext.defaultParallelism, block_rows))
    rows = math.ceil(n / blocks)
    sample = points.where(F.pmod(F.xxhash64("id"), F.lit(-(-n // SAMPLE))) == 0).toPandas()
    sample = points.limit(1).toPandas() if sample.empty else sample.sort_values("id")
    at = far_points(vectors(sample), min(pivots, max(1, blocks)))

    def place(batches):
        for pdf in batches:
            away = pivot_distances(vectors(pdf), at)
            yield pdf.assign(cell=away.argmin(1), r=away.min(1))

    placed = row_numbers(points.mapInPandas(place, "id long, v array<double>, cell int, r double"), ["cell", "r", "id"], "nr")
    cells = placed.groupBy("cell").agg(F.min("nr"), F.count(F.lit(1))).orderBy("cell").collect()   # at most PIVOTS rows
    first, begins = 0, {}
    for cell, nr, size in cells:   # a block lies in one cell
        begins[cell], first = first * rows - nr, first + math.ceil(size / rows)
    begin = F.create_map(*[F.lit(x) for kv in begins.items() for x in kv])[F.col("cell")]
    placed = cut_lineage(placed.select("id", "v", F.floor((F.col("nr") + begin) / rows).alias("block")))

    def ranges(batches):
        for pdf in batches:
            away = pivot_distances(vectors(pdf), at)
            block = pdf["block"].to_numpy()
            for b in np.unique(block):
                own = away[block == b]
                yield pd.DataFrame({"block": b, "pivot": np.arange(len(at)), "lo": own.min(0), "hi": own.max(0)})

    table = placed.mapInPandas(ranges, "block long, pivot int, lo double, hi double").groupBy("block", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    table = table.toPandas().sort_values(["block", "pivot"])   # about MAX_BLOCKS * PIVOTS rows at most
    shape = (-1, len(at))
    return MetricBlocks(placed, Ranges(table["lo"].to_numpy().reshape(shape), table["hi"].to_numpy().reshape(shape)), rows)
