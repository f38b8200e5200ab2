"""All-pairs passes in blocks: every two blocks of points meet in one task,
once, and the task reduces the distances at once, so pairs never become rows.

Points are hashed into B blocks; a point is sent B times (not 2 B: the pair
of blocks (i, j) is formed for i <= j only, and a task works in both
directions).  B follows from ``BLOCK_BYTES`` of vectors in a block, and is at
least such that every core gets some pairs.  The work is O(n^2) distances, as
the exact operators ask for; what moves is n^2 d / block rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.session import cut_lineage

BLOCK_BYTES = 4 << 20
TILE = 2_000_000   # distances in memory at once
CACHED = (128, 512)   # rows and columns of a tile of half a MB


def block_count(n: int, d: int, cores: int, block_rows: int | None = None) -> int:
    by_memory = math.ceil(n / (block_rows or max(256, BLOCK_BYTES // (8 * max(1, d)))))
    by_cores = math.ceil(math.sqrt(4 * cores)) if n > 64 * cores else 1
    return max(1, by_memory, by_cores)


def block_pairs(points: DataFrame, block_rows: int | None = None, order: list[str] | None = None) -> DataFrame:
    """``points`` (id, v, ...) with columns bi <= bj and side, one row for each
    pair of blocks that the point takes part in; group by (bi, bj).  Blocks are
    dealt by a hash, or hold what lies together by the columns ``order``."""
    n, d = points.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    b = block_count(n, d or 1, points.sparkSession.sparkContext.defaultParallelism, block_rows)
    columns, own, other = points.columns, F.pmod(F.xxhash64("id"), F.lit(b)), F.explode(F.sequence(F.lit(0), F.lit(b - 1)))
    if order and b > 1:
        points, own = row_numbers(points, order, "_nr"), F.floor(F.col("_nr") / math.ceil(n / b)).cast("int")
    return points.withColumns({"_b": own}).select("*", other.alias("_o")).select(
        *columns, F.least("_b", "_o").alias("bi"), F.greatest("_b", "_o").alias("bj"), (F.col("_b") > F.col("_o")).alias("side"))


def own_tasks(pairs: DataFrame) -> DataFrame:
    """``pairs`` (from ``block_pairs``) in about as many tasks as there are pairs
    of blocks, 64 a core at most.  Their work grows with the square of their
    rows, so Spark must not join them by their bytes into one task a core."""
    b = pairs.agg(F.max("bj")).first()[0]
    if b is None:
        return pairs
    cores = pairs.sparkSession.sparkContext.defaultParallelism
    return pairs.repartition(min((b + 1) * (b + 2) // 2, 64 * cores), "bi", "bj")


def sides(pdf: pd.DataFrame) -> list[tuple[pd.DataFrame, pd.DataFrame]]:
    """The directions of a group: (from, to) frames; one for a block with
    itself, two for two blocks, none if a side is empty."""
    left, right = pdf[~pdf["side"]], pdf[pdf["side"]]
    if pdf["bi"].iloc[0] == pdf["bj"].iloc[0]:
        return [(left, left)]
    return [] if left.empty or right.empty else [(left, right), (right, left)]


def vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["v"].to_numpy()).astype(np.float64)


def tiles(L: np.ndarray, R: np.ndarray):
    """(row slice, distances of those rows of L to all of R)."""
    rn, step = (R * R).sum(1), max(1, TILE // max(1, len(R)))
    for s in range(0, len(L), step):
        part = L[s:s + step]
        d2 = (part * part).sum(1)[:, None] + rn[None, :] - 2.0 * part @ R.T
        yield slice(s, s + len(part)), np.sqrt(np.maximum(d2, 0.0))


def cached_tiles(L: np.ndarray, R: np.ndarray):
    """(row slice, column slice, distances of those rows of L to those of R), in
    tiles that stay in a core's cache: one matrix product makes the squares."""
    A = np.column_stack([-2.0 * L, (L * L).sum(1), np.ones(len(L))])
    B = np.ascontiguousarray(np.column_stack([R, np.ones(len(R)), (R * R).sum(1)]).T)
    for s in range(0, len(L), CACHED[0]):
        rows = slice(s, min(s + CACHED[0], len(L)))
        for t in range(0, len(R), CACHED[1]):
            cols = slice(t, min(t + CACHED[1], len(R)))
            D = A[rows] @ B[:, cols]
            np.maximum(D, 0.0, out=D)
            yield rows, cols, np.sqrt(D, out=D)


def symmetric_tiles(L: np.ndarray, R: np.ndarray):
    """Like ``tiles``, but a distance is bit-equal in both directions: the
    squared differences are added dimension by dimension."""
    step = max(1, TILE // max(1, len(R)))
    for s in range(0, len(L), step):
        part = L[s:s + step]
        d2 = np.zeros((len(part), len(R)))
        for k in range(L.shape[1]):
            diff = part[:, k, None] - R[None, :, k]
            d2 += diff * diff
        yield slice(s, s + len(part)), np.sqrt(d2)


def near_squares(L: np.ndarray, R: np.ndarray):
    """(row slice, squared distances of those rows of L to all of R, their error
    per row): by one matrix product about R's centre, for picking the pairs
    whose ``pair_distances`` are needed.  Where squares overflow the error is
    infinite, so that every pair is picked."""
    centre = R.mean(0)
    with np.errstate(over="ignore", invalid="ignore"):
        L, R = L - centre, R - centre
        ln, rn = (L * L).sum(1), (R * R).sum(1)
        far = 4.0 * (ln + rn.max())   # no computed square is larger
        err = 2 * (L.shape[1] + 8) * np.finfo(float).eps * far
    usable = np.isfinite(far).all()
    step = max(1, TILE // max(1, len(R)))
    for s in range(0, len(L), step):
        part = slice(s, min(s + step, len(L)))
        if usable:
            G = L[part] @ R.T
            G *= -2.0
            G += ln[part, None]
            G += rn[None, :]
            yield part, G, err[part]
        else:
            yield part, np.zeros((part.stop - s, len(R))), np.full(part.stop - s, np.inf)


def pair_distances(L: np.ndarray, R: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Distances of the pairs (L[r], R[c]), bit-equal to those of ``symmetric_tiles``."""
    out = np.empty(len(r))
    for s in range(0, len(r), TILE):
        rows, cols = r[s:s + TILE], c[s:s + TILE]
        d2 = np.zeros(len(rows))
        for k in range(L.shape[1]):
            diff = L[rows, k] - R[cols, k]
            d2 += diff * diff
        out[s:s + TILE] = np.sqrt(d2)
    return out


def row_numbers(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """``df`` with its rows numbered 0.. by ``order``, without one task for
    all: sorted by range, a row's number is its place in its range plus the
    sizes of the ranges before it (one row per range)."""
    placed = cut_lineage(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    start = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return placed.withColumn("_part", part).join(F.broadcast(start), "_part").select(*df.columns, (F.col("_start") + place).cast("long").alias(out))
