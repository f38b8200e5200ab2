"""Shared machinery for iterative models evaluated in batched passes.

One pass = one ``mapInPandas`` over the (id, v) matrix in which every active
candidate model computes the sufficient statistics of a partition, and one
JVM aggregation (``Summarizer.sum`` over vectors, partial-aggregated) that
adds them per (candidate, component).  The state of a group is one vector,
whatever the number of partitions, and only model-sized results reach the
driver.

A candidate whose numbers break down in a task (singular covariance,
overflow) reports so with a marker row instead of failing the pass; the
others are not touched by it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FAILED = -1   # component number of the marker row of a failed candidate


def matrix(pdf: pd.DataFrame, col: str = "v") -> np.ndarray:
    return np.stack(pdf[col].to_numpy()).astype(np.float64) if len(pdf) else np.zeros((0, 0))


def packed(points: DataFrame) -> DataFrame:
    """The vectors of ``points`` for many passes: a row (n, x) for each batch of
    them, x the bytes of its n vectors, cached.  A pass over arrays spends most of
    its time on turning them into a matrix.  The caller unpersists it."""
    def pack(it):
        for pdf in it:
            if len(pdf):
                yield pd.DataFrame({"n": [len(pdf)], "x": [np.ascontiguousarray(matrix(pdf)).tobytes()]})
    return points.select("v").mapInPandas(pack, "n int, x binary").persist(StorageLevel.MEMORY_AND_DISK)


def _batches(it, is_packed: bool):
    for pdf in it:
        if is_packed:
            for n, x in zip(pdf["n"], pdf["x"]):
                yield np.frombuffer(x).reshape(n, len(x) // (8 * n))
        elif len(pdf):
            yield matrix(pdf)


def run_pass(points: DataFrame, partition_fn) -> dict:
    """Apply ``partition_fn(iterator of X batches) -> {(cand, comp): vector}``
    to every partition of ``points`` (id, v, or from ``packed``), add the vectors
    per (cand, comp), and return the sums as numpy arrays.  Vectors of one (cand,
    comp) have one length; a candidate with a vector that is not finite is
    reported as failed."""
    columns = ["n", "x"] if "x" in points.columns else ["v"]

    def mapper(it):
        acc = partition_fn(_batches(it, len(columns) == 2))
        broken = {c for (c, _), v in acc.items() if not np.isfinite(v).all()}
        acc = {k: v for k, v in acc.items() if k[0] not in broken} | {(c, FAILED): [1.0] for c in broken}
        if acc:
            yield pd.DataFrame([(c, k, np.asarray(v, float).ravel()) for (c, k), v in acc.items()], columns=["cand", "comp", "s"])

    parts = points.select(columns).mapInPandas(mapper, "cand int, comp int, s array<double>")
    total = parts.groupBy("cand", "comp").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    return {(r["cand"], r["comp"]): np.array(r["s"]) for r in total.collect()}


def failed_candidates(stats: dict) -> set:
    return {c for c, k in stats if k == FAILED}


def column_variances(points: DataFrame) -> np.ndarray:
    """Population variance of each dimension over all rows."""
    if points.isEmpty():
        return np.zeros(0)
    row = points.agg(Summarizer.metrics("variance", "count").summary(array_to_vector("v")).alias("s")).select(
        vector_to_array("s.variance").alias("var"), F.col("s.count").alias("n")).first()
    return np.array(row["var"]) * (row["n"] - 1) / row["n"]
