"""Helpers for points stored as ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_points(df: DataFrame, id_col: str, cluster_col: str | None, vec_col: str) -> DataFrame:
    """Normalise to (id, cluster, v array<double>)."""
    cols = [F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("v")]
    if cluster_col:
        cols.insert(1, F.col(cluster_col).cast("int").alias("cluster"))
    return df.select(*cols)


def assemble(df: DataFrame, columns, out: str = "v") -> DataFrame:
    """Feature columns -> one array<double> column (keeps the other columns)."""
    return df.withColumn(out, F.array(*[F.col(c).cast("double") for c in columns]))


def sq_dist(a: Column, b: Column) -> Column:
    """Squared Euclidean distance of two equal-length arrays (JVM-side)."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, z: acc + z)


def dist(a: Column, b: Column) -> Column:
    return F.sqrt(sq_dist(a, b))


def lit_vector(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def centroids(points: DataFrame, key: str = "cluster") -> DataFrame:
    """Mean vector per cluster: element-wise sums via posexplode, one
    aggregation keyed by (cluster, dim) - partial aggregation keeps a hot
    cluster spread over many tasks."""
    e = points.select(key, F.posexplode("v").alias("i", "x"))
    per_dim = e.groupBy(key, "i").agg(F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"))
    return (per_dim.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("i", (F.col("s") / F.col("n")).alias("m")))).alias("_a"),
        F.max("n").alias("size"))
        .select(key, F.col("_a.m").alias("c"), "size"))
