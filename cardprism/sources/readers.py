"""Loading transaction tables and the data dictionary."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardprism.schema import TRANSACTION_SCHEMA

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]"
FORMATS = {".parquet": "parquet", ".csv": "csv", ".json": "json"}


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    jpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(jpath)


def detect_format(path: str) -> str:
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext not in FORMATS:
        raise ValueError(f"unsupported format {ext!r}: use .parquet, .csv or .json")
    return FORMATS[ext]


def load_transactions(spark: SparkSession, path: str, schema: T.StructType | None = TRANSACTION_SCHEMA,
                      timestamp_col: str = "transaction_timestamp", parse_dates: bool = True) -> DataFrame:
    """Dispatch on the extension, fail on a missing path, and coerce
    the timestamp column when the file stores it as text."""
    fmt = detect_format(path)
    if not _exists(spark, path):
        raise FileNotFoundError(path)
    reader = spark.read
    if fmt in ("csv", "json"):
        reader = reader.option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT)
    if fmt == "csv":
        reader = reader.option("header", True)
        if schema is not None:
            reader = reader.schema(schema)
        else:
            reader = reader.option("inferSchema", True)
        df = reader.csv(path)
    elif fmt == "json":
        df = (reader.schema(schema) if schema is not None else reader).json(path)
    else:
        df = reader.parquet(path)
    if parse_dates and timestamp_col in df.columns:
        dt = df.schema[timestamp_col].dataType
        if not isinstance(dt, (T.TimestampType, T.TimestampNTZType)):
            df = df.withColumn(timestamp_col, F.to_timestamp_ntz(F.col(timestamp_col).cast("string")))
    return df


def load_stats(tx: DataFrame) -> DataFrame:
    """Number of transactions and distinct cards (one partial-aggregated pass)."""
    return tx.agg(F.count(F.lit(1)).alias("n_transactions"), F.count_distinct("card_id").alias("n_cards"))


def read_dictionary(spark: SparkSession, path: str, name_col: str = "name", category_col: str = "category") -> DataFrame:
    """Data dictionary CSV with ``#`` comment lines -> (name, category)."""
    df = spark.read.option("header", True).option("comment", "#").csv(path)
    return df.select(F.trim(F.col(name_col)).alias("name"), F.trim(F.col(category_col)).alias("category"))


def sample_key(id_col, seed: int) -> "F.Column":
    """Deterministic pseudo-random order key of a non-negative integer id
    (Lehmer step modulo 2^31-1; portable, so an SQL twin reproduces it)."""
    m = 2147483647
    return ((F.col(id_col) % m) * 48271 + seed) % m


def seeded_sample(df: DataFrame, n: int, id_col: str, seed: int = 42) -> DataFrame:
    """Fixed-size reproducible sample.  A top-k on a hash key: each task
    keeps only its k best rows, so no full sort and no partition-order
    dependence; the limit is the feature."""
    return df.withColumn("_sk", sample_key(id_col, seed)).orderBy("_sk", id_col).limit(n).drop("_sk")
