"""Shared helpers: scratch tables in the cluster's shared folder, byte-exact
lower-casing and word splitting, table access."""

from __future__ import annotations

import os
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: the white space of the query contracts, ``[\x20\x09-\x0D]``.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  Only a local master may
    do without it (tests): then a fresh temporary folder is set for the
    session.  On a cluster an unset folder is an error, because a local folder
    would be seen by one machine only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = sc.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="cardprism-llm-"))
    return sc.getCheckpointDir().rstrip("/")


class Scratch:
    """Tables of one operator call under the shared folder.

    ``put`` writes a frame as Parquet and returns it reread: it cuts the
    lineage (a lost executor costs only the tasks since the last table) and
    fixes values such as generated row numbers.  ``drop`` removes a table that
    nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        path = hadoop.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_batches(spark: SparkSession, size: str = "4m"):
    """Jobs started within hand their Python workers rows of at most about
    ``size`` bytes at once (Spark's own limits are 10,000 rows and 64 MB): for
    tables of few, wide rows, which both sides would hold whole, for each task."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def lower_ascii(c):
    """A-Z to a-z and nothing else (``lower`` follows Unicode)."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\x20\x09-\x0D]+`` of the A-Z lower-cased text, as UTF-8 bytes
    (``bytes.lower`` and ``bytes.split`` know ASCII only, as wanted)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """File of a public tokenizer; ``folder`` overrides the installed place."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers
    return public_tokenizers.path(name)
