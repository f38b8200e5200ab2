"""Spark session helpers.

Library code never creates sessions on its own; these helpers are for
scripts, tests and the benchmark.  Settings that matter at scale:
AQE (runtime coalescing, skew-join splitting), UTC session time zone, no UI.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

AT_ONCE = 4


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "cardprism", checkpoint_dir: str | None = None) -> SparkSession:
    master = master or os.environ.get("CARDPRISM_MASTER", "local[8]")
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("CARDPRISM_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if checkpoint_dir:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which the driver and all
    executors see.  Only a local master (tests, the benchmark) may do without
    it: then a fresh temporary folder is set for the session.  On a cluster an
    unset folder is an error, since a local one is seen by one machine only."""
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="cardprism-ckpt-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame, keep: bool = False) -> DataFrame:
    """A table in the shared folder, reread: for loops, and for frames that
    several later jobs read.  Unlike ``checkpoint()`` it also sheds what the
    optimizer knows of the frame, which would grow with each round of a loop.
    ``keep`` caches it, for passes that read it many times; a lost cached block
    is read again from the table.  ``release`` deletes it."""
    path = f"{shared_dir(df.sparkSession)}/cardprism-{uuid.uuid4().hex}"
    df.write.parquet(path)
    cut = df.sparkSession.read.schema(df.schema).parquet(path)
    cut = cut.persist(StorageLevel.MEMORY_AND_DISK) if keep else cut
    cut._cut_path = path
    return cut


def at_once(spark: SparkSession, fn, items) -> list:
    """``fn`` of each item, in order, the Spark jobs of up to ``AT_ONCE`` items
    side by side: for chains of many small jobs that don't wait for each other.
    Raises what the first failing item raises."""
    items = list(items)
    with ThreadPoolExecutor(max(1, min(AT_ONCE, len(items)))) as pool:
        jobs = [pool.submit(inheritable_thread_target(spark)(fn), item) for item in items]   # a copy of the job properties each
        return [job.result() for job in jobs]


def release(*frames: DataFrame) -> None:
    """Delete the tables of frames made by ``cut_lineage`` that nothing reads
    any more."""
    for df in frames:
        path = getattr(df, "_cut_path", None)
        if path:
            df.unpersist()
            sc = df.sparkSession.sparkContext
            where = sc._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)


def partitioned(df: DataFrame, key: str, target_bytes: int = 16 << 20) -> DataFrame:
    """A matrix ``(key, v)`` for model passes: cut, then dealt by ``key`` into
    partitions of about ``target_bytes``, at least one per core (passes are
    compute-bound) unless that leaves fewer than 1000 rows each; cached."""
    from pyspark.sql import functions as F
    cut = cut_lineage(df)
    n, d = cut.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    by_size = -(-int(n) * max(d or 1, 1) * 8 // target_bytes)
    by_core = min(df.sparkSession.sparkContext.defaultParallelism, -(-int(n) // 1000))
    return cut.repartition(max(1, by_size, by_core), key).persist(StorageLevel.MEMORY_AND_DISK)
