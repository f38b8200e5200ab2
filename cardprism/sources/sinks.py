"""Sinks.  Executors write their partitions directly to storage."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardprism.session import shared_dir

SINK_FORMATS = ("parquet", "csv", "json")
TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"


def save_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> str:
    """Write a table; unsupported formats raise."""
    fmt = fmt.lower()
    if fmt not in SINK_FORMATS:
        raise ValueError(f"unsupported sink format {fmt!r}; use one of {SINK_FORMATS}")
    w = df.write.mode(mode)
    if fmt in ("csv", "json"):
        # keep microseconds (text formats default to milliseconds)
        w = w.option("timestampNTZFormat", TS_FORMAT).option("timestampFormat", TS_FORMAT)
    if fmt == "csv":
        w.option("header", True).csv(path)
    elif fmt == "json":
        w.json(path)
    else:
        w.parquet(path)
    return path


def save_documents(df: DataFrame, path: str, key_col: str | None = None, mode: str = "overwrite") -> str:
    """Nested JSON documents, one per row (e.g. one per segment):
    ``to_json(struct(*))`` keeps non-ASCII text and nested structs/arrays."""
    cols = [F.col(c) for c in df.columns]
    doc = F.to_json(F.struct(*cols)).alias("value")
    out = df.select(doc)
    if key_col:
        out = df.orderBy(key_col).select(doc)
    out.write.mode(mode).text(path)
    return path


def save_text(lines: DataFrame, path: str) -> str:
    """One string column of a few rows, as one text file."""
    lines.coalesce(1).write.mode("overwrite").text(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory (never a
    machine-local temp folder) for round trips and intermediate tables."""
    base = shared_dir(spark).rstrip("/")
    return f"{base}/cardprism-scratch/{name}-{uuid.uuid4().hex}"


# --- several tables that appear together -------------------------------------------

MANIFEST = "manifest.json"


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm, jvm.org.apache.hadoop.fs.Path(path), spark.sparkContext._jsc.hadoopConfiguration()


def read_manifest(spark: SparkSession, base: str) -> dict | None:
    """``{"run_id": .., "files": {name: path}}`` of the export that is complete
    in ``base``; None before the first."""
    base = base.rstrip("/")
    _, path, conf = _file(spark, f"{base}/{MANIFEST}")
    if not path.getFileSystem(conf).exists(path):
        return None
    found = json.loads("".join(r.value for r in spark.read.text(f"{base}/{MANIFEST}").collect()))   # a few lines
    return found | {"files": {name: f"{base}/{rel}" for name, rel in found["files"].items()}}


class Bundle:
    """Tables written one by one that readers see all at once.  Each run writes
    into a folder of its own; ``commit`` renames a manifest over the last one,
    which is one step of the file system.  A run that dies before leaves the
    last export as it was; the same run id again writes its folder anew, or, if
    it was completed, changes nothing."""

    def __init__(self, spark: SparkSession, base: str, run_id: str):
        if not run_id or "/" in run_id or run_id.startswith("."):
            raise ValueError(f"a run id names a folder: {run_id!r}")
        self.spark, self.base, self.run_id, self.names = spark, base.rstrip("/"), run_id, []

    def done(self) -> dict | None:
        """Paths of the tables if this run is the completed one."""
        now = read_manifest(self.spark, self.base)
        return now["files"] if now and now["run_id"] == self.run_id else None

    def path(self, name: str) -> str:
        self.names.append(name)
        return f"{self.base}/runs/{self.run_id}/{name}"

    def commit(self) -> dict:
        text = json.dumps({"run_id": self.run_id, "files": {n: f"runs/{self.run_id}/{n}" for n in self.names}}, ensure_ascii=False)
        jvm, new, conf = _file(self.spark, f"{self.base}/runs/{self.run_id}/{MANIFEST}")
        out = new.getFileSystem(conf).create(new, True)
        out.write(bytearray(text.encode()))
        out.close()
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(new.toUri(), conf).rename(new, jvm.org.apache.hadoop.fs.Path(f"{self.base}/{MANIFEST}"), options)
        return read_manifest(self.spark, self.base)["files"]
