"""A training corpus in five stages: drop toxic documents, drop exact copies,
keep one document of each group of near copies, drop documents that hold
benchmark passages, pack what stays into sequences.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir)
and returns a frame.  All but the last return rows of ``docs`` as they came,
extra columns of any name included.  ``run`` writes each stage's result as Parquet into the
cluster's shared folder and gives it, reread, to the next one.

Defined results: rows with null or empty text pass the toxicity stage (by the
classifier's base score), count as equal texts in the second stage, and have
no links and no leaks.  Rows without doc_id are never near copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardprism.llm import decontam, exact_dedup, minhash, packing, toxicity
from cardprism.llm.common import Scratch, table

#: No stage but the second can be expressed in SQL; tests/llm holds the whole
#: against brute force.
ORACLE_SQL = None


def columns_of(docs: DataFrame) -> list:
    """All columns of ``docs``, whatever their names (``meta.url``)."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_documents(docs, model, out="__toxicity")
    return scored.where(F.col("__toxicity.score") < 0.5).select(*columns_of(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row that ``exact_dedup`` keeps of each group of equal texts."""
    def key(doc_id, n_code, sha):
        return F.concat_ws(":", doc_id.cast("string"), n_code.cast("string"), sha)

    found = exact_dedup.find_copies(docs)
    kept = found.where("kept").select(key(F.col("doc_id"), F.col("n_code"), F.col("text_sha256")).alias("__key"))
    length = F.coalesce(F.length("text"), F.lit(0))
    keyed = docs.withColumn("__key", key(F.col("doc_id"), length, F.sha2(exact_dedup.normalised(F.col("text")), 256)))
    return keyed.join(kept, "__key").dropDuplicates(["__key"]).select(*columns_of(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies share 80 % of their shingles.  60 bands of 7 minima: a pair of
    just that similarity has no common band with probability 1e-6."""
    found = minhash.near_duplicates(docs, percent=80, bands=60, rows=7)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    marked = decontam.mark_leaks(docs, table(spark, sf_dir, "benchmark"), out="__leaks")
    return marked.where(F.size("__leaks") == 0).select(*columns_of(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = scratch.put(stage(spark, docs, sf_dir), f"stage{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
