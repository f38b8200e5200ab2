"""Token counts by source, language and tokenizer version, kept up to date by
deltas.

A batch of changes (insert, revise, delete of a document's count under one
tokenizer version) becomes *signed rows*: minus the old count, plus the new
one.  They are summed by (source, lang, tokenizer) into the batch's delta, and
the totals are the sum of all deltas; nothing is ever recounted.

Store (Parquet, any file system Spark can write):

    <root>/ledger/batch=<id>   signed rows per document
    <root>/deltas/batch=<id>   their sums per (source, lang, tokenizer)

*Idempotent commits.*  The deltas folder is written last; its ``_SUCCESS`` file
commits the batch.  A committed id is not applied again, whatever it is given.
What a failed attempt left is overwritten by the next attempt and is never
read, because readers only look at committed ids.

Sums are partial-aggregated, so a source with a third of all rows is no hot
key; the ledger is shuffled by document.

Defined results: insert and revise both set a document's count (the old one, if
any, is taken back); deleting what is not there does nothing.  If a batch has
several changes of one document and tokenizer, the one with the largest
``seq`` counts, then a delete, then the largest count.  Null ids, sources and
languages are values like others; a null count is 0.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch, words_of
from cardprism.llm.tokens import ByteBpe

KEYS = ["source", "lang", "tokenizer"]


class TokenRollup:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def _ids(self) -> list[str]:
        """Committed batches."""
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(f"{self.root}/deltas")
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        done = [s.getPath() for s in files.listStatus(path) if files.exists(sc._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(p.getName().removeprefix("batch=") for p in done)

    def _read(self, part: str, ids: list[str]) -> DataFrame | None:
        return self.spark.read.parquet(*[f"{self.root}/{part}/batch={i}" for i in ids]) if ids else None

    def live(self) -> DataFrame | None:
        """Current ``doc_id, source, lang, tokenizer, n_tokens``."""
        rows = self._read("ledger", self._ids())
        if rows is None:
            return None
        net = rows.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("sign"))
        return net.where("sign > 0").drop("sign")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply ``changes`` (op, doc_id, source, lang, tokenizer, n_tokens and
        optionally seq) once; False if the batch is committed already."""
        if batch in self._ids():
            return False
        seq = F.col("seq") if "seq" in changes.columns else F.lit(0)
        new = F.struct(seq.cast("long").alias("seq"), (F.col("op") == "delete").alias("gone"), F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"),
                       F.col("source").alias("source"), F.col("lang").alias("lang"))
        last = changes.groupBy("doc_id", "tokenizer").agg(F.max(new).alias("new"))
        plus = last.where(~F.col("new.gone")).select("doc_id", "new.source", "new.lang", "tokenizer", "new.n_tokens", F.lit(1).alias("sign"))
        signed, live = plus, self.live()
        if live is not None:
            same = F.col("l.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("l.tokenizer").eqNullSafe(F.col("c.tokenizer"))
            old = live.alias("l").join(last.select("doc_id", "tokenizer").alias("c"), same, "left_semi")
            signed = plus.unionByName(old.withColumn("sign", F.lit(-1)))
        ledger, deltas = f"{self.root}/ledger/batch={batch}", f"{self.root}/deltas/batch={batch}"
        signed.write.mode("overwrite").parquet(ledger)
        rows = self.spark.read.schema(signed.schema).parquet(ledger)
        sums = rows.groupBy(*KEYS).agg(F.sum("sign").alias("d_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("d_tokens"))
        sums.write.mode("overwrite").parquet(deltas)
        return True

    def totals(self) -> DataFrame:
        """``source, lang, tokenizer, n_docs, n_tokens`` of what is live."""
        deltas = self._read("deltas", self._ids())
        if deltas is None:
            return self.spark.createDataFrame([], "source string, lang string, tokenizer string, n_docs bigint, n_tokens bigint")
        summed = deltas.groupBy(*KEYS).agg(F.sum("d_docs").alias("n_docs"), F.sum("d_tokens").alias("n_tokens"))
        return summed.where("n_docs <> 0 or n_tokens <> 0")


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """``doc_id, source, lang, n_bpe, n_words`` of each row's whole text."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches):
        bpe = ByteBpe(folder)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "lang": pdf["lang"],
                                "n_bpe": [len(bpe.ids(t)) for t in pdf["text"]], "n_words": [len(words_of(t)) for t in pdf["text"]]})

    rows = docs.select(docs[id_col].alias("doc_id"), "source", "lang", docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, source string, lang string, n_bpe bigint, n_words bigint")


def rollup_documents(docs: DataFrame) -> DataFrame:
    """Totals of a corpus that arrives in three batches: documents with word
    counts and estimated token counts; exact token counts; deletes of the
    documents without words.  The second batch is delivered twice."""
    scratch = Scratch(docs.sparkSession, "rollup")
    rollup = TokenRollup(docs.sparkSession, scratch.path("store"))
    counts = scratch.put(count_tokens(docs), "counts")
    guessed = docs.select("doc_id", "source", "lang", F.ceil(F.coalesce(F.length("text"), F.lit(0)) / 4).alias("n_tokens"))

    def changes(op, rows, tokenizer, n):
        return rows.select(F.lit(op).alias("op"), "doc_id", "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.col(n).alias("n_tokens"))

    rollup.commit("load", changes("insert", guessed, "byte_bpe_50k", "n_tokens").unionByName(changes("insert", counts, "words", "n_words")))
    exact = changes("revise", counts, "byte_bpe_50k", "n_bpe")
    rollup.commit("recount", exact)
    blank = counts.where("n_words = 0")
    rollup.commit("blank", changes("delete", blank, "byte_bpe_50k", "n_bpe").unionByName(changes("delete", blank, "words", "n_words")))
    rollup.commit("recount", exact)
    return rollup.totals()
