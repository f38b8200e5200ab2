"""Line deduplication (DataFrame functions only).

Each text is split at line feeds.  A line's key is the line stripped of white
space and A-Z lower-cased; its 128-bit hash stands for it.  Keys of at least
``min_chars`` code points that occur in at least ``min_docs`` documents are
repeated lines: their lines stay in the document with the largest id and go
everywhere else.

The hash rows (hash, document, position) are range-partitioned and sorted by
hash, then document from the largest id, then position.  The range bounds cut
between positions too, so even a line that a third of the documents share is
spread over many tasks.  In that order a task streams over its rows and emits
the first of each (hash, document).  Partial counts of these firsts, summed per
hash, give the number of documents, and the largest document keeps the line.

The result holds no text: per document a compressed keep bitmap, the map of
64-line words (word number to 64 bits, 1 = keep) in which a line goes.  Words
that are kept whole are left out, and so are documents that keep all lines.

Defined results: null and empty text are one empty line.  Rows that repeat a
doc_id count as one document; each keeps its own bitmap, found by the hash of
its text.  Null ids count as one document, smaller than all others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.llm.common import WHITE, Scratch, lower_ascii

WORD = 64


def split_lines(text):
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line):
    return lower_ascii(F.btrim(line, F.lit(WHITE)))


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn(
        "text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``doc_id, text_hash, n_dropped, keep_words`` of each document that
    loses lines."""
    scratch = Scratch(docs.sparkSession, "lines")
    long_line = F.length("key") >= min_chars
    places = (_keyed(docs, id_col, text_col).select("doc_id", "text_hash", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
              .select("doc_id", "text_hash", "pos", line_key(F.col("line")).alias("key")).where(long_line)
              .select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "text_hash", "pos"))
    order = [F.col("hash"), F.col("doc_id").desc_nulls_last(), F.col("pos"), F.col("text_hash")]
    ranged = scratch.put(places.repartitionByRange(*order).sortWithinPartitions(*order), "ranged")
    # a task streams its sorted rows into one first row per (hash, document); a
    # document cut by a range bound meets again in the next aggregation
    firsts = ranged.groupBy("hash", "doc_id").agg(F.min("pos").alias("pos"))
    repeated = firsts.groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= min_docs)
    repeated = scratch.put(repeated.select("hash", "keeper"), "repeated")
    goes = ranged.join(repeated, "hash").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    bit = F.expr(f"shiftleft(1L, pos % {WORD})")
    words = goes.groupBy("doc_id", "text_hash", F.floor(F.col("pos") / WORD).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits"))
    return words.groupBy("doc_id", "text_hash").agg(
        F.sum(F.bit_count("bits")).alias("n_dropped"),
        F.map_from_entries(F.collect_list(F.struct("word", F.bitwise_not("bits")))).alias("keep_words"))


def kept_lines(lines, keep_words):
    """The lines whose bit is 1 or whose word is left out of the map."""
    def stays(line, i):
        word = F.try_element_at(keep_words, F.floor(i / WORD).cast("int"))
        return word.isNull() | (F.getbit(word, i % WORD) == 1)
    return F.when(keep_words.isNull(), lines).otherwise(F.filter(lines, stays))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_lines, n_dropped, kept_text``."""
    rows, marks = _keyed(docs, id_col, text_col).alias("d"), bitmaps.alias("b")
    same = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.text_hash") == F.col("b.text_hash"))
    lines = split_lines(F.col("d.text"))
    return rows.join(marks, same, "left").select(
        "d.doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce("b.n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.array_join(kept_lines(lines, F.col("b.keep_words")), "\n").alias("kept_text"))
