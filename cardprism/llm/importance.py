"""Importance resampling of documents towards a target distribution.

1. *Features.*  A text's words are runs of ASCII digits, letters (A-Z
   lower-cased) and all code points beyond ASCII; its features are all runs of
   1 to ``ngram`` words, hashed into ``buckets`` by crc32.  One pass over all
   documents and one over all target texts count the buckets: a task adds into
   one array and hands on at most ``buckets`` rows.
2. *Weights.*  A bucket's gain is 1000 times the logarithm of its smoothed
   share in the target over that in the corpus, floored.  The array of gains
   (``buckets`` numbers, whatever the input) goes with the tasks; a document's
   weight is the floored mean over its features.  Adding Gumbel noise, which
   depends on the seed and doc_id alone, makes the highest scores a sample
   without replacement in proportion to the exponentiated weights.
3. *Cutoff.*  A quantile sketch brackets the score at which the wanted number
   of documents lies.  Exact counts above and inside the bracket validate it;
   a bracket that misses is widened, up to the whole range.  Only the rows in
   the bracket are sorted to find the cutoff row.  The drawn rows (not the
   others) are then sorted by range for their ranks.

Defined results: null, empty and word-less texts have no features and weight 0
and are never drawn unless ``min_words`` is 0.  A null doc_id is hashed like an
empty one and comes last among equal scores.  Rows that repeat a doc_id are
rows of their own; where equal rows meet the cutoff, exactly as many as wanted
are drawn.  An empty corpus gives an empty result, an empty target counts 0
everywhere.  Texts may be of any length (a text is one row in a task's
memory).  Columns named in ``keep`` go along; a name that the result uses
itself raises ValueError, all other extra columns are left out.
"""

from __future__ import annotations

import math
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch
from cardprism.llm.ranking import number_rows

RESULT = ("n_features", "n_words", "weight", "score", "rank")
ACCURACY = 10_000   # of the quantile sketch: ranks are off by at most one part in so many


def _word_bytes() -> bytes:
    """Maps A-Z to a-z and every ASCII byte of no word to a blank."""
    table = bytearray(b" " * 256)
    for c in [*b"0123456789abcdefghijklmnopqrstuvwxyz", *range(0x80, 0x100)]:
        table[c] = c
    for c in b"ABCDEFGHIJKLMNOPQRSTUVWXYZ":
        table[c] = c + 32
    return bytes(table)


WORD_BYTES = _word_bytes()


def features(text: bytes | None, ngram: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words and the buckets of all features (UTF-8 ``text``)."""
    words = text.translate(WORD_BYTES).split() if text else []
    found = [crc32(w) for w in words]
    for n in range(2, ngram + 1):
        found += [crc32(b" ".join(words[i:i + n])) for i in range(len(words) - n + 1)]
    return len(words), np.array(found, np.int64) % buckets


def bucket_counts(texts: DataFrame, ngram: int, buckets: int, text_col: str = "text") -> np.ndarray:
    """Features of all texts by bucket."""
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                total += np.bincount(features(text, ngram, buckets)[1], minlength=buckets)
        hit = np.flatnonzero(total)
        yield pd.DataFrame({"bucket": hit, "n": total[hit]})

    rows = texts.select(F.col(text_col).cast("binary").alias("text")).mapInPandas(run, "bucket int, n bigint")
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():   # at most ``buckets`` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))), in doubles."""
    buckets, S, T = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log(((t + 1.0) * (S + buckets)) / ((s + 1.0) * (T + buckets))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id, seed: int):
    """Gumbel noise in thousandths, from the first 32 bits of a hash of seed and id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def scored(docs: DataFrame, gain: np.ndarray, ngram: int, seed: int, id_col: str = "doc_id", text_col: str = "text",
           keep: tuple = ()) -> DataFrame:
    """id, ``keep``, n_features, n_words, weight and score of each document."""
    clash = {id_col, *keep} & set(RESULT)
    if clash:
        raise ValueError(f"columns {sorted(clash)} are results of the resampling; rename them first")
    buckets = len(gain)

    @F.pandas_udf("n_features bigint, n_words bigint, weight bigint")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n, at = features(text, ngram, buckets)
            rows.append((len(at), n, int(gain[at].sum()) // len(at) if len(at) else 0))   # // floors
        return pd.DataFrame(rows, columns=["n_features", "n_words", "weight"])

    rows = docs.select(F.col(f"`{id_col}`"), *[F.col(f"`{c}`") for c in keep], weigh(F.col(f"`{text_col}`").cast("binary")).alias("__w"))
    return rows.select(f"`{id_col}`", *[f"`{c}`" for c in keep], "__w.*", (F.col("__w.weight") + noise(F.col(f"`{id_col}`"), seed)).alias("score"))


def bracket(rows: DataFrame, k: int, n: int, accuracy: int = ACCURACY, slack: float = 2.0) -> tuple[int, int, int]:
    """Scores lo and hi with the k-th highest score of ``rows`` (n of them)
    between them, and the exact number of rows above hi.  The sketch proposes,
    the counts decide; a bracket that misses is widened on both sides."""
    while True:
        share, margin = 1 - k / n, slack / accuracy
        ends = F.percentile_approx("score", F.array(F.lit(max(0.0, share - margin)), F.lit(min(1.0, share + margin))), accuracy)
        lo, hi = rows.agg(ends.alias("ends")).first()["ends"]
        above, below = rows.agg(F.count_if(F.col("score") > hi), F.count_if(F.col("score") < lo)).first()
        if above < k <= n - below:
            return lo, hi, above
        if margin >= 1:   # the sketch's own ends are not the extremes
            low, high = rows.agg(F.min("score"), F.max("score")).first()
            return low, high, 0
        slack *= 8


def resample(docs: DataFrame, target: DataFrame, percent: int, ngram: int = 1, buckets: int = 10_000, seed: int = 2024,
             min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", keep: tuple = (), accuracy: int = ACCURACY) -> DataFrame:
    """Every document's id, ``keep``, n_features, n_words, weight, score and
    rank: ``floor(percent * N / 100)`` of the N documents with at least
    ``min_words`` words are drawn and ranked by score, highest first, ties by
    smaller id; all others have no rank."""
    gain = gains(bucket_counts(docs, ngram, buckets, text_col), bucket_counts(target, ngram, buckets, text_col))
    scratch = Scratch(docs.sparkSession, "resample")
    rows = scratch.put(scored(docs, gain, ngram, seed, id_col, text_col, keep), "scored")
    able = rows.where(F.col("n_words") >= min_words)
    n = able.count()
    k = percent * n // 100
    none = rows.withColumn("rank", F.lit(None).cast("long"))
    if k == 0:
        return none
    lo, hi, above = bracket(able, k, n, accuracy)
    order = [F.col("score").desc(), F.col(f"`{id_col}`").asc_nulls_last()]
    inside = able.where(F.col("score").between(lo, hi)).select("score", f"`{id_col}`")
    at, last = number_rows(inside, order, scratch, "bracket").where(F.col("rank") == k - above).select("score", f"`{id_col}`").first()
    upto = F.lit(True) if last is None else F.coalesce(F.col(f"`{id_col}`") <= F.lit(last), F.lit(False))
    drawn = (F.col("n_words") >= min_words) & ((F.col("score") > at) | ((F.col("score") == at) & upto))
    ranked = number_rows(rows.where(drawn), order, scratch, "drawn")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= k, F.col("rank")))   # equal rows at the cutoff
    return ranked.unionByName(none.where(~drawn))
