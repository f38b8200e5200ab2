"""Phrase collocations from one bidirectional FM-index per shard.

1. *Shards.*  Each task lays the pieces of its texts, as word symbols with a 0
   between pieces, into shards of about ``SHARD_TOKENS`` words, whatever their
   language; a symbol stands for a word of one language.  Shards of a task
   share a vocabulary until that holds ``VOCABULARY`` words.  Texts are never
   shuffled.
2. *Words.*  Vocabulary rows (one per vocabulary and word) are added up; words
   with fewer than ``min_count`` occurrences become separators, as no phrase
   with them can count.
3. *Phrases of k words*, k = 2 .. ``max_words``, one round each.  A shard's
   index starts from single words and extends the intervals of its frequent
   phrases by one word to the right and, again, to the left.  What both sides
   reach has a frequent beginning ``p`` and a frequent rest ``s``; the phrase is
   the pair of their numbers.  Counts are added up within a task, then across
   tasks; frequent phrases are numbered and known to the next round.  So all
   counts are exact, and nothing is pruned by what one shard alone has seen.
4. *Scores.*  A frequent phrase knows its beginning and its rest one word
   shorter, so the counts of all cuts follow from joins of tables of frequent
   phrases.  The best left and right extension decide whether a longer phrase
   absorbs it: if any longer phrase holds it often enough, so does one that is
   one word longer.

Why it holds at scale: a phrase moves at most once per shard, so a word pair
that makes up a third of the text is no hot group; a task holds one shard.  Up
to ``BROADCAST_PHRASES`` frequent phrases (of one length) are broadcast to the
next round; more are joined with the phrases of each shard, so that a shard
gets its own only.  Rows reach Python a few MB at a time.

Defined results: null and empty texts and pieces without words add nothing; a
null language is ``und``; repeated rows count as often as they stand there; an
empty table gives no rows.  Long texts are read in slices that end between two
pieces.  Ties in score and count are broken by the phrase's bytes.  Only the
two named columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch, small_batches
from cardprism.llm.fm_index import BiIndex
from cardprism.llm.ranking import number_rows

SHARD_TOKENS = 1 << 19
VOCABULARY, CHUNK = 1 << 18, 1 << 14       # words of one vocabulary, and of one row of it
BROADCAST_WORDS = 500_000                  # frequent words that are broadcast (some 50 MB)
BROADCAST_PHRASES = 2_000_000              # frequent phrases that are broadcast (16 MB)
HELD, ROWS = 1 << 21, 1 << 16              # phrases that a task adds up, and hands on at once
SLICE = 4 << 20                            # bytes of a text read at once
TASK_SHARDS = 1 << 12                      # shards of one task
LOW = (1 << 32) - 1                        # a phrase's key is p << 32 | s

_PIECE_END = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes(ord(".") if c in _PIECE_END else c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Words(dict):
    """Word to symbol, one language; new words get the vocabulary's next symbol."""

    def __init__(self, lang: str, vocabulary: _Vocabulary):
        super().__init__({b".": 0})
        self.lang, self.vocabulary = lang, vocabulary

    def __missing__(self, word: bytes) -> int:
        symbol = self[word] = len(self.vocabulary.words) + 1
        self.vocabulary.words.append(word)
        self.vocabulary.langs.append(self.lang)
        return symbol


class _Vocabulary:
    def __init__(self, number: int):
        self.number, self.words, self.langs, self.by_lang = number, [], [], {}
        self.freq = np.zeros(1, np.int64)

    def symbols(self, lang: str, tokens: list[bytes]) -> np.ndarray:
        if lang not in self.by_lang:
            self.by_lang[lang] = _Words(lang, self)
        return np.fromiter(map(self.by_lang[lang].__getitem__, tokens), np.int32, len(tokens))

    def shard(self, number: int, parts: list[np.ndarray]) -> dict:
        """Row of a finished shard."""
        seq = np.concatenate(parts)
        freq = np.bincount(seq, minlength=len(self.words) + 1)
        freq[:len(self.freq)] += self.freq
        self.freq = freq
        return {"shard": number, "vocabulary": self.number, "seq": pack(seq), "base": 0, "words": None}

    def rows(self):
        for a in range(0, len(self.words), CHUNK):
            words = [{"lang": x, "word": w, "n": n} for x, w, n in
                     zip(self.langs[a:a + CHUNK], self.words[a:a + CHUNK], self.freq[a + 1:a + 1 + CHUNK].tolist(), strict=True)]
            yield {"shard": 0, "vocabulary": self.number, "seq": None, "base": a + 1, "words": words}


def pack(seq: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(seq, np.int32).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.int32)


def slices(text: bytes, size: int = SLICE):
    """Parts of a translated text that end at a piece's end."""
    at = 0
    while at < len(text):
        end = text.find(b".", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def shards(docs: DataFrame, lang_col: str, text_col: str, tokens: int = SHARD_TOKENS, vocabulary: int = VOCABULARY) -> DataFrame:
    """Rows of two kinds: a shard's sequence (``seq``), or a part of a
    vocabulary (``words``, the first of them symbol ``base``)."""
    columns = pa.schema([("shard", pa.int64()), ("vocabulary", pa.int64()), ("seq", pa.binary()), ("base", pa.int32()),
                         ("words", pa.list_(pa.struct([("lang", pa.string()), ("word", pa.binary()), ("n", pa.int64())])))])

    def batch_of(row):
        return pa.RecordBatch.from_pylist([row], columns)

    def run(batches):
        task = TaskContext.get().partitionId()
        made, size, parts, known = 0, 0, [], _Vocabulary(task * TASK_SHARDS)
        for batch in batches:
            langs, texts = batch.column(0), batch.column(1)
            for i in range(batch.num_rows):   # one text at a time leaves Arrow's memory
                lang = langs[i].as_py()
                for part in slices(texts[i].as_py().translate(_TABLE)):
                    symbols = known.symbols(lang, part.replace(b".", b" . ").split())   # what splits is blank or tab: line ends are "." by now
                    parts += [symbols, np.zeros(1, np.int32)]
                    size += len(symbols)
                    if size >= tokens:
                        yield batch_of(known.shard(task * TASK_SHARDS + made, parts))
                        made, size, parts = made + 1, 0, []
                        if made == TASK_SHARDS or task >= 1 << 20:
                            raise ValueError("too many shards for their numbers: raise the shard size")
                        if len(known.words) >= vocabulary:
                            yield from map(batch_of, known.rows())
                            known = _Vocabulary(task * TASK_SHARDS + made)
        if size:
            yield batch_of(known.shard(task * TASK_SHARDS + made, parts))
        yield from map(batch_of, known.rows())

    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`"), F.lit("und")).alias("lang"),
                       F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "shard bigint, vocabulary bigint, seq binary, base int, words array<struct<lang:string,word:binary,n:bigint>>")


def _lists(found: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per shard or vocabulary with its frequent phrases (fewer than its words)."""
    rows = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias("known"))
    return rows.select(key, *[F.col(f"known.{c}").alias(f"known_{c}") for c in columns])


def _without_rare(made: DataFrame, words: DataFrame) -> DataFrame:
    """(shard, seq, ids): sequences of frequent words only, as symbols of
    their own; ids by symbol."""
    def run(batches):
        for pdf in batches:
            out = []
            for shard, data, lo, ids in zip(pdf["shard"], pdf["seq"], pdf["known_lo"], pdf["known_id"], strict=True):
                seq = unpack(data)
                new = np.zeros(max(int(seq.max()), int(lo[-1])) + 1, np.int32)
                new[lo] = np.arange(1, len(lo) + 1)
                seq = new[seq]
                stays = np.r_[seq[0] > 0, (seq[1:] > 0) | (seq[:-1] > 0)]   # one separator in a row
                seq = np.r_[seq[stays], 0]
                there = np.flatnonzero(np.bincount(seq, minlength=2)[1:])
                there = there[np.argsort(ids[there])]   # symbols in the order of the words' numbers: so keys come sorted
                new[:] = 0
                new[there + 1] = np.arange(1, len(there) + 1)
                out.append((shard, pack(new[seq]), ids[there]))
            yield pd.DataFrame(out, columns=["shard", "seq", "ids"])

    joined = made.where("seq is not null").select("shard", "vocabulary", "seq").join(_lists(words, "vocabulary", "lo", "id"), "vocabulary")
    return joined.mapInPandas(run, "shard bigint, seq binary, ids array<bigint>")


def walk(index: BiIndex, ids: np.ndarray, known: list[tuple[np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts of a shard's phrases of k words whose beginning and rest
    are frequent.  ``known``: sorted keys and numbers of the frequent phrases
    of 2 .. k - 1 words."""
    sym, lo, rlo, n = index.symbols()
    of = ids[sym - 1]
    for length in range(2, k + 1):
        p, _, lo_r, rlo_r, count = index.right(lo, rlo, n)
        s, _, lo_l, _, _ = index.left(lo, rlo, n)
        _, i, j = np.intersect1d(lo_r, lo_l, assume_unique=True, return_indices=True)
        key, lo, rlo, n = (of[p[i]] << 32) | of[s[j]], lo_r[i], rlo_r[i], count[i]
        if length == k:
            return key, n
        keys, names = known[length - 2]
        at = np.searchsorted(keys, key)
        hit = np.r_[keys, -1][at] == key
        lo, rlo, n, of = lo[hit], rlo[hit], n[hit], names[at[hit]]
    raise ValueError("phrases have two words or more")


def add_up(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    return key[first], np.add.reduceat(n, first, dtype=np.int64) if len(key) else n


def _longer(kept: DataFrame, known: list, k: int, by_shard: bool = False) -> DataFrame:
    """Phrases of k words: key, n (and shard, if wanted), added up per task.
    ``known``: per length a broadcast array of keys (their numbers run from 1),
    or None if ``kept`` holds each shard's own."""
    def run(batches):
        keys, counts, size = [], [], 0

        def rows(shard=0):
            key, n = add_up(keys, counts)
            keys.clear()
            counts.clear()
            for a in range(0, len(key), ROWS):
                yield pd.DataFrame({"key": key[a:a + ROWS], "n": n[a:a + ROWS], "shard": shard})

        for pdf in batches:
            for row in pdf.itertuples(index=False):
                lists = []
                for length, shared in enumerate(known, 2):
                    if shared is None:
                        lists.append((np.asarray(getattr(row, f"keys{length}"), np.int64), np.asarray(getattr(row, f"ids{length}"), np.int64)))
                    else:
                        lists.append((shared.value, np.arange(1, len(shared.value) + 1)))
                key, n = walk(BiIndex(unpack(row.seq), k), np.asarray(row.ids, np.int64), lists, k)
                keys.append(key)
                counts.append(n.astype(np.int32))
                size += len(key)
                if by_shard or size >= HELD:
                    yield from rows(row.shard)
                    size = 0
        if keys:
            yield from rows()

    return kept.mapInPandas(run, "key bigint, n bigint, shard bigint")


def _countable(table: DataFrame) -> int:
    """Rows of a numbered table; two numbers must fit a key."""
    n = table.count()
    if n >= 1 << 31:
        raise ValueError("more frequent phrases than their keys can tell apart: raise min_count")
    return n


def _hand_on(kept: DataFrame, known: list, table: DataFrame, k: int, most: int) -> tuple[DataFrame, list]:
    """Make the frequent phrases of k words (``table``: key, id) known to the
    shards: broadcast if there are at most ``most``, else joined."""
    if _countable(table) <= most:
        keys = table.select("key").toPandas()["key"].sort_values().to_numpy()
        return kept, [*known, kept.sparkSession.sparkContext.broadcast(keys)]
    own = _longer(kept, known, k, by_shard=True).select("shard", "key").join(table.select("key", "id"), "key")
    lists = _lists(own, "shard", "key", "id").toDF("shard", f"keys{k}", f"ids{k}")
    none = F.array().cast("array<bigint>")
    wide = kept.join(lists, "shard", "left").select(*kept.columns, *[F.coalesce(c, none).alias(c) for c in lists.columns[1:]])
    return wide, [*known, None]


def phrases(docs: DataFrame, scratch: Scratch, min_count: int, max_words: int = 4, lang_col: str = "lang", text_col: str = "text",
            shard_tokens: int = SHARD_TOKENS, broadcast_phrases: int = BROADCAST_PHRASES) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by length, and words by language.  Each table holds id,
    lang, phrase, last (word), a (count), heads (counts of its first 1, 2, ..
    words) and tails (counts of what follows them)."""
    made = scratch.put(shards(docs, lang_col, text_col, shard_tokens), "shards")
    words = made.where("seq is null").select("vocabulary", "base", F.posexplode("words").alias("at", "w"))
    words = words.select("vocabulary", (F.col("base") + F.col("at")).alias("lo"), "w.lang", "w.word", "w.n")
    counts = scratch.put(words.groupBy("lang", "word").agg(F.sum("n").alias("a")), "words")
    totals = scratch.put(counts.groupBy("lang").agg(F.sum("a").alias("n")), "totals")
    frequent = counts.where(F.col("a") >= min_count)
    frequent = number_rows(frequent, ["lang", "word"], scratch, "frequent", "id")
    names = frequent.select("lang", "word", "id")
    known = words.join(F.broadcast(names) if _countable(names) <= BROADCAST_WORDS else names, ["lang", "word"])
    kept = scratch.put(_without_rare(made, known), "kept")
    scratch.drop("shards")
    scratch.drop("words")
    none, word = F.array().cast("array<bigint>"), F.col("word").cast("string")
    tables = [frequent.select("id", "lang", word.alias("phrase"), word.alias("last"), "a", none.alias("heads"), none.alias("tails"))]
    known = []
    for k in range(2, max_words + 1):
        # repartitioned first: the tasks have added up already, a second map-side sum would only cost memory
        found = _longer(kept, known, k).repartition("key").groupBy("key").agg(F.sum("n").alias("a")).where(F.col("a") >= min_count)
        found = number_rows(scratch.put(found, f"found{k}"), ["key"], scratch, f"numbered{k}", "id")
        begin = tables[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("begin"), F.concat("heads", F.array("a")).alias("heads"))
        rest = tables[-1].select(F.col("id").alias("s"), "last", F.concat(F.array("a"), "tails").alias("tails"))
        new = found.withColumns({"p": F.shiftright("key", 32), "s": F.col("key").bitwiseAND(LOW)}).join(begin, "p").join(rest, "s")
        new = new.select("id", "key", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "a", "heads", "tails", "p", "s")
        tables.append(scratch.put(new, f"phrases{k}"))
        if k < max_words:
            kept, known = _hand_on(kept, known, tables[-1], k, broadcast_phrases)
    return tables, totals


def collocations(docs: DataFrame, min_count: int = 30, max_words: int = 4, top: int = 2000, absorb_percent: int = 80,
                 scale: int = 2_000_000, lang_col: str = "lang", text_col: str = "text", shard_tokens: int = SHARD_TOKENS,
                 broadcast_phrases: int = BROADCAST_PHRASES) -> DataFrame:
    """Each language's ``top`` phrases of 2 to ``max_words`` words: lang, rank,
    phrase, a, l, r, n, score, and the counts of the best frequent extension by
    one word, left_extension and right_extension (null: none)."""
    scratch = Scratch(docs.sparkSession, "collocations")
    with small_batches(docs.sparkSession):   # a row may be a shard with its vocabulary's frequent words
        tables, totals = phrases(docs, scratch, min_count, max_words, lang_col, text_col, shard_tokens, broadcast_phrases)
    whole = "cast({} as decimal(19,0))"
    cuts = f"""array_min(zip_with(sequence(1, size(heads)), arrays_zip(heads, tails), (k, c) -> struct(
        cast({scale} as decimal(10,0)) * {whole.format('a')} div ({whole.format('c.heads')} + {whole.format('c.tails')}) as score,
        k, c.heads as l, c.tails as r)))"""
    scored = []
    for k in range(2, max_words + 1):
        now = tables[k - 1].withColumn("cut", F.expr(cuts))
        if k < max_words:
            right = tables[k].groupBy(F.col("p").alias("id")).agg(F.max("a").alias("right_extension"))
            left = tables[k].groupBy(F.col("s").alias("id")).agg(F.max("a").alias("left_extension"))
            now = now.join(left, "id", "left").join(right, "id", "left")
        else:
            now = now.withColumn("left_extension", F.lit(None).cast("bigint")).withColumn("right_extension", F.lit(None).cast("bigint"))
        scored.append(now.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score", "left_extension", "right_extension"))
    rows = reduce(DataFrame.unionByName, scored)
    best = "greatest(left_extension, right_extension)"
    absorbed = F.coalesce(F.expr(f"100 * {whole.format(best)} >= {absorb_percent} * {whole.format('a')}"), F.lit(False))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = rows.where(~absorbed).withColumn("place", F.row_number().over(order)).where(F.col("place") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", "left_extension", "right_extension")
