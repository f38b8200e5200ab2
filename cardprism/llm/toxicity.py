"""Toxicity scores after noisy-channel deobfuscation.

* *Language model*: character trigram counts over the whole corpus (letters
  a-z after folding case, accents and look-alikes; everything else is a word
  boundary), summed over tasks.  27^3 counts, whatever the corpus.
* *Channel*: a stretch of text that looks disguised - leetspeak inside a word,
  single letters with spaces or marks between them, a letter three or more
  times in a row - becomes a lattice: a sign may stand for the letters it
  resembles or be a boundary, a separator may be dropped, a run may be one
  letter or two.  Viterbi decoding finds the path with the best sum of
  channel costs and trigram log probabilities.
* *Classifier*: logistic regression over the restored text's words and word
  beginnings (``PREFIXES`` letters).  It is fitted on at most ``sample_rows``
  labelled rows (those with the smallest hash of doc_id, texts with the same
  word set once), with the ``max_features`` features most typical of label 1.
  Label, language, source and doc_id are never features.

Defined results: null and empty texts get the classifier's base score; without
any training rows of both labels every text scores the share of label 1 (0
without rows).  Repeated rows are scored each.  Repeated labels of a doc_id
count once, as the largest.
"""

from __future__ import annotations

import codecs
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch
from cardprism.llm.pii import _LOOKALIKE

PREFIXES = (3, 4, 5, 6)
SAMPLE_ROWS, MAX_FEATURES = 20_000, 2000

# Letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "\xa3": "l", "\xa5": "y",
}
SEPARATORS = frozenset(" ._*-~'")
SWAP, DROP, MERGE = 1.0, 2.0, 2.0  # channel costs in nats

_SIGN = re.escape("".join(LEET))
_INSIDE = re.compile(rf"[a-z][{_SIGN}]+[a-z]|(?<!\S)[@$0-9][a-z]{{2}}|[a-z]{{2}}[@$013457](?![^\s.,;:?!])")
_SPACED = re.compile(rf"(?<![a-z0-9])(?:[a-z{_SIGN}][ ._*~-]){{3,}}[a-z{_SIGN}](?![a-z0-9])")
_TRIPLE = re.compile(r"([a-z])\1\1")
_TOKEN = re.compile(r"\S+")
N = 27


def _plain_byte(c: int) -> int:
    """Latin-1 code to its lower-case base letter, or itself."""
    base = unicodedata.normalize("NFKD", chr(c).lower())[:1]
    return {0xDF: ord("s"), 0xE6: ord("a"), 0xF8: ord("o"), 0xF0: ord("d"), 0xFE: ord("t")}.get(ord(chr(c).lower()), ord(base) if base.isascii() else c)


_BASE = bytes(_plain_byte(c) for c in range(256))
_LETTERS = bytes(c if 97 <= c <= 122 else 32 for c in range(256))
_CODE = np.array([c - 96 if 97 <= c <= 122 else 0 for c in range(256)], np.int64)
_LETTER = np.array([97 <= c <= 122 for c in range(256)])
_MARK = np.array([chr(c) in LEET for c in range(256)])


def _outside_latin1(error):
    """Codec error handler: look-alikes and compatibility forms become plain
    letters, marks and invisible characters vanish, the rest is a blank."""
    out = []
    for c in error.object[error.start:error.end]:
        base = _LOOKALIKE.get(c) or "".join(x for x in unicodedata.normalize("NFKD", c) if x.isascii())
        out.append(base.lower() or ("" if unicodedata.category(c) in ("Mn", "Cf") else "e" if c == "\u20ac" else " "))
    return "".join(out), error.end


codecs.register_error("cardprism.fold", _outside_latin1)


def fold(text: str) -> bytes:
    """Lower case without accents, look-alikes of Latin letters replaced, as
    Latin-1."""
    return text.encode("latin-1", "cardprism.fold").translate(_BASE)


def words_in(folded: bytes) -> set[str]:
    return set(folded.translate(_LETTERS).decode("ascii").split())


def char_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``code, n``: trigram counts over the whole of ``docs``, summed."""

    def run(batches):
        total = np.zeros(N**3, np.int64)
        for pdf in batches:
            for text in pdf["text"]:
                if text:
                    c = np.concatenate(([0, 0], _CODE[np.frombuffer(fold(text), np.uint8)], [0]))
                    total += np.bincount(c[:-2] * (N * N) + c[1:-1] * N + c[2:], minlength=N**3)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"code": at, "n": total[at]})

    counted = docs.select(docs[text_col].alias("text")).mapInPandas(run, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def language_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a, b; at most 27^3 rows are read."""
    n = np.zeros(N**3)
    for code, k in counts.collect():
        n[code] = k
    n = n.reshape(N, N, N)
    one = (n.sum((0, 1)) + 0.5) / (n.sum() + 0.5 * N)
    two = (n.sum(0) + 5 * one) / (n.sum(0).sum(1, keepdims=True) + 5)
    return np.log((n + 5 * two) / (n.sum(2, keepdims=True) + 5))


class Restorer:
    """Finds disguised stretches of a folded text and decodes them."""

    def __init__(self, lm: np.ndarray, memory: int = 100_000):
        self.lm, self.memory, self.known = lm.tolist(), memory, {}

    def lattice(self, span: str) -> list[list[tuple[str, float]]]:
        steps, i = [], 0
        while i < len(span):
            c, j = span[i], i + 1
            while j < len(span) and span[j] == c:
                j += 1
            k, i = j - i, j
            if "a" <= c <= "z":
                steps.append([(c, 0.0)] if k == 1 else [(c + c, 0.0), (c, MERGE)])
            elif c in SEPARATORS:
                steps.append([(" ", 0.0), ("", DROP)])
            else:
                letters = LEET.get(c, "")
                steps.append([(" ", DROP), ("", DROP + SWAP), *((x, SWAP) for x in letters), *((x + x, SWAP) for x in letters if k > 1)])
        return steps

    def decode(self, span: str) -> str:
        if span in self.known:
            return self.known[span]
        lm, states = self.lm, {(0, 0): (0.0, None)}
        for options in self.lattice(span):
            new: dict = {}
            for (a, b), (score, path) in states.items():
                for letters, cost in options:
                    x, y, s = a, b, score - cost
                    for ch in letters:
                        z = ord(ch) - 96 if ch != " " else 0
                        if z or y:  # one boundary is enough
                            s += lm[x][y][z]
                            x, y = y, z
                    if (x, y) not in new or s > new[x, y][0]:
                        new[x, y] = (s, (path, letters))
            states = new
        (_, path), out = max(((s + lm[a][b][0], p) for (a, b), (s, p) in states.items()), key=lambda v: v[0]), []
        while path:
            path, letters = path
            out.append(letters)
        if len(self.known) > self.memory:
            self.known.clear()
        self.known[span] = found = " ".join("".join(reversed(out)).split())
        return found

    @staticmethod
    def _disguised(token: str) -> bool:
        letters = sum("a" <= c <= "z" for c in token)
        signs = sum(c in LEET for c in token.rstrip("!.,;:?$"))
        return letters >= 2 and signs <= 2 * letters and not ("@" in token and "." in token) and "://" not in token

    def spans(self, folded: bytes) -> list[tuple[int, int]]:
        """Disguised stretches of a folded text, in order, not overlapping.
        Byte classes rule out most texts before a pattern is tried."""
        c = np.frombuffer(folded, np.uint8)
        if len(c) < 3:
            return []
        letter, mark = _LETTER[c], _MARK[c]
        text, found = None, []
        if ((c[2:] == c[1:-1]) & (c[1:-1] == c[:-2]) & letter[2:]).any():
            text = folded.decode("latin-1")
            found += [m.span() for m in re.finditer(r"[a-z]{3,}", text) if _TRIPLE.search(m[0])]
        if (mark[1:] & letter[:-1]).any() or (mark[:-1] & letter[1:]).any():
            text = text or folded.decode("latin-1")
            if _INSIDE.search(text):
                found += [m.span() for m in _TOKEN.finditer(text) if _INSIDE.search(m[0]) and self._disguised(m[0])]
        body = letter | mark
        alone = body.copy()
        alone[1:] &= ~body[:-1]
        alone[:-1] &= ~body[1:]
        if len(c) > 6 and (alone[:-6] & alone[2:-4] & alone[4:-2] & alone[6:]).any():
            text = text or folded.decode("latin-1")
            found += [m.span() for m in _SPACED.finditer(text) if sum("a" <= x <= "z" for x in m[0]) >= 3]
        out, end = [], 0
        for a, b in sorted(found):
            if a >= end:
                out.append((a, b))
                end = b
        return out

    def __call__(self, text: str | None) -> tuple[bytes, int]:
        """(restored text, number of stretches decoded); restored is folded."""
        folded = fold(text or "")
        spans = self.spans(folded)
        if not spans:
            return folded, 0
        out, at = [], 0
        for a, b in spans:
            out += [folded[at:a], self.decode(folded[a:b].decode("latin-1")).encode("latin-1")]
            at = b
        return b"".join([*out, folded[at:]]), len(spans)


def features_of(word: str) -> list[str]:
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]


class Classifier:
    """Weights of features; a text's score needs its distinct features."""

    def __init__(self, weights: dict[str, float], bias: float, memory: int = 300_000):
        self.weights, self.bias, self.memory = weights, bias, memory
        self.heads = {f[1:1 + PREFIXES[0]] for f in weights}   # a word without such a beginning has no feature

    def score(self, words: set[str], known: dict) -> float:
        if len(known) > self.memory:
            known.clear()
        k, heads, found = PREFIXES[0], self.heads, set()
        for w in words:
            if w[:k] in heads:
                if w not in known:
                    known[w] = tuple(f for f in features_of(w) if f in self.weights)
                found.update(known[w])
        z = self.bias + sum(self.weights[f] for f in sorted(found))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit_weights(rows: list[tuple[int, list[int]]], d: int, l2: float = 1e-3, steps: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient descent; ``rows``: label
    and the numbers of the features present."""
    y = np.array([r[0] for r in rows], float)
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    col = np.array([c for r in rows for c in r[1]], np.int64)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    w, b = np.zeros(d), math.log(share / (1 - share))
    v, vb = w.copy(), b
    rate = 1 / (0.25 * (1 + np.bincount(row, minlength=len(rows)).max()) + l2)
    for t in range(steps):
        z = vb + np.bincount(row, v[col], len(rows))
        g = (1 / (1 + np.exp(-z)) - y) / len(rows)
        scale = rate * 20  # features are rare: the bound is far from tight
        new, nb = v - scale * (np.bincount(col, g[row], d) + l2 * v), vb - rate * g.sum()
        v, vb, w, b = new + t / (t + 3) * (new - w), nb + t / (t + 3) * (nb - b), new, nb
    return w, b


def train(docs: DataFrame, labels: DataFrame, lm: np.ndarray, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text",
          sample_rows: int = SAMPLE_ROWS, max_features: int = MAX_FEATURES) -> Classifier:
    """``labels``: ``doc_id, toxic`` of the rows that may be learned from."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = scratch.put(chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows), "chosen")
    lm_b = spark.sparkContext.broadcast(lm)

    def words(batches):
        restore = Restorer(lm_b.value)
        for pdf in batches:
            yield pd.DataFrame({"toxic": pdf["toxic"], "words": [sorted(words_in(restore(t)[0])) for t in pdf["text"]]})

    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).join(F.broadcast(chosen), "doc_id").select("toxic", "text")
    sample = texts.mapInPandas(words, "toxic int, words array<string>")
    sample = scratch.put(sample.withColumn("same", F.xxhash64("words")), "sample")
    sample = sample.dropDuplicates(["same", "toxic"]).select("toxic", "words")
    counts = {t: n for t, n in sample.groupBy("toxic").count().collect()}
    n1, n0 = sum(n for t, n in counts.items() if t == 1), sum(n for t, n in counts.items() if t != 1)
    if not n1 or not n0:
        return Classifier({}, math.log((n1 + 1e-9) / (n0 + 1e-9)) if n1 or n0 else -30.0)

    def tally(batches):
        of = (Counter(), Counter())
        for pdf in batches:
            for toxic, ws in zip(pdf["toxic"], pdf["words"], strict=True):
                of[int(toxic == 1)].update({f for w in ws for f in features_of(w)})
        every = sorted(of[0] | of[1])
        yield pd.DataFrame({"feature": every, "one": [of[1][f] for f in every], "zero": [of[0][f] for f in every]})

    tallied = sample.mapInPandas(tally, "feature string, one bigint, zero bigint").groupBy("feature").agg(F.sum("one").alias("one"), F.sum("zero").alias("zero"))
    p, q = (F.col("one") + 0.5) / (n1 + 1), (F.col("zero") + 0.5) / (n0 + 1)
    gain = F.col("one") * F.log(p / q)  # how much label 1's likelihood gains by the feature
    best = [r[0] for r in tallied.where((F.col("one") >= 3) & (p > 2 * q)).orderBy(gain.desc(), "feature").limit(max_features).select("feature").collect()]
    number = {f: i for i, f in enumerate(best)}
    number_b = spark.sparkContext.broadcast(number)

    def numbered(batches):
        for pdf in batches:
            rows = [sorted({number_b.value[f] for w in ws for f in features_of(w) if f in number_b.value}) for ws in pdf["words"]]
            yield pd.DataFrame({"toxic": (pdf["toxic"] == 1).astype("int32"), "found": rows})

    rows = [(r[0], r[1]) for r in sample.mapInPandas(numbered, "toxic int, found array<int>").collect()]  # at most sample_rows
    w, b = fit_weights(sorted(rows), len(best))
    return Classifier(dict(zip(best, w.tolist(), strict=True)), b)


class ToxicityModel:
    """Language model and classifier, both of bounded size, for broadcasting."""

    def __init__(self, lm: np.ndarray, classifier: Classifier):
        self.lm, self.classifier = lm, classifier

    def scorer(self, spark):
        """A pandas UDF: text to struct(score, n_restored)."""
        model = spark.sparkContext.broadcast(self)

        @F.pandas_udf("score double, n_restored int")
        def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            restore, known = Restorer(model.value.lm), {}
            for texts in batches:
                rows = []
                for t in texts:
                    plain, n = restore(t)
                    rows.append((model.value.classifier.score(words_in(plain), known), n))
                yield pd.DataFrame(rows, columns=["score", "n_restored"])

        return score


def held_out(id_col="doc_id"):
    """Rows that are never learned from: crc32(doc_id as text) mod 5 is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> ToxicityModel:
    """Language model over all of ``docs``, classifier from ``labels`` without
    the held-out rows."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    lm = language_model(char_counts(docs, text_col))
    return ToxicityModel(lm, train(docs, labels.where(~held_out()), lm, scratch, id_col, text_col, **options))


def score_documents(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a struct column ``toxicity`` (score, n_restored)."""
    return docs.withColumn(out, model.scorer(docs.sparkSession)(docs[text_col]))
