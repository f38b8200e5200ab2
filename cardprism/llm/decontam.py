"""Benchmark decontamination by latent semantic retrieval.

1. *Statistics*: in how many documents each of ``DIMS`` hashed terms occurs,
   over all documents; this gives the IDF weights.
2. *Latent space*: randomised SVD of the TF-IDF matrix of passages.  Tasks
   multiply their passages with the current basis and back, the sums of tasks
   (``DIMS x rank`` numbers each, added up by Spark) are orthonormalised, twice
   over; the second product also gives the singular values.  It is fitted on the
   whole texts of all documents: their words are hashed once, into a table of
   two bytes a word.  Which items are found does not depend on the
   space (3.), only the reported cosine and the choice among equally good places
   do; a caller may therefore fit it on fewer documents (``sample_docs``).
3. *Word gate*: an item that keeps ``need`` of its ``n`` words keeps at least
   ``k`` of any ``n - need + k`` of them.  So places with ``k`` hits among its
   rarest ones within ``reach`` words are all the places where the checks can
   accept it; all runs of ``reach`` words there are checked.
4. *Search*: the query set is the benchmark, searched against all documents.
   A text's word windows (widths that follow the items' lengths, about a
   quarter of a width apart, in steps of ``STEP`` words) get latent vectors as
   differences of running sums.  Coordinates are divided by the singular values, so frequent
   topics do not drown the rest.  Windows within cosine ``cosine`` of an item
   of about their width are candidates.  Items that the word gate does not
   find in a text cannot pass the checks and are left out; what a low cosine
   hides is found by the word gate.
5. *Checks*: the longest common subsequence of the item's words and the words
   around the window covers ``coverage`` of the item; or, for a paraphrase,
   ``paraphrase`` of it while the item's answer (its last sentence) is covered
   by ``coverage`` too.

Items are broadcast in blocks of at most ``ITEM_BLOCK``; each block is searched
against all documents, so any benchmark size works.

Defined results: null and empty texts and items match nothing.  Repeated items
match each under its own id; repeated rows give equal rows.  Items of fewer
than ``SHORT`` words count only if all their words stand in a row; the runs of
as many words of all texts are looked up by hash.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.llm.common import Scratch
from cardprism.llm.hashing import WordHasher, mix

DIMS, RANK, PASSAGE = 8192, 64, 64
STEP, RATIO, SHORT, ITEM_BLOCK = 8, 1.6, 5, 20_000
_M = np.uint64(0x9E3779B97F4A7C15)
_SIGNS = re.compile("[\xa0-\xbf\u2000-\u206f\u3000-\u303f\ufe30-\ufe6f\uff00-\uff0f\ufeff]")
_BLANK = np.array([c < 128 and not chr(c).isalnum() for c in range(256)])


class Words:
    """Hashes of a text's lower-cased words of letters and digits; the low
    bits of a hash are the word's term number."""

    def __init__(self, dims: int = DIMS):
        self.dims, self.hasher = np.uint64(dims), WordHasher(_BLANK)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint64)
        if not text.isascii():
            text = _SIGNS.sub(" ", text)
        return self.hasher(text.lower().encode("utf-8", "surrogatepass"))

    def several(self, texts, size: int = 1 << 15) -> Iterator[np.ndarray]:
        """The hashes of each text; short texts are hashed about ``size`` bytes
        at a time."""
        parts, n = [], 0
        for text in texts:
            if text and not text.isascii():
                text = _SIGNS.sub(" ", text)
            parts.append(text.lower().encode("utf-8", "surrogatepass") if text else b"")
            n += len(parts[-1]) + 1
            if n >= size:
                yield from self.hasher.several(parts)
                parts, n = [], 0
        yield from self.hasher.several(parts)

    def terms(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % self.dims).astype(np.int64)


def answer_of(text: str) -> str:
    """The last sentence that has at least three words."""
    sentences = [s for s in re.split(r"[.!?\n]+", text or "") if len(s.split()) >= 3]
    return sentences[-1] if sentences else text or ""


def term_numbers(docs: DataFrame, scratch: Scratch, dims: int = DIMS) -> DataFrame:
    """One row per text with words: ``draw``, a hash of its ``doc_id``, and
    ``terms``, the term numbers of all its words.  Words are hashed once for
    all passes that fit the space."""

    def run(batches):
        words, kind = Words(dims), np.min_scalar_type(dims - 1)
        for pdf in batches:
            terms = [words.terms(h).astype(kind).tobytes() for h in words.several(pdf["text"])]
            yield pd.DataFrame({"draw": pdf["draw"], "terms": terms}).loc[[len(t) > 0 for t in terms]]

    return scratch.put(docs.select(F.xxhash64("doc_id", F.lit(9)).alias("draw"), "text").mapInPandas(run, "draw bigint, terms binary"), "terms")


def _added_up(terms: DataFrame, run) -> dict[int, np.ndarray]:
    """Sums over tasks of the arrays ``part`` that ``run`` gives by ``at``,
    added up by Spark; there are as many numbers as one task gives."""
    rows = terms.mapInPandas(run, "at int, part array<double>").groupBy("at").agg(Summarizer.sum(array_to_vector("part")).alias("part"))
    return {r["at"]: r["part"].toArray() for r in rows.collect()}


def _blocks(z: np.ndarray, size: int = 256) -> pd.DataFrame:
    """A task's ``z`` in blocks of rows, for ``_added_up``."""
    at = range(0, len(z), size)
    return pd.DataFrame({"at": list(at), "part": [z[i:i + size].ravel().astype(float) for i in at]})


def inverse_frequencies(terms: DataFrame, dims: int = DIMS) -> np.ndarray:
    """IDF of each hashed term over all rows of ``term_numbers``."""

    def run(batches):
        kind, seen, mark = np.min_scalar_type(dims - 1), np.zeros(dims + 1), np.zeros(dims, bool)
        for pdf in batches:
            for t in pdf["terms"]:
                mark[:] = False
                mark[np.frombuffer(t, kind)] = True
                seen[:dims] += mark
                seen[dims] += 1
        yield pd.DataFrame({"at": [0], "part": [seen]})

    n = _added_up(terms.select("terms"), run).get(0, np.zeros(dims + 1))
    return np.log((1 + n[dims]) / (1 + n[:dims])) + 0.1


def _passages(texts, idf: np.ndarray, size: int, at_once: int = 32):
    """TF-IDF rows of the passages of some texts (term numbers), about
    ``at_once`` at a time: (the terms that occur, a row per passage over them)."""
    kind, place, mark = np.min_scalar_type(len(idf) - 1), np.zeros(len(idf), np.int64), np.zeros(len(idf), bool)

    def rows(parts):
        t = np.concatenate(parts)
        words = np.array([len(p) for p in parts])
        passages = -(-words // size)
        own = np.arange(len(t)) - np.repeat(np.cumsum(words) - words, words)   # place in the part
        row = own // size + np.repeat(np.cumsum(passages) - passages, words)
        mark[t] = True
        here = np.flatnonzero(mark)
        mark[here] = False
        place[here] = np.arange(len(here))
        n = int(passages.sum())
        a = np.bincount(row * len(here) + place[t], minlength=n * len(here)).reshape(n, len(here)).astype(np.float32)
        a *= idf[here]
        a /= np.sqrt(np.einsum("ij,ij->i", a, a))[:, None]
        return here, a

    idf, parts, n = idf.astype(np.float32), [], 0
    for text in texts:
        t = np.frombuffer(text, kind)
        for i in range(0, len(t), size * at_once):
            parts.append(t[i:i + size * at_once])
            n += -(-len(parts[-1]) // size)
            if n >= at_once:
                yield rows(parts)
                parts, n = [], 0
    if parts:
        yield rows(parts)


def latent_space(terms: DataFrame, idf: np.ndarray, rank: int = RANK, passage: int = PASSAGE, spare: int = 8, rounds: int = 2, seed: int = 9) -> np.ndarray:
    """``DIMS x rank``: right singular vectors over singular values of the
    passages ``a`` of all rows of ``term_numbers``, by distributed randomised
    SVD.  The last round's ``z = a.T a q`` gives the singular values too:
    ``a.T a`` is about ``z (q.T z)^-1 z.T``."""
    dims, spark, space = len(idf), terms.sparkSession, np.zeros((len(idf), rank), np.float32)
    rng = np.random.Generator(np.random.PCG64(seed))
    basis = np.linalg.qr(rng.standard_normal((dims, rank + spare)))[0]
    idf = spark.sparkContext.broadcast(idf)

    def product(q):
        """``a.T a q`` over all passages."""
        def run(batches):
            z = None
            for pdf in batches:
                for here, a in _passages(pdf["terms"], idf.value, passage):
                    z = np.zeros(q.value.shape, np.float32) if z is None else z
                    z[here] += a.T @ (a @ q.value.take(here, 0))
            if z is not None:
                yield _blocks(z)

        found = _added_up(terms.select("terms"), run)
        return np.concatenate([found[at] for at in sorted(found)]).reshape(basis.shape) if found else None

    z = None
    for _ in range(rounds):
        basis = basis if z is None else np.linalg.qr(z)[0]
        if (z := product(spark.sparkContext.broadcast(basis.astype(np.float32)))) is None:
            return space
    inner = basis.T @ z
    size, turn = np.linalg.eigh((inner + inner.T) / 2)
    some = size > 1e-6 * size[-1]   # fewer directions than asked for: the others stay 0
    v, sigma, _ = np.linalg.svd(z @ (turn[:, some] / np.sqrt(size[some])), full_matrices=False)
    top = min(rank, len(sigma))
    space[:, :top] = (v / sigma)[:, :top]
    return space


def fit_space(docs: DataFrame, scratch: Scratch, sample_docs: int | None = None, dims: int = DIMS, rank: int = RANK) -> np.ndarray:
    """The term vectors of ``fit``."""
    return fit(docs, scratch, sample_docs, dims, rank)[1]


def fit(docs: DataFrame, scratch: Scratch, sample_docs: int | None = None, dims: int = DIMS, rank: int = RANK) -> tuple[np.ndarray, np.ndarray]:
    """(IDF, term vectors: IDF times latent space) of ``docs`` (``doc_id,
    text``), of all rows unless the caller sets ``sample_docs``: then the
    vectors, not the IDF, come from about as many."""
    terms = part = term_numbers(docs, scratch, dims)
    idf = inverse_frequencies(terms, dims)
    if sample_docs is not None and (n := docs.count()) > sample_docs:
        part = terms.where(F.pmod("draw", F.lit(1_000_000)) < math.ceil(1_000_000 * sample_docs / n))
    vectors = (idf[:, None] * latent_space(part, idf, rank)).astype(np.float32)
    scratch.drop("terms")
    return idf, vectors


def common_length(item: list, other: list) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in other:
        if m := places.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _width(n: int) -> int:
    """Window width, in steps, for an item of ``n`` words: the nearest of
    2, 3, 5, 8, ... (steps of ``RATIO``)."""
    if n <= 2 * STEP:
        return 2
    return round(2 * RATIO ** round(math.log(n / (2 * STEP), RATIO)))


class Item:
    """A benchmark item: its words and its answer's words, as hashes."""

    def __init__(self, item_id, text: str):
        words = Words()
        self.item_id, self.hashes = item_id, words(text)
        self.words, self.answer = self.hashes.tolist(), words(answer_of(text)).tolist()
        self.bag = set(self.words)


def _least(share: float, n: int) -> int:
    """The smallest whole number that is at least ``share`` of ``n``."""
    return max(1, math.ceil(share * n - 1e-9))


class WordGate:
    """Places of a text that can hold an item: ``k`` hits among its rarest
    ``n - need + k`` words within ``reach`` words."""

    def __init__(self, items: list[Item], idf: np.ndarray | None, coverage: float, paraphrase: float):
        lists: dict[int, list[int]] = {}
        k, reach = [], []
        for j, item in enumerate(items):
            n = len(item.words)
            need = _least(coverage if item.answer == item.words else min(coverage, paraphrase), n)
            k.append(min(need // 2 + 1, need))
            reach.append(2 * _width(n) * STEP)
            rare = range(n) if idf is None else np.argsort(-idf[(item.hashes % np.uint64(len(idf))).astype(np.int64)], kind="stable")
            for w in {item.words[i] for i in rare[:n - need + k[-1]]}:
                lists.setdefault(w, []).append(j)
        self.k, self.reach = np.array(k, np.int64), np.array(reach, np.int64)
        self.vocabulary = np.array(sorted(lists), np.uint64)
        self.start = np.cumsum([0, *(len(lists[w]) for w in sorted(lists))])
        self.lists = np.array([j for w in sorted(lists) for j in lists[w]], np.int64)
        self.low = np.uint64((1 << max(16, (8 * len(lists)).bit_length())) - 1)   # first look: low bits
        self.known = np.zeros(int(self.low) + 1, bool)
        self.known[(self.vocabulary & self.low).astype(np.int64)] = True

    def __call__(self, hashes: np.ndarray):
        """(item's number, first and end of the words to look at)."""
        if not len(self.k):
            return
        at = np.flatnonzero(self.known[(hashes & self.low).astype(np.int64)])
        if not len(at):
            return
        w = np.minimum(np.searchsorted(self.vocabulary, hashes[at]), len(self.vocabulary) - 1)
        same = self.vocabulary[w] == hashes[at]
        at, w = at[same], w[same]
        n = self.start[w + 1] - self.start[w]
        item = self.lists[np.repeat(self.start[w] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        place = np.repeat(at, n)
        enough = (np.bincount(item, minlength=len(self.k)) >= self.k)[item]
        item, place = item[enough], place[enough]
        if not len(item):
            return
        order = np.argsort(item, kind="stable")
        item, place = item[order], place[order]
        last = np.arange(len(item)) + self.k[item] - 1
        inside = last < len(item)
        last = np.minimum(last, len(item) - 1)
        inside &= (item[last] == item) & (place[last] - place < self.reach[item])
        now = None
        for j, first, end in zip(item[inside].tolist(), place[inside].tolist(), place[last[inside]].tolist()):
            reach = int(self.reach[j])
            if now and now[0] == j and first + reach - now[1] <= 4 * reach:
                now[2] = first + reach
                continue
            if now:
                yield tuple(now)
            now = [j, max(0, end - reach + 1), first + reach]
        if now:
            yield tuple(now)


class ShortItems:
    """Exact places of items of fewer than ``SHORT`` words: the hashes of all
    runs of as many words are looked up."""

    def __init__(self, items: list[Item], offset: int):
        self.known: dict[int, dict[int, list[int]]] = {}   # words: run's hash: items' numbers
        for j, item in enumerate(items, offset):
            n = len(item.words)
            self.known.setdefault(n, {}).setdefault(int(self.runs(item.hashes, n)[0]), []).append(j)
        self.sorted = {n: np.array(sorted(of), np.uint64) for n, of in self.known.items()}

    @staticmethod
    def runs(hashes: np.ndarray, n: int) -> np.ndarray:
        """One hash per run of ``n`` words."""
        h = np.zeros(max(0, len(hashes) - n + 1), np.uint64)
        for i in range(n):
            h = mix(h * _M + hashes[i:i + len(h)])
        return h

    def __call__(self, hashes: np.ndarray):
        """(item's number, first word), the first place of each."""
        for n, known in self.sorted.items():
            runs = self.runs(hashes, n)
            at = np.flatnonzero(known[np.minimum(np.searchsorted(known, runs), len(known) - 1)] == runs)
            for h, first in zip(*np.unique(runs[at], return_index=True)):
                for j in self.known[n][int(h)]:
                    yield j, int(at[first])


class Searcher:
    """Searches texts for the items of one block.  ``idf`` orders words by
    rarity: it makes the word gate faster, not its result another one."""

    def __init__(self, vectors: np.ndarray, items: list[Item], cosine: float, coverage: float, paraphrase: float, idf: np.ndarray | None = None):
        self.vectors, self.words = vectors, Words(len(vectors))
        self.cosine, self.coverage, self.paraphrase = cosine, coverage, paraphrase
        self.items = sorted(items, key=lambda i: len(i.words) < SHORT)   # those of the word gate first
        self.by_width: dict[int, tuple[np.ndarray, np.ndarray]] = {}   # width in steps: items' numbers, vectors
        groups: dict[int, list[int]] = {}
        longer = [i for i in self.items if len(i.words) >= SHORT]
        for j, item in enumerate(longer):
            groups.setdefault(_width(len(item.words)), []).append(j)
        for width, group in groups.items():
            v = np.stack([vectors[self.words.terms(self.items[j].hashes)].sum(axis=0) for j in group])
            self.by_width[width] = (np.array(group), v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9))
        self.gate = WordGate(longer, idf, coverage, paraphrase)
        self.short = ShortItems(self.items[len(longer):], len(longer))
        self.widest = max(self.by_width, default=2) * STEP

    def candidates(self, t: np.ndarray, wanted: np.ndarray):
        """(first word, words, item, cosine) of windows near a wanted item of
        their width.  Latent vectors are summed per step, windows are differences of
        running sums over steps."""
        if not wanted.any():
            return
        full = len(t) // STEP
        each = self.vectors[t]
        steps = each[:full * STEP].reshape(full, STEP, each.shape[1]).sum(axis=1)
        if full * STEP < len(t):
            steps = np.vstack([steps, each[full * STEP:].sum(axis=0)])
        sums = np.vstack([np.zeros((1, steps.shape[1]), np.float32), np.cumsum(steps, axis=0)])
        for width, (items, v) in self.by_width.items():
            if not (on := wanted[items]).any():
                continue
            items, v = items[on], v[on]
            last, apart = len(steps) - width, max(1, width // 4)
            if last <= 0:
                w = sums[-1:] - sums[:1]
            else:
                w = sums[width::apart] - sums[:last + 1:apart]
                if last % apart:   # one more window at the text's end
                    w = np.vstack([w, sums[-1] - sums[last]])
            near = w @ v.T
            norm = np.sqrt(np.einsum("ij,ij->i", w, w))
            for i, j in zip(*np.nonzero(near >= self.cosine * np.maximum(norm, 1e-9)[:, None])):
                yield min(int(i) * apart, max(last, 0)) * STEP, width * STEP, self.items[items[j]], float(near[i, j] / norm[i])

    def confirm(self, item: Item, around: list[int]) -> tuple[int, bool] | None:
        """(common words, by its answer) if the item, of at least ``SHORT``
        words, stands in these words."""
        if len(item.bag.intersection(around)) < self.paraphrase * len(item.bag) / 2:
            return None
        n = common_length(item.words, around)
        if n >= self.coverage * len(item.words):
            return n, False
        if n >= self.paraphrase * len(item.words) and common_length(item.answer, around) >= self.coverage * len(item.answer):
            return n, True
        return None

    def best_run(self, item: Item, words: list[int], lo: int, hi: int) -> tuple[int, bool, int] | None:
        """(common words, by answer, first word) of the best run of ``reach``
        words within ``words[lo:hi]``; only runs that start with a word of the
        item can be best."""
        around, reach = words[lo:hi], 2 * _width(len(item.words)) * STEP
        most = common_length(item.words, around)
        if most < self.coverage * len(item.words) and (
                most < self.paraphrase * len(item.words) or common_length(item.answer, around) < self.coverage * len(item.answer)):
            return None
        best = None
        for a in range(lo, min(hi, len(words))):
            if words[a] in item.bag and (found := self.confirm(item, words[a:min(a + reach, hi)])) and (best is None or found[0] > best[0]):
                best = (*found, a)
                if found[0] == most:
                    break
        return best

    def likeness(self, item: Item, hashes: np.ndarray) -> float:
        """Cosine of an item and some words."""
        a, b = (self.vectors[self.words.terms(h)].sum(axis=0) for h in (item.hashes, hashes))
        return float(a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-9))

    def __call__(self, text: str | None, chunk: int = 4096) -> list[tuple]:
        return self.places(self.words(text), chunk)

    def places(self, hashes: np.ndarray, chunk: int = 4096) -> list[tuple]:
        """(item_id, cosine, common words, item's words, by answer, first word)
        per item found in a text with these words, best place first.  Long texts
        are read in overlapping chunks, so memory stays bounded."""
        best: dict = {}
        if not len(hashes) or not self.items:
            return []
        widest = self.widest
        chunk = max(chunk, 4 * widest)
        for at in range(0, len(hashes), chunk):
            part = hashes[at:at + chunk + 2 * widest]
            for j, a in self.short(part):
                item = self.items[j]
                if item.item_id not in best or best[item.item_id][2] < len(item.words):
                    best[item.item_id] = (item.item_id, self.likeness(item, item.hashes), len(item.words), len(item.words), False, at + a)
            places = list(self.gate(part))
            wanted = np.zeros(len(self.items), bool)
            wanted[[p[0] for p in places]] = True
            near = sorted(self.candidates(self.words.terms(part), wanted), key=lambda c: -c[3])
            words = part.tolist() if near or places else []
            for start, width, item, cos in near:
                if item.item_id in best and best[item.item_id][2] == len(item.words):
                    continue
                if found := self.confirm(item, words[max(0, start - width // 2):start + width + width // 2]):
                    row = (item.item_id, cos, found[0], len(item.words), found[1], at + start)
                    if item.item_id not in best or row[2] > best[item.item_id][2]:
                        best[item.item_id] = row
            for j, lo, hi in places:
                item = self.items[j]
                if item.item_id in best and best[item.item_id][2] == len(item.words):
                    continue
                if (found := self.best_run(item, words, lo, hi)) and (item.item_id not in best or found[0] > best[item.item_id][2]):
                    n, by_answer, a = found
                    best[item.item_id] = (item.item_id, self.likeness(item, part[a:a + len(item.words)]), n, len(item.words), by_answer, at + a)
        return [best[k] for k in sorted(best)]


def _search_udf(schema: str, vectors, idf, items, limits: tuple[float, float, float]):
    """Pandas UDF: text to the items of one broadcast block found in it."""
    names = re.findall(r"(\w+):", schema)

    @F.pandas_udf(schema)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = Searcher(vectors.value, items.value, *limits, idf.value)
        for texts in batches:
            yield pd.Series([[dict(zip(names, r, strict=True)) for r in look.places(h)] for h in look.words.several(texts)], dtype=object)

    return search


def mark_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "leaks", cosine: float = 0.55,
               coverage: float = 0.8, paraphrase: float = 0.6, sample_docs: int | None = None, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``docs`` with an array column ``out`` of the items found in each text."""
    spark, item_kind = docs.sparkSession, dict(benchmark.dtypes)["item_id"]
    schema = f"array<struct<item_id:{item_kind},cosine:double,n_common:int,n_item:int,by_answer:boolean,first_word:int>>"
    items = benchmark.select("item_id", "text").where("item_id is not null and length(text) > 0")
    blocks = math.ceil(items.count() / item_block)
    if not blocks:
        return docs.withColumn(out, F.array().cast(schema))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    idf, vectors = (spark.sparkContext.broadcast(x) for x in fit(rows, Scratch(spark, "decontam"), sample_docs))
    found = []
    for b in range(blocks):
        block = [Item(*r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()]
        sent = spark.sparkContext.broadcast([i for i in block if i.words])
        found.append(_search_udf(schema, vectors, idf, sent, (cosine, coverage, paraphrase))(docs[text_col]))
    return docs.withColumn(out, F.concat(*found) if blocks > 1 else found[0])


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs`` and benchmark item found in it."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return mark_leaks(rows, benchmark, **options).select("doc_id", F.inline("leaks"))
