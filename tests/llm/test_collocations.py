import random
import re
from collections import Counter

import numpy as np
import pytest

from cardprism.llm import collocations as C
from cardprism.llm.common import Scratch
from cardprism.llm.fm_index import BiIndex

AZ = {c: c + 32 for c in range(65, 91)}


def pieces(text):
    return [re.findall("[^ \t]+", p) for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(AZ))]


def counts(rows, longest=4):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for words in pieces(text):
            n[lang] += len(words)
            f.update((lang, tuple(words[i:i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return f, n


def brute(rows, least, longest=4, top=2000, percent=80):
    f, n = counts(rows, longest)
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    gone = set()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            gone |= {(lang, w[i:i + k]) for i in range(len(w) - k + 1) if 100 * a >= percent * cand[lang, w[i:i + k]]}
    out = {}
    for (lang, w), a in cand.items():
        if (lang, w) not in gone:
            score, k = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k) for k in range(1, len(w)))
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {(lang, r + 1, p.decode(), -a, l, x, n[lang], -s) for lang, found in out.items() for r, (s, a, p, l, x) in enumerate(sorted(found)[:top])}


def got(df):
    return {(r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in df.collect()}


def corpus(seed, n=300, words="ab cd E'f gh é 日本 x-1 \x01 q".split(" ")):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", " \t ", ". ", "\n", "!", "; "]) for _ in range(rng.randint(0, 40)))
        out.append((rng.choice(["en", "en", "en", "de", None]), text))
    return [*out, ("fr", None), ("fr", ""), ("es", " .;\n"), ("en", "new york city " * 3000), ("en", "word" * 5000), *[("it", "come va")] * 40]


@pytest.mark.parametrize("shard_tokens", [50, 1 << 21])
def test_against_brute_force(make, shard_tokens):
    rows = corpus(1)
    df = make([(lang, t, 1, 2, "x") for lang, t in rows], "lang string, text string, id int, n int, phrase string", 5)
    for least, top, most in ((5, 2000, 10**6), (5, 2000, 0), (30, 7, 20)):   # phrases broadcast, joined, both
        assert got(C.collocations(df, min_count=least, top=top, shard_tokens=shard_tokens, broadcast_phrases=most)) == brute(rows, least, top=top)


def test_shorter_and_longer_limits(make):
    rows = corpus(2, 100)
    df = make(rows, "lang string, text string")
    for longest in (2, 3, 5):
        assert got(C.collocations(df, 4, longest, shard_tokens=200)) == brute(rows, 4, longest)


def test_extensions_and_counts_of_phrases(make):
    rows = [("en", "a b c. a b d. x a b"), ("en", "a b c")] * 3
    out = {r.phrase: r for r in C.collocations(make(rows, "lang string, text string"), 1, absorb_percent=101).collect()}
    assert (out["a b"].a, out["a b"].left_extension, out["a b"].right_extension) == (12, 3, 6)
    assert out["x a b"].right_extension is None


def test_empty_table_and_no_frequent_word(make):
    empty = make([], "lang string, text string")
    assert C.collocations(empty).count() == 0
    assert C.collocations(make([("en", "one two"), (None, None)], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(10**18, 10**18 - 1, 3)], "a bigint, l bigint, r bigint")
    assert row.selectExpr("cast(2000000 as decimal(10,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as s").first().s == 2_000_000 * 10**18 // (10**18 + 2)


def test_slices_join_to_the_text():
    for text in (b"", b"abc", b"a.b..c.", b"." * 10, b"abcdef.g" * 50):
        for size in (1, 3, 1000):
            parts = list(C.slices(text, size))
            assert b"".join(parts) == text and all(p.startswith(b".") for p in parts[1:])


@pytest.mark.parametrize("depth", [2, 3, 4, 5])
def test_index_extends_to_all_phrases(depth):
    rng = np.random.default_rng(depth)
    seq = np.r_[rng.integers(0, 4, 400) * rng.integers(0, 2, 400) + rng.integers(0, 2, 400), 0].astype(np.int32)
    index = BiIndex(seq, depth)

    def words(k):
        return Counter(tuple(seq[i:i + k]) for i in range(len(seq) - k + 1) if 0 not in seq[i:i + k])

    sym, lo, rlo, n = index.symbols()
    names = [(int(s),) for s in sym]
    for k in range(2, depth + 1):
        up, sym, lo_r, rlo_r, n_r = index.right(lo, rlo, n)
        right = [names[u] + (int(s),) for u, s in zip(up, sym, strict=True)]
        assert dict(zip(right, n_r.tolist(), strict=True)) == words(k)
        up, sym, lo_l, rlo_l, n_l = index.left(lo, rlo, n)
        left = [(int(s),) + names[u] for u, s in zip(up, sym, strict=True)]
        assert dict(zip(left, n_l.tolist(), strict=True)) == words(k)
        at = dict(zip(left, zip(lo_l, rlo_l, strict=True), strict=True))   # both ways meet in the same intervals
        assert all(at[w] == (a, b) for w, a, b in zip(right, lo_r, rlo_r, strict=True))
        names, lo, rlo, n = right, lo_r, rlo_r, n_r


def test_shards_cover_every_word_once(make, spark):
    rows = corpus(3, 200)
    f, seen = counts(rows, 1)[0], Counter()
    made = C.shards(make(rows, "lang string, text string"), "lang", "text", 100, 12).collect()
    words = {}
    for r in made:
        if r.seq is None:
            words.update({(r.vocabulary, r.base + k): (w.lang, bytes(w.word).decode(), w.n) for k, w in enumerate(r.words)})
    for r in made:
        if r.seq is not None:
            seq = C.unpack(r.seq)
            assert seq[-1] == 0
            seen.update(words[r.vocabulary, x][:2] for x in seq.tolist() if x)
    assert seen == {(a, w[0]): c for (a, w), c in f.items()}
    again = Counter()
    for lang, word, c in words.values():
        again[lang, word] += c
    assert again == seen and len({v for v, _ in words}) > 3
    tables, _ = C.phrases(make(rows, "lang string, text string"), Scratch(spark, "t"), 3, 2, shard_tokens=100)
    assert {(r.lang, r.phrase): r.a for r in tables[1].collect()} == {(a, " ".join(w)): c for (a, w), c in counts(rows)[0].items() if len(w) == 2 and c >= 3}


def test_python_gets_few_wide_rows_at_once(make, spark, monkeypatch):
    name, seen = "spark.sql.execution.arrow.maxBytesPerBatch", []
    before = spark.conf.get(name)
    wide = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) as t")

    def sizes(batches):
        for pdf in batches:
            yield pdf[["id"]].head(1).assign(id=len(pdf))

    longer = C._longer
    monkeypatch.setattr(C, "_longer", lambda *a, **k: seen.append(max(r.id for r in wide.mapInPandas(sizes, "id bigint").collect())) or longer(*a, **k))
    C.collocations(make([("en", "a b c. a b")] * 3, "lang string, text string"), 2).collect()
    assert len(seen) == 3 and max(seen) < 10   # 40 without a limit on bytes
    assert spark.conf.get(name) == before
