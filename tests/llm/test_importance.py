import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from cardprism.llm import importance
from cardprism.llm.common import Scratch
from cardprism.llm.ranking import number_rows

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
AZ = {c: c + 32 for c in range(65, 91)}


def brute(rows, target, percent, ngram=1, buckets=100, seed=2024, min_words=3):
    """Resampling over lists: (id, n_features, weight, score, rank) of each row."""
    def feats(text):
        words = WORD.findall((text or "").translate(AZ))
        runs = [" ".join(words[i:i + n]) for n in range(1, ngram + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(r.encode()) % buckets for r in runs]

    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(feats(text)[1])
    for text in target:
        t.update(feats(text)[1])
    S, T = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        n, f = feats(text)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in f)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = total // len(f) if f else 0
        out.append((n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    able = sorted((x for x in out if x[0] >= min_words), key=lambda x: (-x[4], x[1] is None, x[1]))
    k = percent * len(able) // 100
    left = Counter((x[1], *x[2:], r + 1) for r, x in enumerate(able[:k]))
    rest = Counter((x[1], *x[2:], None) for x in [*able[k:], *[x for x in out if x[0] < min_words]])
    return left + rest


def got(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r.rank) for r in df.collect())


TEXTS = [None, "", " ,;", "One two THREE", "Été d'été 2024!", "x" * 70_000, "word " * 5000, "a b c d", "a b c d", "日本 語 テキスト", "\x00zero\x00byte one two"]


@pytest.mark.parametrize("percent", [0, 10, 55, 100])
@pytest.mark.parametrize("ngram", [1, 2])
def test_resample_against_brute_force(docs, make, percent, ngram):
    rows = [*enumerate(TEXTS), *[(100 + i, f"a b c {i % 7} d{i % 3}") for i in range(200)], (7, "a b c d"), (7, "a b c d"), (None, "p q r s")]
    target = ["a b d1", None, "", "two three"]
    t = make([(x,) for x in target], "text string")
    out = importance.resample(docs(rows, extra=True), t, percent, ngram=ngram, buckets=100, min_words=3)
    assert got(out) == brute(rows, target, percent, ngram)


def test_exactly_as_many_as_wanted_where_equal_rows_meet_the_cutoff(docs, make):
    rows = [(5, "a b c")] * 10
    out = importance.resample(docs(rows), make([("a",)], "text string"), 35, buckets=10, min_words=1).collect()
    assert sorted(r.rank for r in out if r.rank) == [1, 2, 3]


def test_empty_tables_and_clashing_names(docs, make):
    empty = make([], "text string")
    assert importance.resample(docs([]), empty, 10).count() == 0
    out = importance.resample(docs([(1, "a b c")]), empty, 100, min_words=1, buckets=10).collect()
    assert out[0].rank == 1
    kept = importance.resample(docs([(1, "a b c")], extra=True), empty, 100, min_words=1, keep=("lang", "name")).collect()
    assert kept[0].lang == "en" and kept[0].name == "n"
    with pytest.raises(ValueError):
        importance.resample(docs([(1, "a")]).selectExpr("*", "1 as rank"), empty, 10, keep=("rank",))
    dotted = docs([(1, "a b c")]).selectExpr("*", "7 as `meta.url`")
    assert importance.resample(dotted, empty, 100, min_words=1, keep=("meta.url",)).collect()[0]["meta.url"] == 7


def test_bracket_holds_the_rank_whatever_the_sketch_says(spark):
    for scores in ([5] * 1000, list(range(1000)), [0] * 990 + list(range(10)), [1]):
        rows = spark.createDataFrame([(x,) for x in scores], "score bigint").repartition(3)
        best = sorted(scores, reverse=True)
        for accuracy in (2, 10_000):
            for k in {1, max(1, len(scores) // 10), len(scores)}:
                lo, hi, above = importance.bracket(rows, k, len(scores), accuracy, slack=0.01)
                assert lo <= best[k - 1] <= hi and above == sum(x > hi for x in scores)


def test_numbers_run_on_over_ranges(spark):
    rows = spark.createDataFrame([(i * 7919 % 5000, i) for i in range(5000)], "x bigint, y bigint").repartition(8)
    out = number_rows(rows, ["x"], Scratch(spark, "t"), "n")
    assert [(r.x, r.rank) for r in out.collect()] == [(r.x, r.x + 1) for r in out.collect()]
    assert out.agg({"rank": "max"}).first()[0] == 5000
