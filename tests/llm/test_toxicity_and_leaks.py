import random

import numpy as np

from cardprism.llm import decontam, toxicity
from cardprism.llm.common import Scratch

GOOD = "the house stands near river and people walk there every morning while children play in quiet gardens with their small dogs before school".split()
BAD = ["idiot", "moron", "stupid", "scumbag", "pathetic"]


def corpus(n=900, seed=1, disguise=None):
    rng, rows, marks = random.Random(seed), [], []
    for i in range(n):
        ws = [rng.choice(GOOD) for _ in range(rng.randint(5, 60))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            w = rng.choice(BAD)
            ws[rng.randrange(len(ws))] = disguise(w) if disguise else w
        rows.append((i, " ".join(ws)))
        marks.append((i, 1, toxic))
    return rows, marks


def model_of(docs, make, rows, marks):
    return toxicity.fit(docs(rows), make(marks, "doc_id bigint, quality int, toxic int"))


def test_held_out_accuracy_and_restoration(docs, make):
    rows, marks = corpus()
    model = model_of(docs, make, rows, marks)
    truth = {i: t for i, _, t in marks}
    got = toxicity.score_documents(docs(rows, extra=True), model).select("doc_id", toxicity.held_out().alias("out"), "toxicity.*").collect()
    held = [r for r in got if r.out]
    assert len(held) > 100 and all((r.score >= 0.5) == bool(truth[r.doc_id]) for r in held)
    leet = str.maketrans("ioase", "1045" + "3")
    for disguise in (lambda w: w.translate(leet), lambda w: " ".join(w), lambda w: "".join(c * 4 if c in "aeiou" else c for c in w), lambda w: w.replace("i", "і").replace("o", "о")):
        hidden, labels = corpus(300, seed=2, disguise=disguise)
        want = {i: t for i, _, t in labels}
        found = {r.doc_id: r.toxicity.score >= 0.5 for r in toxicity.score_documents(docs(hidden), model).collect()}
        hits = [found[i] for i in want if want[i]]
        assert sum(hits) >= 0.9 * len(hits) and not any(found[i] for i in want if not want[i])


def test_decoding_by_the_language_model(docs):
    rows, _ = corpus()
    lm = toxicity.language_model(toxicity.char_counts(docs(rows)))
    assert lm.shape == (27, 27, 27) and np.allclose(np.exp(lm).sum(2), 1)
    restore = toxicity.Restorer(lm)
    plain = lambda t: restore(t)[0].decode()
    assert plain("such 1di0t here").split()[1] == "idiot"
    assert "stupid" in plain("x, s t u p i d man")
    assert plain("stuuuupid") == "stupid" and plain("ＳＴÜＰІＤ") == "stupid"
    for text in ("plain words only, nothing hidden!", "the number 12345 and 3.14", "wow!!! ***", "a a b", ""):
        assert plain(text) == text
    assert restore(None) == (b"", 0)
    assert restore("x" * 100_000)[1] == 1 and restore("a " * 50_000)[1] >= 1


def test_counts_cover_whole_texts(docs):
    got = {r.code: r.n for r in toxicity.char_counts(docs(["Ab", "ab c", None, "", "é" * 3])).collect()}
    c = lambda s: sum((ord(x) - 96 if x != " " else 0) * 27 ** (2 - i) for i, x in enumerate(s))
    assert got[c("  a")] == 2 and got[c(" ab")] == 2 and got[c("ab ")] == 2 and got[c("eee")] == 1
    assert sum(got.values()) == 3 + 5 + 4


def test_degenerate_training_sets(docs, make):
    rows = [(1, "some text"), (1, "some text"), (2, None), (None, "x"), (3, "")]
    schema = "doc_id bigint, quality int, toxic int"
    for marks, low in (([(1, 0, 0), (2, 0, 0)], True), ([(None, 1, None)], True), ([(1, 1, 1), (2, 1, 1), (1, 1, 0)], False)):
        model = model_of(docs, make, rows, marks)
        scores = [r.toxicity.score for r in toxicity.score_documents(docs(rows), model).collect()]
        assert len(scores) == 5 and all(0 <= s <= 1 and (s < 0.5) == low for s in scores)
    none = docs(rows).where("false")
    model = toxicity.fit(none, make([(1, 1, 1)], schema))
    assert toxicity.score_documents(none, model).count() == 0


WORDS = decontam.Words()


def brute_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence():
    rng = random.Random(8)
    for _ in range(300):
        a, b = ([rng.choice([b"x", b"y", b"z"]) for _ in range(rng.randint(0, 90))] for _ in range(2))
        assert decontam.common_length(a, b) == brute_lcs(a, b)


def leaky_corpus(rng, n_items=60, n_docs=400):
    vocabulary = [f"w{i}" for i in range(1500)]
    weights = [1 / (i + 3) for i in range(1500)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(i, " ".join(text(n)) + ". " + " ".join(text(6)) + ".") for i, n in enumerate(rng.choices([8, 20, 50, 90], k=n_items))]
    rows, truth = [], set()
    for d in range(n_docs):
        ws = text(rng.choice([0, 5, 60, 300, 1500]))
        kind = d % 4
        if kind in (1, 2):
            i = rng.randrange(n_items)
            part = items[i][1].split()
            if kind == 2:  # paraphrase: about one word in seven is another one
                part = [x if rng.random() > 0.13 else rng.choice(vocabulary) for x in part]
            at = rng.randint(0, len(ws))
            ws[at:at] = part
            truth.add((d, i, kind))
        rows.append((d, " ".join(ws).upper() if d % 3 else "\n".join(ws)))
    return items, rows, truth


def test_search_recall_against_brute_force(docs, make):
    """Brute force: the best common subsequence over all windows."""
    items, rows, truth = leaky_corpus(random.Random(9))
    bench = make(items, "item_id int, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(rows, extra=True), bench).collect()}
    known = [decontam.Item(*i) for i in items]
    want = set()
    for d, t in rows:
        ws = WORDS(t).tolist()
        for item in known:
            if len(item.bag.intersection(ws)) < 0.8 * len(item.bag):
                continue
            n = len(item.words)
            if any(decontam.common_length(item.words, ws[a:a + n + n // 2]) >= 0.8 * n for a in range(0, max(1, len(ws) - n + 1), 3)):
                want.add((d, item.item_id))
    assert len(want) > 150 and len(got & want) >= 0.97 * len(want)
    verbatim = {(d, i) for d, i, kind in truth if kind == 1}
    assert verbatim <= got
    assert {d for d, _ in got} <= {d for d, _, _ in truth} | {d for d, _ in want}


def test_items_in_blocks_and_odd_rows(docs, make):
    items, rows, _ = leaky_corpus(random.Random(10), 12, 60)
    items += [(None, items[0][1]), (70, None), (71, ""), (72, "... "), (73, items[0][1]), (74, "two words"), (1, items[1][1])]
    rows += [(None, items[0][1]), (500, None), (501, ""), (502, "here two words stand"), (503, "two other words"), (504, items[1][1]), (504, items[1][1])]
    bench = make(items, "item_id int, text string")
    one = sorted(tuple(r) for r in decontam.find_leaks(docs(rows), bench).select("doc_id", "item_id").na.fill(-1).collect())
    many = sorted(tuple(r) for r in decontam.find_leaks(docs(rows), bench, item_block=5).select("doc_id", "item_id").na.fill(-1).collect())
    assert one == many
    assert (-1, 0) in one and (-1, 73) in one and (502, 74) in one and not any(d in (500, 501, 503) for d, _ in one) and one.count((504, 1)) >= 2
    empty = docs(rows).where("false")
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(docs(rows), bench.where("false")).count() == 0


def test_long_text_is_searched_to_its_end(docs, make, spark):
    items, rows, _ = leaky_corpus(random.Random(12), 10, 100)
    vectors = decontam.fit_space(docs(rows), Scratch(spark, "t"))
    search = decontam.Searcher(vectors, [decontam.Item(*i) for i in items], 0.6, 0.8, 0.6)
    rng = random.Random(3)
    noise = [f"n{rng.randrange(5000)}" for _ in range(60_000)]
    for at in (0, 4090, 4096, 30_001, 60_000):
        found = search(" ".join(noise[:at] + [items[3][1]] + noise[at:]))
        assert [f[0] for f in found] == [3] and abs(found[0][5] - at) <= 60


def kept_parts(rng, n_items=40, n_docs=120, names="w", lengths=(300, 1500, 6000)):
    """Items of 15 to 30 words, and long texts that keep 60 to 70 % of an
    item's words, its answer among them, at random places of its length."""
    vocabulary = [f"{names}{i}" for i in range(3000)]
    weights = [1 / (i + 3) for i in range(3000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(i, " ".join(text(rng.randint(15, 30) - 5)) + ". " + " ".join(text(5)) + ".") for i in range(n_items)]
    rows = []
    for d in range(n_docs):
        part = items[d % n_items][1].split()
        n, share = len(part), rng.uniform(0.62, 0.7)
        lost = set(rng.sample(range(n - 5), min(n - 5, int((1 - share) * n))))
        part = [rng.choice(vocabulary[500:]) if i in lost else w for i, w in enumerate(part)]
        ws = text(rng.choice(lengths))
        at = rng.randint(0, len(ws))
        ws[at:at] = part
        rows.append((d, " ".join(ws)))
    return items, rows


def brute_leaks(items, rows, coverage=0.8, paraphrase=0.6):
    """All pairs, every run of 3/2 of an item's words, both branches of the check."""
    known, want = [decontam.Item(*i) for i in items], set()
    for d, t in rows:
        ws = WORDS(t).tolist()
        for item in known:
            n, reach = len(item.words), len(item.words) * 3 // 2
            inside = [w in item.bag for w in ws]
            sums = [0]
            for x in inside:
                sums.append(sums[-1] + x)
            for a in range(len(ws)):
                if not inside[a] or sums[min(a + reach, len(ws))] - sums[a] < paraphrase * n:
                    continue
                run = ws[a:a + reach]
                common = decontam.common_length(item.words, run)
                if common >= coverage * n or (common >= paraphrase * n and decontam.common_length(item.answer, run) >= coverage * len(item.answer)):
                    want.add((d, item.item_id))
                    break
    return want


def test_paraphrases_by_answer_against_brute_force(docs, make):
    items, rows = kept_parts(random.Random(31))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(rows), make(items, "item_id int, text string")).collect()}
    want = brute_leaks(items, rows)
    assert len(want) >= 110 and want <= got
    planted = {(d, d % 40) for d, _ in rows}
    assert len(got - planted - want) <= 0.1 * len(want)


def two_sources(n_docs, lengths=(60, 300)):
    """A common source and a rare one (1 text in 60) of other words, each with
    items of its own."""
    items, rows = kept_parts(random.Random(n_docs), 20, n_docs, "w", lengths)
    rare_items, rare = kept_parts(random.Random(n_docs + 1), 3, max(3, n_docs // 60), "r", lengths)
    return items + [(1000 + i, t) for i, t in rare_items], rows + [(100_000 + d, t) for d, t in rare]


def test_recall_does_not_hang_on_the_sample(docs, make):
    for n_docs in (60, 240, 720):
        items, rows = two_sources(n_docs)
        bench, want = make(items, "item_id int, text string"), brute_leaks(items, rows)
        found = [{(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(rows), bench, sample_docs=k).collect()} for k in (10, 10_000)]
        assert found[0] == found[1] and want <= found[0]
        assert len(want) >= 0.95 * len(rows) and sum(d >= 100_000 for d, _ in want) >= 3


def test_latent_space_is_that_of_all_documents(docs, spark):
    """Against a full SVD of all passages of more texts than a part of 1,500."""
    rng = random.Random(51)
    common, rare = [[f"{c}{i}" for i in range(7)] for c in "cr"]
    rows = [(d, " ".join(rng.choices(rare if d % 40 == 7 else common, k=rng.randint(1, 150)))) for d in range(2400)] + [(None, None), (1, "")]
    vectors = decontam.fit_space(docs(rows), Scratch(spark, "t"), rank=8)
    numbers = [WORDS.terms(WORDS(t)) for _, t in rows if t]
    seen = np.zeros(decontam.DIMS)
    for t in numbers:
        seen[np.unique(t)] += 1
    idf, used = np.log((1 + len(numbers)) / (1 + seen)) + 0.1, np.flatnonzero(seen)
    passages = [np.bincount(t[i:i + decontam.PASSAGE], minlength=decontam.DIMS) * idf for t in numbers for i in range(0, len(t), decontam.PASSAGE)]
    a = np.stack([p / np.linalg.norm(p) for p in passages])[:, used]
    space = vectors[used] / idf[used][:, None]   # columns: singular vectors over singular values
    assert np.allclose((a @ space).T @ (a @ space), np.eye(8), atol=1e-3)
    assert np.allclose(1 / np.linalg.norm(space, axis=0)[:2], np.linalg.svd(a, compute_uv=False)[:2], rtol=1e-3)


def test_texts_hashed_together_as_alone():
    rng = random.Random(52)
    texts = [None, "", " ", "one", "a b", "\u00a1Hola! \u4e2d\u6587\u3002x", *(" ".join(f"w{rng.randrange(99)}" for _ in range(rng.randrange(3000))) for _ in range(30)), "x" * 50, ""]
    for size in (1, 100, 1 << 15):
        together = list(WORDS.several(texts, size))
        assert len(together) == len(texts) and all(np.array_equal(h, WORDS(t)) for h, t in zip(together, texts, strict=True))
    assert list(WORDS.several([])) == []


def test_short_items_in_long_texts(docs, make):
    """Items of 1 to 9 words verbatim inside long texts, also across the ends
    of the parts in which texts are read."""
    rng = random.Random(41)
    vocabulary = [f"w{i}" for i in range(2000)]
    weights = [1 / (i + 3) for i in range(2000)]
    text = lambda n: rng.choices(vocabulary, weights, k=n)
    items = [(k, " ".join(f"q{k}x{i}" if i % 2 else w for i, w in enumerate(text(1 + k % 9)))) for k in range(45)]
    items = [(k, t if " " in t else f"q{k}") for k, t in items]
    rows, truth = [], set()
    for d in range(90):
        ws = text(rng.choice([200, 3000, 9000]))
        at = min(rng.choice([0, 5, 4094, len(ws), rng.randrange(len(ws))]), len(ws))
        part = items[d % 45][1].split()
        ws[at:at] = part
        truth.add((d, d % 45))
        rows.append((d, " ".join(ws)))
        if 2 <= len(part) < decontam.SHORT:   # all its words, but not in a row
            rows.append((500 + d, " ".join([*text(300), *(x for w in part for x in (w, "between")), *text(300)])))
    got = {(r.doc_id, r.item_id) for r in decontam.find_leaks(docs(rows), make(items, "item_id int, text string")).collect()}
    assert truth <= got
    text_of, joined = dict(rows), lambda t: f" {t} "
    short = {k: t for k, t in items if len(t.split()) < decontam.SHORT}
    assert {g for g in got if g[1] in short} == {(d, k) for d, t in text_of.items() for k, i in short.items() if joined(i) in joined(t)}
    assert not any(d >= 500 for d, _ in got)
    found = decontam.find_leaks(docs(rows), make([i for i in items if i[0] in short], "item_id int, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {g for g in got if g[1] in short}
    assert decontam.find_leaks(docs(rows), make([(1, "none such")], "item_id int, text string")).count() == 0
