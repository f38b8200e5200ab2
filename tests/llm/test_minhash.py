import random

import numpy as np

from cardprism.llm import components, minhash
from cardprism.llm.common import Scratch, words_of


def shingle_set(text, k=5):
    words = words_of(text)
    k = min(k, len(words))
    return {tuple(words[i:i + k]) for i in range(len(words) - k + 1)} if words else set()


def brute(rows, percent=85):
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingle_set(t))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    flat = [(i, s) for i, many in sets.items() for s in many if s]
    for k, (i, a) in enumerate(flat):
        for j, b in flat[:k]:
            both = len(a & b)
            if 100 * both >= percent * (len(a) + len(b) - both):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i in sets}


def family(rng, words, n, edits):
    """A text and copies of copies: chains whose ends are less similar."""
    text, out = list(words), []
    for _ in range(n):
        out.append(" ".join(text))
        text = list(text)
        for _ in range(edits):
            text[rng.randrange(len(text))] = f"w{rng.randrange(10**6)}"
    return out


def check(docs, texts, **options):
    got = minhash.near_duplicates(docs(texts, extra=True), **options).collect()
    want = brute(texts)
    assert len(got) == len(texts)
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id]), r
    return got


def test_components_against_brute_force(docs):
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"v{rng.randrange(300)}" for _ in range(rng.choice([30, 120, 400]))]
        texts += family(rng, base, rng.choice([2, 5, 12]), rng.choice([1, 2, 6]))
    texts += ["one two three", "ONE  two\nthree", "one two", "", None, " \t", "a b c d e", "A B C D E", "é b c d e", "É b c d e"] * 2
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    got = {r.doc_id: r for r in check(docs, rows)}
    for i, t in rows:
        assert got[i].n_shingles == len(shingle_set(t))


def test_large_buckets_meet_in_blocks(docs, monkeypatch):
    """Buckets beyond SMALL are compared block by block and lose no link;
    nothing is broadcast."""
    monkeypatch.setattr(minhash, "SMALL", 2)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    monkeypatch.setattr(minhash, "BROADCAST_PAIRS", 0)
    rng = random.Random(2)
    texts = family(rng, [f"v{i}" for i in range(120)], 25, 1) + family(rng, [f"v{i}" for i in range(90)], 15, 2)
    rows = list(enumerate(rng.sample(texts, len(texts))))
    check(docs, rows, rows=1, bands=20)


def test_intersections():
    rng = np.random.default_rng(3)
    a, b = ([np.unique(rng.integers(0, 60, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)] for _ in range(2))
    got = minhash.intersections(a, b, columns=7)
    assert all(got[i, j] == len(np.intersect1d(a[i], b[j])) for i in range(9) for j in range(9))


def test_repeated_and_missing_ids(docs):
    text = " ".join(f"w{i}" for i in range(50))
    other = " ".join(f"u{i}" for i in range(50))
    check(docs, [(5, text), (5, other), (7, text), (3, other), (None, text), (None, None), (9, text), (9, text)])
    assert minhash.near_duplicates(docs([(1, "a")]).where("false")).count() == 0


def test_signature_keys_are_shared_by_similar_sets_only():
    signer = minhash.Signer()
    base = [f"w{i}" for i in range(400)]
    near = base[:200] + ["x"] + base[201:]
    far = base[:100] + [f"z{i}" for i in range(300)]
    key = lambda ws: set(signer.keys(signer.shingles(" ".join(ws))).tolist())
    assert key(base) & key(near) and len(key(base) & key(far)) <= 3


def test_star_rounds_on_a_long_chain(make, spark):
    rng = random.Random(1)
    ids = list(range(0, 400))
    rng.shuffle(ids)
    edges = list(zip(ids[:300], ids[1:300])) + [(ids[350], ids[351]), (ids[351], ids[350]), (ids[360], ids[360])]
    got = {r.node: r.component for r in components.connected_components(make(edges, "u bigint, v bigint"), Scratch(spark, "cc"), "c").collect()}
    low = min(ids[:300])
    want = {i: low for i in ids[:300] if i != low} | {max(ids[350:352]): min(ids[350:352])}
    assert got == want
