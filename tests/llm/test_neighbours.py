import math
from itertools import combinations

import numpy as np
import pytest

from cardprism.llm import neighbours as N

SCHEMA = "vec_id bigint, embedding array<double>, rep int, keys string, part int"


def frame(make, rows, schema=SCHEMA, parts=4):
    return make([(i, v, 1, "k", 2) for i, v in rows], schema, parts)


def usable(rows):
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    sizes = [len(v) for _, v in ok]
    size = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 0
    return sorted({r for r in ok if len(r[1]) == size})


def brute(rows, k, every):
    rows, out = usable(rows), {}
    V = np.array([v for _, v in rows])
    for i, v in rows:
        if i % every == 0:
            d = np.sqrt(((V - np.array(v)) ** 2).sum(1))
            near = sorted((float(x), j) for x, (j, _) in zip(d, rows, strict=True) if j != i)[:k]
            out.setdefault(i, []).append([(r + 1, j, x) for r, (x, j) in enumerate(near)])
    return out


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


def recall(found, true, k):
    hit = sum(len({j for _, j, _ in found.get(i, [])} & {j for _, j, _ in lists[0]}) for i, lists in true.items())
    return hit / sum(len(lists[0]) for lists in true.values())


def points(n, dim, seed, spread=0.0):
    rng = np.random.default_rng(seed)
    V = rng.standard_normal((n, dim))
    if spread:
        V = V[rng.integers(0, max(1, n // 40), n)] + spread * rng.standard_normal((n, dim))
    return [(i, v.tolist()) for i, v in enumerate(V)]


@pytest.mark.parametrize(("dim", "spread"), [(4, 0), (64, 0), (32, 0.2)])
def test_recall_against_brute_force(make, dim, spread):
    rows = points(2000, dim, dim, spread)
    found, true = got(N.nearest(frame(make, rows), every=20)), brute(rows, 10, 20)
    assert set(found) == set(true) and all(len(x) == 10 for x in found.values())
    assert recall(found, true, 10) >= 0.9
    for i, near in found.items():   # true distances, in order
        d = {j: math.dist(rows[i][1], rows[j][1]) for _, j, _ in near}
        assert all(abs(d[j] - x) < 1e-12 for _, j, x in near) and i not in d
        assert [(x, j) for _, j, x in near] == sorted((x, j) for _, j, x in near) and [r for r, _, _ in near] == list(range(1, 11))


def wide(dim, probes=1):
    return N.Hashes(dim, 1, 1e9, probes)   # one bucket holds all: the search must be exact


def test_exact_where_all_share_a_bucket_and_buckets_are_split(make):
    same, rng = [1.0, 2.0, 3.0], np.random.default_rng(1)
    rows = [(i, same) for i in range(300)] + [(1000 + i, rng.integers(0, 3, 3).astype(float).tolist()) for i in range(700)]
    rows += [(0, same), (0, same), (5000, same), (5000, [9.0, 9.0, 9.0])]   # repeated rows, an id with two vectors
    for part_bytes in (64 << 20, 48 * 20):
        out = N.nearest(frame(make, rows), k=5, every=100, hashes=wide(3, 3), part_bytes=part_bytes)
        found, true = got(out), brute(rows, 5, 100)
        assert {i: sorted(x) for i, x in found.items()} == {i: sorted(sum(lists, [])) for i, lists in true.items()}


def test_rows_that_take_no_part(make):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]),
            (None, [1.0, 1.0]), (7, []), (8, [1.0]), (100, [0.0, 0.0]), (200, None), (300, [-0.0, 1.0]), (9, [1e200, 1.0])]
    assert got(N.nearest(frame(make, rows), hashes=wide(2, 3), k=10)) == {i: x[0] for i, x in brute(rows, 10, 100).items()}


def test_small_and_empty_tables(make, spark):
    for schema in (SCHEMA, SCHEMA.replace("double", "float")):
        assert N.nearest(frame(make, [], schema)).count() == 0
    assert N.nearest(frame(make, [(1, [1.0, 2.0]), (2, [2.0, 1.0])])).count() == 0   # no query
    assert N.nearest(frame(make, [(0, [1.0, 2.0])])).count() == 0                    # no candidate
    assert got(N.nearest(frame(make, [(0, [1.0, 2.0]), (1, [1.0, 2.0])]))) == {0: [(1, 1, 0.0)]}
    dotted = spark.createDataFrame([(0, [1.0]), (3, [2.0])], "`a.id` bigint, `a.v` array<float>")
    assert N.nearest(dotted, id_col="a.id", vec_col="a.v").columns == ["query_id", "rank", "a.id", "score"]


def test_template_is_every_set_of_moves_by_expected_cost():
    m = 3
    j = np.arange(1, 2 * m + 1)
    up = 2 * m + 1 - j
    cost = np.where(j <= m, j * (j + 1) / (4 * (m + 1) * (m + 2)), 1 - up / (m + 1) + up * (up + 1) / (4 * (m + 1) * (m + 2)))
    sets = [c for r in range(2 * m + 1) for c in combinations(range(2 * m), r) if len({min(a, 2 * m - 1 - a) for a in c}) == r]
    out = [tuple(np.flatnonzero(row)) for row in N.template(m, 10_000)]
    assert sorted(out) == sorted(sets) and len(set(out)) == 3 ** m
    spent = [sum(cost[a] for a in c) for c in out]
    assert spent == pytest.approx(sorted(sum(cost[a] for a in c) for c in sets))


def test_probes_are_the_buckets_of_moved_slots():
    h = N.Hashes(5, 4, 1.3, 81, 2)
    V = np.random.default_rng(2).standard_normal((20, 5))
    for t in range(2):
        probes = h.probe(V, t)
        assert (probes[:, 0] == h.keys(V, t)).all()
        slot, off = h._slots(V, t)
        for q in range(20):
            keys, costs = [], []
            for moves in np.ndindex(*[3] * 4):
                step = np.array(moves) - 1
                keys.append(int(((slot[q] + step) * h.mixer[t]).sum() + h.salt[t]))
                costs.append(float(np.where(step < 0, off[q] ** 2, np.where(step > 0, (1 - off[q]) ** 2, 0)).sum()))
            assert sorted(keys) == sorted(probes[q].tolist())   # each bucket once
            assert np.argmin(costs) == keys.index(int(probes[q, 0]))


def test_a_fit_for_close_neighbours_visits_few_points():
    rng = np.random.default_rng(3)
    asked = rng.standard_normal((40, 32))
    near, of = np.repeat(asked, 5, axis=0) + 0.02 * rng.standard_normal((200, 32)), np.repeat(np.arange(40), 5)
    sample = rng.standard_normal((2000, 32))
    h = N.choose(asked, near, of, sample, 0.12)
    visited = np.mean([np.isin(h.keys(sample, t), h.probe(asked[q:q + 1], t)[0]).mean() for t in range(2) for q in range(40)])
    assert visited < 0.05
