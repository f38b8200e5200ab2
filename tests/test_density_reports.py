"""Density primitives against brute force, and the report export bundle."""

import numpy as np
import pytest

from cardprism.operators import density as D


@pytest.fixture(scope="module")
def pts(spark):
    rng = np.random.RandomState(5)
    X = np.vstack([rng.normal([0, 0], 0.3, size=(40, 2)), rng.normal([5, 5], 0.3, size=(40, 2)),
                   rng.uniform(-3, 8, size=(6, 2))])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "id long, v array<double>")
    return df, X


def test_core_distance_and_knn(pts):
    df, X = pts
    m = 4
    neigh = D.knn(df, m, True, block_size=16)
    core = {r["id"]: r["core_distance"] for r in D.core_distances(neigh, m).collect()}
    Dm = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    exp = np.sort(Dm, axis=1)[:, m - 1]
    for i in range(len(X)):
        assert core[i] == pytest.approx(exp[i])


def test_components_and_cut(pts, spark):
    edges = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.1), (3, 4, 0.1), (10, 11, 0.1), (4, 10, 5.0)],
                                  "src long, dst long, weight double")
    v = spark.createDataFrame([(i,) for i in [1, 2, 3, 4, 10, 11, 12]], "id long")
    cc = {r["id"]: r["comp"] for r in D.connected_components(v, edges.where("weight < 1")).collect()}
    assert cc == {1: 1, 2: 1, 3: 1, 4: 1, 10: 10, 11: 10, 12: 12}
    cut = {r["id"]: r["cluster"] for r in D.density_cut(v, edges, 1.0, 3).collect()}
    assert cut[1] == 0 and cut[10] == -1 and cut[12] == -1


def _union_find(n, pairs):
    par = list(range(n))

    def find(x):
        while par[x] != x:
            par[x] = par[par[x]]
            x = par[x]
        return x
    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            par[max(ra, rb)] = min(ra, rb)
    groups = {}
    for i in range(n):
        groups.setdefault(find(i), []).append(i)
    return {i: min(g) for g in groups.values() for i in g}


def test_components_random_graph(spark):
    rng = np.random.RandomState(11)
    n = 300
    pairs = [(int(a), int(b)) for a, b in rng.randint(0, n, size=(260, 2))]
    chain = list(range(200, 300))   # a long chain in shuffled order as well
    rng.shuffle(chain)
    pairs += list(zip(chain[:-1], chain[1:]))
    v = spark.createDataFrame([(i,) for i in range(n)], "id long")
    e = spark.createDataFrame(pairs, "src long, dst long").repartition(7)
    got = {r["id"]: r["comp"] for r in D.connected_components(v, e).collect()}
    assert got == _union_find(n, pairs)


def _reach(X, m):
    Dm = np.sqrt(((X[:, None] - X[None]) ** 2).sum(-1))
    core = np.sort(Dm, axis=1)[:, m - 1]
    return np.maximum(np.maximum(Dm, core[:, None]), core[None])


def _prim(W):
    n, inside, edges = len(W), [0], []
    out = set(range(1, n))
    while out:
        w, a, b, j = min((W[i, j], min(i, j), max(i, j), j) for i in inside for j in out)
        edges.append((w, a, b))
        inside.append(j)
        out.remove(j)
    return edges


def _hdbscan(X, size, m):
    """The textbook way: single linkage over all points, condensed tree,
    excess of mass; returns the set of clusters (as frozen sets)."""
    n = len(X)
    edges = sorted(_prim(_reach(X, m)))
    members, at = {i: [i] for i in range(n)}, {i: i for i in range(n)}
    kids, dist = {}, {}
    for k, (w, i, j) in enumerate(edges):
        a, b, new = at[i], at[j], n + k
        members[new], kids[new], dist[new] = members[a] + members[b], (a, b), w
        for x in members[new]:
            at[x] = new
    clusters = {}   # condensed: birth level, point -> leaving level, children

    def walk(node, cid):
        stack = [node]
        while stack:
            x = stack.pop()
            if x not in kids:
                continue
            lam = 1 / dist[x]
            big = [c for c in kids[x] if len(members[c]) >= size]
            if len(big) == 2:
                for c in big:
                    new = len(clusters)
                    clusters[new] = {"birth": lam, "points": {}, "kids": [], "all": members[c]}
                    clusters[cid]["kids"].append(new)
                    clusters[cid]["points"].update({p: lam for p in members[c]})
                    walk(c, new)
            else:
                for c in kids[x]:
                    if c in big:
                        stack.append(c)
                    else:
                        clusters[cid]["points"].update({p: lam for p in members[c]})

    clusters[0] = {"birth": 0.0, "points": {}, "kids": [], "all": list(range(n))}
    walk(max(kids), 0)
    best, chosen = {}, {}
    for c in sorted(clusters, reverse=True):
        mass = sum(lam - clusters[c]["birth"] for lam in clusters[c]["points"].values())
        below = sum(best[k] for k in clusters[c]["kids"])
        chosen[c] = c != 0 and not (clusters[c]["kids"] and below > mass)
        best[c] = mass if chosen[c] else below
    found, stack = set(), [0]
    while stack:
        c = stack.pop()
        if chosen[c]:
            found.add(frozenset(clusters[c]["all"]))
        else:
            stack += clusters[c]["kids"]
    return found


def _blobs(seed, n=90):
    rng = np.random.RandomState(seed)
    centers = rng.uniform(0, 12, size=(5, 2))
    return np.vstack([rng.normal(centers[i % 5], 0.2 + 0.25 * (i % 5), size=(1, 2)) for i in range(n)] + [rng.uniform(-4, 16, size=(15, 2))])


@pytest.mark.parametrize("seed,size,m", [(1, 5, 3), (2, 8, 5), (3, 10, 3)])
def test_density_clusters_equal_the_textbook_algorithm(spark, seed, size, m):
    X = _blobs(seed)
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "id long, v array<double>")
    neigh = D.knn(df, m, True, block_size=40)
    tree = D.minimum_spanning_tree(df, D.core_distances(neigh, m), block_size=40)
    got = tree.collect()
    assert len(got) == len(X) - 1
    assert sum(r["weight"] for r in got) == pytest.approx(sum(w for w, _, _ in _prim(_reach(X, m))))
    labels = {}
    for r in D.eom_select(df, tree, size).collect():
        labels.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(v) for k, v in labels.items() if k != -1} == _hdbscan(X, size, m)


def test_sweep_shares_one_neighbour_pass(pts):
    df, X = pts
    one, other = D.density_sweep(df, [(10, 4), (10, 3)], block_size=32)
    lab = {r["id"]: r["cluster"] for r in one.collect()}
    a, b = {lab[i] for i in range(40)} - {-1}, {lab[i] for i in range(40, 80)} - {-1}
    assert len(a) == 1 and len(b) == 1 and a != b
    assert other.count() == len(X)


def test_export_report(spark, tmp_path):
    from cardprism.plans.q_features import features_of
    from cardprism.plans.report import export_report
    f = features_of(spark, "/root/testdata/sf0.001", "events")
    labels = f.select("card_id", (f.card_id % 3).cast("int").alias("cluster"))
    pts = f.select(f.card_id.alias("id"), __import__("pyspark.sql.functions", fromlist=["array"]).array("avg_amount", "tx_count").cast("array<double>").alias("v"))
    out = export_report(f, labels, pts, None, str(tmp_path / "rep"), algorithm="fixed")
    assert spark.read.parquet(out["segments"]).count() == f.count()
    assert spark.read.parquet(out["summary"]).count() == 3
    assert spark.read.json(out["insights"]).count() == 3
    import json
    doc = json.loads(spark.read.text(out["technical"]).first()[0])
    assert doc["quality_metrics"]["n_clusters"] == 3


def _report_inputs(spark, n=60):
    from cardprism.schema import AGGREGATE_FEATURES, DERIVED_FEATURES, INTEGER_FEATURES
    cols = [f"cast(1 + id % 7 as {'bigint' if c in INTEGER_FEATURES else 'double'}) as {c}" for c in AGGREGATE_FEATURES + DERIVED_FEATURES]
    f = spark.range(n).selectExpr("id as card_id", *cols)
    labels = f.selectExpr("card_id", "cast(card_id % 3 as int) as cluster")
    return f, labels, f.selectExpr("card_id as id", "array(avg_amount, cast(tx_count as double), cast(card_id as double)) as v")


def test_report_appears_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """Killed after each of its seven writes, an export leaves the last one."""
    from cardprism.plans import report
    from cardprism.sources import sinks
    f, labels, pts = _report_inputs(spark)
    base = str(tmp_path / "rep")
    calls, limit = [0], [None]

    def killed(fn):
        def run(*args, **kw):
            if calls[0] == limit[0]:
                raise RuntimeError("killed")
            calls[0] += 1
            return fn(*args, **kw)
        return run

    for name in ("save_table", "save_text", "save_documents"):
        monkeypatch.setattr(report, name, killed(getattr(report, name)))
    monkeypatch.setattr(report.Bundle, "commit", killed(report.Bundle.commit))
    monkeypatch.setattr(report, "quality_report", lambda points, algorithm: spark.createDataFrame([(3,)], "n_clusters int"))
    last = None
    for round_, stops in enumerate((range(7), (3,))):
        for stop in stops:
            calls[0], limit[0] = 0, stop
            with pytest.raises(RuntimeError):
                report.export_report(f, labels, pts, None, base, run_id=f"broken{round_}-{stop}")
            assert sinks.read_manifest(spark, base) == last
        calls[0], limit[0] = 0, None
        out = report.export_report(f.limit(30 + 30 * round_), labels, pts, None, base, run_id=f"whole{round_}")
        last = sinks.read_manifest(spark, base)
        assert calls[0] == 7 and last["run_id"] == f"whole{round_}" and last["files"] == out and len(out) == 6
        assert spark.read.parquet(out["segments"]).count() == 30 + 30 * round_


def test_a_completed_run_id_changes_nothing(spark, tmp_path, monkeypatch):
    from cardprism.plans import report
    from cardprism.plans.report import export_report
    monkeypatch.setattr(report, "quality_report", lambda points, algorithm: spark.createDataFrame([(3,)], "n_clusters int"))
    f, labels, pts = _report_inputs(spark, 30)
    base = str(tmp_path / "rep")
    one = export_report(f, labels, pts, None, base, run_id="a")
    two = export_report(f.limit(0), labels, pts, None, base, run_id="a")
    assert one == two and spark.read.parquet(two["segments"]).count() == 30
    with pytest.raises(ValueError):
        export_report(f, labels, pts, None, base, run_id="a/b")


def test_seed_propagation():
    from cardprism.config import SegmentationConfig
    c = SegmentationConfig().with_seed(123)
    assert c.seed == 123 and SegmentationConfig().seed == 42


def test_density_cut_links_all_pairs(spark, tmp_path):
    """Two knots of six points within eps of each other, though each point's
    nearest neighbours lie in its own knot; the far points are noise."""
    from cardprism.plans import q_density
    at = [0.01 * i for i in range(6)] + [1 + 0.01 * i for i in range(6)] + [100 + 3.0 * i for i in range(20)]
    rows = [(i, [float(x), 0.0], 0) for i, x in enumerate(at)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r.cluster for r in q_density._cut(spark, str(tmp_path)).collect()}
    assert got == {i: 0 if i < 12 else -1 for i in range(32)}


# --- pruning, deep trees, points that can't be placed ---------------------------------

def _frame(spark, X, first=0):
    return spark.createDataFrame([(first + i, [float(a) for a in x]) for i, x in enumerate(X)], "id long, v array<double>").repartition(3)


def _fast_prim(W):
    n = len(W)
    best, frm, out, edges = W[0].copy(), np.zeros(n, int), np.ones(n, bool), []
    out[0] = False
    for _ in range(n - 1):
        j = int(np.where(out, best, np.inf).argmin())
        edges.append((best[j], min(frm[j], j), max(frm[j], j)))
        out[j] = False
        closer = out & (W[j] < best)
        best[closer], frm[closer] = W[j][closer], j
    return edges


@pytest.mark.parametrize("kind", ["blobs", "equal", "grid", "line"])
def test_neighbours_are_exact_and_blocks_pruned(spark, kind):
    rng = np.random.RandomState(3)
    X = {"blobs": lambda: np.vstack([rng.normal(rng.uniform(0, 60, 3), 0.4, size=(50, 3)) for _ in range(12)]),
         "equal": lambda: np.ones((90, 2)), "grid": lambda: np.array([[i // 12, i % 12] for i in range(144)], float),
         "line": lambda: 1.3 ** np.arange(80)[:, None]}[kind]()
    df, m, formed = _frame(spark, X), 4, []
    got = {}
    for r in D.knn(df, m, True, block_size=30, formed=formed).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.d, r.other))
    away = np.zeros((len(X), len(X)))
    for k in range(X.shape[1]):
        away += (X[:, None, k] - X[None, :, k]) ** 2
    away = np.sqrt(away)
    for i in range(len(X)):
        assert got[i] == sorted(zip(away[i].tolist(), range(len(X)), strict=True))[:m]
    if kind == "blobs":
        assert formed[0][0] < 0.5 * formed[0][1]


def test_spanning_tree_forms_fewer_block_pairs_each_round(spark):
    rng = np.random.RandomState(4)
    X = np.vstack([rng.normal(c, 0.3, size=(40, 2)) for c in [(0, 0), (9, 0), (0, 9), (9, 9), (30, 30), (33, 30), (60, 0), (60, 4)]])
    df, m, formed = _frame(spark, X), 4, []
    neigh = D.knn(df, m, True, block_size=20).cache()
    core = D.core_distances(neigh, m)
    tree = D.minimum_spanning_tree(df, core, 20, neigh, formed=formed)
    plain = D.minimum_spanning_tree(df, core, 1000)
    exp = _fast_prim(_reach(X, m))
    for t in (tree, plain):
        rows = t.collect()
        assert len(rows) == len(X) - 1 and sum(r.weight for r in rows) == pytest.approx(sum(w for w, _, _ in exp))
    assert sorted((r.src, r.dst) for r in tree.collect()) == sorted((r.src, r.dst) for r in plain.collect())
    blocks = len(X) // 20
    assert max(formed) < 0.5 * blocks * (blocks + 1) / 2 and formed[-1] < formed[0]


def test_one_point_without_a_finite_vector_is_noise_alone(spark):
    rng = np.random.RandomState(5)
    X = np.vstack([rng.normal(c, 0.2, size=(20, 2)) for c in [(0, 0), (8, 0), (0, 8)]])
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)]
    odd = [(60, [float("nan"), 1.0]), (61, [float("inf"), 1.0]), (62, None), (63, [1.0, None])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>")
    got = {r.id: r.cluster for r in D.density_cluster(df, 5, 3).collect()}
    alone = {r.id: r.cluster for r in D.density_cluster(df.where("id < 60"), 5, 3).collect()}
    assert {i: c for i, c in got.items() if i < 60} == alone and len(set(alone.values()) - {-1}) == 3
    assert all(got[i] == -1 for i, _ in odd)
    assert {r.id: r.reason for r in D.unusable_points(df).collect()} == {
        60: "null or non-finite number", 61: "null or non-finite number", 62: "no vector", 63: "null or non-finite number"}


def _select(X, size, m):
    """Condensed tree and excess of mass from a fast spanning tree."""
    global _prim
    slow, _prim = _prim, _fast_prim
    try:
        return _hdbscan(X, size, m)
    finally:
        _prim = slow


@pytest.mark.parametrize("kind", ["random", "chain"])
def test_many_small_clusters_without_a_tree_on_the_driver(spark, kind, monkeypatch):
    """Two thousand points, clusters from two points on; groups of 8 splits, so
    that the halving is used.  The chain's tree is as deep as it has clusters."""
    from cardprism.operators import condensed
    rng = np.random.RandomState(6)
    X = rng.uniform(0, 100, size=(2000, 2))
    if kind == "chain":
        at = np.cumsum(1.02 ** np.arange(200))
        X = np.repeat(at, 2)[:, None] + np.tile([0.0, 0.01], 200)[:, None] * (1 + 0.001 * np.arange(400)[:, None])
    df = _frame(spark, X)
    neigh = D.knn(df, 2).cache()
    tree = D.minimum_spanning_tree(df, D.core_distances(neigh, 2), neigh=neigh)
    monkeypatch.setattr(condensed, "GROUP_BITS", 3)
    monkeypatch.setattr(condensed.excess_of_mass, "__defaults__", (3,))
    labels = {}
    for r in D.eom_select(df, tree, 2).collect():
        labels.setdefault(r.cluster, set()).add(r.id)
    assert {frozenset(v) for k, v in labels.items() if k != -1} == _select(X, 2, 2)
    firsts = [min(labels[c]) for c in sorted(labels) if c >= 0]
    assert firsts == sorted(firsts)


def test_tree_values_and_labels_against_plain_walks(spark):
    from cardprism.operators import condensed
    rng = np.random.RandomState(7)
    for shape in ("random", "deep"):
        roots, nodes = list(range(-60, 0)), {i: (None, None) for i in range(-60, 0)}
        for new in range(59):
            pick = [0, len(roots) - 1] if shape == "deep" else rng.choice(len(roots), 2, replace=False).tolist()
            a, b = (roots[i] for i in pick)
            roots = [r for r in roots if r not in (a, b)] + [new]
            nodes[new] = (a, b)
        c = {n: float(rng.randint(-5, 20)) for n in nodes}
        k = {n: float(rng.randint(-3, 4)) for n in nodes}
        value = {}
        for n in sorted(nodes):
            value[n] = max(c[n], k[n] + sum(value[x] for x in nodes[n] if x is not None))
        df = spark.createDataFrame([(n, c[n], k[n], *nodes[n]) for n in nodes], "node long, c double, k double, a long, b long")
        assert {r.node: r.value for r in condensed.tree_values(df).collect()} == value
        parent = {x: n for n, ab in nodes.items() for x in ab if x is not None}
        chosen = {n: bool(rng.randint(0, 2)) for n in nodes}
        top = {}
        for n in sorted(nodes, reverse=True):
            above = top.get(parent.get(n))
            top[n] = above if above is not None else n if chosen[n] else None
        df = spark.createDataFrame([(n, parent.get(n), chosen[n]) for n in nodes], "node long, parent long, chosen boolean")
        assert {r.node: r.top for r in condensed.topmost(df).collect()} == top


def test_matrix_product_kernels_equal_plain_distances():
    """Neighbours and lightest edges of two blocks, by the product and by all
    distances, to the last bit: copies, ties on a grid, far offsets, overflow."""
    import numpy as np
    import pandas as pd

    from cardprism.operators.blocks import near_squares, symmetric_tiles
    from cardprism.operators.density import _knn_fn, _lightest_fn
    rng = np.random.default_rng(5)
    cases = [rng.normal(size=(300, 6)), rng.integers(0, 3, (300, 3)).astype(float), rng.normal(size=(300, 4)) * 1e-3 + 1e7,
             np.repeat(rng.normal(size=(20, 5)), 15, axis=0), rng.normal(size=(60, 3)) * 1e160]
    for X in cases:
        n, half = len(X), len(X) // 2
        ids, side = rng.permutation(n), np.arange(n) >= half
        base = pd.DataFrame({"id": ids, "v": list(X), "bi": 0, "bj": 1, "side": side, "lower": 0.0})
        D = np.empty((n, n))
        with np.errstate(over="ignore"):
            for rows, d in symmetric_tiles(X, X):
                D[rows] = d
        # neighbours in the other block, within reach
        reach = np.sort(D, axis=1)[:, 9]
        with np.errstate(over="ignore"):
            got = _knn_fn(4, True)(base.assign(reach=reach))
        want = []
        for i in range(n):
            other = np.flatnonzero(side != side[i])
            best = other[np.lexsort((ids[other], D[i, other]))][:4]
            want += [(ids[i], ids[j], D[i, j]) for j in best if D[i, j] <= reach[i]]
        assert sorted(zip(got["id"], got["other"], got["d"])) == sorted(want)
        # lightest edge of each component
        core, comp = np.sort(D, axis=1)[:, 3], rng.integers(0, 7, n)
        with np.errstate(over="ignore"):
            got = _lightest_fn(base.assign(core=core, comp=comp, bound=np.inf))
        best = {}
        for i in range(n):
            for j in np.flatnonzero((side != side[i]) & (comp != comp[i])):
                e = (max(D[i, j], core[i], core[j]), min(ids[i], ids[j]), max(ids[i], ids[j]))
                if np.isfinite(e[0]) and e < best.get(comp[i], (np.inf,)):
                    best[comp[i]] = e
        assert {r.comp: (r.weight, r.src, r.dst) for r in got.itertuples()} == best
    # the product leaves few pairs to be compared in full
    X = rng.normal(size=(2000, 8))
    ((_, G, err),) = list(near_squares(X[:1000], X[1000:]))
    assert (G <= (np.partition(G, 4, axis=1)[:, 4] + 2 * err)[:, None]).sum() == 5 * 1000


def test_every_cell_of_the_density_grid_is_fitted(spark):
    """Six sizes and four numbers of samples are 24 cells (only the first two of
    each list were tried); all are cut from the trees together, each as by itself."""
    from cardprism.config import SegmentationConfig
    from cardprism.plans.segmentation import _fit_density
    X = _blobs(4)
    ids = [3 * i + 10 for i in range(len(X))]
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in zip(ids, X)] + [(1, None)], "id long, v array<double>")
    cfg = SegmentationConfig()
    cands, labels = _fit_density(df, cfg, len(X), 5)
    cells = [(mcs, ms) for mcs in cfg.density_min_cluster_sizes for ms in cfg.density_min_samples]
    assert len(cells) == 24 and [(c.cand, c.model) for c in cands] == list(enumerate(cells, 5))
    found, sets = {}, {}
    for r in labels.collect():
        found.setdefault(r.cand, {})[r.id] = r.cluster
        sets.setdefault(r.cand, {}).setdefault(r.cluster, set()).add((r.id - 10) // 3)
    assert all(set(found[5 + i]) == {1, *ids} and found[5 + i][1] == -1 for i in range(24))
    for i, (mcs, ms) in enumerate(cells):
        got = {c: s for c, s in sets[5 + i].items() if c != -1}
        assert set(map(frozenset, got.values())) == _select(X, mcs, ms), (mcs, ms)
        assert [min(got[c]) for c in range(len(got))] == sorted(min(s) for s in got.values())
