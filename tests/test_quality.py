"""Cluster sizes, balance and silhouette against direct computations."""

import numpy as np
import pytest

from cardprism.operators.quality import (
    balance_many, calinski_harabasz, cluster_balance, davies_bouldin, silhouette, silhouette_many, size_stats,
)


def brute_silhouette(X, lab):
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    s = []
    for i in range(len(X)):
        own = lab == lab[i]
        if own.sum() <= 1:
            s.append(0.0)
            continue
        a = D[i, own].sum() / (own.sum() - 1)
        b = min(D[i, lab == c].mean() for c in set(lab) if c != lab[i])
        s.append((b - a) / max(a, b))
    return float(np.mean(s))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(0)
    centers = np.array([[0, 0], [6, 0], [0, 6]])
    X = np.vstack([rng.normal(c, 1.0, size=(60, 2)) for c in centers])
    lab = np.repeat([0, 1, 2], 60)
    df = spark.createDataFrame([(i, int(l), [float(a), float(b)]) for i, (l, (a, b)) in enumerate(zip(lab, X))],
                               "id long, cluster int, v array<double>")
    return df, X, lab


def test_silhouette_exact(blobs):
    df, X, lab = blobs
    got = silhouette(df, block_size=50).first()[0]    # several blocks
    assert got == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    assert got > 0.6


def test_silhouette_many_matches_single(blobs, spark):
    df, X, lab = blobs
    alt = (np.arange(len(lab)) % 2)
    labels = spark.createDataFrame([(i, 0, int(l)) for i, l in enumerate(lab)] +
                                   [(i, 1, int(l)) for i, l in enumerate(alt)], "id long, cand int, cluster int")
    got = {r["cand"]: r["silhouette"] for r in silhouette_many(df, labels, block_size=64).collect()}
    assert got[0] == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    assert got[1] == pytest.approx(brute_silhouette(X, alt), abs=1e-9)


def test_silhouette_many_with_noise(blobs, spark):
    """A labelling with noise points (absent rows) is scored on its
    non-noise points only, alongside a complete labelling."""
    df, X, lab = blobs
    noise = np.arange(len(lab)) % 7 == 0
    labels = spark.createDataFrame([(i, 0, int(l)) for i, l in enumerate(lab)] +
                                   [(i, 1, int(l)) for i, l in enumerate(lab) if not noise[i]],
                                   "id long, cand int, cluster int")
    got = {r["cand"]: r["silhouette"] for r in silhouette_many(df, labels, block_size=64).collect()}
    assert got[0] == pytest.approx(brute_silhouette(X, lab), abs=1e-9)
    assert got[1] == pytest.approx(brute_silhouette(X[~noise], np.asarray(lab)[~noise]), abs=1e-9)


def test_silhouette_null_rules(spark):
    df = spark.createDataFrame([(0, 0, [0.0]), (1, 0, [1.0]), (2, 1, [5.0])], "id long, cluster int, v array<double>")
    assert silhouette(df).first()[0] is None          # a singleton cluster


def test_balance(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0] * 10 + [1] * 30 + [-1] * 5)], "id long, cluster int")
    r = cluster_balance(df).first()
    sizes = np.array([10, 30])
    gini = 2 * np.sum(np.arange(1, 3) * sizes) / (2 * sizes.sum()) - 3 / 2
    assert r["balance_ratio"] == pytest.approx(1 - gini)
    assert r["n_clusters"] == 2 and r["noise_points"] == 5
    assert r["largest_cluster_pct"] == pytest.approx(75.0)
    s = size_stats(df).first()
    assert s["cluster_balance"] == pytest.approx(1 - np.std(sizes) / np.mean(sizes))
    m = balance_many(df.withColumn("cand", df.id * 0)).first()
    assert m["balance_ratio"] == pytest.approx(1 - gini)


def test_no_clusters(spark):
    df = spark.createDataFrame([(0, -1), (1, -1)], "id long, cluster int")
    r = cluster_balance(df).first()
    assert r["balance_ratio"] == 0.0 and r["largest_cluster_pct"] == 100.0


def test_db_ch(blobs):
    df, X, lab = blobs
    C = np.array([X[lab == k].mean(0) for k in range(3)])
    s = np.array([np.sqrt(((X[lab == k] - C[k]) ** 2).sum(1)).mean() for k in range(3)])
    R = [[(s[i] + s[j]) / np.linalg.norm(C[i] - C[j]) for j in range(3) if j != i] for i in range(3)]
    assert davies_bouldin(df).first()[0] == pytest.approx(np.mean([max(r) for r in R]))
    W = sum(((X[lab == k] - C[k]) ** 2).sum() for k in range(3))
    B = sum((lab == k).sum() * ((C[k] - X.mean(0)) ** 2).sum() for k in range(3))
    assert calinski_harabasz(df).first()[0] == pytest.approx((B / 2) / (W / (len(X) - 3)))


# --- sampled silhouette -----------------------------------------------------------

def test_sampled_silhouette_holds_the_exact_one_within_its_error(spark):
    from cardprism.operators.quality import silhouette, silhouette_sampled
    from cardprism.plans.q_quality import emb_points
    p = emb_points(spark, "/root/testdata/sf0.01").cache()
    exact = silhouette(p).first()[0]
    for seed in range(20):
        r = silhouette_sampled(p, 20, seed).first()
        assert 0 < r.error < 0.01 and abs(r.silhouette - exact) <= 3 * r.error
    whole = silhouette_sampled(p, 10_000).first()
    assert whole.error == 0 and whole.silhouette == pytest.approx(exact, abs=1e-9)


def test_sampled_silhouettes_of_many_labellings(spark):
    """Noise absent from some labellings, a cluster of two, labellings without
    a silhouette; small clusters are whole."""
    from cardprism.operators.quality import silhouette_many, silhouette_sampled_many
    rng = np.random.RandomState(2)
    X = np.vstack([rng.normal(c, 0.5, size=(40, 2)) for c in [(0, 0), (4, 0), (0, 4)]])
    pts = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(X)], "id long, v array<double>").repartition(3)
    labs = [(i, 0, i // 40) for i in range(120)] + [(i, 1, 0 if i < 2 else 1) for i in range(100)] + [(i, 2, 0) for i in range(120)] + \
           [(i, 3, 1 if i == 5 else 0) for i in range(120)]
    labels = spark.createDataFrame(labs, "id long, cand int, cluster int")
    exact = {r.cand: r.silhouette for r in silhouette_many(pts, labels).collect()}
    whole = {r.cand: r for r in silhouette_sampled_many(pts, labels, 200).collect()}
    some = {r.cand: r for r in silhouette_sampled_many(pts, labels, 15).collect()}
    assert set(whole) == set(some) == set(exact) == {0, 1, 2, 3}
    for c in (0, 1):
        assert whole[c].silhouette == pytest.approx(exact[c]) and whole[c].error == 0
        assert some[c].error > 0 and abs(some[c].silhouette - exact[c]) <= 4 * some[c].error
    assert exact[2] is None and exact[3] is None and all(x[c].silhouette is None and x[c].error is None for x in (whole, some) for c in (2, 3))
    with pytest.raises(ValueError):
        silhouette_sampled_many(pts, labels, 1)
    assert silhouette_sampled_many(pts, labels.limit(0), 5).count() == 0


def test_model_selection_with_sampled_silhouettes(spark):
    from cardprism.config import SegmentationConfig
    from cardprism.plans.segmentation import perform_clustering
    rng = np.random.RandomState(3)
    X = np.vstack([rng.normal(c, 0.4, size=(80, 2)) for c in [(0, 0), (6, 0), (0, 6), (6, 6)]])
    pts = spark.createDataFrame([(i, [float(a) for a in x]) for i, x in enumerate(X)], "id long, v array<double>")
    out = {}
    for sample in (None, 20):
        cfg = SegmentationConfig(algorithm="kmeans", kmeans_k=(3, 4, 5), kmeans_restarts=2, kmeans_max_iter=50, silhouette_sample=sample)
        runs, _, best, cands = perform_clustering(pts, cfg)
        out[sample] = (cands[best].k, {r.k: r.silhouette for r in runs.collect()})
    assert out[None][0] == out[20][0] == 4
    assert all(out[20][1][k] == pytest.approx(out[None][1][k], abs=0.1) for k in (3, 4, 5))


def test_silhouettes_of_many_labellings_move_one_row_a_point_and_block_pair(spark):
    """Few and very many clusters, noise, singletons and copies, in several
    blocks: as by all distances; a task returns one row per point, not one per
    point, labelling and cluster."""
    import numpy as np
    import pandas as pd
    import pytest

    from cardprism.operators.quality import _sums_fn, silhouette_many
    rng = np.random.default_rng(2)
    n = 1300
    X = np.round(rng.normal(size=(n, 2)), 1)
    labs = np.column_stack([rng.integers(0, 3, n), rng.permutation(np.arange(n) // 2), rng.integers(-1, 2, n), np.zeros(n, int)])
    points = spark.createDataFrame([(i, X[i].tolist()) for i in range(n)], "id long, v array<double>")
    rows = [(i, m, int(labs[i, m])) for i in range(n) for m in range(4) if labs[i, m] >= 0]
    labels = spark.createDataFrame(rows, "id long, cand int, cluster int")
    got = {r.cand: r.silhouette for r in silhouette_many(points, labels, 500).collect()}
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    for m in range(3):
        here = np.flatnonzero(labs[:, m] >= 0)
        total = 0.0
        for i in here:
            mean = {c: D[i, here[labs[here, m] == c]].sum() / ((labs[here, m] == c).sum() - (c == labs[i, m])) for c in set(labs[here, m].tolist())} if m != 1 else None
            if m == 1:
                sums = np.bincount(labs[:, 1], D[i]) / 2.0
                a = 2 * sums[labs[i, 1]]
                sums[labs[i, 1]] = np.inf
                b = sums.min()
            else:
                a, b = mean[labs[i, m]], min(v for c, v in mean.items() if c != labs[i, m])
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
        assert got[m] == pytest.approx(total / len(here), abs=1e-6)
    assert got[3] is None
    pdf = pd.DataFrame({"id": np.arange(n), "v": list(X), "labs": list(labs.astype(np.int64)), "bi": 0, "bj": 1, "side": np.arange(n) % 2 == 1})
    assert len(_sums_fn([np.unique(c[c >= 0]) for c in labs.T])(pdf)) == n


def test_one_labelling_of_many_clusters_leaves_the_others_to_the_product():
    """All labellings side by side, whichever way they are added up; the
    distances of a tile are those of its points."""
    import numpy as np
    import pandas as pd

    from cardprism.operators.blocks import cached_tiles
    from cardprism.operators.quality import _by_product, _sums_fn
    rng = np.random.default_rng(4)
    n = 1400
    X = rng.normal(size=(n, 3))
    labs = np.column_stack([rng.integers(0, 3, n), rng.permutation(n) // 2, rng.integers(-1, 4, n)])
    found = [np.unique(c[c >= 0]) for c in labs.T]
    assert _by_product(found).tolist() == [True, False, True]
    assert _by_product([np.arange(300), np.arange(300)]).tolist() == [True, False]
    D = np.sqrt(((X[:, None, :] - X[None, :, :]) ** 2).sum(-1))
    side = np.arange(n) >= 200
    pdf = pd.DataFrame({"id": np.arange(n), "v": list(X), "labs": list(labs.astype(np.int64)), "bi": 0, "bj": 1, "side": side})
    got = _sums_fn(found)(pdf).set_index("id")["s"]
    for i in (0, 150, 199, 200, 1399):
        other = side != side[i]
        want = np.concatenate([[D[i, other & (labs[:, m] == c)].sum() for c in ids] for m, ids in enumerate(found)])
        assert np.allclose(got[i], want, atol=1e-6)
    seen = np.full((200, n), np.nan)
    for rows, cols, T in cached_tiles(X[:200], X):
        assert T.nbytes <= 2 << 20
        seen[rows, cols] = T
    assert np.allclose(seen, D[:200], atol=1e-6)


def test_pairs_of_blocks_get_tasks_of_their_own(spark):
    """Adaptive execution joined them into about one task a core, by their bytes."""
    from cardprism.operators.blocks import block_pairs, own_tasks
    points = spark.range(2000).selectExpr("id", "array(double(id), 1.0) as v")
    pairs = own_tasks(block_pairs(points, 250))   # 8 blocks, 36 pairs
    tasks = pairs.groupBy("bi", "bj").applyInPandas(lambda pdf: pdf[["id"]][:1], "id long").rdd.getNumPartitions()
    assert tasks == 36
    assert own_tasks(block_pairs(points.where("false"))).count() == 0


def test_distances_are_added_up_by_runs_of_equal_labels(spark):
    """Blocks hold points with the same labels side by side, so that a tile has a
    few runs whose sums serve all labellings; single points are no runs."""
    import numpy as np

    from cardprism.operators.blocks import block_pairs
    from cardprism.operators.quality import _run_totals, _runs
    rng = np.random.default_rng(5)
    labs = np.repeat(rng.integers(-1, 3, (30, 2)), 20, axis=0)
    found = [np.unique(c[c >= 0]) for c in labs.T]
    tiles = _runs(labs, found, 256)
    assert set(tiles) == {0, 256, 512}
    D = rng.random((600, 7))
    for s, (begin, columns) in tiles.items():
        assert begin[0] == 0 and len(begin) <= 14
        tile = slice(s, s + 256)
        want = np.concatenate([[D[tile][labs[tile, m] == c].sum(0) for c in ids] for m, ids in enumerate(found)])
        for total in (_run_totals(D[tile], begin), np.add.reduceat(D[tile], begin, axis=0)):
            assert np.allclose(columns.T @ total, want)
    many = np.repeat(np.arange(40)[:, None], 5, axis=0)
    begin, columns = _runs(many, [np.arange(40)], 256)[0]
    assert len(begin) == 40 and np.allclose(columns.T @ _run_totals(D[:200], begin), D[:200].reshape(40, 5, 7).sum(1))
    assert _runs(rng.permutation(200)[:, None], [np.arange(200)], 256)[0][0] is None
    points = spark.range(1000).selectExpr("id", "array(double(id)) as v", "id % 4 as label")
    pairs = block_pairs(points, 250, ["label", "id"])
    assert pairs.columns == ["id", "v", "label", "bi", "bj", "side"]
    own = pairs.where("bi = bj").groupBy("bi").agg({"label": "max", "id": "count"}).collect()
    assert len({r.bi for r in own}) == pairs.select("bj").distinct().count() and max(r["count(id)"] for r in own) <= 250
    assert pairs.where("bi = bj").select("bi", "label").distinct().count() <= len(own) + 3
