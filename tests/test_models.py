"""K-Means and GMM invariants on planted blobs (FIXTURES F-B)."""

import numpy as np
import pytest

from cardprism.operators import gmm as G
from cardprism.operators import kmeans as KM
from cardprism.operators.batched import run_pass
from cardprism.operators.selection import RUNS_SCHEMA, best_model, choose_n_components, model_score


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.RandomState(3)
    centers = np.array([[0, 0], [8, 0], [0, 8]])
    X = np.vstack([rng.normal(c, 1.0, size=(100, 2)) for c in centers])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "id long, v array<double>")
    return df.repartition(3), X


def test_kmeans_recovers_blobs(blobs):
    df, X = blobs
    res = KM.best_per_k(KM.kmeans_sweep(df, [3], restarts=3, seed=1))[3]
    got = sorted(map(tuple, np.round(res.centers)))
    assert got == sorted([(0.0, 0.0), (8.0, 0.0), (0.0, 8.0)])


def test_gmm_em_monotone_and_bic(blobs):
    df, X = blobs
    n = len(X)
    specs = {i: (k, cov) for i, (k, cov) in enumerate((k, c) for k in (2, 3, 4) for c in ("full", "tied", "diag", "spherical"))}
    init = KM.best_per_k(KM.kmeans_sweep(df, [2, 3, 4], restarts=1, seed=42))
    models = G.fit_many(df, specs, {k: init[k].centers for k in (2, 3, 4)}, n, max_iter=100, tol=1e-6)
    for g in models.values():
        h = g.history
        assert all(b >= a - 1e-9 for a, b in zip(h, h[1:])), h
        assert g.weights.sum() == pytest.approx(1.0)
    best = min(models.values(), key=lambda g: G.bic(g, n))
    assert best.k == 3


def test_single_component_diag_is_sample_moments(blobs):
    df, X = blobs
    g = G.GMM(1, "diag", np.array([1.0]), X.mean(0, keepdims=True), X.var(0, keepdims=True))
    stats = run_pass(df, G._estep_fn({0: g}, {}))
    new = G.mstep(stats, 0, 1, "diag", len(X), 0.0, g.means)
    assert new.means[0] == pytest.approx(X.mean(0))
    assert new.cov[0] == pytest.approx(X.var(0))


def test_responsibilities_sum_to_one(blobs):
    df, X = blobs
    g = G.GMM(2, "spherical", np.array([0.5, 0.5]), np.array([[0, 0], [8, 0]], float), np.array([1.0, 2.0]))
    for r in G.estep_frame(df, g).collect():
        assert sum(r["resp"]) == pytest.approx(1.0)


def test_selection_rules(spark):
    rows = [
        (0, "gmm_auto_search", 2, "full", None, None, 100.0, 90.0, 2, 0.9, 55.0, 0.0, 0.2, 0, None),
        (1, "gmm_auto_search", 3, "full", None, None, 80.0, 95.0, 3, 0.8, 40.0, 0.0, None, 1, None),
        (2, "gmm_auto_search", 4, "diag", None, None, 80.0, 70.0, 4, 0.7, 30.0, 0.0, 0.1, 2, None),
        (3, "gmm", 3, "full", None, None, None, None, 3, 0.5, 40.0, 0.0, None, 3, None),
        (4, "kmeans", 3, None, None, None, None, None, 3, 0.5, 40.0, 0.0, 0.75, 4, None),
        (5, "kmeans", 4, None, None, None, None, None, 4, 0.5, 40.0, 0.0, 0.75, 5, None),
    ]
    runs = spark.createDataFrame(rows, RUNS_SCHEMA)
    assert choose_n_components(runs, "bic").first()[0] == 3          # tie on BIC -> first in sweep order
    assert choose_n_components(runs, "aic").first()[0] == 4
    assert choose_n_components(runs.where("algorithm = 'kmeans'"), "bic").first()[0] == 3   # nothing fitted
    sc = {r["cand"]: r["combined_score"] for r in model_score(runs).collect()}
    assert sc[1] == pytest.approx(0.6 * 0.8) and sc[0] == pytest.approx(0.6 * 0.9 + 0.4 * 0.2)
    best = best_model(runs).where("is_best").first()
    assert best["cand"] == 4                                        # kmeans 0.6, first of the tie


def test_combined_criterion_at_its_pole(spark):
    rows = [(0, "gmm_auto_search", 5, "full", None, None, -1000.0, 0.0, 5, 0.9, 40.0, 0.0, None, 0, None),
            (1, "gmm_auto_search", 6, "full", None, None, 500.0, 0.0, 6, 0.1, 40.0, 0.0, None, 1, None)]
    assert choose_n_components(spark.createDataFrame(rows, RUNS_SCHEMA), "combined").first()[0] == 6


def test_failed_candidates_are_rows_and_never_chosen(spark):
    rows = [(0, "gmm", 3, "full", None, None, None, None, None, None, None, None, None, 0, "singular"),
            (1, "kmeans", 3, None, None, None, None, None, 3, 0.1, 40.0, 0.0, 0.1, 1, None)]
    runs = spark.createDataFrame(rows, RUNS_SCHEMA)
    assert model_score(runs).where("cand = 0").first()["combined_score"] is None
    assert best_model(runs).where("is_best").first()["cand"] == 1


def test_a_singular_candidate_leaves_the_others_fitted(blobs):
    df, X = blobs
    init = {2: np.array([[0.0, 0.0], [8.0, 0.0]]), 3: np.array([[0.0, 0.0], [8.0, 0.0], [0.0, 8.0]])}
    good = G._estep_fn({0: G.GMM(1, "full", np.ones(1), X.mean(0, keepdims=True), np.zeros((1, 2, 2))),
                        1: G.GMM(1, "diag", np.ones(1), X.mean(0, keepdims=True), np.ones((1, 2)))}, {})
    stats = run_pass(df, good)
    assert (0, -1) in stats and (1, 0) in stats and (0, 0) not in stats
    far = X.copy()
    far[0] = [np.inf, 0.0]
    spark = df.sparkSession
    bad = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(far)], "id long, v array<double>")
    models = G.fit_many(bad, {0: (2, "full"), 1: (3, "diag")}, init, len(X), max_iter=5)
    assert all(m.error for m in models.values())
    models = G.fit_many(df, {0: (2, "full"), 1: (3, "diag")}, init, len(X), max_iter=30)
    assert all(m.error is None and np.isfinite(m.lower_bound) for m in models.values())


def test_large_offsets_keep_covariances_positive(spark):
    rng = np.random.RandomState(0)
    X = rng.normal(0, 0.01, size=(400, 2)) + np.array([1e6, -1e6])
    df = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(X)], "id long, v array<double>").repartition(3)
    g = G.fit_many(df, {0: (1, "full")}, {1: X[:1]}, len(X), max_iter=5)[0]
    assert g.error is None and g.cov[0] == pytest.approx(np.cov(X.T, bias=True) + 1e-6 * np.eye(2), rel=1e-3)


def test_seeding_reads_all_rows_and_inertia_is_final(spark):
    """A far, tiny group beyond the first 20,000 rows gets its own centre."""
    rng = np.random.RandomState(4)
    X = np.vstack([rng.normal(0, 1, size=(24_000, 2)), rng.normal([300, 300], 1, size=(12, 2))])
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>").repartition(4)
    best = KM.best_per_k(KM.kmeans_sweep(df, [2], restarts=2, seed=1))[2]
    assert best.centers.max() > 290
    d2 = ((X[:, None] - best.centers[None]) ** 2).sum(-1).min(1)
    assert best.inertia == pytest.approx(d2.sum(), rel=1e-9)


def test_seeds_do_not_depend_on_partitions(blobs):
    df, _ = blobs
    a, b = (KM.parallel_seeds(d, 3, 2, 7) for d in (df, df.repartition(5)))
    assert all(np.array_equal(x[0], y[0]) and np.array_equal(x[1], y[1]) for x, y in zip(a, b))


def test_run_all_isolates_families(blobs, monkeypatch):
    from cardprism.config import SegmentationConfig
    from cardprism.plans import segmentation as S
    df, _ = blobs

    def broken(*_):
        raise RuntimeError("no luck")
    monkeypatch.setitem(S.FITTERS, "gmm", broken)
    cfg = SegmentationConfig(algorithm="all", gmm_auto_max=3, kmeans_k=(3,), kmeans_restarts=2)
    runs, lab, best, cands = S.perform_clustering(df, cfg)
    rows = runs.collect()
    assert {r["algorithm"] for r in rows} == {"gmm_auto_search", "gmm_auto", "gmm", "kmeans", "hdbscan"}
    assert "no luck" in next(r for r in rows if r["algorithm"] == "gmm")["error"]
    assert sum(r["algorithm"] == "gmm_auto_search" and r["silhouette"] is not None for r in rows) == 8
    assert best is not None and lab.where(lab.cand == best).count() == 300


def test_jobs_at_once_keep_order_and_own_properties(spark):
    """Items run side by side, each with its own copy of the job properties;
    the first failure is raised."""
    import threading

    from cardprism.session import at_once
    together = threading.Barrier(3, timeout=60)
    spark.sparkContext.setLocalProperty("cardprism.test", "mine")

    def job(i):
        together.wait()   # one after the other would never get here
        n = spark.range(1000 + i).repartition(3).count()
        return n, spark.sparkContext.getLocalProperty("cardprism.test")

    try:
        assert at_once(spark, job, range(3)) == [(1000 + i, "mine") for i in range(3)]
    finally:
        spark.sparkContext.setLocalProperty("cardprism.test", None)
    assert at_once(spark, job, []) == []
    with pytest.raises(ZeroDivisionError):
        at_once(spark, lambda i: 1 // i, [1, 0, 2])


def test_passes_over_packed_points_and_tiles(spark):
    """Points packed for many passes give the sums of the points; candidates of
    one k go through a tile together, equal centres and ties to the lowest."""
    from cardprism.operators.batched import packed
    rng = np.random.RandomState(9)
    X = np.round(rng.normal(size=(1500, 3)), 1)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, v array<double>").repartition(3)
    centers = {0: X[:3], 1: X[[5, 5, 9]], 2: X[10:14], 3: X[[1, 0, 2]]}
    pack = packed(df)
    assert pack.columns == ["n", "x"] and pack.agg({"n": "sum"}).first()[0] == 1500
    for got in (run_pass(df, KM._assign_fn(centers)), run_pass(pack, KM._assign_fn(centers))):
        assert set(got) == {(c, j) for c, C in centers.items() for j in range(len(C))}
        for c, C in centers.items():
            d2 = KM.sq_distances(X, C)
            lab = d2.argmin(1)
            for j in range(len(C)):
                own = X[lab == j]
                assert got[(c, j)][0] == pytest.approx(len(own), abs=20)   # a tie within rounding may go either way
            assert sum(got[(c, j)][0] for j in range(len(C))) == 1500
            assert sum(got[(c, j)][1] for j in range(len(C))) == pytest.approx(d2.min(1).sum())
            assert np.allclose(sum(got[(c, j)][2:] for j in range(len(C))), X.sum(0))
        assert got[(1, 1)][0] == 0 < got[(1, 0)][0]
    pack.unpersist()
    assert KM._assign_fn(centers)(iter([])) == {}


@pytest.mark.parametrize("cov_type", ["full", "tied", "diag", "spherical"])
def test_tiles_give_the_statistics_of_all_points(cov_type):
    rng = np.random.RandomState(10)
    X = rng.normal(size=(1100, 3)) * [1, 2, 3] + 100
    A = rng.normal(size=(2, 3, 3))
    cov = {"full": A @ A.transpose(0, 2, 1) + np.eye(3), "tied": A[0] @ A[0].T + np.eye(3), "diag": rng.uniform(1, 4, (2, 3)), "spherical": np.array([2.0, 5.0])}[cov_type]
    g = G.GMM(2, cov_type, np.array([0.3, 0.7]), X[:2], cov)
    lp, lse = G.log_resp(X, g)
    want = {}
    G._add(want, 0, X, np.exp(lp - lse[:, None]), cov_type, lse.sum(), g.means)
    got = G._estep_fn({0: g}, {})([X[:700], X[700:]])
    assert set(got) == {(0, 0), (0, 1)} and all(np.allclose(got[k], want[k], rtol=1e-9, atol=1e-7) for k in want)
    scale, const = G._scale(g)
    assert np.allclose(G._tile_stats(np.ascontiguousarray(X[:50].T), g, scale, const)[0, 1], lse[:50].sum())
