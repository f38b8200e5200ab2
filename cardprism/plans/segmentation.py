"""End-to-end segmentation: transactions -> features -> preprocessing ->
model sweep and selection -> labels -> segment profiles.

Driver-side state is limited to model parameters and the small
``model_runs`` table; rows stay in DataFrames.  The card feature table and
the clustering matrix are checkpointed (reliable storage) because every
model pass reads them again.
"""

from __future__ import annotations

import dataclasses
import functools
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardprism.config import COVARIANCE_TYPES, SegmentationConfig
from cardprism.operators import gmm as G
from cardprism.operators import kmeans as KM
from cardprism.operators.density import density_sweep
from cardprism.operators.features import customer_features
from cardprism.operators.preprocess import PreprocessModel, fit_preprocess
from cardprism.operators.quality import balance_many, silhouette_many, silhouette_sampled_many
from cardprism.operators.selection import RUNS_SCHEMA, best_model, best_of, choose_n_components, model_score
from cardprism.session import at_once, cut_lineage, partitioned


@dataclass
class Candidate:
    cand: int
    algorithm: str
    k: int
    cov_type: str | None = None
    model: object = None
    bic: float | None = None
    aic: float | None = None
    error: str | None = None


def predict_centers(points: DataFrame, centers: dict) -> DataFrame:
    """Nearest-centre labels of several K-Means candidates in one pass."""
    def mapper(it):
        for pdf in it:
            if not len(pdf):
                continue
            X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            for c, C in centers.items():
                yield pd.DataFrame({"id": pdf["id"].to_numpy(), "cand": c, "cluster": KM.sq_distances(X, C).argmin(1).astype(np.int32)})
    return points.select("id", "v").mapInPandas(mapper, "id long, cand int, cluster int")


def _score_candidates(spark, points, labels, cands: list[Candidate], block_size: int | None, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Balance and silhouette of every candidate; one blocked distance pass
    for all silhouettes, or one pass against a sample of each cluster.  Failed candidates become rows with their error."""
    good = [c for c in cands if c.error is None]
    sil, bal = {}, {}
    if good:
        place = {c.cand: i for i, c in enumerate(good)}
        remap = F.create_map(*[F.lit(x) for kv in place.items() for x in kv])
        placed = labels.where(F.col("cluster") >= 0).select("id", remap[F.col("cand")].alias("cand"), "cluster")
        scored = silhouette_sampled_many(points, placed, sample, seed) if sample else silhouette_many(points, placed, block_size)
        sil = {r["cand"]: r["silhouette"] for r in scored.collect()}
        sil = {c: sil.get(i) for c, i in place.items()}
        bal = {r["cand"]: r for r in balance_many(labels).collect()}
    rows = []
    for seq, c in enumerate(cands):
        mcs, ms = c.model if c.algorithm == "hdbscan" and c.model else (None, None)
        if c.error is not None:
            rows.append((c.cand, c.algorithm, c.k, c.cov_type, mcs, ms, None, None, None, None, None, None, None, seq, c.error))
            continue
        b, s = bal[c.cand], sil[c.cand]
        rows.append((c.cand, c.algorithm, c.k, c.cov_type, mcs, ms, c.bic, c.aic, b["n_clusters"], float(b["balance_ratio"]),
                     float(b["largest_cluster_pct"]), float(b["noise_ratio"]), None if s is None else float(s), seq, None))
    return spark.createDataFrame(rows, RUNS_SCHEMA)


def gmm_candidates(points, specs: dict, algorithm: str, cfg: SegmentationConfig, n: int) -> list[Candidate]:
    """Fit all ``specs`` (cand -> (k, covariance type)) together, each from
    one K-Means fit of its k over all rows."""
    ks = sorted({k for k, _ in specs.values()})
    init = {k: r.centers for k, r in KM.best_per_k(KM.kmeans_sweep(points, ks, 1, cfg.kmeans_max_iter, seed=cfg.seed)).items()}
    models = G.fit_many(points, specs, init, n, cfg.gmm_max_iter, cfg.gmm_tol, cfg.gmm_reg_covar)
    out = []
    for c, (k, cov) in specs.items():
        g = models[c]
        if g.error:
            out.append(Candidate(c, algorithm, k, cov, g, error=g.error))
        else:
            out.append(Candidate(c, algorithm, k, cov, g, float(G.bic(g, n)), float(G.aic(g, n))))
    return out


FAMILIES = {"gmm_auto": ("gmm_auto",), "gmm": ("gmm",), "kmeans": ("kmeans",), "hdbscan": ("hdbscan",)}
ALL_FAMILIES = ("gmm_auto", "gmm", "kmeans", "hdbscan")   # any other name


def _fit_gmm_auto(points, cfg, n, first):
    specs = {first + i: s for i, s in enumerate((k, cov) for k in range(cfg.gmm_auto_min, cfg.gmm_auto_max + 1) for cov in COVARIANCE_TYPES)}
    cands = gmm_candidates(points, specs, "gmm_auto_search", cfg, n)
    return cands, G.predict(points, {c.cand: c.model for c in cands if c.error is None})


def _fit_gmm(points, cfg, n, first):
    specs = {first + i: s for i, s in enumerate((k, cov) for k in cfg.gmm_components for cov in cfg.gmm_covariance_types)}
    cands = gmm_candidates(points, specs, "gmm", cfg, n)
    return cands, G.predict(points, {c.cand: c.model for c in cands if c.error is None})


def _fit_kmeans(points, cfg, n, first):
    best = KM.best_per_k(KM.kmeans_sweep(points, cfg.kmeans_k, cfg.kmeans_restarts, cfg.kmeans_max_iter, seed=cfg.seed))
    cands = [Candidate(first + i, "kmeans", k, None, best[k]) for i, k in enumerate(cfg.kmeans_k)]
    return cands, predict_centers(points, {c.cand: c.model.centers for c in cands})


def _fit_density(points, cfg, n, first):
    # the whole grid; the reference tries the first two values of each list, for speed
    grid = [(mcs, ms) for mcs in cfg.density_min_cluster_sizes for ms in cfg.density_min_samples]
    cands, labels = [], []
    for i, (cell, found) in enumerate(zip(grid, density_sweep(points, grid), strict=True)):
        cands.append(Candidate(first + i, "hdbscan", -1, None, cell))
        labels.append(found.select("id", F.lit(first + i).alias("cand"), "cluster"))
    return cands, functools.reduce(DataFrame.unionByName, labels)


FITTERS = {"gmm_auto": _fit_gmm_auto, "gmm": _fit_gmm, "kmeans": _fit_kmeans, "hdbscan": _fit_density}


def perform_clustering(points: DataFrame, cfg: SegmentationConfig = SegmentationConfig(), block_size: int | None = None):
    """C01-C08 dispatch.  Any algorithm name but the four runs all four
    families.  A family that raises becomes one failure row, and so does each
    candidate that breaks down; the others go on.  Families are fitted side by
    side.  Returns (model_runs
    DataFrame, labels (id, cand, cluster), best candidate id, candidates);
    the best is None if nothing could be fitted."""
    spark: SparkSession = points.sparkSession
    points = partitioned(points.select("id", "v"), "id")
    n = points.count()
    families = FAMILIES.get(cfg.algorithm.lower(), ALL_FAMILIES)

    def fit(family):
        try:
            more, lab = FITTERS[family](points, cfg, n, 0)
            return more, cut_lineage(lab)
        except Exception as e:  # noqa: BLE001  isolation: reported as a row
            if len(families) == 1:
                raise
            return [Candidate(0, family, -1, error=f"{type(e).__name__}: {str(e)[:200]}")], None

    cands: list[Candidate] = []
    labels = []
    for more, lab in at_once(spark, fit, families):   # numbered on from family to family
        if lab is not None:
            labels.append(lab.withColumn("cand", (F.col("cand") + len(cands)).cast("int")))
        cands += [dataclasses.replace(c, cand=c.cand + len(cands)) for c in more]
    lab = functools.reduce(DataFrame.unionByName, labels) if labels else spark.createDataFrame([], "id long, cand int, cluster int")
    runs = _score_candidates(spark, points, lab, cands, block_size, cfg.silhouette_sample, cfg.seed)
    if any(c.algorithm == "gmm_auto_search" for c in cands):
        n_best = choose_n_components(runs, cfg.gmm_auto_criterion).first()[0]
        chosen = runs.where((F.col("algorithm") == "gmm_auto_search") & (F.col("k") == n_best))
        runs = runs.unionByName(chosen.withColumn("algorithm", F.lit("gmm_auto")))
    best = (best_of(runs, families[0]) if len(families) == 1 else best_model(runs).where("is_best")).first()
    points.unpersist()
    return model_score(runs), lab, None if best is None else int(best["cand"]), cands


def canonical_labels(labels: DataFrame, features: DataFrame, key: str = "card_id") -> DataFrame:
    """Renumber clusters by mean CLV (descending), then smallest card id, so
    names and lookups do not depend on arbitrary model ids.  Noise stays -1."""
    j = labels.join(features.select(key, "customer_lifetime_value"), key)
    order = j.where(F.col("cluster") != -1).groupBy("cluster").agg(
        F.avg("customer_lifetime_value").alias("clv"), F.min(key).alias("first"))
    mapping = order.select("cluster", (F.row_number().over(
        Window.orderBy(F.desc("clv"), "first")) - 1).alias("segment"))   # one row per cluster
    return labels.join(mapping, "cluster", "left").select(
        key, F.coalesce("segment", F.lit(-1)).cast("int").alias("cluster"))


@dataclass
class SegmentationResult:
    features: DataFrame
    preprocess: PreprocessModel
    matrix: DataFrame
    runs: DataFrame
    best_cand: int
    labels: DataFrame


def run_segmentation(tx: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> SegmentationResult:
    features = cut_lineage(customer_features(tx, cfg))
    model = fit_preprocess(features, cfg)
    matrix = cut_lineage(model.transform(features).select(F.col("card_id").alias("id"), "v"))
    runs, lab, best, _ = perform_clustering(matrix, cfg)
    chosen = lab.where(F.col("cand") == best).select(F.col("id").alias("card_id"), "cluster")
    labels = cut_lineage(canonical_labels(chosen, features))
    return SegmentationResult(features, model, matrix, runs, best, labels)
