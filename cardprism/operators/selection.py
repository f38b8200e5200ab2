"""Candidate scoring and model selection.

Candidates of every algorithm become rows of one small ``model_runs``
table (parameters, BIC / AIC, balance, silhouette, score); choices are
``min_by`` / ``max_by`` over it with the reference's tie rules (strict
improvement, so the first candidate in sweep order wins ties).  A candidate
or family that failed is a row with ``error`` set: it has no score and is
never chosen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RUNS_SCHEMA = ("cand int, algorithm string, k int, cov_type string, min_cluster_size int, min_samples int, "
               "bic double, aic double, n_clusters long, balance_ratio double, largest_cluster_pct double, "
               "noise_ratio double, silhouette double, seq int, error string")


def model_score(runs: DataFrame) -> DataFrame:
    """0.6 balance + 0.4 silhouette (missing silhouette -> 0.6 balance);
    density candidates 0.7 silhouette + 0.3 balance."""
    sil = F.col("silhouette")
    bal = F.col("balance_ratio")
    dens = F.col("algorithm") == "hdbscan"
    score = (F.when(F.col("error").isNotNull(), F.lit(None)).when(dens & sil.isNotNull(), 0.7 * sil + 0.3 * bal).when(dens, 0.3 * bal)
              .when(sil.isNotNull(), 0.6 * bal + 0.4 * sil).otherwise(0.6 * bal))
    return runs.withColumn("combined_score", score)


def choose_n_components(runs: DataFrame, criterion: str = "bic") -> DataFrame:
    """Component count from the auto sweep (2..8 x 4 types): minimum
    BIC or AIC, or maximum 0.5/(1+BIC/1000) + 0.3 balance + 0.2 silhouette
    (first term 0 at its pole, BIC = -1000).
    Only the count is returned (the winning covariance is discarded).
    Ties -> first in sweep order.  No runs -> 3."""
    r = runs.where((F.col("algorithm") == "gmm_auto_search") & F.col("error").isNull())
    if criterion == "bic":
        key = F.struct(-F.col("bic"), -F.col("seq"))
    elif criterion == "aic":
        key = F.struct(-F.col("aic"), -F.col("seq"))
    else:
        bic_score = F.coalesce(F.try_divide(F.lit(1.0), 1.0 + F.col("bic") / 1000.0), F.lit(0.0))
        comb = 0.5 * bic_score + 0.3 * F.col("balance_ratio") + 0.2 * F.coalesce(F.col("silhouette"), F.lit(0.0))
        key = F.struct(comb, -F.col("seq"))
    return r.agg(F.coalesce(F.max_by("k", key), F.lit(3)).alias("n_components"))


def best_of(runs: DataFrame, algorithm: str | None = None) -> DataFrame:
    """Highest combined score (strictly better than -1; first wins ties)."""
    r = model_score(runs)
    if algorithm:
        r = r.where(F.col("algorithm") == algorithm)
    w = Window.orderBy(F.desc("combined_score"), "seq")
    return r.where(F.col("combined_score") > -1).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def best_model(runs: DataFrame) -> DataFrame:
    """Per-algorithm winners, then the overall winner (scores of
    different algorithms compared directly, as the reference does)."""
    scored = model_score(runs).where((F.col("algorithm") != "gmm_auto_search") & (F.col("combined_score") > -1))
    w = Window.partitionBy("algorithm").orderBy(F.desc("combined_score"), "seq")
    winners = scored.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")
    order = {"gmm_auto": 0, "gmm": 1, "kmeans": 2, "hdbscan": 3}
    alg_rank = F.create_map(*[x for k, v in order.items() for x in (F.lit(k), F.lit(v))])[F.col("algorithm")]
    w2 = Window.orderBy(F.desc("combined_score"), alg_rank)
    return winners.withColumn("_r", F.row_number().over(w2)).withColumn("is_best", F.col("_r") == 1).drop("_r")
