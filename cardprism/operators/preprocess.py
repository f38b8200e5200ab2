"""Preparing card features for clustering.

Fitting needs only small statistics, each one aggregation over the feature
table: quantiles (exact, bounded memory), means / variances, the d x d
covariance, Yeo-Johnson log-likelihoods on a lambda grid.  Those d- or d x d-
sized parameters live in the fitted model on the driver; ``transform`` is a
projection of JVM expressions (whole-stage codegen), no UDFs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.functions.columns import nan_to_null
from cardprism.operators.batched import run_pass
from cardprism.operators.quantiles import column_quantiles
from cardprism.schema import FEATURE_COLUMNS


# --- scaling ---------------------------------------------------------------------

def robust_params(df: DataFrame, cols) -> dict:
    """Median and IQR (interpolated quantiles) per column; zero IQR -> 1."""
    q = column_quantiles(df, cols, [0.25, 0.5, 0.75], ["q1", "med", "q3"]).collect()
    got = {r["feature"]: r for r in q}
    out = {}
    for c in cols:
        r = got.get(c)
        med = r["med"] if r else 0.0
        iqr = (r["q3"] - r["q1"]) if r else 0.0
        out[c] = (med, iqr if iqr != 0 else 1.0)
    return out


def standard_params(df: DataFrame, cols) -> dict:
    """Mean and population std per column (ddof 0); zero std -> 1."""
    r = df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]).first()
    return {c: (r[f"m_{c}"] or 0.0, (r[f"s_{c}"] or 0.0) or 1.0) for c in cols}


def apply_scaling(df: DataFrame, params: dict, keep=("card_id",)) -> DataFrame:
    return df.select(*keep, *[((F.col(c) - F.lit(float(m))) / F.lit(float(s))).alias(c) for c, (m, s) in params.items()])


def robust_scale(df: DataFrame, cols=FEATURE_COLUMNS, keep=("card_id",)) -> DataFrame:
    """(x - median) / IQR."""
    return apply_scaling(df, robust_params(df, cols), keep)


def standard_scale(df: DataFrame, cols=FEATURE_COLUMNS, keep=("card_id",)) -> DataFrame:
    """(x - mean) / std_pop."""
    return apply_scaling(df, standard_params(df, cols), keep)


# --- correlation -------------------------------------------------------------------

def as_matrix(df: DataFrame, cols) -> DataFrame:
    """(v): the columns as one vector, missing values as NaN."""
    return df.select(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in cols]).alias("v"))


def covariance(df: DataFrame, cols) -> tuple[np.ndarray, np.ndarray, int]:
    """Mean vector and sample covariance (d x d): a pass for the means, and one
    for the cross-products around them (stable for large magnitudes).  Tasks
    return one d x d sum each, added by ``run_pass``; the driver reads d x d
    numbers, however many partitions there are."""
    points, d = as_matrix(df, cols), len(list(cols))
    if points.isEmpty():
        return np.zeros(d), np.full((d, d), np.nan), 0
    row = points.agg(Summarizer.metrics("mean", "count").summary(array_to_vector("v")).alias("s")).select(
        vector_to_array("s.mean").alias("mean"), F.col("s.count").alias("n")).first()
    n = int(row["n"])
    mean = np.array(row["mean"])

    def products(batches):
        total = np.zeros((d, d))
        for X in batches:
            C = X - mean
            total += C.T @ C
        return {(0, 0): total}

    m2 = run_pass(points, products).get((0, 0), np.full(d * d, np.nan)).reshape(d, d)   # missing: values not finite
    return mean, m2 / (n - 1) if n > 1 else np.full((d, d), np.nan), n


def correlation_matrix(df: DataFrame, cols) -> np.ndarray:
    _, cov, _ = covariance(df, cols)
    sd = np.sqrt(np.clip(np.diag(cov), 0, None))
    with np.errstate(divide="ignore", invalid="ignore"):
        r = cov / np.outer(sd, sd)
    r[~np.isfinite(r)] = np.nan
    return r


def drop_rule(corr: np.ndarray, threshold: float) -> list[int]:
    """M03b on the driver-side d x d matrix (same rule as ``correlated_drop``)."""
    d = len(corr)
    return sorted({j for i in range(d) for j in range(i + 1, d)
                   if not np.isnan(corr[i, j]) and abs(corr[i, j]) > threshold})


def correlation_pairs(df: DataFrame, cols) -> DataFrame:
    """Pearson correlation for every pair i < j, long form
    (i, j, feature_i, feature_j, corr); undefined (constant column) -> NULL."""
    cols = list(cols)
    _, cov, _ = covariance(df, cols)
    rows = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            den = math.sqrt(cov[i, i] * cov[j, j]) if cov[i, i] > 0 and cov[j, j] > 0 else 0.0
            rows.append((i, j, cols[i], cols[j], float(cov[i, j] / den) if den > 0 else None))
    return df.sparkSession.createDataFrame(rows, "i int, j int, feature_i string, feature_j string, corr double")


def correlated_drop(pairs: DataFrame, cols, threshold: float = 0.8) -> DataFrame:
    """Column j is removed when |corr(i, j)| > threshold for any i < j
    (even if i itself is removed); undefined correlations never remove."""
    spark = pairs.sparkSession
    names = spark.createDataFrame([(i, c) for i, c in enumerate(cols)], "j int, feature string")
    removed = pairs.where(F.abs("corr") > threshold).select("j").distinct().withColumn("removed", F.lit(True))
    return names.join(removed, "j", "left").select("j", "feature", F.coalesce("removed", F.lit(False)).alias("removed"))


# --- PCA ------------------------------------------------------------------------------

def pca_fit(df: DataFrame, cols, variance_ratio: float | int | None = 0.95):
    """Eigen-decomposition of the d x d covariance (driver, d <= 30);
    components ordered by variance, sign fixed so that the largest |loading|
    of each component is positive; k = smallest count whose cumulative
    explained ratio exceeds ``variance_ratio`` (int = fixed k)."""
    mu, cov, n = covariance(df, cols)
    vals, vecs = np.linalg.eigh(cov)
    order = np.argsort(vals)[::-1]
    vals, vecs = np.clip(vals[order], 0.0, None), vecs[:, order].T
    for r in range(len(vecs)):
        if vecs[r][np.argmax(np.abs(vecs[r]))] < 0:
            vecs[r] = -vecs[r]
    total = vals.sum()
    ratio = vals / total if total > 0 else np.zeros_like(vals)
    if variance_ratio is None:
        k = len(vals)
    elif isinstance(variance_ratio, int):
        k = variance_ratio
    else:
        k = int(np.searchsorted(np.cumsum(ratio), variance_ratio, side="right") + 1)
        k = min(k, len(vals))
    return {"mean": mu, "components": vecs[:k], "explained_variance": vals[:k], "explained_ratio": ratio[:k],
            "all_variance": vals, "all_ratio": ratio, "n": n}


def dot(cols, weights) -> Column:
    expr = F.lit(0.0)
    for c, w in zip(cols, weights):
        expr = expr + (c * F.lit(float(w)))
    return expr


def pca_project(df: DataFrame, cols, fit: dict, keep=("card_id",), prefix: str = "pc") -> DataFrame:
    """Mean-centred projection onto the kept components."""
    cen = [F.col(c) - F.lit(float(m)) for c, m in zip(cols, fit["mean"])]
    return df.select(*keep, *[dot(cen, comp).alias(f"{prefix}{k}") for k, comp in enumerate(fit["components"])])


# --- Yeo-Johnson -------------------------------------------------------------------------

def yeo_johnson(x: Column, lam: Column | float) -> Column:
    """psi(lambda, x) as a JVM expression."""
    lam = lam if isinstance(lam, Column) else F.lit(float(lam))
    pos = F.when(F.abs(lam) < 1e-12, F.log1p(x)).otherwise((F.pow(x + 1.0, lam) - 1.0) / lam)
    neg = F.when(F.abs(lam - 2.0) < 1e-12, -F.log1p(-x)).otherwise(-(F.pow(1.0 - x, 2.0 - lam) - 1.0) / (2.0 - lam))
    return F.when(x >= 0, pos).otherwise(neg)


def _psi(x: np.ndarray, lam: np.ndarray, scale: np.ndarray | float = 0.0) -> np.ndarray:
    """psi of each x for each lambda, times exp(-scale): (x+1)^l = exp(l *
    log1p(x)) on the non-negative part, (1-x)^(2-l) = exp((2-l) * log1p(-x)) on
    the rest."""
    out = np.empty((len(x), len(lam)))
    pos, scale = x >= 0, np.broadcast_to(scale, lam.shape)

    def side(t, power):   # (e^(t power) - 1) / power
        flat = np.abs(power) < 1e-12
        grown = np.where(scale > 0, np.exp(t * power - scale) - np.exp(-scale), np.expm1(t * power))
        return np.where(flat, t * np.exp(-scale), grown / np.where(flat, 1.0, power))

    with np.errstate(all="ignore"):
        out[pos] = side(np.log1p(x[pos])[:, None], lam)
        out[~pos] = -side(np.log1p(-x[~pos])[:, None], 2.0 - lam)
    return out


def _psi_scale(lam: np.ndarray, low: float, high: float) -> np.ndarray:
    """Logarithm by which psi is divided where it would grow beyond e^200 on
    [low, high]; 0 elsewhere."""
    up = lam * np.log1p(high) if high > 0 else np.zeros(len(lam))
    down = (2.0 - lam) * np.log1p(-low) if low < 0 else np.zeros(len(lam))
    most = np.maximum(up, down)
    return np.where(most > 200, most, 0.0)


def yj_loglik_grid(df: DataFrame, cols, grids: dict) -> DataFrame:
    """Log-likelihood of every (column, lambda) candidate in ONE pass.  Tasks
    return n, sum(sign * log1p|x|) and the first two moments of psi around
    psi(column mean); ``run_pass`` adds them, so the driver reads columns x
    grid numbers.  LL = -n/2 ln var_pop + (lambda - 1) sum."""
    cols = list(cols)
    grid = [np.asarray(grids[c], dtype=np.float64) for c in cols]
    real = [nan_to_null(F.col(c).cast("double")) for c in cols]
    about = df.agg(*[F.struct(F.avg(x).alias("mean"), F.min(x).alias("low"), F.max(x).alias("high")) for x in real]).first()
    scale = [_psi_scale(g, a["low"] or 0.0, a["high"] or 0.0) for a, g in zip(about, grid, strict=True)]
    origin = [_psi(np.array([a["mean"] or 0.0]), g, s)[0] for a, g, s in zip(about, grid, scale, strict=True)]

    def moments(batches):
        acc = {}
        for X in batches:
            for i, g in enumerate(grid):
                x = X[:, i]
                x = x[~np.isnan(x)]
                if len(x):
                    P = _psi(x, g, scale[i]) - origin[i]
                    stat = np.concatenate([[len(x), (np.sign(x) * np.log1p(np.abs(x))).sum()], P.sum(0), (P * P).sum(0)])
                    acc[(i, 0)] = acc.get((i, 0), 0.0) + stat
        return acc

    out = []
    for (i, _), s in sorted(run_pass(as_matrix(df, cols), moments).items()):
        n, slog, k = s[0], s[1], len(grid[i])
        var = s[2 + k:] / n - (s[2:2 + k] / n) ** 2
        for lam, v, log in zip(grid[i], var, scale[i], strict=True):
            ll = float(-n / 2.0 * (np.log(v) + 2 * log) + (lam - 1.0) * slog) if v > 0 and np.isfinite(v) else None
            out.append((cols[i], float(lam), ll))
    return df.sparkSession.createDataFrame(out, "feature string, lam double, ll double")


def lambda_grid(lo: float, hi: float, points: int) -> list:
    """Evenly spaced candidates, rounded so that e.g. 0.0 is exactly zero."""
    return [round(lo + (hi - lo) * i / (points - 1), 12) for i in range(points)]


def yj_fit(df: DataFrame, cols, rounds: int | None = None, points: int = 17, start: float = 2.0, width: float = 2e-3) -> dict:
    """Per-column lambda that maximises the log-likelihood, without
    bounds.  Each step is one pass for all columns that are not done: ``points``
    values over a column's bracket, at first [-start, start].  If the best one is
    an end, the bracket moves past it and doubles; else it shrinks to the
    neighbours of the best.  Below ``width`` the vertex of the parabola through
    the best three ends the search.  A column without a likelihood (constant,
    empty) gets 1.  ``rounds`` stops after so many passes with the best so far."""
    best, open_ = {}, {c: (-start, start) for c in cols}
    done = 0
    while open_:
        done += 1
        grids = {c: lambda_grid(lo, hi, points) for c, (lo, hi) in open_.items()}
        found = {c: {} for c in open_}
        for row in yj_loglik_grid(df, list(open_), grids).collect():   # columns x points numbers
            if row["ll"] is not None and not math.isnan(row["ll"]):
                found[row["feature"]][row["lam"]] = row["ll"]
        for c, (lo, hi) in list(open_.items()):
            grid, ll, step = grids[c], found[c], (hi - lo) / (points - 1)
            if not ll:
                best[c] = 1.0
                del open_[c]
                continue
            at = max(ll, key=lambda x, ll=ll: (ll[x], -abs(x)))
            left, right = grid[max(0, grid.index(at) - 1)], grid[min(points - 1, grid.index(at) + 1)]
            if done == rounds:
                best[c] = at
                del open_[c]
            elif at == grid[0] and at - step < at:
                open_[c] = (at - 2 * (hi - lo), right)
            elif at == grid[-1] and at + step > at:
                open_[c] = (left, at + 2 * (hi - lo))
            elif right - left > width and left in ll and right in ll:
                open_[c] = (left, right)
            elif right - left > 1e-9 * max(1.0, abs(at)) and not (left in ll and right in ll):
                open_[c] = (left, right)   # the likelihood ends between them
            else:
                best[c] = _vertex(at, step, ll.get(left), ll[at], ll.get(right))
                del open_[c]
    return best


def _vertex(at: float, step: float, left: float | None, middle: float, right: float | None) -> float:
    """Highest point of the parabola through three values ``step`` apart."""
    if left is None or right is None or left - 2 * middle + right >= 0:
        return at
    return at + 0.5 * step * (left - right) / (left - 2 * middle + right)


def yj_apply(df: DataFrame, cols, lambdas: dict, standardize: bool = True, keep=("card_id",)) -> DataFrame:
    """Transform with fitted lambdas, then standardise (ddof 0)."""
    t = df.select(*keep, *[yeo_johnson(F.col(c), lambdas[c]).alias(c) for c in cols])
    if not standardize:
        return t
    return apply_scaling(t, standard_params(t, cols), keep)


# --- pipeline ------------------------------------------------------------------------------

@dataclass
class PreprocessModel:
    """Fitted parameters (all bounded by the number of features)."""
    feature_cols: list
    scaler: str
    scale_params: dict
    corr_removed: list
    kept: list
    pca: dict | None
    lambdas: dict | None
    yj_std: dict | None
    info: dict = field(default_factory=dict)

    def transform(self, features: DataFrame, key: str = "card_id") -> DataFrame:
        """(key, v array<double>) ready for clustering, plus the columns x0..xk."""
        s = apply_scaling(features, self.scale_params, (key,))
        out_cols = self.kept
        if self.pca is not None:
            s = pca_project(s, self.kept, self.pca, (key,), "pc")
            out_cols = [f"pc{k}" for k in range(len(self.pca["components"]))]
        if self.lambdas is not None:
            s = s.select(key, *[yeo_johnson(F.col(c), self.lambdas[c]).alias(c) for c in out_cols])
            s = apply_scaling(s, self.yj_std, (key,))
        return s.select(key, F.array(*[F.col(c) for c in out_cols]).alias("v"),
                        *[F.col(c).alias(f"x{i}") for i, c in enumerate(out_cols)])


def fit_preprocess(features: DataFrame, cfg: SegmentationConfig = SegmentationConfig(),
                   cols=FEATURE_COLUMNS, key: str = "card_id") -> PreprocessModel:
    """Scale -> drop correlated -> PCA -> Yeo-Johnson (+ standardise)."""
    cols = list(cols)
    params = robust_params(features, cols) if cfg.scaler == "robust" else standard_params(features, cols)
    scaled = apply_scaling(features, params, (key,))
    removed = [cols[j] for j in drop_rule(correlation_matrix(scaled, cols), cfg.correlation_threshold)]
    kept = [c for c in cols if c not in removed]
    pca = pca_fit(scaled, kept, cfg.pca_variance_ratio) if cfg.pca_variance_ratio else None
    lambdas = yj_std = None
    out_cols = kept
    if pca is not None:
        proj = pca_project(scaled, kept, pca, (key,), "pc")
        out_cols = [f"pc{k}" for k in range(len(pca["components"]))]
    else:
        proj = scaled
    if cfg.power_transform:
        try:
            lambdas = yj_fit(proj, out_cols)
            t = proj.select(key, *[yeo_johnson(F.col(c), lambdas[c]).alias(c) for c in out_cols])
            yj_std = standard_params(t, out_cols)
        except Exception:  # noqa: BLE001
            if cfg.power_on_error != "skip":
                raise
            lambdas = yj_std = None
    n = pca["n"] if pca else features.count()
    info = {"original_shape": (n, len(cols)), "scaled_shape": (n, len(cols)), "decorr_shape": (n, len(kept)),
            "pca_shape": (n, len(out_cols)), "final_shape": (n, len(out_cols)),
            "pca_variance_explained": float(np.sum(pca["explained_ratio"])) if pca else None,
            "removed": removed}
    return PreprocessModel(cols, cfg.scaler, params, removed, kept, pca, lambdas, yj_std, info)


def preprocess_info(model: PreprocessModel, spark) -> DataFrame:
    """One-row stage-shape report of a fitted pipeline."""
    i = model.info
    row = (i["original_shape"][0], i["original_shape"][1], i["decorr_shape"][1], i["pca_shape"][1],
           i["final_shape"][1], i["pca_variance_explained"], ",".join(i["removed"]))
    return spark.createDataFrame([row], "n_rows long, n_features long, n_decorrelated long, n_pca long, "
                                        "n_final long, pca_variance_explained double, removed string")
