"""Gaussian mixtures with four covariance types, batched EM.

Spark ML's GaussianMixture offers full covariances only, so EM is written
as passes over the card matrix: per pass, every active candidate
(components, covariance type) computes responsibilities for the partition's
points in numpy (log-sum-exp, Cholesky) and emits N_k, sum r x, sum r x x^T
and the log-likelihood; the reduced statistics (sum over candidates of
k x d x d numbers) drive the M-step on the driver.  Second moments are taken
around the current means, so large offsets cancel nothing.  Candidates retire
independently when the mean log-likelihood changes by less than ``tol``, and a
candidate whose covariance turns singular is marked as failed and left out;
the others go on.  Initialisation: K-Means centres per component count (hard
responsibilities).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from cardprism.operators.batched import FAILED, failed_candidates, packed, run_pass

LOG2PI = np.log(2.0 * np.pi)
EPS = 10 * np.finfo(float).eps
TILE = 512   # points whose numbers for all components of a model stay in the processor's cache


@dataclass
class GMM:
    k: int
    cov_type: str
    weights: np.ndarray
    means: np.ndarray
    cov: np.ndarray                 # full: k x d x d; tied: d x d; diag: k x d; spherical: k
    n_iter: int = 0
    converged: bool = False
    lower_bound: float = float("-inf")
    history: list = field(default_factory=list)
    error: str | None = None

    def n_parameters(self) -> int:
        d = self.means.shape[1]
        cov = {"full": self.k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": self.k * d,
               "spherical": self.k}[self.cov_type]
        return int(cov + self.k * d + self.k - 1)


def log_resp(X: np.ndarray, g: GMM) -> tuple[np.ndarray, np.ndarray]:
    """Weighted log densities (n x k) and per-point log-likelihood (n)."""
    n, d = X.shape
    lp = np.empty((n, g.k))
    if g.cov_type in ("full", "tied"):
        covs = g.cov if g.cov_type == "full" else np.broadcast_to(g.cov, (g.k, d, d))
        for j in range(g.k):
            L = np.linalg.cholesky(covs[j])
            z = np.linalg.solve(L, (X - g.means[j]).T)
            lp[:, j] = -0.5 * (d * LOG2PI + 2.0 * np.log(np.diag(L)).sum() + (z * z).sum(0))
    elif g.cov_type == "diag":
        for j in range(g.k):
            v = g.cov[j]
            lp[:, j] = -0.5 * (d * LOG2PI + np.log(v).sum() + (((X - g.means[j]) ** 2) / v).sum(1))
    else:
        for j in range(g.k):
            v = g.cov[j]
            lp[:, j] = -0.5 * (d * LOG2PI + d * np.log(v) + ((X - g.means[j]) ** 2).sum(1) / v)
    lp += np.log(g.weights)[None, :]
    mx = lp.max(1, keepdims=True)
    lse = (mx + np.log(np.exp(lp - mx).sum(1, keepdims=True)))[:, 0]
    return lp, lse


def _stats(X, resp, cov_type, centers):
    """Per component: N, log-likelihood slot, sum r (x - c), sum r (x - c)(x - c)^T
    (or its diagonal), c the component's current mean."""
    N = resp.sum(0)
    out = []
    for j in range(resp.shape[1]):
        Z = X - centers[j]
        R = Z * resp[:, j:j + 1]
        s2 = (R.T @ Z).ravel() if cov_type in ("full", "tied") else (R * Z).sum(0)
        out.append(np.concatenate([[N[j], 0.0], R.sum(0), s2]))
    return out


def _scale(g: GMM) -> tuple[np.ndarray, np.ndarray]:
    """What turns centred points into standardised ones, per component, and the
    constant of its log density, weight included."""
    d = g.means.shape[1]
    if g.cov_type in ("full", "tied"):
        L = np.linalg.cholesky(g.cov if g.cov_type == "full" else g.cov[None])
        scale, logdet = np.linalg.inv(L), 2.0 * np.log(np.diagonal(L, axis1=1, axis2=2)).sum(1)
    elif g.cov_type == "diag":
        scale, logdet = 1.0 / g.cov, np.log(g.cov).sum(1)
    else:
        scale, logdet = 1.0 / g.cov, d * np.log(g.cov)
    return scale, np.log(g.weights) - 0.5 * (d * LOG2PI + logdet)


def _tile_stats(T: np.ndarray, g: GMM, scale: np.ndarray, const: np.ndarray) -> np.ndarray:
    """The statistics of ``_stats`` for the points T (d x m), all components at
    once, the log-likelihood in the first one's slot."""
    Z = T[None] - g.means[:, :, None]
    if g.cov_type in ("full", "tied"):
        W = np.matmul(scale, Z)
        q = np.einsum("kdm,kdm->km", W, W)
    else:
        sq = Z * Z
        q = np.matmul(scale[:, None, :], sq)[:, 0] if g.cov_type == "diag" else sq.sum(1) * scale[:, None]
    lp = const[:, None] - 0.5 * q
    top = lp.max(0)
    lse = top + np.log(np.exp(lp - top).sum(0))
    if not np.isfinite(lse).all():
        raise FloatingPointError("log-likelihood is not finite")
    resp = np.exp(lp - lse)
    first = np.matmul(Z, resp[:, :, None])[:, :, 0]
    if g.cov_type in ("full", "tied"):
        second = np.matmul(Z * resp[:, None, :], Z.transpose(0, 2, 1)).reshape(g.k, -1)
    else:
        second = np.matmul(sq, resp[:, :, None])[:, :, 0]
    ll = np.zeros(g.k)
    ll[0] = lse.sum()
    return np.column_stack([resp.sum(1), ll, first, second])


def _estep_fn(models: dict, hard: dict):
    """models: cand -> GMM (soft E-step); hard: cand -> (cov_type, centers)."""
    def fn(batches):
        acc, failed, scales, total = {}, set(), {}, {}
        for X in batches:
            tiles = [np.ascontiguousarray(X[s:s + TILE].T) for s in range(0, len(X), TILE)]
            for cand, g in models.items():
                if cand in failed:
                    continue
                try:
                    if cand not in scales:
                        scales[cand] = _scale(g)
                    total[cand] = sum((_tile_stats(T, g, *scales[cand]) for T in tiles), total.get(cand, 0.0))
                except (np.linalg.LinAlgError, FloatingPointError):
                    failed.add(cand)
            for cand, (cov_type, C) in hard.items():
                d2 = (X * X).sum(1)[:, None] + (C * C).sum(1)[None, :] - 2.0 * X @ C.T
                resp = np.zeros((len(X), len(C)))
                resp[np.arange(len(X)), d2.argmin(1)] = 1.0
                _add(acc, cand, X, resp, cov_type, 0.0, C)
        acc |= {(cand, j): row for cand, rows in total.items() for j, row in enumerate(rows)}
        return {k: v for k, v in acc.items() if k[0] not in failed} | {(c, FAILED): [1.0] for c in failed}
    return fn


def _add(acc, cand, X, resp, cov_type, ll, centers):
    for j, s in enumerate(_stats(X, resp, cov_type, centers)):
        if j == 0:
            s[1] = ll
        acc[(cand, j)] = acc.get((cand, j), 0.0) + s


def mstep(stats: dict, cand: int, k: int, cov_type: str, n_total: float, reg: float, centers: np.ndarray) -> GMM:
    """``centers``: the means that the statistics were taken around."""
    d = centers.shape[1]
    S = np.array([stats[(cand, j)] for j in range(k)])
    N = S[:, 0] + EPS
    shift = S[:, 2:2 + d] / N[:, None]
    means = centers + shift
    if cov_type in ("full", "tied"):
        S2 = S[:, 2 + d:].reshape(k, d, d)
        if cov_type == "full":
            cov = S2 / N[:, None, None] - np.einsum("ki,kj->kij", shift, shift)
            cov = 0.5 * (cov + cov.transpose(0, 2, 1)) + reg * np.eye(d)[None]
        else:
            cov = (S2.sum(0) - np.einsum("k,ki,kj->ij", N, shift, shift)) / N.sum()
            cov = 0.5 * (cov + cov.T) + reg * np.eye(d)
    else:
        cov = S[:, 2 + d:] / N[:, None] - shift ** 2 + reg
        if cov_type == "spherical":
            cov = cov.mean(1)
    return GMM(k, cov_type, N / n_total, means, cov)


def loglik_total(stats: dict, cand: int) -> float:
    return float(stats[(cand, 0)][1])


def fit_many(points: DataFrame, specs, init_centers: dict, n_total: int, max_iter: int = 100,
             tol: float = 1e-3, reg: float = 1e-6) -> dict:
    """Fit every spec (cand -> (k, cov_type)) together.  ``init_centers``:
    k -> K-Means centres.  Returns cand -> fitted GMM whose ``lower_bound``
    is the mean log-likelihood under the final parameters; a candidate that
    broke down has ``error`` set."""
    pack = packed(points)
    stats = run_pass(pack, _estep_fn({}, {c: (cov, init_centers[k]) for c, (k, cov) in specs.items()}))
    models = {}
    for c, (k, cov) in specs.items():
        if c in failed_candidates(stats):
            models[c] = GMM(k, cov, np.full(k, 1 / k), init_centers[k], np.zeros(0), error="statistics not finite")
        else:
            models[c] = mstep(stats, c, k, cov, n_total, reg, init_centers[k])
    active = {c: g for c, g in models.items() if g.error is None}

    def drop_failed(stats, among):
        for c in failed_candidates(stats):
            models[c].error = "singular covariance or log-likelihood not finite"
            models[c].lower_bound = float("nan")
            among.pop(c, None)

    for _ in range(max_iter):
        if not active:
            break
        stats = run_pass(pack, _estep_fn(active, {}))
        drop_failed(stats, active)
        moving = {}
        for c, g in active.items():
            bound = loglik_total(stats, c) / n_total
            new = mstep(stats, c, g.k, g.cov_type, n_total, reg, g.means)
            new.n_iter, new.history, new.lower_bound = g.n_iter + 1, g.history + [bound], bound
            models[c] = new
            if abs(bound - g.lower_bound) < tol:
                new.converged = True
            else:
                moving[c] = new
        active = moving
    # final parameters: log-likelihood under them (BIC / AIC use it)
    good = {c: g for c, g in models.items() if g.error is None}
    final = run_pass(pack, _estep_fn(good, {}))
    pack.unpersist()
    drop_failed(final, good)
    for c, g in good.items():
        g.lower_bound = loglik_total(final, c) / n_total
    return models


def bic(g: GMM, n: int) -> float:
    return -2.0 * g.lower_bound * n + g.n_parameters() * np.log(n)


def aic(g: GMM, n: int) -> float:
    return -2.0 * g.lower_bound * n + 2.0 * g.n_parameters()


def predict(points: DataFrame, models: dict, key: str = "id") -> DataFrame:
    """Labels of every model in one pass: (id, cand, cluster)."""
    def mapper(it):
        for pdf in it:
            if not len(pdf):
                continue
            X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            ids = pdf[key].to_numpy()
            out = []
            for c, g in models.items():
                lp, _ = log_resp(X, g)
                out.append(pd.DataFrame({"id": ids, "cand": c, "cluster": lp.argmax(1).astype(np.int32)}))
            yield pd.concat(out, ignore_index=True)
    return points.select(key, "v").mapInPandas(mapper, "id long, cand int, cluster int")


def estep_frame(points: DataFrame, g: GMM) -> DataFrame:
    """Responsibilities and log-likelihood per point for fixed parameters."""
    def mapper(it):
        for pdf in it:
            if not len(pdf):
                continue
            X = np.stack(pdf["v"].to_numpy()).astype(np.float64)
            lp, lse = log_resp(X, g)
            resp = np.exp(lp - lse[:, None])
            yield pd.DataFrame({"id": pdf["id"].to_numpy(), "ll": lse, "resp": list(resp)})
    return points.select("id", "v").mapInPandas(mapper, "id long, ll double, resp array<double>")
