"""K-Means sweep (several k, several restarts) as batched passes.

All (k, restart) candidates advance together: each pass assigns every point
to the nearest centre of every active candidate inside one pandas task per
partition and returns per-cluster counts, sums and inertia.

Seeding is k-means|| over all rows: ``INIT_ROUNDS`` passes draw about
``2 * max(ks)`` points a round with probability proportional to their squared
distance to what is drawn already, one more pass weighs the drawn points by
the rows nearest to them, and k-means++ over these few weighted points (a
number that depends on k only) gives each candidate's first centres.  Draws
are made by a hash of the point's id, so they do not depend on the
partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.operators.batched import column_variances, matrix, packed, run_pass
from cardprism.operators.vectors import lit_vector, sq_dist

INIT_ROUNDS = 3
TILE = 512   # points whose distances to all centres of one k stay in the processor's cache


@dataclass
class KMeansResult:
    k: int
    restart: int
    centers: np.ndarray
    inertia: float
    n_iter: int


def sq_distances(X: np.ndarray, C: np.ndarray) -> np.ndarray:
    return np.maximum((X * X).sum(1)[:, None] + (C * C).sum(1)[None, :] - 2.0 * X @ C.T, 0.0)


def kmeanspp(X: np.ndarray, w: np.ndarray, k: int, rng: np.random.RandomState) -> np.ndarray:
    """Greedy k-means++ over weighted points (2 + log k trials per centre)."""
    draw = lambda p, size: np.clip(np.searchsorted(np.cumsum(p), rng.random_sample(size) * p.sum()), 0, len(X) - 1)
    centers = [X[draw(w, 1)[0]]]
    d2 = ((X - centers[0]) ** 2).sum(1)
    for _ in range(1, k):
        p = w * d2
        trials = draw(p if p.sum() > 0 else w, 2 + int(np.log(k)))
        nearer = [np.minimum(d2, ((X - X[c]) ** 2).sum(1)) for c in trials]
        best = min(range(len(trials)), key=lambda t: float((w * nearer[t]).sum()))
        centers.append(X[trials[best]])
        d2 = nearer[best]
    return np.array(centers)


def _uniform(ids: np.ndarray, seed: int) -> np.ndarray:
    """Hash of (id, seed) in [0, 1)."""
    h = ids.astype(np.int64).view(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64)
    for shift, mul in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(mul)
    return ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def parallel_seeds(points: DataFrame, k: int, pools: int, seed: int, pack: DataFrame | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-means||: ``pools`` independent sets of weighted candidate points.
    ``pack``: the same points from ``packed``."""
    pack = points if pack is None else pack
    first = points.select("id", "v").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(pools).collect()
    drawn = [np.array([first[p % len(first)]["v"]], float) for p in range(pools)]

    def cost(batches):
        acc = {}
        for X in batches:
            for p, C in enumerate(drawn):
                acc[(p, 0)] = acc.get((p, 0), 0.0) + sq_distances(X, C).min(1).sum()
        return acc

    for r in range(INIT_ROUNDS):
        phi = {p: float(v[0]) for (p, _), v in run_pass(pack, cost).items()}

        def draw(it, phi=phi, r=r):
            for pdf in it:
                if not len(pdf):
                    continue
                X, ids = matrix(pdf), pdf["id"].to_numpy()
                for p, C in enumerate(drawn):
                    if phi.get(p, 0.0) > 0:
                        hit = _uniform(ids, seed + 1009 * p + 100_003 * (r + 1)) < 2 * k * sq_distances(X, C).min(1) / phi[p]
                        if hit.any():
                            yield pd.DataFrame({"pool": p, "id": ids[hit], "v": list(X[hit])})

        new = points.select("id", "v").mapInPandas(draw, "pool int, id long, v array<double>").orderBy("pool", "id").collect()
        for p in range(pools):   # about 2 k points a pool and round
            rows = [x["v"] for x in new if x["pool"] == p]
            drawn[p] = np.vstack([drawn[p], *([np.array(rows, float)] if rows else [])])

    def weigh(batches):
        acc = {}
        for X in batches:
            for p, C in enumerate(drawn):
                n = np.bincount(sq_distances(X, C).argmin(1), minlength=len(C)).astype(float)
                acc[(p, 0)] = acc.get((p, 0), 0.0) + n
        return acc

    weights = run_pass(pack, weigh)
    return [(drawn[p], weights[(p, 0)]) for p in range(pools)]


def _assign_fn(centers: dict):
    """Per (candidate, cluster): count, inertia and the sum of its points.
    Candidates of one k go together, tile by tile."""
    groups = [(k, [c for c, C in centers.items() if len(C) == k]) for k in sorted({len(C) for C in centers.values()})]
    stacked = [np.vstack([centers[c] for c in cands]).astype(float) for _, cands in groups]

    def fn(batches):
        total = None
        for X in batches:
            if total is None:
                total = [np.zeros((len(C), 2 + X.shape[1])) for C in stacked]
            for s in range(0, len(X), TILE):
                P = X[s:s + TILE]
                norm = (P * P).sum(1)
                stat = np.column_stack([np.ones(len(P)), np.zeros(len(P)), P])
                for (k, cands), C, out in zip(groups, stacked, total):
                    G = (-2.0 * C) @ P.T
                    G += (C * C).sum(1)[:, None]
                    G = G.reshape(len(cands), k, len(P))   # squared distances less the points' norms
                    least = G.min(1)
                    own = (G == least[:, None]).astype(float)
                    part = own.reshape(len(C), len(P)) @ stat
                    if part[:, 0].sum() != least.size:   # ties: the lowest
                        own = (own.argmax(1)[:, None] == np.arange(k)[None, :, None]).astype(float)
                        part = own.reshape(len(C), len(P)) @ stat
                    least += norm
                    np.maximum(least, 0.0, out=least)
                    part[:, 1] = np.matmul(own, least[:, :, None]).ravel()
                    out += part
        if total is None:
            return {}
        return {(c, j): out[i * k + j] for (k, cands), out in zip(groups, total) for i, c in enumerate(cands) for j in range(k)}
    return fn


def farthest_points(points: DataFrame, centers: np.ndarray, m: int) -> np.ndarray:
    """The ``m`` points farthest from their nearest centre."""
    far = F.least(*[sq_dist(F.col("v"), lit_vector(c)) for c in centers])
    rows = points.select("id", "v", far.alias("d")).orderBy(F.desc("d"), "id").limit(m).collect()
    return np.array([r["v"] for r in rows], float)


def kmeans_sweep(points: DataFrame, ks=(3, 4, 5, 6, 7, 8), restarts: int = 10, max_iter: int = 300,
                 tol: float = 1e-4, seed: int = 42) -> list[KMeansResult]:
    """Fit every (k, restart); return all results (callers keep the lowest
    inertia per k).  ``points``: (id, v array<double>), ideally cached.
    Empty clusters move to the points farthest from their centres; the
    inertia is that of the final centres, from a last pass."""
    var = column_variances(points)
    if not len(var):
        return []
    stop = tol * float(var.mean())
    pack = packed(points)
    pools = parallel_seeds(points, max(ks), restarts, seed, pack)
    meta = {c: kr for c, kr in enumerate((k, r) for k in ks for r in range(restarts))}
    cands = {c: kmeanspp(*pools[r], k, np.random.RandomState(seed + r)) for c, (k, r) in meta.items()}
    active, iters = dict(cands), dict.fromkeys(cands, 0)
    for _ in range(max_iter):
        if not active:
            break
        stats, moving = run_pass(pack, _assign_fn(active)), {}
        for c, C in active.items():
            new = np.array([s[2:] / s[0] if (s := stats[(c, j)])[0] > 0 else C[j] for j in range(len(C))])
            empty = [j for j in range(len(C)) if stats[(c, j)][0] == 0]
            if empty:
                far = farthest_points(points, C, len(empty))
                new[empty[:len(far)]] = far
            cands[c], iters[c] = new, iters[c] + 1
            if float(((new - C) ** 2).sum()) > stop:
                moving[c] = new
        active = moving
    final = run_pass(pack, _assign_fn(cands))
    pack.unpersist()
    inertia = {c: sum(float(final[(c, j)][1]) for j in range(len(C))) for c, C in cands.items()}
    return [KMeansResult(*meta[c], cands[c], inertia[c], iters[c]) for c in cands]


def best_per_k(results: list[KMeansResult]) -> dict:
    best = {}
    for r in results:
        if r.k not in best or r.inertia < best[r.k].inertia:
            best[r.k] = r
    return best


def assign_nearest(points: DataFrame, centers, cluster_col: str = "cluster") -> DataFrame:
    """Nearest centre per point as a JVM expression (k literal
    vectors; ties -> lowest centre index)."""
    dists = [F.struct(sq_dist(F.col("v"), lit_vector(c)).alias("d"), F.lit(j).alias("j"))
             for j, c in enumerate(centers)]
    return points.select("*", F.least(*dists)["j"].alias(cluster_col))


def lloyd_step(points: DataFrame, centers) -> DataFrame:
    """One Lloyd update from fixed centres: assign, then mean vector
    of each cluster (element-wise, per dimension)."""
    a = assign_nearest(points, centers)
    e = a.select("cluster", F.posexplode("v").alias("i", "x"))
    return e.groupBy("cluster", "i").agg(F.avg("x").alias("center"), F.count(F.lit(1)).alias("size"))
