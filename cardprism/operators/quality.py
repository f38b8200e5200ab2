"""Q01-Q07: clustering quality.

Per-cluster statistics are one aggregation; anything of size k or k x d
(centroids, the k x k Davies-Bouldin ratios) is combined on the driver, which
never sees a row of data.  The exact Euclidean silhouette is O(n^2): blocks of
points meet pairwise (``blocks``) and their distances are reduced at once to
per-(point, cluster) sums - pairs never become rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cardprism.operators.blocks import CACHED, block_pairs, cached_tiles, own_tasks, sides, tiles, vectors
from cardprism.operators.vectors import centroids, sq_dist
from cardprism.session import cut_lineage

NOISE = -1
PRODUCT_WIDTH = 512   # clusters of all labellings that one matrix product adds up
PAIR_SUMS = "id long, cand int, cluster long, other long, dsum double, cnt long"


# --- sizes and balance ------------------------------------------------------

def cluster_sizes(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Q01: size per cluster (noise included as -1) and share of non-noise points."""
    sizes = labels.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    valid = F.sum(F.when(F.col("cluster") != NOISE, F.col("size"))).over(Window.partitionBy())   # over one row per cluster
    return sizes.select("cluster", "size",
                        F.when(F.col("cluster") != NOISE, F.col("size") * 100.0 / valid).alias("pct_of_valid"))


def cluster_balance(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Q02: n_clusters, noise ratio, largest share and balance = 1 - Gini of
    the (ascending) cluster sizes.  No clusters -> balance 0, largest 100.
    One aggregation to k rows, a rank over those k rows (noise ordered
    last, so valid clusters get ranks 1..n), one final aggregate."""
    sizes = labels.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    is_noise = (F.col("cluster") == NOISE)
    ranked = sizes.withColumn("r", F.row_number().over(Window.orderBy(is_noise.cast("int"), "size", "cluster")))
    valid = ~is_noise
    g = ranked.agg(
        F.count_if(valid).alias("n"), F.sum(F.when(valid, F.col("size"))).alias("s"),
        F.sum(F.when(valid, F.col("r") * F.col("size"))).alias("rs"), F.max(F.when(valid, F.col("size"))).alias("mx"),
        F.sum("size").alias("total"), F.coalesce(F.sum(F.when(is_noise, F.col("size"))), F.lit(0)).alias("noise"))
    gini = 2.0 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1.0) / F.col("n")
    return g.select(
        F.col("n").cast("long").alias("n_clusters"),
        F.col("total").cast("long").alias("total_points"),
        F.col("noise").cast("long").alias("noise_points"),
        (F.col("noise") / F.col("total")).alias("noise_ratio"),
        F.when(F.col("n") > 0, F.col("mx") * 100.0 / F.col("s")).otherwise(F.lit(100.0)).alias("largest_cluster_pct"),
        F.when(F.col("n") > 0, 1.0 - gini).otherwise(F.lit(0.0)).alias("balance_ratio"))


def size_stats(labels: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Q06: min / max / mean cluster size and cluster_balance = 1 - CV
    (population std; a single cluster -> 1).  Not the Gini balance of Q02."""
    sizes = labels.where(F.col(cluster_col) != NOISE).groupBy(cluster_col).agg(F.count(F.lit(1)).alias("size"))
    return sizes.agg(
        F.min("size").cast("long").alias("min_cluster_size"), F.max("size").cast("long").alias("max_cluster_size"),
        F.avg("size").alias("avg_cluster_size"),
        F.when(F.count(F.lit(1)) > 1, 1.0 - F.stddev_pop("size") / F.avg("size"))
         .when(F.count(F.lit(1)) == 1, F.lit(1.0)).alias("cluster_balance"))


def drop_noise(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """The rows that belong to a cluster."""
    return labelled.where(F.col(cluster_col) != NOISE)


# --- silhouette ---------------------------------------------------------------

def _many_fn(n_cands: int, kmax: int):
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for left, right in sides(pdf):
            L, R = vectors(left), vectors(right)
            ids = left["id"].to_numpy()
            LL, RL = np.stack(left["labs"].to_numpy()), np.stack(right["labs"].to_numpy())
            onehots = [(RL[:, m][:, None] == np.arange(kmax)[None, :]).astype(np.float64) for m in range(n_cands)]
            for rows, D in tiles(L, R):
                for m, onehot in enumerate(onehots):
                    # label -1: the point is noise (or unlabelled) in this labelling
                    keep = LL[rows, m] >= 0
                    cnt = onehot.sum(0)
                    present = np.nonzero(cnt)[0]
                    if not len(present) or not keep.any():
                        continue
                    sums, nl = D[keep] @ onehot[:, present], int(keep.sum())
                    out.append(pd.DataFrame({
                        "id": np.repeat(ids[rows][keep], len(present)), "cand": m, "cluster": np.repeat(LL[rows, m][keep], len(present)),
                        "other": np.tile(present, nl), "dsum": sums.reshape(-1), "cnt": np.tile(cnt[present], nl).astype(np.int64)}))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=["id", "cand", "cluster", "other", "dsum", "cnt"])
    return fn


def _mean_silhouettes(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Per-point silhouettes (b - a) / max(a, b), 0 for a singleton cluster,
    from the (id, cluster, other) distance sums."""
    s = sums.groupBy(*keys, "id", "cluster", "other").agg(F.sum("dsum").alias("dsum"), F.sum("cnt").alias("cnt"))
    own = F.col("other") == F.col("cluster")
    per = s.groupBy(*keys, "id", "cluster").agg(
        F.max(F.when(own, F.try_divide("dsum", F.col("cnt") - 1))).alias("a"),
        F.max(F.when(own, F.col("cnt"))).alias("own"),
        F.min(F.when(~own, F.col("dsum") / F.col("cnt"))).alias("b"))
    sil = F.when(F.col("own") <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per.select(*keys, "id", "cluster", sil.alias("s"))


def silhouette_values(points: DataFrame, block_size: int | None = None) -> DataFrame:
    """Per-point silhouette (id, cluster, s); ``points``: (id, cluster >= 0, v)."""
    kmax = points.agg(F.max("cluster")).first()[0]
    if kmax is None:
        return points.select("id", "cluster", F.lit(None).cast("double").alias("s"))
    p = points.select("id", "v", F.array(F.col("cluster").cast("long")).alias("labs"))
    sums = block_pairs(p, block_size).groupBy("bi", "bj").applyInPandas(_many_fn(1, kmax + 1), PAIR_SUMS)
    return _mean_silhouettes(sums, [])


def silhouette(points: DataFrame, block_size: int | None = None, drop_noise: bool = True) -> DataFrame:
    """Q03: mean Euclidean silhouette; NULL when fewer than 2 clusters or any
    cluster has fewer than 2 points (noise removed first)."""
    p = points.where(F.col("cluster") != NOISE) if drop_noise else points
    sizes = p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    ok = sizes.agg((F.count(F.lit(1)) >= 2) & (F.min("n") >= 2)).first()[0]
    if not ok:
        return p.sparkSession.createDataFrame([(None,)], "silhouette double")
    return silhouette_values(p, block_size).agg(F.avg("s").alias("silhouette"))


def silhouette_sq_euclidean(points: DataFrame) -> DataFrame:
    """Silhouette on squared Euclidean distances over all points, O(n k):
    a point's mean squared distance to a cluster follows from the cluster's
    size, vector sum and sum of squared norms.  Another number than Q03, by
    choice of the caller.  NULL under Q03's rules."""
    p = points.where(F.col("cluster") != NOISE)
    norm = F.aggregate("v", F.lit(0.0), lambda acc, x: acc + x * x)
    per_dim = p.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("x").alias("s"))
    sums = per_dim.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "s"))).alias("a")).select("cluster", F.col("a.s").alias("s"))
    sizes = p.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(norm).alias("q"))
    stats = sums.join(sizes, "cluster").select(F.col("cluster").alias("other"), "s", "n", "q")
    ok = stats.agg((F.count(F.lit(1)) >= 2) & (F.min("n") >= 2)).first()[0]
    if not ok:
        return points.sparkSession.createDataFrame([(None,)], "silhouette_sq double")
    every = stats.agg(F.collect_list(F.struct("other", "s", "n", "q")).alias("cl"))   # k rows of d numbers, as one array
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, z: acc + z)
    rows = p.select("id", "cluster", "v", norm.alias("q0"), F.lit(1).alias("_k")).join(F.broadcast(every.withColumn("_k", F.lit(1))), "_k")
    rows = rows.select("id", "cluster", "v", "q0", F.explode("cl").alias("c"))
    total = F.col("c.n") * F.col("q0") + F.col("c.q") - 2.0 * dot(F.col("v"), F.col("c.s"))
    own = F.col("c.other") == F.col("cluster")
    per = rows.select("id", own.alias("own"), F.greatest(F.lit(0.0), total).alias("t"), F.col("c.n").alias("n")).groupBy("id").agg(
        F.max(F.when(F.col("own"), F.col("t") / (F.col("n") - 1))).alias("a"), F.min(F.when(~F.col("own"), F.col("t") / F.col("n"))).alias("b"))
    return per.agg(F.avg(F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))).alias("silhouette_sq"))


# --- centroid-based indices -------------------------------------------------------

def _centroid_table(points: DataFrame):
    rows = centroids(points).collect()  # k rows of d numbers (bounded by the model, not the data)
    ids = [r["cluster"] for r in rows]
    C = np.array([r["c"] for r in rows], dtype=float)
    sizes = np.array([r["size"] for r in rows], dtype=float)
    return ids, C, sizes


def _with_centroid(points: DataFrame, ids, C) -> DataFrame:
    spark = points.sparkSession
    cen = spark.createDataFrame([(int(i), [float(x) for x in c]) for i, c in zip(ids, C)], "cluster int, c array<double>")
    return points.join(F.broadcast(cen), "cluster")   # k rows: bounded by the number of clusters


def davies_bouldin(points: DataFrame) -> DataFrame:
    """Q04: mean over clusters of max_j (s_i + s_j) / ||c_i - c_j||."""
    p = points.where(F.col("cluster") != NOISE)
    ids, C, _ = _centroid_table(p)
    disp = dict(_with_centroid(p, ids, C).groupBy("cluster").agg(F.avg(F.sqrt(sq_dist(F.col("v"), F.col("c"))))).collect())
    s = np.array([disp[i] for i in ids])
    k = len(ids)
    if k < 2:
        val = None
    else:
        D = np.sqrt(((C[:, None, :] - C[None, :, :]) ** 2).sum(-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            R = (s[:, None] + s[None, :]) / D
        np.fill_diagonal(R, -np.inf)
        val = float(np.mean(R.max(axis=1)))
    return points.sparkSession.createDataFrame([(val,)], "davies_bouldin double")


def calinski_harabasz(points: DataFrame) -> DataFrame:
    """Q05: (B / (k - 1)) / (W / (n - k)), B between- and W within-cluster
    sums of squares."""
    p = points.where(F.col("cluster") != NOISE)
    ids, C, sizes = _centroid_table(p)
    w = _with_centroid(p, ids, C).agg(F.sum(sq_dist(F.col("v"), F.col("c")))).first()[0] or 0.0
    n, k = sizes.sum(), len(ids)
    if k < 2:
        val = None
    else:
        mean = (C * sizes[:, None]).sum(0) / n
        b = float((sizes * ((C - mean) ** 2).sum(1)).sum())
        val = float("nan") if w == 0 else float((b / (k - 1)) / (w / (n - k)))
    return points.sparkSession.createDataFrame([(val,)], "calinski_harabasz double")


def quality_report(points: DataFrame, algorithm: str = "", block_size: int | None = None) -> DataFrame:
    """Q07: the full metric row; index metrics NULL when <= 1 cluster."""
    spark: SparkSession = points.sparkSession
    counts = points.agg(F.count(F.lit(1)).alias("total"),
                        F.count_if(F.col("cluster") == NOISE).alias("noise"),
                        F.count_distinct(F.when(F.col("cluster") != NOISE, F.col("cluster"))).alias("k")).first()
    total, noise, k = counts["total"], counts["noise"], counts["k"]
    sil = db = ch = None
    if total - noise > 1 and k > 1:
        sil = silhouette_values(points.where(F.col("cluster") != NOISE), block_size).agg(F.avg("s")).first()[0]
        db = davies_bouldin(points).first()[0]
        ch = calinski_harabasz(points).first()[0]
    ss = size_stats(points).first()
    f = lambda v: None if v is None else float(v)
    row = (algorithm, int(k), noise / total if total else None, int(total), int(total - noise), f(sil), f(db), f(ch),
           ss["min_cluster_size"], ss["max_cluster_size"], ss["avg_cluster_size"], ss["cluster_balance"])
    return spark.createDataFrame([row], "algorithm string, n_clusters long, noise_ratio double, total_points long, "
                                 "non_noise_points long, silhouette_score double, davies_bouldin double, "
                                 "calinski_harabasz double, min_cluster_size long, max_cluster_size long, "
                                 "avg_cluster_size double, cluster_balance double")


# --- many labelings at once (model selection) ---------------------------------------

def silhouette_many(points: DataFrame, labels: DataFrame, block_size: int | None = None) -> DataFrame:
    """Euclidean silhouette of many labelings in ONE blocked pass: the
    distances are shared, each labeling only changes the per-cluster
    reduction.  ``labels``: (id, cand, cluster) with cand = 0..m-1 and
    cluster >= 0; noise points are simply absent from their labelling (a
    point may be labelled by some candidates only).  Returns (cand,
    silhouette) with NULL where a labeling has < 2 clusters or a cluster
    with < 2 points."""
    top = labels.agg(F.max("cand").alias("m"), F.max("cluster").alias("k")).first()
    if top["m"] is None:
        return points.sparkSession.createDataFrame([], "cand int, silhouette double")
    n_cands = top["m"] + 1
    # dense per-point label vector (bounded by the number of candidates), -1 = absent
    m = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cand", "cluster"))).alias("_m"))
    labs = m.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_cands - 1)),
                                      lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(-1)).cast("long")).alias("labs"))
    p = cut_lineage(points.select("id", "v").join(labs, "id"))
    sizes = labels.groupBy("cand", "cluster").agg(F.count(F.lit(1)).alias("n"))
    found = [np.zeros(0, np.int64) for _ in range(n_cands)]   # a row per candidate and cluster, of the labelled points that take part
    count = [np.zeros(0) for _ in range(n_cands)]
    here = p.select(F.posexplode("labs").alias("cand", "cluster")).where("cluster >= 0").groupBy("cand", "cluster").agg(F.count(F.lit(1)).alias("n"))
    for cand, rows in here.toPandas().sort_values(["cand", "cluster"]).groupby("cand"):
        found[cand], count[cand] = rows["cluster"].to_numpy(), rows["n"].to_numpy(float)
    few = np.flatnonzero(_by_product(found))
    if len(few):   # points with the same labels lie together
        p = p.withColumn("_same", F.array(*[F.get("labs", F.lit(int(m))) for m in few]))
    pairs = own_tasks(block_pairs(p, block_size, ["_same", "id"] if len(few) else None).drop("_same"))
    sums = pairs.groupBy("bi", "bj").applyInPandas(_sums_fn(found), "id long, s array<double>")
    sums = sums.groupBy("id").agg(vector_to_array(Summarizer.sum(array_to_vector("s"))).alias("s"))
    per = p.select("id", "labs").join(sums, "id").select("labs", "s").mapInPandas(_silhouettes_fn(found, count), "cand int, s double")
    val = per.groupBy("cand").agg(F.avg("s").alias("silhouette"))
    sizes = sizes.groupBy("cand").agg(((F.count(F.lit(1)) >= 2) & (F.min("n") >= 2)).alias("ok"))
    return sizes.join(val, "cand", "left").select("cand", F.when(F.col("ok"), F.col("silhouette")).alias("silhouette"))


def _columns(labs: np.ndarray, found: list) -> np.ndarray:
    """Which clusters a point is in: a 0/1 column for each of each labelling."""
    onehot, at = np.zeros((len(labs), sum(map(len, found)))), 0
    for m, ids in enumerate(found):
        rows = np.flatnonzero(labs[:, m] >= 0)
        onehot[rows, at + np.searchsorted(ids, labs[rows, m])] = 1.0
        at += len(ids)
    return onehot


def _cluster_sums(D: np.ndarray, labs: np.ndarray, found: list) -> np.ndarray:
    """Sums of D's columns over each cluster of each labelling, side by side:
    columns in the order of their labels, added up."""
    out, at = np.zeros((len(D), sum(map(len, found)))), 0
    for m, ids in enumerate(found):
        rows = np.flatnonzero(labs[:, m] >= 0)
        rows = rows[np.argsort(labs[rows, m], kind="stable")]
        if len(rows):
            here, first = np.unique(labs[rows, m], return_index=True)
            out[:, at + np.searchsorted(ids, here)] = np.add.reduceat(D[:, rows], first, axis=1)
        at += len(ids)
    return out


def _by_product(found: list) -> np.ndarray:
    """The labellings whose sums come from one matrix product: those with the
    fewest clusters, ``PRODUCT_WIDTH`` clusters in all; the others' are added up."""
    size = np.array([len(ids) for ids in found], np.int64)
    order = np.argsort(size, kind="stable")
    chosen = np.zeros(len(found), bool)
    chosen[order[np.cumsum(size[order]) <= PRODUCT_WIDTH]] = True
    return chosen


def _runs(labs: np.ndarray, found: list, step: int) -> dict:
    """Runs of points with the same labels, for each tile of ``step`` points:
    where they begin in it, and the 0/1 columns of their clusters.  No runs
    (None) where most are single points: the columns of all points then."""
    first = np.ones(len(labs), bool)
    first[1:] = (labs[1:] != labs[:-1]).any(axis=1)
    first[::step] = True
    out = {}
    for s in range(0, len(labs), step):
        tile = labs[s:s + step]
        begin = np.flatnonzero(first[s:s + step])
        out[s] = (begin, _columns(tile[begin], found)) if 2 * len(begin) <= len(tile) else (None, _columns(tile, found))
    return out


def _run_totals(D: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Sums of D's rows over runs of rows."""
    if len(begin) > 16:
        return np.add.reduceat(D, begin, axis=0)
    member = np.zeros((len(begin), len(D)))
    member[np.repeat(np.arange(len(begin)), np.diff(begin, append=len(D))), np.arange(len(D))] = 1.0
    return member @ D


def _sums_fn(found: list):
    """Per point of a pair of blocks: the sums of its distances to the other
    block's clusters, all labellings in one array.  Labellings of few clusters
    share the distances, which serve both their ends while they are in the
    processor's cache: points with the same labels lie side by side, so their
    distances are added up first, once for all labellings."""
    few = _by_product(found)
    column = np.repeat(few, [len(ids) for ids in found])   # of the arrays: from a product or not
    small, large = [ids for ids, f in zip(found, few) if f], [ids for ids, f in zip(found, few) if not f]

    def ordered(side: pd.DataFrame):
        labs = np.stack(side["labs"].to_numpy())
        order = np.lexsort(labs[:, few].T) if few.any() else np.arange(len(labs))
        return side["id"].to_numpy()[order], vectors(side)[order], labs[order]

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        both = sides(pdf)
        if not both:
            return pd.DataFrame({"id": np.zeros(0, np.int64), "s": []})
        lid, L, LL = ordered(both[0][0])
        rid, R, RL = ordered(both[0][1])
        width = sum(map(len, small))
        forth, back = np.zeros((len(L), width)), np.zeros((len(R), width))
        if small:
            of_left, of_right = _runs(LL[:, few], small, CACHED[0]), _runs(RL[:, few], small, CACHED[1])
            for rows, cols, D in cached_tiles(L, R):
                begin, columns = of_right[cols.start]
                forth[rows] += (D if begin is None else np.add.reduceat(D, begin, axis=1)) @ columns
                if len(both) == 2:
                    begin, columns = of_left[rows.start]
                    back[cols] += (D if begin is None else _run_totals(D, begin)).T @ columns
        if large:
            there, here = forth, back
            forth, back = np.zeros((len(L), len(column))), np.zeros((len(R), len(column)))
            forth[:, column], back[:, column] = there, here
            for rows, D in tiles(L, R):
                forth[rows, ~column] = _cluster_sums(D, RL[:, ~few], large)
                if len(both) == 2:
                    back[:, ~column] += _cluster_sums(D.T, LL[rows][:, ~few], large)
        out = [pd.DataFrame({"id": lid, "s": list(forth)})]
        if len(both) == 2:
            out.append(pd.DataFrame({"id": rid, "s": list(back)}))
        return pd.concat(out, ignore_index=True)
    return fn


def _silhouettes_fn(found: list, count: list):
    """(cand, s) of points from all their sums: (b - a) / max(a, b), 0 for a
    singleton cluster, and where there is no other cluster or both are 0."""
    def fn(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            S, labs, at = np.stack(pdf["s"].to_numpy()), np.stack(pdf["labs"].to_numpy()), 0
            for m, ids in enumerate(found):
                rows = np.flatnonzero(labs[:, m] >= 0)
                own = np.searchsorted(ids, labs[rows, m])
                part, n = S[rows, at:at + len(ids)], count[m]
                at += len(ids)
                if not len(rows):
                    continue
                with np.errstate(divide="ignore", invalid="ignore"):
                    a = part[np.arange(len(rows)), own] / (n[own] - 1)
                    mean = part / n
                    mean[np.arange(len(rows)), own] = np.inf
                    b = mean.min(1)
                    s = (b - a) / np.maximum(a, b)
                s[(n[own] <= 1) | (len(ids) < 2) | (np.maximum(a, b) == 0)] = 0.0
                yield pd.DataFrame({"cand": np.int32(m), "s": s})
    return fn


def silhouette_sampled_many(points: DataFrame, labels: DataFrame, per_cluster: int, seed: int = 42) -> DataFrame:
    """An estimate of every labelling's silhouette and its standard
    error: (cand, silhouette, error), NULL under the rules of Q03.

    A stratified sample: of each cluster the ``per_cluster`` points whose hash
    of seed and id is smallest (small clusters whole), each compared with ALL
    points of its labelling, so every sampled silhouette is exact.  Strata are
    weighted by their sizes; the error has the finite-population correction and
    is 0 when all clusters are whole.  The sample (candidates x clusters x
    ``per_cluster`` vectors, whatever the input) goes with the tasks; the work
    is O(sample x n), and a task returns one row per sampled point and cluster."""
    if per_cluster < 2:
        raise ValueError("a stratum needs two points for an error")
    spark = points.sparkSession
    top = labels.agg(F.max("cand").alias("m"), F.max("cluster").alias("k")).first()
    if top["m"] is None:
        return spark.createDataFrame([], "cand int, silhouette double, error double")
    n_cands, kmax = top["m"] + 1, top["k"] + 1
    draw = Window.partitionBy("cand", "cluster").orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256), "id")
    drawn = labels.withColumn("nr", F.row_number().over(draw)).where(F.col("nr") <= per_cluster).select("id", "cand", "cluster")
    drawn = drawn.groupBy("id").agg(F.collect_list(F.struct("cand", "cluster")).alias("of"))
    sample = points.select("id", "v").join(F.broadcast(drawn), "id").toPandas()   # bounded by the sample's size
    S = vectors(sample)
    members = {}
    for at, of in enumerate(sample["of"]):
        for x in of:
            members.setdefault(x["cand"], []).append((at, x["cluster"]))
    place = {c: np.array([a for a, _ in rows]) for c, rows in members.items()}
    ids = sample["id"].to_numpy()
    labs = labels.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("cand", "cluster"))).alias("_m"))   # a row per candidate
    labs = labs.select("id", F.transform(F.sequence(F.lit(0), F.lit(n_cands - 1)),
                                         lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(-1)).cast("long")).alias("labs"))

    def run(batches):
        sums = {c: np.zeros((len(rows), kmax)) for c, rows in place.items()}
        counts = {c: np.zeros(kmax, np.int64) for c in place}
        for pdf in batches:
            L = np.stack(pdf["labs"].to_numpy())
            onehots = {c: (L[:, c][:, None] == np.arange(kmax)[None, :]).astype(np.float64) for c in place}
            for c in place:
                counts[c] += onehots[c].sum(0).astype(np.int64)
            R = vectors(pdf)
            for rows, D in tiles(S, R):
                for c, at in place.items():
                    here = np.flatnonzero((at >= rows.start) & (at < rows.stop))
                    sums[c][here] += D[at[here] - rows.start] @ onehots[c]
        for c, at in place.items():
            here = np.flatnonzero(counts[c])
            if len(here):
                yield pd.DataFrame({"id": np.repeat(ids[at], len(here)), "cand": c, "cluster": np.repeat([k for _, k in members[c]], len(here)),
                                    "other": np.tile(here, len(at)), "dsum": sums[c][:, here].reshape(-1), "cnt": np.tile(counts[c][here], len(at))})

    near = points.select("id", "v").join(labs, "id").select("v", "labs").mapInPandas(run, PAIR_SUMS)
    per = _mean_silhouettes(near, ["cand"]).groupBy("cand", "cluster").agg(
        F.avg("s").alias("mean"), F.coalesce(F.var_samp("s"), F.lit(0.0)).alias("var"), F.count(F.lit(1)).alias("drawn"))
    sizes = labels.groupBy("cand", "cluster").agg(F.count(F.lit(1)).alias("size"))
    per = per.join(sizes, ["cand", "cluster"]).withColumn("w", F.col("size") / F.sum("size").over(Window.partitionBy("cand")))   # a row per cluster
    spread = F.col("w") * F.col("w") * (1 - F.col("drawn") / F.col("size")) * F.col("var") / F.col("drawn")
    ok = (F.count(F.lit(1)) >= 2) & (F.min("size") >= 2)
    return per.groupBy("cand").agg(F.when(ok, F.sum(F.col("w") * F.col("mean"))).alias("silhouette"), F.when(ok, F.sqrt(F.sum(spread))).alias("error"))


def silhouette_sampled(points: DataFrame, per_cluster: int, seed: int = 42) -> DataFrame:
    """Q03b for one labelling (noise removed first): (silhouette, error)."""
    p = points.where(F.col("cluster") != NOISE)
    out = silhouette_sampled_many(p, p.select("id", F.lit(0).alias("cand"), "cluster"), per_cluster, seed)
    return out.agg(F.max("silhouette").alias("silhouette"), F.max("error").alias("error"))


def balance_many(labels: DataFrame) -> DataFrame:
    """Q02 for many labelings at once: (cand, n_clusters, balance_ratio,
    largest_cluster_pct, noise_ratio)."""
    sizes = labels.groupBy("cand", "cluster").agg(F.count(F.lit(1)).alias("size"))
    is_noise = F.col("cluster") == NOISE
    w = Window.partitionBy("cand").orderBy(is_noise.cast("int"), "size", "cluster")
    r = sizes.withColumn("r", F.row_number().over(w))
    valid = ~is_noise
    g = r.groupBy("cand").agg(
        F.count_if(valid).alias("n"), F.sum(F.when(valid, F.col("size"))).alias("s"),
        F.sum(F.when(valid, F.col("r") * F.col("size"))).alias("rs"), F.max(F.when(valid, F.col("size"))).alias("mx"),
        F.sum("size").alias("total"), F.coalesce(F.sum(F.when(is_noise, F.col("size"))), F.lit(0)).alias("noise"))
    gini = 2.0 * F.col("rs") / (F.col("n") * F.col("s")) - (F.col("n") + 1.0) / F.col("n")
    return g.select("cand", F.col("n").cast("long").alias("n_clusters"),
                    F.when(F.col("n") > 0, 1.0 - gini).otherwise(F.lit(0.0)).alias("balance_ratio"),
                    F.when(F.col("n") > 0, F.col("mx") * 100.0 / F.col("s")).otherwise(F.lit(100.0)).alias("largest_cluster_pct"),
                    (F.col("noise") / F.col("total")).alias("noise_ratio"))
