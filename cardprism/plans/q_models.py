"""Registered queries: clustering models (C) and reproducibility (T).

SQL-checkable operators use parameters Spark derives from the data
(per-label centroids / variances of ``embeddings``); sweeps and the end-to-
end run use the orders-derived card matrix and are row-checked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.operators import gmm as G
from cardprism.operators import kmeans as KM
from cardprism.operators.batched import run_pass
from cardprism.operators.preprocess import fit_preprocess
from cardprism.operators.profiles import segment_bundle
from cardprism.operators.selection import best_model, choose_n_components, model_score
from cardprism.operators.vectors import as_points, centroids
from cardprism.plans.q_features import features_of
from cardprism.plans.registry import memo, register, round_doubles, table
from cardprism.plans.segmentation import canonical_labels, perform_clustering
from cardprism.plans.sqlgen import rnd
from cardprism.session import cut_lineage

CFG = SegmentationConfig()


def emb(spark, sf):
    return memo(spark, ("emb", sf), lambda: cut_lineage(as_points(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")))


def label_params(spark, sf, reg=1e-6):
    """Diagonal Gaussian per label (weights, means, variances + reg): k x d
    numbers from one aggregation."""
    p = emb(spark, sf)
    rows = sorted(centroids(p).collect(), key=lambda r: r["cluster"])
    n = sum(r["size"] for r in rows)
    ids = [r["cluster"] for r in rows]
    means = np.array([r["c"] for r in rows])
    e = p.select("cluster", F.posexplode("v").alias("i", "x")).groupBy("cluster", "i").agg(F.var_pop("x").alias("var"))
    var = np.zeros_like(means)
    pos = {c: j for j, c in enumerate(ids)}
    for r in e.collect():
        var[pos[r["cluster"]], r["i"]] = r["var"]
    w = np.array([r["size"] for r in rows]) / n
    return ids, w, means, var + reg, n


EMB = "with p as (select vec_id as id, label as cluster, embedding::double[] as v from embeddings)"
CEN = f"""{EMB},
e as (select id, cluster, unnest(v) as x, generate_subscripts(v, 1) - 1 as i from p),
cen as (select cluster, i, avg(x) as m, var_pop(x) + 1e-6 as var, count(*) as sz from e group by cluster, i),
cv as (select cluster, list(m order by i) as c from cen group by cluster)"""


def _assign(spark, sf):
    ids, _, means, _, _ = label_params(spark, sf)
    a = KM.assign_nearest(emb(spark, sf).select("id", "v"), means)
    m = spark.createDataFrame([(j, int(c)) for j, c in enumerate(ids)], "j int, label int")
    return a.join(F.broadcast(m), a.cluster == m.j).select(F.col("id").alias("vec_id"), F.col("label").alias("cluster"))


register("kmeans_assign", f"""{CEN}
select p.id as vec_id, arg_min(cv.cluster, (list_distance(p.v, cv.c), cv.cluster)) as cluster from p, cv group by p.id""")(_assign)


def _step(spark, sf):
    ids, _, means, _, _ = label_params(spark, sf)
    s = KM.lloyd_step(emb(spark, sf).select("id", "v"), means)
    m = spark.createDataFrame([(j, int(c)) for j, c in enumerate(ids)], "j int, label int")
    return round_doubles(s.join(F.broadcast(m), s.cluster == m.j).select(
        F.col("label").alias("cluster"), "i", "center", F.col("size").cast("long").alias("size")))


register("kmeans_step", f"""{CEN},
asg as (select p.id, arg_min(cv.cluster, (list_distance(p.v, cv.c), cv.cluster)) as cl from p, cv group by p.id),
ex as (select asg.cl as cluster, unnest(p.v) as x, generate_subscripts(p.v, 1) - 1 as i from p join asg using (id))
select cluster, i::int as i, {rnd('avg(x)')} as center, count(*)::bigint as size from ex group by cluster, i""")(_step)


def _gmm_from_labels(spark, sf, cov_type):
    ids, w, means, var, n = label_params(spark, sf)
    cov = var if cov_type == "diag" else var.mean(1)
    return ids, G.GMM(len(ids), cov_type, w, means, cov), n


def _estep(cov_type):
    def q(spark, sf):
        ids, g, _ = _gmm_from_labels(spark, sf, cov_type)
        e = G.estep_frame(emb(spark, sf), g)
        idx = F.array_position(e.resp, F.array_max(e.resp)) - 1
        m = spark.createDataFrame([(j, int(c)) for j, c in enumerate(ids)], "j int, label int")
        out = e.select(F.col("id").alias("vec_id"), "ll", idx.cast("int").alias("j"), F.array_max("resp").alias("max_resp"))
        return round_doubles(out.join(F.broadcast(m), "j").select("vec_id", "ll", F.col("label").alias("component"), "max_resp"))
    return q


def _estep_sql(cov_type):
    var = "var" if cov_type == "diag" else "avg(var) over (partition by cluster)"
    return f"""{CEN},
par as (select cluster, i, m, {var} as var from cen),
w as (select cluster, count(*)::double / (select count(*) from p) as w from p group by cluster),
lp as (select e.id, par.cluster as comp,
          -0.5 * sum(ln(2 * pi()) + ln(par.var) + (e.x - par.m) * (e.x - par.m) / par.var) + ln(any_value(w.w)) as lp
       from e join par on e.i = par.i join w on w.cluster = par.cluster group by e.id, par.cluster),
mx as (select id, max(lp) as m from lp group by id),
ls as (select lp.id, mx.m + ln(sum(exp(lp.lp - mx.m))) as ll from lp join mx using (id) group by lp.id, mx.m)
select lp.id as vec_id, {rnd('ls.ll')} as ll, arg_max(lp.comp, (lp.lp, -lp.comp)) as component, {rnd('max(exp(lp.lp - ls.ll))')} as max_resp
from lp join ls using (id) group by lp.id, ls.ll"""


register("gmm_estep", _estep_sql("diag"))(_estep("diag"))
register("gmm_estep_spherical", _estep_sql("spherical"))(_estep("spherical"))


def _bic(spark, sf):
    ids, g, n = _gmm_from_labels(spark, sf, "diag")
    ll = emb(spark, sf).transform(lambda p: G.estep_frame(p, g)).agg(F.sum("ll")).first()[0]
    g.lower_bound = ll / n
    return round_doubles(spark.createDataFrame([(float(ll), float(G.bic(g, n)), float(G.aic(g, n)), g.n_parameters())],
                                               "ll double, bic double, aic double, n_parameters int"))


_BIC_SQL = _estep_sql("diag").rsplit("select lp.id as vec_id", 1)[0] + f"""
, tot as (select sum(ll) as ll from ls), dims as (select count(distinct i) as d, count(distinct cluster) as k from cen)
select {rnd('ll')} as ll, {rnd('-2 * ll + (2 * k * d + k - 1) * ln((select count(*) from p))')} as bic,
  {rnd('-2 * ll + 2 * (2 * k * d + k - 1)')} as aic, (2 * k * d + k - 1)::int as n_parameters from tot, dims"""
register("gmm_bic", _BIC_SQL)(_bic)


def _stepped(spark, sf, cov_type):
    """One M-step of the given kind, from the diagonal model's responsibilities."""
    ids, g, n = _gmm_from_labels(spark, sf, "diag")

    def statistics(batches):
        acc = {}
        for X in batches:
            lp, lse = G.log_resp(X, g)
            G._add(acc, 0, X, np.exp(lp - lse[:, None]), cov_type, float(lse.sum()), g.means)
        return acc

    return ids, G.mstep(run_pass(emb(spark, sf), statistics), 0, g.k, cov_type, n, 1e-6, g.means)


def _mstep(spark, sf):
    ids, new = _stepped(spark, sf, "diag")
    rows = [(int(ids[j]), i, float(new.weights[j]), float(new.means[j, i]), float(new.cov[j, i]))
            for j in range(new.k) for i in range(new.means.shape[1])]
    return round_doubles(spark.createDataFrame(rows, "component int, i int, weight double, mean double, var double"))


_RESP = _estep_sql("diag").rsplit("select lp.id as vec_id", 1)[0] + f""",
r as (select lp.id, lp.comp, exp(lp.lp - ls.ll) as r from lp join ls using (id)),
nk as (select comp, sum(r) + {float(10 * np.finfo(float).eps)!r} as nk from r group by comp),
s as (select r.comp, e.i, sum(r.r * e.x) / any_value(nk.nk) as m from r join e on e.id = r.id join nk on nk.comp = r.comp group by r.comp, e.i),
z as (select r.comp, r.id, r.r, e.i, e.x - s.m as z from r join e on e.id = r.id join s on s.comp = r.comp and s.i = e.i)"""
register("gmm_mstep", f"""{_RESP},
v as (select comp, i, sum(r * z * z) as s2 from z group by comp, i)
select s.comp as component, s.i::int as i, {rnd('nk.nk / (select count(*) from p)')} as weight, {rnd('s.m')} as mean,
  {rnd('v.s2 / nk.nk + 1e-6')} as var from s join nk using (comp) join v using (comp, i)""")(_mstep)


def _mstep_full(spark, sf):
    ids, new = _stepped(spark, sf, "full")
    rows = [(int(ids[c]), i, j, float(new.cov[c, i, j])) for c in range(new.k) for i in range(new.cov.shape[1]) for j in range(new.cov.shape[1])]
    return round_doubles(spark.createDataFrame(rows, "component int, i int, j int, cov double"))


def _mstep_tied(spark, sf):
    _, new = _stepped(spark, sf, "tied")
    rows = [(i, j, float(new.cov[i, j])) for i in range(len(new.cov)) for j in range(len(new.cov))]
    return round_doubles(spark.createDataFrame(rows, "i int, j int, cov double"))


def _mstep_spherical(spark, sf):
    ids, new = _stepped(spark, sf, "spherical")
    return round_doubles(spark.createDataFrame([(int(ids[c]), float(new.cov[c])) for c in range(new.k)], "component int, var double"))


_CROSS = f"""{_RESP},
zz as (select a.comp, a.i, b.i as j, sum(a.r * a.z * b.z) as s2 from z a join z b on a.comp = b.comp and a.id = b.id group by a.comp, a.i, b.i)"""
register("gmm_mstep_full", f"""{_CROSS}
select zz.comp as component, zz.i::int as i, zz.j::int as j, {rnd('zz.s2 / nk.nk + case when zz.i = zz.j then 1e-6 else 0 end')} as cov
from zz join nk using (comp)""")(_mstep_full)
register("gmm_mstep_tied", f"""{_CROSS}, t as (select i, j, sum(s2) as s2 from zz group by i, j)
select i::int as i, j::int as j, {rnd('s2 / (select sum(nk) from nk) + case when i = j then 1e-6 else 0 end')} as cov from t""")(_mstep_tied)
register("gmm_mstep_spherical", f"""{_RESP},
v as (select comp, i, sum(r * z * z) as s2 from z group by comp, i)
select comp as component, {rnd('avg(v.s2 / nk.nk + 1e-6)')} as var from v join nk using (comp) group by comp""")(_mstep_spherical)


# --- sweeps on the card matrix (row-checked) ---------------------------------------

def card_matrix(spark, sf):
    def build():
        f = cut_lineage(features_of(spark, sf, "orders"))
        model = fit_preprocess(f, CFG)
        return f, cut_lineage(model.transform(f).select(F.col("card_id").alias("id"), "v"))
    return memo(spark, ("matrix", sf), build)


def _runs(alg):
    def build(spark, sf):
        return memo(spark, ("runs", alg, sf), lambda: perform_clustering(card_matrix(spark, sf)[1],
                                                                           SegmentationConfig(algorithm=alg)))
    return build


def _runs_df(alg):
    return lambda spark, sf: _runs(alg)(spark, sf)[0].orderBy("seq")


register("kmeans_sweep")(_runs_df("kmeans"))
register("gmm_sweep")(_runs_df("gmm"))
register("gmm_auto")(_runs_df("gmm_auto"))
register("hdbscan_sweep")(_runs_df("hdbscan"))      # C06: the whole density grid
register("all_models")(_runs_df("all"))             # C07: every family, best by score

# --- selection rules on a runs table that the data makes up -----------------------
# Sales stand in for criteria: 28 supplier classes as the auto-search grid (every
# fifth without a silhouette, as for labellings that have none), 12 more as
# K-Means, mixture and density candidates.

def sales_runs(spark, sf):
    li = table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 40).cast("int").alias("cand")).agg(
        F.avg("l_extendedprice").alias("bic"), F.avg(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("aic"),
        (F.avg("l_discount") * 10).alias("balance_ratio"), (F.avg("l_tax") * 10 - 0.3).alias("sil"))
    c, auto = F.col("cand"), F.col("cand") < 28
    algorithm = F.when(auto, "gmm_auto_search").otherwise(F.element_at(F.array(*map(F.lit, ("gmm_auto", "gmm", "kmeans", "hdbscan"))), (c % 4 + 1).cast("int")))
    return li.select("cand", algorithm.alias("algorithm"), F.when(auto, F.floor(c / 4) + 2).otherwise(c % 5 + 3).cast("int").alias("k"),
                     F.lit(None).cast("string").alias("cov_type"), "bic", "aic", "balance_ratio",
                     F.when(c % 5 != 0, F.col("sil")).alias("silhouette"), c.alias("seq"), F.lit(None).cast("string").alias("error"))


RUNS = """with runs as (
  select (l_suppkey % 40)::int as cand,
    case when l_suppkey % 40 < 28 then 'gmm_auto_search' when l_suppkey % 4 = 0 then 'gmm_auto' when l_suppkey % 4 = 1 then 'gmm'
         when l_suppkey % 4 = 2 then 'kmeans' else 'hdbscan' end as algorithm,
    case when l_suppkey % 40 < 28 then (l_suppkey % 40) // 4 + 2 else (l_suppkey % 40) % 5 + 3 end::int as k,
    avg(l_extendedprice) as bic, avg(l_extendedprice * (1 - l_discount)) as aic, avg(l_discount) * 10 as balance,
    case when any_value(l_suppkey % 40) % 5 <> 0 then avg(l_tax) * 10 - 0.3 end as sil
  from lineitem group by l_suppkey % 40, algorithm, k),
scored as (select *, case when algorithm = 'hdbscan' then 0.7 * coalesce(sil, 0) + 0.3 * balance
                          else 0.6 * balance + 0.4 * coalesce(sil, 0) end as score from runs)"""


def _choices(spark, sf):
    runs, out = sales_runs(spark, sf), None
    for criterion in ("bic", "aic", "combined"):
        one = choose_n_components(runs, criterion).select(F.lit(criterion).alias("criterion"), F.col("n_components").cast("int").alias("n_components"))
        out = one if out is None else out.unionByName(one)
    return out


register("gmm_choose_n", f"""{RUNS}, a as (select * from runs where algorithm = 'gmm_auto_search')
select 'bic' as criterion, arg_min(k, (bic, cand))::int as n_components from a
union all select 'aic', arg_min(k, (aic, cand))::int from a
union all select 'combined', arg_max(k, (0.5 / (1 + bic / 1000) + 0.3 * balance + 0.2 * coalesce(sil, 0), -cand))::int from a""")(_choices)
register("model_score", f"{RUNS} select cand, algorithm, k, {rnd('score')} as combined_score from scored")(
    lambda spark, sf: round_doubles(model_score(sales_runs(spark, sf)).select("cand", "algorithm", "k", "combined_score")))
register("best_model", f"""{RUNS},
w as (select *, row_number() over (partition by algorithm order by score desc, cand) as r from scored where algorithm <> 'gmm_auto_search' and score > -1),
b as (select *, row_number() over (order by score desc, case algorithm when 'gmm_auto' then 0 when 'gmm' then 1 when 'kmeans' then 2 else 3 end) as o from w where r = 1)
select algorithm, cand, k, {rnd('score')} as combined_score, o = 1 as is_best from b""")(
    lambda spark, sf: round_doubles(best_model(sales_runs(spark, sf)).select("algorithm", "cand", "k", "combined_score", "is_best")))


def _segmentation(spark, sf):
    f, m = card_matrix(spark, sf)
    runs, lab, best, _ = _runs("gmm_auto")(spark, sf)
    chosen = lab.where(F.col("cand") == best).select(F.col("id").alias("card_id"), "cluster")
    labels = canonical_labels(chosen, f)
    return round_doubles(segment_bundle(f.join(labels, "card_id")))


register("segmentation_run")(_segmentation)
