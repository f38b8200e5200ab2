"""Registered queries: preprocessing (M) on the orders-derived card features."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.operators import preprocess as PP
from cardprism.plans.q_features import features_of
from cardprism.plans.registry import register, round_doubles
from cardprism.plans.sqlgen import features_ctes, rnd
from cardprism.schema import FEATURE_COLUMNS
from cardprism.session import cut_lineage

COLS = list(FEATURE_COLUMNS)


def features_table(spark, sf, adapter="orders"):
    """Card features (a checkpointed table: every preprocessing fit makes
    several small passes over it)."""
    return cut_lineage(features_of(spark, sf, adapter))


FEAT = f"with {features_ctes('orders')}"
_Q = ",\n  ".join(f"quantile_cont({c}::double, 0.25) as q1_{c}, quantile_cont({c}::double, 0.5) as md_{c}, "
                  f"quantile_cont({c}::double, 0.75) as q3_{c}" for c in COLS)
ROBUST = f"""{FEAT}, rp as (select {_Q} from features),
rs as (select card_id, {", ".join(f"({c}::double - md_{c}) / (case when q3_{c} - q1_{c} = 0 then 1.0::double else q3_{c} - q1_{c} end) as {c}" for c in COLS)}
  from features, rp)"""
register("robust_scale", f"{ROBUST} select card_id, {', '.join(f'{rnd(c)} as {c}' for c in COLS)} from rs")(
    lambda spark, sf: round_doubles(PP.robust_scale(features_table(spark, sf)), money=False))

_S = ", ".join(f"avg({c}::double) as m_{c}, stddev_pop({c}::double) as s_{c}" for c in COLS)
register("standard_scale", f"""{FEAT}, sp as (select {_S} from features)
select card_id, {", ".join(rnd(f"({c}::double - m_{c}) / (case when s_{c} = 0 then 1.0::double else s_{c} end)") + f" as {c}" for c in COLS)}
from features, sp""")(lambda spark, sf: round_doubles(PP.standard_scale(features_table(spark, sf)), money=False))

_UNPIV = " union all ".join(f"select card_id, {i} as i, {c}::double as x from features" for i, c in enumerate(COLS))
_NAMES = ", ".join(f"({i}, '{c}')" for i, c in enumerate(COLS))
PAIRS = f"""{FEAT}, lf as ({_UNPIV}), nm as (select * from (values {_NAMES}) t(i, feature)),
pr as (select a.i, b.i as j, case when var_samp(a.x) = 0 or var_samp(b.x) = 0 then null else corr(a.x, b.x) end as corr
       from lf a join lf b on a.card_id = b.card_id and a.i < b.i group by a.i, b.i)"""
register("feature_corr", f"""{PAIRS} select pr.i::int as i, pr.j::int as j, na.feature as feature_i, nb.feature as feature_j,
  {rnd('corr')} as corr from pr join nm na on na.i = pr.i join nm nb on nb.i = pr.j""")(
    lambda spark, sf: round_doubles(PP.correlation_pairs(features_table(spark, sf), COLS)))

register("feature_decorr", f"""{PAIRS} select nm.i::int as j, nm.feature,
  coalesce(nm.i in (select j from pr where abs(corr) > 0.8), false) as removed from nm""")(
    lambda spark, sf: PP.correlated_drop(PP.correlation_pairs(features_table(spark, sf), COLS), COLS, 0.8))


def _kept(spark, sf):
    f = features_table(spark, sf)
    scaled = cut_lineage(PP.robust_scale(f))
    drop = PP.correlated_drop(PP.correlation_pairs(scaled, COLS), COLS, 0.8).collect()
    kept = [r["feature"] for r in sorted(drop, key=lambda r: r["j"]) if not r["removed"]]
    return scaled, kept


def _pca_trace(spark, sf):
    scaled, kept = _kept(spark, sf)
    fit = PP.pca_fit(scaled, kept, None)
    return spark.createDataFrame([(float(fit["all_variance"].sum()), len(kept))], "trace double, n_kept int")


_RS_UNPIV = " union all ".join(f"select card_id, {i} as i, {c} as x from rs" for i, c in enumerate(COLS))
register("pca_trace", f"""{ROBUST}, lf as ({_RS_UNPIV}),
pr as (select a.i, b.i as j, case when var_samp(a.x) = 0 or var_samp(b.x) = 0 then null else corr(a.x, b.x) end as corr
       from lf a join lf b on a.card_id = b.card_id and a.i < b.i group by a.i, b.i),
kept as (select distinct i from lf where i not in (select j from pr where abs(corr) > 0.8))
select {rnd('sum(v)')} as trace, count(*)::int as n_kept from (select i, var_samp(x) as v from lf where i in (select i from kept) group by i)""")(
    lambda spark, sf: round_doubles(_pca_trace(spark, sf)))


def _pca_variance(spark, sf):
    scaled, kept = _kept(spark, sf)
    fit = PP.pca_fit(scaled, kept, None)
    cum = 0.0
    rows = []
    for k, (v, r) in enumerate(zip(fit["all_variance"], fit["all_ratio"])):
        cum += r
        rows.append((k, float(v), float(r), float(cum)))
    return spark.createDataFrame(rows, "component int, variance double, ratio double, cumulative double")


register("pca_variance")(lambda spark, sf: round_doubles(_pca_variance(spark, sf)))


def _pca_scores(spark, sf):
    scaled, kept = _kept(spark, sf)
    fit = PP.pca_fit(scaled, kept, 0.95)
    return PP.pca_project(scaled, kept, fit)


register("pca_scores")(lambda spark, sf: round_doubles(_pca_scores(spark, sf)))

GRID = PP.lambda_grid(-2.0, 2.0, 41)
_RS_LONG = " union all ".join(f"select card_id, '{c}' as feature, {c} as x from rs" for c in COLS)
def psi_sql(x: str, lam: str) -> str:
    return (f"case when {x} >= 0 then (case when abs({lam}) < 1e-12 then ln(1 + {x}) else (pow({x} + 1.0, {lam}) - 1.0) / {lam} end) "
            f"else (case when abs({lam} - 2.0) < 1e-12 then -ln(1 - {x}) else -(pow(1.0 - {x}, 2.0 - {lam}) - 1.0) / (2.0 - {lam}) end) end")


_PSI = psi_sql("x", "lam")
YJ = f"""{ROBUST}, lf as ({_RS_LONG}), g as (select unnest([{", ".join(repr(x) for x in GRID)}]::double[]) as lam),
e as (select feature, lam, x, {_PSI} as psi from lf, g),
ll as (select feature, lam, case when var_pop(psi) > 0 then -count(*) / 2.0 * ln(var_pop(psi))
       + (lam - 1.0) * sum(sign(x) * ln(1 + abs(x))) end as ll from e group by feature, lam),
best as (select feature, arg_max(lam, (ll, -lam)) as lam, max(ll) as ll from ll where ll is not null group by feature)"""
register("yeojohnson_lambda", f"select feature, lam, {rnd('ll')} as ll from ({YJ} select * from best)")(
    lambda spark, sf: round_doubles(_yj_lambda(spark, sf)))


def _yj_grid_best(scaled):
    ll = PP.yj_loglik_grid(scaled, COLS, {c: GRID for c in COLS}).where(F.col("ll").isNotNull())
    return ll.groupBy("feature").agg(F.max_by("lam", F.struct("ll", -F.col("lam"))).alias("lam"), F.max("ll").alias("ll"))


def _yj_lambda(spark, sf):
    return _yj_grid_best(cut_lineage(PP.robust_scale(features_table(spark, sf))))


def _yj_apply(spark, sf):
    scaled = cut_lineage(PP.robust_scale(features_table(spark, sf)))
    lam = {r["feature"]: r["lam"] for r in _yj_grid_best(scaled).collect()}
    cols = [c for c in COLS if c in lam]
    return PP.yj_apply(scaled, cols, lam)


_YJW = ", ".join(f"max(case when feature = '{c}' then lam end) as l_{c}" for c in COLS)
_PSI_C = lambda c: psi_sql(c, f"l_{c}")
register("yeojohnson_apply", f"""{YJ}, lw as (select {_YJW} from best),
t as (select card_id, {", ".join(f"{_PSI_C(c)} as {c}" for c in COLS)} from rs, lw),
st as (select {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in COLS)} from t)
select card_id, {", ".join(rnd(f"({c} - m_{c}) / (case when s_{c} = 0 then 1.0::double else s_{c} end)") + f" as {c}" for c in COLS)}
from t, st""")(lambda spark, sf: round_doubles(_yj_apply(spark, sf), money=False))


def _info(spark, sf):
    model = PP.fit_preprocess(features_table(spark, sf), SegmentationConfig())
    return PP.preprocess_info(model, spark)


register("preprocess_info")(_info)
