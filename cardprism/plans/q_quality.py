"""Registered queries: clustering quality (Q) with labels fixed by the data:
``embeddings.label`` for geometry, and the planted card archetype
(``card_id % 4``, with ``card_id % 29 = 0`` as noise) for size statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardprism.operators.quality import (
    calinski_harabasz, cluster_balance, cluster_sizes, davies_bouldin, quality_report, silhouette,
    silhouette_sampled, silhouette_sq_euclidean, size_stats,
)
from cardprism.operators.vectors import as_points
from cardprism.plans.q_features import features_of
from cardprism.plans.registry import register, round_doubles, table
from cardprism.plans.sqlgen import features_ctes, rnd


def archetype(card_id="card_id"):
    return F.when(F.col(card_id) % 29 == 0, F.lit(-1)).otherwise(F.col(card_id) % 4).cast("int")


ARCHETYPE_SQL = "cast(case when card_id % 29 = 0 then -1 else card_id % 4 end as int)"


def card_labels(spark, sf):
    return features_of(spark, sf, "orders").select("card_id", archetype().alias("cluster"))


def emb_points(spark, sf):
    return as_points(table(spark, sf, "embeddings"), "vec_id", "label", "embedding")


LABELS_SQL = f"with {features_ctes('orders')}, lab as (select card_id, {ARCHETYPE_SQL} as cluster from features)"

register("cluster_sizes", f"""{LABELS_SQL}, s as (select cluster, count(*) as size from lab group by cluster)
select cluster, size, {rnd("case when cluster <> -1 then size * 100.0::double / (select sum(size) from s where cluster <> -1) end")} as pct_of_valid from s""")(
    lambda spark, sf: round_doubles(cluster_sizes(card_labels(spark, sf))))

register("cluster_balance", f"""{LABELS_SQL}, s as (select cluster, count(*) as size from lab group by cluster),
v as (select size, row_number() over (order by size, cluster) as r from s where cluster <> -1),
g as (select count(*) as n, sum(size) as ss, sum(r * size) as rs, max(size) as mx from v)
select n::bigint as n_clusters, (select sum(size) from s)::bigint as total_points,
  coalesce((select sum(size) from s where cluster = -1), 0)::bigint as noise_points,
  {rnd("coalesce((select sum(size) from s where cluster = -1), 0)::double / (select sum(size) from s)")} as noise_ratio,
  {rnd("case when n > 0 then mx * 100.0::double / ss else 100.0 end")} as largest_cluster_pct,
  {rnd("case when n > 0 then 1.0::double - (2.0::double * rs / (n * ss) - (n + 1.0::double) / n) else 0.0 end")} as balance_ratio
from g""")(lambda spark, sf: round_doubles(cluster_balance(card_labels(spark, sf))))

register("size_stats", f"""{LABELS_SQL}, s as (select cluster, count(*) as size from lab where cluster <> -1 group by cluster)
select min(size)::bigint as min_cluster_size, max(size)::bigint as max_cluster_size, {rnd("avg(size)")} as avg_cluster_size,
  {rnd("case when count(*) > 1 then 1.0::double - stddev_pop(size) / avg(size) when count(*) = 1 then 1.0 end")} as cluster_balance from s""")(
    lambda spark, sf: round_doubles(size_stats(card_labels(spark, sf))))

EMB_SQL = """with p as (select vec_id as id, label as cluster, embedding::double[] as v from embeddings where label <> -1)"""
SIL_SQL = f"""{EMB_SQL},
d as (select a.id, a.cluster, b.cluster as other, sum(list_distance(a.v, b.v)) as dsum, count(*) as cnt
      from p a, p b group by a.id, a.cluster, b.cluster),
per as (select id, cluster, max(case when other = cluster then dsum / (cnt - 1) end) as a,
          max(case when other = cluster then cnt end) as own,
          min(case when other <> cluster then dsum / cnt end) as b from d group by id, cluster)
select {rnd("avg(case when own <= 1 then 0.0 else coalesce((b - a) / greatest(a, b), 0.0) end)")} as silhouette from per"""

register("silhouette_exact", SIL_SQL)(lambda spark, sf: round_doubles(silhouette(emb_points(spark, sf))))
# At most SAMPLE points of each cluster, drawn by hash, against all points.
SAMPLE = 20
register("silhouette_sampled", f"""{SIL_SQL[:SIL_SQL.rindex("select")].rstrip()},
drawn as (select id, row_number() over (partition by cluster order by sha256('42:' || id), id) as nr, count(*) over (partition by cluster) as size,
            count(*) over () as total from p),
st as (select cluster, max(size) as size, max(total) as total, count(*) as n, avg(s) as mean, coalesce(var_samp(s), 0) as var
       from (select *, case when own <= 1 then 0.0 else coalesce((b - a) / greatest(a, b), 0.0) end as s from per) join drawn using (id)
       where nr <= {SAMPLE} group by cluster)
select {rnd("sum(size * mean / total)")} as silhouette,
  {rnd("sqrt(sum((size / total) * (size / total) * (1 - n / size) * var / n))")} as error from st""")(
    lambda spark, sf: round_doubles(silhouette_sampled(emb_points(spark, sf), SAMPLE)))
register("silhouette_fast", SIL_SQL.replace("sum(list_distance(a.v, b.v))", "sum(list_distance(a.v, b.v) * list_distance(a.v, b.v))").replace(
    "as silhouette from", "as silhouette_sq from"))(lambda spark, sf: round_doubles(silhouette_sq_euclidean(emb_points(spark, sf))))

CEN_SQL = f"""{EMB_SQL},
e as (select cluster, unnest(v) as x, generate_subscripts(v, 1) as i from p),
cen as (select cluster, i, avg(x) as m from e group by cluster, i),
cv as (select cluster, list(m order by i) as c, from cen group by cluster),
pc as (select p.*, cv.c from p join cv using (cluster))"""

register("davies_bouldin", f"""{CEN_SQL},
s as (select cluster, avg(list_distance(v, c)) as s from pc group by cluster),
r as (select a.cluster, max((sa.s + sb.s) / list_distance(a.c, b.c)) as r
      from cv a join cv b on a.cluster <> b.cluster join s sa on sa.cluster = a.cluster join s sb on sb.cluster = b.cluster
      group by a.cluster)
select {rnd("avg(r)")} as davies_bouldin from r""")(
    lambda spark, sf: round_doubles(davies_bouldin(emb_points(spark, sf))))

CH_SQL = f"""{CEN_SQL},
w as (select sum(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as w from pc),
sz as (select cluster, count(*) as n from p group by cluster),
g as (select list(avg_x order by i) as mu from (select i, sum(m * n) / sum(n) as avg_x from cen join sz using (cluster) group by i)),
b as (select sum(n * list_sum(list_transform(list_zip(c, mu), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) as b
      from cv join sz using (cluster), g)
select {rnd("(b / (k - 1)) / (w / (n - k))")} as calinski_harabasz
from b, w, (select count(*) as k, sum(n) as n from sz)"""

register("calinski_harabasz", CH_SQL)(lambda spark, sf: round_doubles(calinski_harabasz(emb_points(spark, sf))))

register("quality_report", f"""with sil as ({SIL_SQL}), db as ({CEN_SQL.replace(EMB_SQL, EMB_SQL)},
s as (select cluster, avg(list_distance(v, c)) as s from pc group by cluster),
r as (select a.cluster, max((sa.s + sb.s) / list_distance(a.c, b.c)) as r
      from cv a join cv b on a.cluster <> b.cluster join s sa on sa.cluster = a.cluster join s sb on sb.cluster = b.cluster
      group by a.cluster) select {rnd("avg(r)")} as davies_bouldin from r),
ch as ({CH_SQL}),
sz as (select label, count(*) as size from embeddings where label <> -1 group by label),
cnt as (select count(*) as total, count(*) filter (where label = -1) as noise, count(distinct label) filter (where label <> -1) as k from embeddings)
select 'embeddings' as algorithm, k::bigint as n_clusters, {rnd("noise::double / total")} as noise_ratio, total::bigint as total_points,
  (total - noise)::bigint as non_noise_points, silhouette as silhouette_score, davies_bouldin, calinski_harabasz,
  (select min(size) from sz)::bigint as min_cluster_size, (select max(size) from sz)::bigint as max_cluster_size,
  {rnd("(select avg(size) from sz)")} as avg_cluster_size,
  {rnd("(select case when count(*) > 1 then 1.0::double - stddev_pop(size) / avg(size) else 1.0 end from sz)")} as cluster_balance
from cnt, sil, db, ch""")(lambda spark, sf: round_doubles(quality_report(emb_points(spark, sf), "embeddings")))
