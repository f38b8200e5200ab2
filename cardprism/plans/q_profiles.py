"""Registered queries: segment profiles (A) and report tables (R) over the
orders-derived card features labelled with the planted archetype."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardprism.operators import profiles as PR
from cardprism.operators import reports as RP
from cardprism.plans.q_features import features_of
from cardprism.plans.q_quality import ARCHETYPE_SQL, archetype
from cardprism.plans.registry import MONEY, register, round_by_metric, round_doubles
from cardprism.plans.sqlgen import features_ctes, rc, rnd
from cardprism.session import cut_lineage


def labelled(spark, sf, col="cluster"):
    """Labelled card features, as a table: profiles and reports read them several times."""
    return cut_lineage(features_of(spark, sf, "orders").withColumn(col, archetype()))


def profiles(spark, sf):
    return PR.profile_segments(labelled(spark, sf))


def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_list(xs) -> str:
    return "[" + ", ".join(_sql_str(x) for x in xs) + "]"


LAB = f"with {features_ctes('orders')}, lab as (select f.*, {ARCHETYPE_SQL} as cluster, {ARCHETYPE_SQL} as segment from features f)"

_MEANS = ",\n    ".join(f"avg({src}) as {name}" for name, src in PR.PROFILE_MEANS.items())
PROF = f"""{LAB},
prof0 as (
  select cluster, count(*) as size, stddev_samp(avg_amount) as std_amount, sum(total_amount) as total_volume,
    median(avg_amount) as median_amount, median(tx_count::double) as median_transactions,
    {_MEANS}
  from lab group by cluster),
prof as (
  select *, size * 100.0::double / sum(size) over () as percentage,
    case when weekend_activity > 0.3 then 'weekend' else 'weekdays' end as peak_activity_day,
    1.0::double - amount_volatility as activity_consistency,
    city_diversity as avg_cities_visited,
    case when city_diversity > 15 or international_usage > 0.1 then 'high'
         when city_diversity > 8 or international_usage > 0.05 then 'medium' else 'low' end as travel_intensity
  from prof0)"""

TEXT_COLS = {"peak_activity_day", "travel_intensity"}
INT_COLS = {"size", "cluster", "segment", "rank", "bin", "n"}


def sel(cols, src=""):
    out = []
    for c in cols:
        if c in TEXT_COLS or c in INT_COLS:
            out.append(f"{src}{c}" if c != "size" else f"{src}size::bigint as size")
        else:
            out.append(rc(c, src + c))
    return ", ".join(out)


def _prof_query(cols):
    return lambda spark, sf: round_doubles(profiles(spark, sf).select("cluster", *cols))


for _key, _cols in (("seg_metrics", PR.METRIC_COLS), ("seg_behaviour", PR.BEHAVIOUR_COLS),
                    ("seg_financial", PR.FINANCIAL_COLS), ("seg_temporal", PR.TEMPORAL_COLS),
                    ("seg_geography", PR.GEOGRAPHY_COLS)):
    register(_key, f"{PROF} select cluster, {sel(_cols)} from prof")(_prof_query(_cols))


# literal thresholds and texts: the twin does not read the operator's tables
NAME_SQL = """case
  when cluster = 0 and avg_amount > 20000 and digital_wallet_usage > 0.7 then 'Segment 0: large tickets, wallet users'
  when cluster = 0 and digital_wallet_usage > 0.6 then 'Segment 0: wallet users'
  when cluster = 1 and digital_wallet_usage > 0.5 and avg_transactions > 8000 then 'Segment 1: wallet users, many payments'
  when cluster = 1 and avg_transactions > 5000 then 'Segment 1: many payments'
  when cluster = 2 and avg_amount > 25000 and payment_sophistication > 3.5 then 'Segment 2: large tickets, varied payments'
  when cluster = 2 and avg_amount > 20000 then 'Segment 2: large tickets'
  when cluster = 3 and digital_wallet_usage < 0.05 and avg_transactions > 1500 then 'Segment 3: few wallets, many payments'
  when cluster = 3 and digital_wallet_usage < 0.1 then 'Segment 3: few wallets'
  when cluster = 4 and avg_amount > 30000 and digital_wallet_usage > 0.5 then 'Segment 4: large tickets, wallet users'
  when cluster = 4 and avg_amount > 25000 then 'Segment 4: large tickets'
  when cluster = 5 and digital_wallet_usage > 0.55 and avg_transactions > 8000 then 'Segment 5: wallet users, many payments'
  when cluster = 5 and avg_transactions > 5000 then 'Segment 5: many payments'
  when cluster = 6 and digital_wallet_usage > 0.7 and avg_transactions > 15000 then 'Segment 6: wallet users, many payments'
  when cluster = 6 and digital_wallet_usage > 0.7 then 'Segment 6: wallet users'
  when cluster between 0 and 6 then 'Segment ' || cluster::varchar || ': all others'
  else 'Cluster ' || cluster::varchar end"""
register("seg_name", f"{PROF} select cluster, {NAME_SQL} as segment_name from prof")(
    lambda spark, sf: PR.name_segments(profiles(spark, sf)))


def _fixed(expr, d):
    return f"printf('%.{d}f', {rnd(expr, d)})"


def _grouped(expr):
    return f"format('{{:,.0f}}', {rnd(expr, 0)})"


def _desc_case() -> str:
    args = (f"size::varchar, {_fixed('percentage', 1)}, {_grouped('avg_amount')}, {_fixed('avg_transactions', 0)}, "
            f"{_fixed('digital_wallet_usage * 100.0', 1)}, {_fixed('contactless_usage * 100.0', 1)}, {_grouped('clv')}")
    parts = [f"when cluster = {cl} then printf({_sql_str(t)}, {args})" for cl, t in PR.DESCRIPTION_TEMPLATES]
    return ("case " + " ".join(parts) +
            " else printf('Cluster %d: %d cards with basic characteristics.', cluster, size) end")


register("seg_description", f"{PROF} select cluster, {_desc_case()} as description from prof")(
    lambda spark, sf: PR.describe_segments(profiles(spark, sf)))

_RANK_UNION = " union all ".join(
    f"select '{m}' as metric, cluster, {src}::double as value from prof" for m, src in PR.RANK_METRICS)
_MONEY_KEYS = ("revenue", "highest_value", "most_profitable")


def _by_key(key):
    return f"case when {key} in {_MONEY_KEYS} then {rnd('value', 2)} else {rnd('value')} end as value"


register("seg_rankings", f"""{PROF}, l as ({_RANK_UNION})
select metric, row_number() over (partition by metric order by value desc, cluster) as rank, cluster, {_by_key('metric')} from l""")(
    lambda spark, sf: round_by_metric(PR.rank_segments(profiles(spark, sf)), "metric", _MONEY_KEYS))

_LEAD_UNION = " union all ".join(
    f"select '{m}' as key, cluster, {src}::double as value from prof" for m, src in PR.LEADER_METRICS)
register("seg_leaders", f"""{PROF}, l as ({_LEAD_UNION}),
r as (select *, row_number() over (partition by key order by value desc, cluster) as rn from l)
select key, cluster, {_by_key('key')} from r where rn = 1""")(
    lambda spark, sf: round_by_metric(PR.segment_leaders(profiles(spark, sf)), "key", _MONEY_KEYS))

PAYLOAD = ("segment_name string, size long, percentage double, avg_amount double, avg_transactions double, digital_wallet_usage double, "
           "contactless_usage double, international_usage double, city_diversity double, clv double, payment_sophistication double")
_PAYLOAD_DIGITS = (("percentage", 1), ("avg_amount", 0), ("avg_transactions", 0), ("digital_wallet_usage", 3), ("contactless_usage", 3),
                   ("international_usage", 3), ("city_diversity", 1), ("clv", 0), ("payment_sophistication", 2))


def _payload(spark, sf):
    """The payload documents, read back."""
    p = profiles(spark, sf)
    docs = PR.segment_payload(p, PR.name_segments(p))
    return round_doubles(docs.select("key", F.from_json("payload", PAYLOAD).alias("p")).select("key", "p.*"))


register("seg_payload", f"""{PROF}, n as (select *, {NAME_SQL} as segment_name from prof)
select 'cluster_' || cluster::varchar as key, segment_name, size::bigint as size,
  {', '.join(rc(c, f'round({c}, {d})') for c, d in _PAYLOAD_DIGITS)} from n""")(_payload)

PRIORITY_SQL = ("case when clv > 400000 then 'High' when clv > 200000 then 'Medium' else 'Standard' end as priority, "
                "case when avg_amount > 25000 then 'Premium' else 'Standard' end as investment_level")
register("seg_priority", f"{PROF} select cluster, {PRIORITY_SQL} from prof")(
    lambda spark, sf: PR.priority_levels(profiles(spark, sf)))

_REC_CASE = """case when cluster between 0 and 6 then [
  case when digital_wallet_usage > 0.6 then 'Put new card functions into the phone wallet first'
       when digital_wallet_usage > 0.3 then 'Reward the second and third wallet payment of a month' else 'Show how to add the card to a phone wallet' end,
  case when clv > 400000 then 'Assign a named adviser' when clv > 200000 then 'Offer a fee-free upgrade of the card'
       else 'Keep the standard card, without added fees' end,
  case when international_usage > 0.1 then 'Drop the currency surcharge' when international_usage > 0.05 then 'Announce travel cover before holidays'
       else 'Leave foreign payments switched off unless asked for' end,
  case when weekend_activity > 0.3 then 'Time offers for Friday evening' else 'Time offers for working days' end,
  case when amount_volatility > 1.0 then 'Send an alert for unusually large payments' else 'Propose a standing monthly saving' end]
  else []::varchar[] end"""
register("seg_recommend", f"""{PROF} select cluster, {NAME_SQL} as segment_name, {_REC_CASE} as recommendations,
  {PRIORITY_SQL} from prof""")(
    lambda spark, sf: (lambda p: PR.recommend(p, PR.name_segments(p)))(profiles(spark, sf)))

_FC_SQL = """case when cluster between 0 and 6 then case when tx_frequency > 1.0 then 'large' when tx_frequency > 0.1 then 'some' else 'little' end end as growth_potential,
  case when cluster between 0 and 6 then case when digital_wallet_usage > 0.6 then 'nearly complete' when digital_wallet_usage > 0.3 then 'under way' else 'still to come' end end as digital_adoption_forecast,
  case when cluster between 0 and 6 then case when clv > 400000 then 'above the portfolio' when clv > 200000 then 'with the portfolio' else 'below the portfolio' end end as revenue_forecast,
  case when cluster between 0 and 6 then case when activity_consistency > 0.5 then 'small' when activity_consistency > 0 then 'moderate' else 'considerable' end end as churn_risk,
  case when cluster between 0 and 6 then case when payment_sophistication > 1.0 then 'new products' when payment_sophistication > 0.6 then 'more ways to pay' else 'first steps' end end as recommended_focus"""
register("seg_forecast", f"{PROF} select cluster, {_FC_SQL} from prof")(
    lambda spark, sf: PR.forecast(profiles(spark, sf)))

register("exec_summary", f"""{PROF}, n as (select *, {NAME_SQL} as segment_name from prof)
select sum(size)::bigint as total_customers, count(*)::bigint as total_clusters,
  {rnd('sum(clv * size)', 2)} as estimated_total_revenue,
  case when max(percentage) < 50 then 'excellent' else 'good' end as balance_quality,
  arg_max(segment_name, (clv, -cluster)) as most_valuable_segment, {rnd('max(clv)', 2)} as most_valuable_clv,
  arg_max(segment_name, (size, -cluster)) as largest_segment, {rnd('arg_max(percentage, (size, -cluster))')} as largest_segment_pct,
  arg_max(segment_name, (digital_wallet_usage, -cluster)) as most_digital_segment,
  {rnd('max(digital_wallet_usage)')} as most_digital_usage
from n""")(
    lambda spark, sf: round_doubles((lambda p: PR.executive_summary(p, PR.name_segments(p)))(profiles(spark, sf))))

_BUNDLE_COLS = ("cluster",) + PR.METRIC_COLS + PR.BEHAVIOUR_COLS + PR.FINANCIAL_COLS + (
    "holiday_activity", "peak_activity_day", "activity_consistency", "avg_cities_visited", "country_diversity",
    "travel_intensity")
register("seg_profile", f"""{PROF} select {sel(_BUNDLE_COLS)}, {NAME_SQL} as segment_name, {_desc_case()} as description,
  {PRIORITY_SQL}, {_FC_SQL} from prof""")(
    lambda spark, sf: round_doubles(PR.segment_bundle(labelled(spark, sf))))


def _parsed(spark, sf):
    """A response as a report service returns it (fenced JSON keyed cluster_N,
    with names of its own and without investment levels), and one that is no
    JSON: that one falls back on the rules.  Names come from the profile."""
    p = profiles(spark, sf)
    rules = PR.recommend(p, PR.name_segments(p))
    body = rules.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(
        F.concat(F.lit("cluster_"), F.col("cluster").cast("string")),
        F.struct(F.lit("a name of the service's own").alias("segment_name"), "recommendations", "priority"))))).alias("j"))
    good = body.select(F.concat(F.lit("```json\n"), F.col("j"), F.lit("\n```")).alias("response"))
    bad = body.select(F.concat(F.lit("I cannot answer in JSON: "), F.length("j").cast("string")).alias("response"))
    return PR.parse_responses(good.unionByName(bad), rules)


register("parse_responses", f"""{PROF}, rules as (select cluster, {NAME_SQL} as segment_name, {_REC_CASE} as recommendations, {PRIORITY_SQL} from prof)
select cluster, segment_name, recommendations, priority, 'Standard' as investment_level, false as parse_error from rules
union all select cluster, segment_name, recommendations, priority, investment_level, true from rules""")(_parsed)

# --- Reports -----------------------------------------------------------------------

def seg_lab(spark, sf):
    return labelled(spark, sf, "segment")


STATS = f"""{LAB},
st0 as (select segment, count(*) as size, avg(tx_count) as avg_transactions, avg(avg_amount) as avg_amount,
  sum(total_amount) as total_revenue, avg(digital_wallet_ratio) as digital_wallet_ratio,
  avg(international_ratio) as international_ratio, avg(contactless_ratio) as contactless_ratio,
  avg(weekend_ratio) as weekend_ratio, avg(city_diversity) as city_diversity, avg(country_diversity) as country_diversity,
  avg(payment_sophistication) as payment_sophistication from lab group by segment),
st as (select *, case when segment = -1 then 'Outliers' else 'Segment_' || segment::varchar end as segment_name,
  size * 100.0::double / sum(size) over () as percentage from st0)"""
_STAT_COLS = ("segment", "segment_name", "size", "percentage", "avg_transactions", "avg_amount", "total_revenue",
              "digital_wallet_ratio", "international_ratio", "contactless_ratio", "weekend_ratio", "city_diversity",
              "country_diversity", "payment_sophistication")
TEXT_COLS.add("segment_name")
register("segment_stats", f"{STATS} select {sel(_STAT_COLS)} from st")(
    lambda spark, sf: round_doubles(RP.segment_stats(seg_lab(spark, sf))))
register("segment_summary", f"{STATS} select {sel(RP.SUMMARY_COLS)} from st")(
    lambda spark, sf: round_doubles(RP.segment_summary(seg_lab(spark, sf))))

_RULE = ("case when segment = -1 then 1 when avg_amount > 20000 then 2 when digital_wallet_ratio > 0.6 then 3 "
         "when avg_transactions > 1000 then 4 else 5 end")


def _rule_col(i):
    return "case " + " ".join(f"when r = {row[0]} then {_sql_str(row[i]) if isinstance(row[i], str) else _sql_list(row[i])}"
                              for row in RP.INSIGHT_RULES) + " end"


INS = f"""{STATS}, ins as (select segment, segment_name, {_RULE} as r from st),
ins2 as (select segment, segment_name, {_rule_col(1)} as business_name, {_rule_col(2)} as description,
  {_rule_col(3)} as recommendations, {_sql_str(RP.REVENUE_OPPORTUNITY)} as revenue_opportunity from ins)"""
register("insight_rules", f"{INS} select * from ins2")(
    lambda spark, sf: RP.insight_rules(RP.segment_stats(seg_lab(spark, sf))))
register("insight_summary", f"""{INS} select count(*) as total_segments, list(business_name order by segment) as segment_names,
  {_sql_list(RP.KEY_OPPORTUNITIES)} as key_opportunities, {", ".join(f"{_sql_str(v)} as {k}" for k, v in RP.EXPECTED_IMPACT.items())} from ins2""")(
    lambda spark, sf: RP.insight_summary(RP.insight_rules(RP.segment_stats(seg_lab(spark, sf)))))


def _pct(expr):
    return f"{_fixed(expr + ' * 100.0', 1)} || '%'"


register("summary_table", f"""{LAB},
g as (select cluster, count(*) as size, avg(avg_amount) as avg_amount, median(avg_amount) as median_amount,
  avg(tx_count) as avg_tx, avg(digital_wallet_ratio) as wallet, avg(contactless_ratio) as contactless,
  avg(international_ratio) as intl, avg(days_active) as days, avg(city_diversity) as cities,
  avg(payment_sophistication) as soph from lab group by cluster),
g2 as (select *, size * 100.0::double / sum(size) over () as share from g)
select cluster, 'Cluster ' || cluster::varchar as label, size::varchar as size_text, {_fixed('share', 1)} || '%' as share_text,
  {_grouped('avg_amount')} as avg_check, {_grouped('median_amount')} as median_check, {_fixed('avg_tx', 0)} as avg_transactions,
  {_pct('wallet')} as digital_wallet, {_pct('contactless')} as contactless_text, {_pct('intl')} as international,
  {_fixed('days', 0)} as active_days, {_fixed('cities', 1)} as geo_diversity, {_fixed('soph', 2)} as sophistication,
  size::bigint as size, {rc('share')}, {rc('avg_amount')}, {rc('median_amount')}
from g2""")(lambda spark, sf: round_doubles(RP.summary_table(labelled(spark, sf))))

register("chart_overview", f"""{LAB} select cluster, count(*)::bigint as size, {rnd('count(*) * 100.0::double / sum(count(*)) over ()')} as share
from lab group by cluster""")(lambda spark, sf: round_doubles(RP.chart_overview(labelled(spark, sf))))

_MEANS_UNION = " union all ".join(
    f"select cluster, '{m}' as metric, {rnd(f'avg({m}::double)', 2 if m in MONEY else 6)} as value from lab group by cluster" for m in RP.CHART_METRICS)
register("chart_means", f"{LAB} {_MEANS_UNION}")(
    lambda spark, sf: round_by_metric(RP.chart_means(labelled(spark, sf)), "metric"))

_BOX_UNION = " union all ".join(f"select cluster, '{m}' as metric, {m}::double as x from lab" for m in ("avg_amount", "tx_count"))
register("chart_box", f"""{LAB}, l as ({_BOX_UNION}),
q as (select cluster, metric, quantile_cont(x, 0.25) as q1, median(x) as median, quantile_cont(x, 0.75) as q3 from l group by all),
q2 as (select *, q3 - q1 as iqr, q1 - 1.5 * (q3 - q1) as lower_fence, q3 + 1.5 * (q3 - q1) as upper_fence from q)
select q2.cluster, q2.metric, {rnd('q1', 2)} as q1, {rnd('median')} as median, {rnd('q3', 2)} as q3, {rnd('iqr', 2)} as iqr,
  {rnd('lower_fence', 2)} as lower_fence, {rnd('upper_fence', 2)} as upper_fence,
  {rnd('min(case when x >= lower_fence then x end)', 2)} as lower_whisker,
  {rnd('max(case when x <= upper_fence then x end)', 2)} as upper_whisker,
  count(*) filter (where x < lower_fence or x > upper_fence) as n_outliers
from q2 join l using (cluster, metric) group by all""")(
    lambda spark, sf: round_doubles(RP.chart_box(labelled(spark, sf))))

_HM_UNION = " union all ".join(
    f"select '{m}' as metric, cluster, {rnd(f'avg({m}::double)', 2 if m in MONEY else 6)} as value from lab group by cluster" for m in RP.HEATMAP_METRICS)


def _heatmap(spark, sf):
    """The matrix in long form; its columns are the clusters of the data."""
    wide = RP.chart_heatmap(labelled(spark, sf))
    ids = [c for c in wide.columns if c != "metric"]
    long = wide.unpivot(["metric"], ids, "name", "value")
    cluster = F.when(F.col("name") == "cluster_noise", F.lit(-1)).otherwise(F.regexp_extract("name", r"(\d+)$", 1).try_cast("int"))
    return round_by_metric(long.select("metric", cluster.alias("cluster"), "value"), "metric")


register("chart_heatmap", f"{LAB} {_HM_UNION}")(_heatmap)

register("chart_hist", f"""{LAB} select cluster, least(floor(digital_wallet_ratio * 10), 9)::int as bin, count(*) as n
from lab group by all""")(lambda spark, sf: RP.chart_hist(labelled(spark, sf)))
