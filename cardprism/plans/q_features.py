"""Registered queries: row-level flags (P), per-card aggregates (G), derived
features (F) and cleaning (F08)."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.operators.features import (
    add_behaviour_flags, add_day_parts, add_time_features, clean_features, customer_features,
)
from cardprism.plans.registry import register, round_doubles
from cardprism.plans.sqlgen import features_ctes, features_sql, rc, rnd, tx_cte
from cardprism.sources.adapters import events_transactions, orders_transactions

CFG = SegmentationConfig()


def features_of(spark, sf_dir, adapter="orders", cfg=CFG):
    tx = orders_transactions(spark, sf_dir) if adapter == "orders" else events_transactions(spark, sf_dir)
    return customer_features(tx, cfg)


register("customer_features", features_sql("events"))(
    lambda spark, sf: round_doubles(features_of(spark, sf, "events")))
register("customer_features_orders", features_sql("orders"))(
    lambda spark, sf: round_doubles(features_of(spark, sf, "orders")))

# --- P: row-level ---------------------------------------------------------

register("time_parts", f"""with {tx_cte('events')}
select transaction_id, hour(transaction_timestamp) as hour, isodow(transaction_timestamp) - 1 as day_of_week,
       month(transaction_timestamp) as month from tx""")(
    lambda spark, sf: add_time_features(events_transactions(spark, sf))
    .select("transaction_id", "hour", "day_of_week", "month"))

register("time_flags", f"""with {tx_cte('orders')}
select transaction_id, count(*) as n,
  bool_or(coalesce(isodow(transaction_timestamp) in (6, 7), false)) as is_weekend,
  bool_or(coalesce(month(transaction_timestamp) in (11, 12, 1), false)) as is_holiday_season
from tx group by transaction_id""")(
    lambda spark, sf: add_time_features(orders_transactions(spark, sf)).groupBy("transaction_id").agg(
        F.count(F.lit(1)).alias("n"), F.bool_or("is_weekend").alias("is_weekend"),
        F.bool_or("is_holiday_season").alias("is_holiday_season")))

register("behaviour_flags", f"""with {tx_cte('events')}
select transaction_id, wallet_type is not null as is_digital_wallet,
  transaction_currency is distinct from 'KZT' as is_international,
  pos_entry_mode is not distinct from 'Contactless' as is_contactless from tx""")(
    lambda spark, sf: add_behaviour_flags(events_transactions(spark, sf))
    .select("transaction_id", "is_digital_wallet", "is_international", "is_contactless"))

register("day_parts", f"""with {tx_cte('events')}
select case when hour(transaction_timestamp) < 6 then 'night' when hour(transaction_timestamp) < 12 then 'morning'
            when hour(transaction_timestamp) < 18 then 'afternoon' else 'evening' end as day_part,
       count(*) as n
from tx group by 1""")(
    lambda spark, sf: add_day_parts(events_transactions(spark, sf)).select(
        F.when(F.col("is_night"), "night").when(F.col("is_morning"), "morning")
         .when(F.col("is_afternoon"), "afternoon").otherwise("evening").alias("day_part"))
    .groupBy("day_part").agg(F.count(F.lit(1)).alias("n")))

# --- G / F: feature groups (column subsets of the one aggregation) --------

GROUPS = {
    "feat_frequency": ("tx_count",),
    "feat_monetary": ("avg_amount", "std_amount", "total_amount", "min_amount", "max_amount"),
    "feat_median": ("median_amount",),
    "feat_behaviour": ("digital_wallet_ratio", "international_ratio", "contactless_ratio"),
    "feat_variety": ("tx_type_variety", "payment_method_variety"),
    "feat_dayparts": ("night_ratio", "morning_ratio", "afternoon_ratio", "evening_ratio"),
    "feat_calendar": ("weekend_ratio", "holiday_ratio"),
    "feat_geo": ("city_diversity", "mcc_diversity", "country_diversity", "bank_diversity"),
    "feat_recency": ("days_active", "tx_frequency"),
    "feat_derived": ("amount_volatility", "high_value_ratio", "spending_consistency",
                     "customer_lifetime_value", "avg_daily_amount", "payment_sophistication"),
}
INT_COLS = {"tx_count", "tx_type_variety", "payment_method_variety", "city_diversity", "mcc_diversity",
            "country_diversity", "bank_diversity", "days_active"}


def _group_query(cols):
    return lambda spark, sf: round_doubles(features_of(spark, sf, "orders").select("card_id", *cols))


for _name, _cols in GROUPS.items():
    _sel = ", ".join(c if c in INT_COLS else rc(c) for c in _cols)
    register(_name, f"with {features_ctes('orders')} select card_id, {_sel} from features")(_group_query(_cols))


# --- F08: cleaning, on features with injected infinities -------------------
# amount_volatility/avg_daily_amount get +-Inf where a card's days_active is 1
# and NaN where tx_count is odd: the data decides where, so the work grows
# with the table.

def _inject(df):
    return df.select(
        "card_id",
        F.when(F.col("days_active") == 1, F.lit(float("inf"))).otherwise(F.col("amount_volatility")).alias("amount_volatility"),
        F.when(F.col("days_active") == 1, F.lit(float("-inf"))).otherwise(F.col("avg_daily_amount")).alias("avg_daily_amount"),
        F.when(F.col("tx_count") % 2 == 1, F.lit(float("nan"))).otherwise(F.col("avg_amount")).alias("avg_amount"),
    )


register("clean_features", f"""with {features_ctes('events')},
inj as (select card_id,
  case when days_active = 1 then 'inf'::double else amount_volatility end as amount_volatility,
  case when days_active = 1 then '-inf'::double else avg_daily_amount end as avg_daily_amount,
  case when tx_count % 2 = 1 then 'nan'::double else avg_amount end as avg_amount from features),
ext as (select
  max(case when isfinite(coalesce(amount_volatility, 0)) then coalesce(amount_volatility, 0) end) as mx_v,
  min(case when isfinite(coalesce(amount_volatility, 0)) then coalesce(amount_volatility, 0) end) as mn_v,
  max(case when isfinite(coalesce(avg_daily_amount, 0)) then coalesce(avg_daily_amount, 0) end) as mx_d,
  min(case when isfinite(coalesce(avg_daily_amount, 0)) then coalesce(avg_daily_amount, 0) end) as mn_d
  from (select card_id, case when isnan(amount_volatility) then null else amount_volatility end as amount_volatility,
               case when isnan(avg_daily_amount) then null else avg_daily_amount end as avg_daily_amount from inj))
select card_id,
  {rnd("case when amount_volatility is null or isnan(amount_volatility) then 0 when amount_volatility = 'inf'::double then mx_v when amount_volatility = '-inf'::double then mn_v else amount_volatility end")} as amount_volatility,
  {rnd("case when avg_daily_amount is null or isnan(avg_daily_amount) then 0 when avg_daily_amount = 'inf'::double then mx_d when avg_daily_amount = '-inf'::double then mn_d else avg_daily_amount end", 2)} as avg_daily_amount,
  {rnd("case when avg_amount is null or isnan(avg_amount) then 0 else avg_amount end", 2)} as avg_amount
from inj, ext""")(
    lambda spark, sf: round_doubles(clean_features(_inject(features_of(spark, sf, "events")))))
