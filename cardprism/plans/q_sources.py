"""Registered queries: sources, sinks (round trips) and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from cardprism.operators.features import attach_labels
from cardprism.operators.quality import drop_noise
from cardprism.operators.validation import (
    column_report, dictionary_audit, dictionary_categories, feature_quality, field_names, null_keys, table_profile,
)
from cardprism.plans.q_features import _inject, features_of
from cardprism.plans.q_quality import ARCHETYPE_SQL, archetype
from cardprism.plans.registry import register, round_doubles, table
from cardprism.plans.sqlgen import features_ctes, rc, tx_cte
from cardprism.sources.adapters import events_transactions, orders_transactions
from cardprism.sources.readers import load_stats, load_transactions, read_dictionary, seeded_sample
from cardprism.sources.sinks import save_table, save_text, scratch_path

TX_COLS = ("transaction_id, transaction_timestamp, card_id, issuer_bank_name, merchant_mcc, "
           "merchant_city, transaction_type, transaction_amount_kzt, transaction_currency, "
           "acquirer_country_iso, pos_entry_mode, wallet_type")


def _tx_cols(df):
    return df.select(*[c.strip() for c in TX_COLS.split(",")])


register("scan_parquet", "select event_id, ts, user_id, value from events")(
    lambda spark, sf: load_transactions(spark, f"{sf}/events.parquet", schema=None, timestamp_col="ts")
    .select("event_id", "ts", "user_id", "value"))


def _roundtrip(fmt, ext):
    def q(spark, sf):
        path = scratch_path(spark, f"tx-{fmt}") + ext
        save_table(events_transactions(spark, sf), path, fmt)
        return round_doubles(_tx_cols(load_transactions(spark, path)))
    return q


_TX_EVENTS = f"with {tx_cte('events')} select {TX_COLS.replace('transaction_amount_kzt', rc('transaction_amount_kzt'))} from tx"
register("scan_csv", _TX_EVENTS)(_roundtrip("csv", ".csv"))
register("sink_csv", _TX_EVENTS)(_roundtrip("csv", ".csv"))
register("sink_roundtrip", _TX_EVENTS)(_roundtrip("parquet", ".parquet"))
register("sink_json", _TX_EVENTS)(_roundtrip("json", ".json"))

register("load_stats", f"with {tx_cte('orders')} select count(*) as n_transactions, count(distinct card_id) as n_cards from tx")(
    lambda spark, sf: load_stats(orders_transactions(spark, sf)))

register("seeded_sample", f"""with {tx_cte('events')}
select transaction_id, card_id, transaction_type from tx
order by ((cast(transaction_id as bigint) % 2147483647) * 48271 + 42) % 2147483647, cast(transaction_id as bigint) limit 1000""")(
    lambda spark, sf: seeded_sample(events_transactions(spark, sf).withColumn("_id", F.col("transaction_id").cast("long")),
                                    1000, "_id", 42).select("transaction_id", "card_id", "transaction_type"))

# V01 on the raw table: what it has of the expected columns, and in how many rows
_ASKED = ("event_id", "ts", "user_id", "value", "card_id", "merchant_mcc")
register("schema_missing", " union all ".join(
    f"select '{c}' as column_name, true as present, count({c}) as n_values from events" if c in ("event_id", "ts", "user_id", "value")
    else f"select '{c}', false, 0::bigint" for c in _ASKED))(
    lambda spark, sf: column_report(table(spark, sf, "events"), _ASKED))

register("null_keys", f"""with {tx_cte('orders')}
select count(*) as n_rows, count(*) filter (where card_id is null) as null_keys from tx""")(
    lambda spark, sf: null_keys(orders_transactions(spark, sf)))

register("feature_quality", f"""with {features_ctes('events')},
inj as (select card_id,
  case when days_active = 1 then 'inf'::double else amount_volatility end as amount_volatility,
  case when days_active = 1 then '-inf'::double else avg_daily_amount end as avg_daily_amount,
  case when tx_count % 2 = 1 then 'nan'::double else avg_amount end as avg_amount from features)
select 'amount_volatility' as feature, count(*) filter (where amount_volatility is null or isnan(amount_volatility)) as n_missing,
       count(*) filter (where abs(amount_volatility) = 'inf'::double) as n_inf from inj
union all
select 'avg_daily_amount', count(*) filter (where avg_daily_amount is null or isnan(avg_daily_amount)),
       count(*) filter (where abs(avg_daily_amount) = 'inf'::double) from inj
union all
select 'avg_amount', count(*) filter (where avg_amount is null or isnan(avg_amount)),
       count(*) filter (where abs(avg_amount) = 'inf'::double) from inj""")(
    lambda spark, sf: feature_quality(_inject(features_of(spark, sf, "events"))))

register("table_profile", f"""with {tx_cte('orders')},
g as (select {TX_COLS}, count(*) as c from tx group by all)
select sum(c)::bigint as n_rows, 12::bigint as n_columns,
  '{{"bigint":1,"double":1,"int":1,"string":8,"timestamp_ntz":1}}' as type_histogram,
  sum(c * ((transaction_id is null)::int + (transaction_timestamp is null)::int + (card_id is null)::int
    + (issuer_bank_name is null)::int + (merchant_mcc is null)::int + (merchant_city is null)::int
    + (transaction_type is null)::int + (transaction_amount_kzt is null)::int + (transaction_currency is null)::int
    + (acquirer_country_iso is null)::int + (pos_entry_mode is null)::int + (wallet_type is null)::int))::bigint as missing_cells,
  (sum(c) - count(*))::bigint as duplicate_rows
from g""")(
    lambda spark, sf: table_profile(_tx_cols(orders_transactions(spark, sf))))


# Labels attached by key, noise dropped

def _labels(spark, sf):
    return features_of(spark, sf, "events").select("card_id", archetype().alias("cluster"))


register("attach_labels", f"""with {features_ctes('events')} select card_id, tx_count, {rc('total_amount')}, {ARCHETYPE_SQL} as cluster from features""")(
    lambda spark, sf: round_doubles(attach_labels(features_of(spark, sf, "events"), _labels(spark, sf)).select("card_id", "tx_count", "total_amount", "cluster")))
register("noise_filter", f"""with {features_ctes('events')} select card_id, {ARCHETYPE_SQL} as cluster from features where {ARCHETYPE_SQL} <> -1""")(
    lambda spark, sf: drop_noise(_labels(spark, sf)))


# A data dictionary written from the events of a few users, with
# comment lines, read back, and held against the fields of all events: columns,
# JSON keys, and the attributes of the long form (event type and key value).
# Attributes of odd key values are engineered fields, by event type.

_ATTRIBUTE = {"spark": "concat(event_type, '_', get_json_object(props, '$.k'))", "duck": "event_type || '_' || json_extract_string(props, '$.k')"}
_ODD = {"spark": "cast(get_json_object(props, '$.k') as int) % 2 = 1", "duck": "cast(json_extract_string(props, '$.k') as int) % 2 = 1"}
_DOCUMENTED = "user_id % 29 = 1"


def _dictionary(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    names = events.where(_DOCUMENTED).selectExpr(f"{_ATTRIBUTE['spark']} as name", f"case when {_ODD['spark']} then event_type else 'raw' end as category").distinct()
    names = names.select(F.lit(2).alias("place"), F.concat_ws(",", "name", "category").alias("value"))
    head = ["# fields of the events table", "name,category", "event_id,raw", "ts,raw", "# the next one is not in the table", "channel,raw"]
    lines = spark.createDataFrame([(min(i, 2), line) for i, line in enumerate(head)], "place int, value string").unionByName(names)
    path = scratch_path(spark, "dictionary")
    save_text(lines.repartition(1).sortWithinPartitions("place", "value").select("value"), path)   # a line per documented field
    return read_dictionary(spark, path)


def _audit(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("attribute", F.expr(_ATTRIBUTE["spark"])).withColumn("odd", F.expr(_ODD["spark"]))
    raw = field_names(events.where("not odd").drop("odd"), "props", "attribute")
    engineered = events.where("odd").select(F.col("attribute").alias("name")).distinct()
    return dictionary_audit(spark, _dictionary(spark, sf), raw, "raw", engineered)


_DICTIONARY_SQL = f"""dict as (
  select distinct {_ATTRIBUTE['duck']} as name, case when {_ODD['duck']} then event_type else 'raw' end as category from events where {_DOCUMENTED}
  union all values ('event_id', 'raw'), ('ts', 'raw'), ('channel', 'raw'))"""
register("dictionary_audit", f"""with {_DICTIONARY_SQL},
found as (
  select distinct case when {_ODD['duck']} then 'engineered' else 'raw' end as kind, {_ATTRIBUTE['duck']} as name from events
  union all select distinct 'raw', unnest(json_keys(props)) from events where not {_ODD['duck']}
  union all select 'raw', unnest(['event_id', 'ts', 'user_id', 'event_type', 'value'])),
doc as (select case when category = 'raw' then 'raw' else 'engineered' end as kind, name from dict)
select kind, 'undocumented' as problem, name from (select * from found except select * from doc)
union all select kind, 'superfluous', name from (select * from doc except select * from found)""")(_audit)
register("dictionary_categories", f"""with {_DICTIONARY_SQL} select category, count(*) as n_fields from dict group by category""")(
    lambda spark, sf: dictionary_categories(_dictionary(spark, sf)))
