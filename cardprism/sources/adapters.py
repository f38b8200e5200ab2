"""Adapters: derive card-transaction tables from the given test tables.

The reference's own transaction file is not available, so transactions are
derived from ``events`` (adapter E: real times of day, ~70 rows per card) and
from ``lineitem ⋈ orders ⋈ supplier ⋈ nation`` (adapter O: volume, joins,
several years).  Each adapter is a DataFrame plan (Catalyst prunes unread
columns and pushes filters into the scans) plus its DuckDB twin used as the
independent oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardprism.schema import TRANSACTION_SCHEMA


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _conform(df: DataFrame) -> DataFrame:
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in TRANSACTION_SCHEMA.fields])


def events_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter E: one transaction per event; archetype ``user_id % 4``."""
    e = _table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    e = e.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"))
    arche = F.col("user_id") % 4
    out = e.select(
        F.col("event_id").cast("string").alias("transaction_id"),
        F.col("ts").alias("transaction_timestamp"),
        F.col("user_id").alias("card_id"),
        F.lit(None).cast("string").alias("expiry_date"),
        F.concat(F.lit("BANK_"), (F.col("k") % 7).cast("string")).alias("issuer_bank_name"),
        F.col("k").cast("bigint").alias("merchant_id"),
        F.col("k").alias("merchant_mcc"),
        F.concat(F.lit("CITY_"), ((F.col("k") + F.col("user_id")) % (3 + arche * 8)).cast("string")).alias("merchant_city"),
        F.col("event_type").alias("transaction_type"),
        (F.col("value") * (1 + 3 * arche)).alias("transaction_amount_kzt"),
        F.col("value").alias("original_amount"),
        F.when(F.col("k") % 25 == 1, F.lit(None)).when(F.col("k") % 10 == 0, F.lit("USD"))
         .otherwise(F.lit("KZT")).alias("transaction_currency"),
        F.concat(F.lit("C"), (F.col("k") % 5).cast("string")).alias("acquirer_country_iso"),
        F.when(F.col("k") == 99, F.lit(None)).when(F.col("k") % 4 <= arche, F.lit("Contactless"))
         .when(F.col("k") % 4 == 1, F.lit("Chip")).otherwise(F.lit("ECom")).alias("pos_entry_mode"),
        F.when((F.col("k") + 17 * F.col("user_id")) % 100 < 30 * arche, F.lit("WALLET")).alias("wallet_type"),
    )
    return _conform(out)


def orders_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adapter O: lineitem joined to orders (card = customer), supplier and
    nation.  lineitem ⋈ orders is a shuffle join on the order key (both sides
    grow with the data); supplier is joined by itself, so that Spark plans it by
    its own size (joined with nation first, it is estimated as their product
    and all lines are shuffled again); nation (25 rows, fixed domain) is
    broadcast."""
    li = _table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_returnflag", "l_shipdate")
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    s = _table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(s, li.l_suppkey == s.s_suppkey)
    j = j.join(F.broadcast(n), s.s_nationkey == n.n_nationkey)
    arche = F.col("o_custkey") % 4
    hours = ((F.col("l_orderkey") * 7 + F.col("l_linenumber") * 3) % 24).cast("int")
    pk = F.col("l_partkey")
    out = j.select(
        F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"),
                    pk.cast("string"), F.col("l_suppkey").cast("string")).alias("transaction_id"),
        F.timestamp_add("HOUR", hours, F.col("l_shipdate")).alias("transaction_timestamp"),
        F.col("o_custkey").alias("card_id"),
        F.lit(None).cast("string").alias("expiry_date"),
        F.col("o_orderpriority").alias("issuer_bank_name"),
        F.col("l_suppkey").alias("merchant_id"),
        (pk % 50).cast("int").alias("merchant_mcc"),
        F.concat(F.col("n_name"), F.lit("_"), (pk % (2 + 4 * arche)).cast("string")).alias("merchant_city"),
        F.col("l_returnflag").alias("transaction_type"),
        (F.col("l_extendedprice") * (1 + arche)).alias("transaction_amount_kzt"),
        F.col("l_extendedprice").alias("original_amount"),
        F.when(F.col("l_linenumber") == 6, F.lit(None)).when(F.col("l_linenumber") == 7, F.lit("USD"))
         .otherwise(F.lit("KZT")).alias("transaction_currency"),
        F.col("n_name").alias("acquirer_country_iso"),
        F.when(pk % 97 == 0, F.lit(None)).when(pk % 4 <= arche, F.lit("Contactless"))
         .when(pk % 4 == 1, F.lit("Chip")).otherwise(F.lit("ECom")).alias("pos_entry_mode"),
        F.when((pk * 13 + F.col("l_suppkey")) % 100 < 30 * arche, F.lit("WALLET")).alias("wallet_type"),
    )
    return _conform(out)


ADAPTERS = {"events": events_transactions, "orders": orders_transactions}


# DuckDB twins of the adapters (the independent oracle; FIXTURES.md §2).
EVENTS_TX_SQL = """
select cast(event_id as varchar) as transaction_id, ts as transaction_timestamp, user_id as card_id,
  cast(null as varchar) as expiry_date,
  concat('BANK_', cast(k % 7 as varchar)) as issuer_bank_name, cast(k as bigint) as merchant_id, k as merchant_mcc,
  concat('CITY_', cast((k + user_id) % (3 + (user_id % 4) * 8) as varchar)) as merchant_city,
  event_type as transaction_type, value * (1 + 3 * (user_id % 4)) as transaction_amount_kzt, value as original_amount,
  case when k % 25 = 1 then null when k % 10 = 0 then 'USD' else 'KZT' end as transaction_currency,
  concat('C', cast(k % 5 as varchar)) as acquirer_country_iso,
  case when k = 99 then null when k % 4 <= user_id % 4 then 'Contactless' when k % 4 = 1 then 'Chip' else 'ECom' end as pos_entry_mode,
  case when (k + 17 * user_id) % 100 < 30 * (user_id % 4) then 'WALLET' else null end as wallet_type
from (select *, cast(json_extract_string(props, '$.k') as int) as k from events) e
"""

ORDERS_TX_SQL = """
select concat(cast(l_orderkey as varchar), '-', cast(l_linenumber as varchar), '-', cast(l_partkey as varchar), '-', cast(l_suppkey as varchar)) as transaction_id,
  l_shipdate + to_hours(cast((l_orderkey*7+l_linenumber*3) % 24 as int)) as transaction_timestamp, o_custkey as card_id,
  cast(null as varchar) as expiry_date,
  o_orderpriority as issuer_bank_name, l_suppkey as merchant_id, cast(l_partkey % 50 as int) as merchant_mcc,
  concat(n_name, '_', cast(l_partkey % (2 + 4 * (o_custkey % 4)) as varchar)) as merchant_city,
  l_returnflag as transaction_type, l_extendedprice * (1 + o_custkey % 4) as transaction_amount_kzt, l_extendedprice as original_amount,
  case when l_linenumber = 6 then null when l_linenumber = 7 then 'USD' else 'KZT' end as transaction_currency,
  n_name as acquirer_country_iso,
  case when l_partkey % 97 = 0 then null when l_partkey % 4 <= o_custkey % 4 then 'Contactless' when l_partkey % 4 = 1 then 'Chip' else 'ECom' end as pos_entry_mode,
  case when (l_partkey * 13 + l_suppkey) % 100 < 30 * (o_custkey % 4) then 'WALLET' else null end as wallet_type
from lineitem join orders on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
"""

ADAPTER_SQL = {"events": EVENTS_TX_SQL, "orders": ORDERS_TX_SQL}
