"""DuckDB twins: SQL text for the independent oracle.

These strings are *not* executed by the library; the verification harness
runs them in DuckDB against the same parquet tables and compares results
with the Spark plans.
"""

from __future__ import annotations

from cardprism.schema import AGGREGATE_FEATURES, DERIVED_FEATURES, INTEGER_FEATURES
from cardprism.sources.adapters import ADAPTER_SQL

FEATURES = AGGREGATE_FEATURES + DERIVED_FEATURES
DOUBLE_FEATURES = tuple(c for c in FEATURES if c not in INTEGER_FEATURES)


from cardprism.plans.registry import HALF, MONEY


def rc(c: str, expr: str | None = None) -> str:
    """Rounded output column: money-magnitude columns to 2 decimals, others 6."""
    return f"{rnd(expr or c, 2 if c in MONEY else 6)} as {c}"


def rnd(expr: str, digits: int = 6) -> str:
    """Twin of ``registry.fround``: identical IEEE operations in DuckDB."""
    k = f"{float(10 ** digits)!r}::double"
    y = f"(({expr})::double * {k} + {HALF}::double)"
    return f"(({y} - fmod({y}, 1.0::double) - case when fmod({y}, 1.0::double) < 0 then 1.0::double else 0.0::double end) / {k})"


def r6(cols, prefix: str = "") -> str:
    return ", ".join(rc(c, prefix + c) for c in cols)


def tx_cte(adapter: str) -> str:
    return f"tx as ({ADAPTER_SQL[adapter]})"


def features_ctes(adapter: str) -> str:
    """CTEs ``tx``, ``fagg``, ``features`` (unrounded card_id + 30 features)."""
    one = "1.0::double"
    zero = "0.0::double"
    return f"""{tx_cte(adapter)},
ft as (select *, hour(transaction_timestamp) as h, isodow(transaction_timestamp) as dow,
              month(transaction_timestamp) as mon from tx where card_id is not null),
fagg as (
  select card_id,
    count(transaction_id) as tx_count,
    sum(transaction_amount_kzt) / nullif(count(transaction_amount_kzt), 0) as avg_amount,
    stddev_samp(transaction_amount_kzt) as std_amount,
    median(transaction_amount_kzt) as median_amount,
    coalesce(sum(transaction_amount_kzt), 0) as total_amount,
    min(transaction_amount_kzt) as min_amount,
    max(transaction_amount_kzt) as max_amount,
    avg(case when wallet_type is not null then {one} else {zero} end) as digital_wallet_ratio,
    avg(case when transaction_currency is distinct from 'KZT' then {one} else {zero} end) as international_ratio,
    avg(case when pos_entry_mode is not distinct from 'Contactless' then {one} else {zero} end) as contactless_ratio,
    count(distinct transaction_type) as tx_type_variety,
    count(distinct pos_entry_mode) as payment_method_variety,
    avg(case when h >= 0 and h < 6 then {one} else {zero} end) as night_ratio,
    avg(case when h >= 6 and h < 12 then {one} else {zero} end) as morning_ratio,
    avg(case when h >= 12 and h < 18 then {one} else {zero} end) as afternoon_ratio,
    avg(case when h >= 18 and h < 24 then {one} else {zero} end) as evening_ratio,
    avg(case when dow in (6, 7) then {one} else {zero} end) as weekend_ratio,
    avg(case when mon in (11, 12, 1) then {one} else {zero} end) as holiday_ratio,
    count(distinct merchant_city) as city_diversity,
    count(distinct merchant_mcc) as mcc_diversity,
    count(distinct acquirer_country_iso) as country_diversity,
    count(distinct issuer_bank_name) as bank_diversity,
    date_sub('day', min(transaction_timestamp), max(transaction_timestamp)) + 1 as days_active,
    count(*) as n_rows
  from ft group by card_id),
fagg2 as (select *, n_rows / nullif(days_active, 0) as tx_frequency from fagg),
fder as (
  select *,
    std_amount / nullif(avg_amount, 0) as amount_volatility_raw,
    coalesce(max_amount / nullif(avg_amount, 0), 1.0::double) as high_value_ratio_raw,
    1.0::double / nullif(1.0::double + coalesce(std_amount / nullif(avg_amount, 0), 0.0::double), 0) as spending_consistency_raw,
    total_amount * tx_frequency as customer_lifetime_value_raw,
    total_amount / nullif(days_active, 0) as avg_daily_amount_raw,
    (digital_wallet_ratio + contactless_ratio + payment_method_variety / 5.0::double) / 3.0::double as payment_sophistication_raw
  from fagg2),
features as (
  select card_id,
    {", ".join(f"coalesce({c}, 0)::bigint as {c}" if c in INTEGER_FEATURES else
               (f"coalesce({c}_raw, 0.0::double) as {c}" if c in DERIVED_FEATURES else f"coalesce({c}, 0.0::double) as {c}")
               for c in FEATURES)}
  from fder)"""


def features_sql(adapter: str) -> str:
    return f"""with {features_ctes(adapter)}
select card_id, {", ".join(c if c in INTEGER_FEATURES else rc(c) for c in FEATURES)} from features"""
