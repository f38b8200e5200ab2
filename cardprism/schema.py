"""Declared schemas and column lists."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTION_SCHEMA = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("transaction_timestamp", T.TimestampNTZType()),
    T.StructField("card_id", T.LongType()),
    T.StructField("expiry_date", T.StringType()),
    T.StructField("issuer_bank_name", T.StringType()),
    T.StructField("merchant_id", T.LongType()),
    T.StructField("merchant_mcc", T.IntegerType()),
    T.StructField("merchant_city", T.StringType()),
    T.StructField("transaction_type", T.StringType()),
    T.StructField("transaction_amount_kzt", T.DoubleType()),
    T.StructField("original_amount", T.DoubleType()),
    T.StructField("transaction_currency", T.StringType()),
    T.StructField("acquirer_country_iso", T.StringType()),
    T.StructField("pos_entry_mode", T.StringType()),
    T.StructField("wallet_type", T.StringType()),
])

# Aggregated per-card features, in output order (fixed by the reference).
AGGREGATE_FEATURES = (
    "tx_count", "avg_amount", "std_amount", "median_amount", "total_amount",
    "min_amount", "max_amount", "digital_wallet_ratio", "international_ratio",
    "contactless_ratio", "tx_type_variety", "payment_method_variety",
    "night_ratio", "morning_ratio", "afternoon_ratio", "evening_ratio",
    "weekend_ratio", "holiday_ratio", "city_diversity", "mcc_diversity",
    "country_diversity", "bank_diversity", "days_active", "tx_frequency",
)
DERIVED_FEATURES = (
    "amount_volatility", "high_value_ratio", "spending_consistency",
    "customer_lifetime_value", "avg_daily_amount", "payment_sophistication",
)
FEATURE_COLUMNS = AGGREGATE_FEATURES + DERIVED_FEATURES
INTEGER_FEATURES = (
    "tx_count", "tx_type_variety", "payment_method_variety", "city_diversity",
    "mcc_diversity", "country_diversity", "bank_diversity", "days_active",
)
