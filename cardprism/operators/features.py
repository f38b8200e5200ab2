"""Per-card behavioural features (row flags -> aggregation -> derived).

One lazy plan: the transactions' needed columns are moved once, by ``card_id``,
and one task sorts a card's rows by amount (it may spill) and aggregates them,
exact median included.  Partial aggregation would not pay: a card's rows lie in
as many tasks as it has payments, and a state with six sets is larger than the
rows it stands for.  Where single cards hold much of the data,
``median_mode="spread"`` aggregates partially and finds the medians in a second,
pruned scan keyed by card and amount (``ordered_quantiles``).  Nothing is cached
or written, and no job runs before the caller's action; filters on the result
reach the scan.  Callers that read the features often cut them (``cut_lineage``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardprism.config import SegmentationConfig
from cardprism.functions.columns import (
    day_part_flag, elapsed_days, flag_ratio, hour_of, is_holiday, is_weekend,
    month_of, nan_to_null, safe_div, weekday_mon0,
)
from cardprism.operators.quantiles import ordered_quantiles, place_quantile, with_places
from cardprism.schema import AGGREGATE_FEATURES, DERIVED_FEATURES, INTEGER_FEATURES

TS = "transaction_timestamp"
AMT = "transaction_amount_kzt"


def add_time_features(df: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """Hour, day_of_week (Monday = 0), month, weekend and holiday flags."""
    return df.select(
        "*",
        hour_of(TS).alias("hour"),
        weekday_mon0(TS).alias("day_of_week"),
        month_of(TS).alias("month"),
        is_weekend(TS, cfg.weekend_days).alias("is_weekend"),
        is_holiday(TS, cfg.holiday_months).alias("is_holiday_season"),
    )


def add_behaviour_flags(df: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """Wallet present; currency differs from base (NULL counts as
    foreign); contactless entry (NULL is not contactless)."""
    return df.select(
        "*",
        F.col("wallet_type").isNotNull().alias("is_digital_wallet"),
        (~F.col("transaction_currency").eqNullSafe(F.lit(cfg.base_currency))).alias("is_international"),
        F.col("pos_entry_mode").eqNullSafe(F.lit(cfg.contactless_mode)).alias("is_contactless"),
    )


def add_day_parts(df: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """One indicator per half-open hour range; NULL time -> False."""
    h = hour_of(TS)
    return df.select("*", *[day_part_flag(h, a, b).alias(f"is_{name}") for name, a, b in cfg.day_parts])


def aggregate_cards(tx: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """The 24 aggregated features, one row per non-null card_id."""
    t = tx.where(F.col("card_id").isNotNull()).select(
        "card_id", "transaction_id", TS, nan_to_null(F.col(AMT).cast("double")).alias(AMT), "wallet_type", "transaction_currency",
        "pos_entry_mode", "transaction_type", "merchant_city", "merchant_mcc", "acquirer_country_iso", "issuer_bank_name")
    own = cfg.median_mode == "exact"
    flagged = add_behaviour_flags(t, cfg).withColumn("has_id", F.col("transaction_id").isNotNull())
    if own:   # flags stand for ids, wallets and currencies: less to move
        flagged = flagged.drop("transaction_id", "wallet_type", "transaction_currency")
        flagged = with_places(flagged, ["card_id"], AMT)
    flagged = flagged.transform(lambda d: add_time_features(d, cfg)).transform(lambda d: add_day_parts(d, cfg))
    first = F.min(TS)
    last = F.max(TS)
    amt = F.col(AMT)
    agg = flagged.groupBy("card_id").agg(
        F.count_if("has_id").alias("tx_count"),
        *([place_quantile(AMT, 0.5).alias("median_amount")] if own else []),
        F.sum(amt).alias("total_amount"),
        F.count(amt).alias("_n"),
        F.stddev_samp(AMT).alias("std_amount"),
        F.min(AMT).alias("min_amount"),
        F.max(AMT).alias("max_amount"),
        flag_ratio("is_digital_wallet").alias("digital_wallet_ratio"),
        flag_ratio("is_international").alias("international_ratio"),
        flag_ratio("is_contactless").alias("contactless_ratio"),
        distinct_count("transaction_type").alias("tx_type_variety"),
        distinct_count("pos_entry_mode").alias("payment_method_variety"),
        *[flag_ratio(f"is_{name}").alias(f"{name}_ratio") for name, _, _ in cfg.day_parts],
        flag_ratio("is_weekend").alias("weekend_ratio"),
        flag_ratio("is_holiday_season").alias("holiday_ratio"),
        distinct_count("merchant_city").alias("city_diversity"),
        distinct_count("merchant_mcc").alias("mcc_diversity"),
        distinct_count("acquirer_country_iso").alias("country_diversity"),
        distinct_count("issuer_bank_name").alias("bank_diversity"),
        (elapsed_days(first, last) + 1).alias("days_active"),
        F.count(F.lit(1)).alias("_rows"),
    )
    agg = (agg.withColumn("avg_amount", safe_div(F.col("total_amount"), F.col("_n")))
              .withColumn("total_amount", F.coalesce("total_amount", F.lit(0.0)))
              .withColumn("tx_frequency", safe_div(F.col("_rows"), F.col("days_active"))))
    if not own:
        agg = agg.join(card_medians(t, cfg), "card_id", "left")
    return agg.select("card_id", *AGGREGATE_FEATURES)


def distinct_count(c):
    """Distinct non-null values per card.  ``size(collect_set)`` is one
    object-hash aggregation whose state is bounded by the column's value
    domain (types, entry modes, cities, MCCs, countries, banks), not by the
    card's row count; ``count_distinct`` x6 would make Catalyst expand every
    row seven times."""
    return F.size(F.collect_set(c)).cast("long")


def card_medians(t: DataFrame, cfg: SegmentationConfig) -> DataFrame:
    if cfg.median_mode == "approx":
        return t.groupBy("card_id").agg(F.percentile_approx(AMT, 0.5, 10000).cast("double").alias("median_amount"))
    return ordered_quantiles(t, ["card_id"], AMT, [0.5], ["median_amount"])


def derive(features: DataFrame) -> DataFrame:
    """F01-F06.  Division by zero yields NULL, later replaced by the reference's
    defaults (high_value_ratio -> 1, volatility inside consistency -> 0,
    everything else -> 0) instead of +-Inf."""
    vol = safe_div(F.col("std_amount"), F.col("avg_amount"))
    return features.select(
        "*",
        vol.alias("amount_volatility"),
        F.coalesce(safe_div(F.col("max_amount"), F.col("avg_amount")), F.lit(1.0)).alias("high_value_ratio"),
        safe_div(F.lit(1.0), F.lit(1.0) + F.coalesce(vol, F.lit(0.0))).alias("spending_consistency"),
        (F.col("total_amount") * F.col("tx_frequency")).alias("customer_lifetime_value"),
        safe_div(F.col("total_amount"), F.col("days_active")).alias("avg_daily_amount"),
        ((F.col("digital_wallet_ratio") + F.col("contactless_ratio") + F.col("payment_method_variety") / 5.0) / 3.0)
        .alias("payment_sophistication"),
    )


def fill_missing(features: DataFrame) -> DataFrame:
    """Missing -> 0 for every feature (NaN was mapped to NULL at load)."""
    cols = []
    for c in AGGREGATE_FEATURES + DERIVED_FEATURES:
        if c in INTEGER_FEATURES:
            cols.append(F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c))
        else:
            cols.append(F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0)).alias(c))
    return features.select("card_id", *cols)


def customer_features(tx: DataFrame, cfg: SegmentationConfig = SegmentationConfig()) -> DataFrame:
    """card_id + 30 features (the flagship query)."""
    return fill_missing(derive(aggregate_cards(tx, cfg)))


def attach_labels(features: DataFrame, labels: DataFrame, label_col: str = "cluster") -> DataFrame:
    """Attach cluster labels by key (never by position)."""
    return features.join(labels.select("card_id", label_col), "card_id")


def clean_features(features: DataFrame, columns=None) -> DataFrame:
    """NaN/NULL -> 0, +Inf -> the column's largest finite value, -Inf ->
    its smallest finite value.  One aggregation gives all finite extremes (2·d
    numbers, collected), then a projection replaces the infinities."""
    cols = list(columns) if columns else [f.name for f in features.schema.fields
                                          if f.name != "card_id" and f.dataType.typeName() in ("double", "float")]
    # extremes are taken after NaN/NULL -> 0, as the reference fills first
    filled = lambda c: F.coalesce(nan_to_null(F.col(c).cast("double")), F.lit(0.0))
    finite = lambda c: F.when(F.abs(filled(c)) != float("inf"), filled(c))
    ext = features.agg(*[F.max(finite(c)).alias(f"mx_{c}") for c in cols],
                       *[F.min(finite(c)).alias(f"mn_{c}") for c in cols]).first().asDict()
    out = []
    for f in features.schema.fields:
        c = f.name
        if c not in cols:
            out.append(F.col(c))
            continue
        x = F.col(c).cast("double")
        mx, mn = ext[f"mx_{c}"], ext[f"mn_{c}"]
        out.append(
            F.when(x.isNull() | F.isnan(x), F.lit(0.0))
             .when(x == float("inf"), F.lit(mx).cast("double"))
             .when(x == float("-inf"), F.lit(mn).cast("double"))
             .otherwise(x).alias(c))
    return features.select(*out)
