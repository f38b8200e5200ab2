"""Per-card features on the hand-computed edge rows (FIXTURES F-N)."""

import datetime as dt

import pytest

from cardprism.operators.features import add_time_features, clean_features, customer_features
from cardprism.schema import FEATURE_COLUMNS, TRANSACTION_SCHEMA


def tx_row(i, card, ts, amount, cur="KZT", pos="Chip", wallet=None, city="A"):
    return (str(i), ts, card, None, "B", 1, 1, city, "POS", amount, amount, cur, "KZ", pos, wallet)


@pytest.fixture(scope="module")
def fn(spark):
    rows = [
        tx_row(1, 1, dt.datetime(2024, 1, 5, 23, 30), 100.0, "KZT", "Contactless", "W", "A"),
        tx_row(2, 1, dt.datetime(2024, 1, 7, 1, 30), 300.0, None, None, None, None),
        tx_row(3, 2, dt.datetime(2024, 6, 3, 12, 0), 50.0),
        tx_row(4, 3, dt.datetime(2024, 6, 3, 12, 0), 50.0),
        tx_row(5, 3, dt.datetime(2024, 6, 3, 12, 0), -50.0),
        tx_row(6, 4, None, 10.0),
        tx_row(7, None, dt.datetime(2024, 6, 3, 12, 0), 10.0),
    ]
    df = spark.createDataFrame(rows, TRANSACTION_SCHEMA)
    return {r["card_id"]: r.asDict() for r in customer_features(df).collect()}


EXPECTED = {
    1: dict(tx_count=2, avg_amount=200, std_amount=141.421356, median_amount=200, digital_wallet_ratio=.5,
            international_ratio=.5, contactless_ratio=.5, night_ratio=.5, morning_ratio=0, afternoon_ratio=0,
            evening_ratio=.5, weekend_ratio=.5, holiday_ratio=1, city_diversity=1, payment_method_variety=1,
            days_active=2, tx_frequency=1, amount_volatility=.707107, high_value_ratio=1.5,
            spending_consistency=.585786, customer_lifetime_value=400, avg_daily_amount=200,
            payment_sophistication=.4),
    2: dict(tx_count=1, avg_amount=50, std_amount=0, median_amount=50, digital_wallet_ratio=0, international_ratio=0,
            contactless_ratio=0, afternoon_ratio=1, weekend_ratio=0, holiday_ratio=0, days_active=1, tx_frequency=1,
            amount_volatility=0, high_value_ratio=1, spending_consistency=1, customer_lifetime_value=50,
            avg_daily_amount=50, payment_sophistication=.066667),
    3: dict(tx_count=2, avg_amount=0, std_amount=70.710678, median_amount=0, afternoon_ratio=1, days_active=1,
            tx_frequency=2, amount_volatility=0, high_value_ratio=1, spending_consistency=1,
            customer_lifetime_value=0, avg_daily_amount=0, payment_sophistication=.066667),
    4: dict(tx_count=1, avg_amount=10, night_ratio=0, morning_ratio=0, afternoon_ratio=0, evening_ratio=0,
            weekend_ratio=0, days_active=0, tx_frequency=0, customer_lifetime_value=0, avg_daily_amount=0),
}


def test_null_card_dropped(fn):
    assert set(fn) == {1, 2, 3, 4}


@pytest.mark.parametrize("card", sorted(EXPECTED))
def test_edge_rows(fn, card):
    got = fn[card]
    for k, v in EXPECTED[card].items():
        assert got[k] == pytest.approx(v, abs=1e-6), (card, k, got[k], v)


def test_thirty_features(fn):
    assert len(FEATURE_COLUMNS) == 30
    assert all(set(FEATURE_COLUMNS) <= set(r) for r in fn.values())


def test_weekday_monday_zero(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 6, 10, 0),), (dt.datetime(2024, 1, 8, 10, 0),)],
                               "transaction_timestamp timestamp_ntz")
    r = add_time_features(df).orderBy("transaction_timestamp").collect()
    assert [x["day_of_week"] for x in r] == [5, 0]
    assert [x["is_weekend"] for x in r] == [True, False]


def test_clean_features_replaces_infinities(spark):
    df = spark.createDataFrame([(1, 1.0), (2, float("inf")), (3, float("-inf")), (4, float("nan")), (5, None), (6, -2.0)],
                               "card_id long, x double")
    got = {r["card_id"]: r["x"] for r in clean_features(df).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: -2.0, 4: 0.0, 5: 0.0, 6: -2.0}


def test_day_parts_sum_to_one(spark):
    from cardprism.plans.q_features import features_of
    rows = features_of(spark, "/root/testdata/sf0.001", "events").collect()
    for r in rows:
        assert r["night_ratio"] + r["morning_ratio"] + r["afternoon_ratio"] + r["evening_ratio"] == pytest.approx(1.0)
        assert r["min_amount"] <= r["median_amount"] <= r["max_amount"]


def test_sums_keep_small_amounts_and_stand_infinite_ones(spark):
    ts = dt.datetime(2024, 6, 3, 12, 0)
    rows = [tx_row(i, 1, ts, 1e-7) for i in range(10)] + [tx_row(20 + i, 2, ts, a) for i, a in enumerate((float("inf"), 5.0))] + \
           [tx_row(30, 3, ts, 9e18), tx_row(31, 3, ts, 9e18)]
    got = {r["card_id"]: r for r in customer_features(spark.createDataFrame(rows, TRANSACTION_SCHEMA)).collect()}
    assert got[1]["total_amount"] == pytest.approx(1e-6, rel=1e-12) and got[1]["avg_amount"] == pytest.approx(1e-7, rel=1e-12)
    assert got[2]["total_amount"] == float("inf")
    assert got[3]["total_amount"] == pytest.approx(1.8e19)
    clean = {r["card_id"]: r for r in clean_features(spark.createDataFrame(list(got.values()))).collect()}
    assert clean[2]["total_amount"] == clean[3]["total_amount"]


def test_features_are_one_lazy_plan(spark):
    """Building the frame starts no job and caches nothing; a filter on the
    card reaches the source."""
    rows = spark.range(0, 50).selectExpr("cast(id as string) as transaction_id", "timestamp_ntz'2024-01-05 10:00:00' as transaction_timestamp", "id % 5 as card_id",
                                         "cast(id as double) as transaction_amount_kzt", *[f"'x' as {c}" for c in (
                                             "wallet_type", "transaction_currency", "pos_entry_mode", "transaction_type", "merchant_city", "acquirer_country_iso", "issuer_bank_name")],
                                         "cast(1 as int) as merchant_mcc")
    tracker, sc = spark.sparkContext.statusTracker(), spark.sparkContext
    sc.setJobGroup("lazy", "features")
    df = customer_features(rows)
    assert not tracker.getJobIdsForGroup("lazy")
    sc.setLocalProperty("spark.jobGroup.id", None)
    plan = df.where("card_id = 3")._jdf.queryExecution().toString()
    assert "InMemoryRelation" not in plan
    assert df.where("card_id = 3").first().median_amount == 25.5


def test_features_read_and_move_the_transactions_once(spark):
    """One scan of the lines and no shuffle of them by supplier."""
    from cardprism.plans.q_features import features_of
    plan = features_of(spark, "/root/testdata/sf0.001", "orders")._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and "l_orderkey" in line for line in plan.splitlines()) == 1
    assert "hashpartitioning(l_suppkey" not in plan


def test_medians_of_the_one_pass_equal_those_of_spread_cards(spark):
    """Null, NaN and infinite amounts, ties, both zeros, a card with a third of the rows."""
    import random

    from cardprism.config import SegmentationConfig
    rng, ts = random.Random(3), dt.datetime(2024, 6, 3, 12, 0)
    odd = [None, float("nan"), float("inf"), float("-inf"), 0.0, -0.0, 5.0]
    rows = [tx_row(i, i % 40 if i % 3 else 7, ts, rng.choice(odd) if i % 5 == 0 else rng.gauss(0, 100)) for i in range(3000)]
    rows += [tx_row(9000 + i, 100 + i, ts, x) for i, x in enumerate(odd)] + [tx_row(9100, 200, ts, None), tx_row(9101, 200, ts, None)]
    df = spark.createDataFrame(rows, TRANSACTION_SCHEMA).repartition(3)
    one, spread = ({r.card_id: r for r in customer_features(df, SegmentationConfig(median_mode=m)).collect()} for m in ("exact", "spread"))
    assert set(one) == set(spread)
    for card, r in spread.items():
        for c in ("median_amount", "tx_count", "city_diversity", "min_amount", "max_amount", "digital_wallet_ratio", "days_active"):
            assert one[card][c] == r[c], (card, c)
