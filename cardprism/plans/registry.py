"""Registry of named queries (Spark callables) and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Output columns of money magnitude (1e3..1e9): compared at 2 decimals, all
# other floating columns at 6, so that summation-order noise cannot cross a
# rounding boundary.
MONEY = frozenset({
    "avg_amount", "std_amount", "median_amount", "total_amount", "min_amount", "max_amount",
    "customer_lifetime_value", "avg_daily_amount", "clv", "total_volume", "avg_volume_per_customer",
    "total_revenue", "estimated_total_revenue", "avg_clv", "median_avg_amount", "std_avg_amount",
    "q1", "q3", "iqr", "most_valuable_clv", "lower_fence", "upper_fence", "lower_whisker", "upper_whisker", "sum_x", "sum_xx",
})

# A little above one half: a value that lies exactly between two outputs goes
# up in both engines although their sums differ in the last bits.
HALF = 0.50001

QUERIES: dict = {}
ORACLE: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fround(c, digits: int = 6):
    """Half-up rounding written as plain IEEE operations (multiply, add, exact
    fmod, divide) so that Spark and the DuckDB twin (``sqlgen.rnd``) produce
    bit-identical doubles; the engines' own ``round`` disagree on ties."""
    k = float(10 ** digits)
    y = (F.col(c) if isinstance(c, str) else c).cast("double") * k + HALF
    f = y % 1.0
    return F.when(f < 0, y - f - 1.0).otherwise(y - f) / k


def round_doubles(df: DataFrame, digits: int = 6, money: bool = True) -> DataFrame:
    """Round every floating column (deterministic comparison with DuckDB);
    ``money=False`` for outputs that keep feature names but are rescaled."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            out.append(fround(f.name, 2 if (money and f.name in MONEY) else digits).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def round_by_metric(df: DataFrame, key: str, money=MONEY) -> DataFrame:
    """Round ``value`` at 2 decimals where ``key`` names a money metric, else 6."""
    value = F.when(F.col(key).isin(*money), fround("value", 2)).otherwise(fround("value", 6))
    return df.select(*[value.alias("value") if c == "value" else F.col(c) for c in df.columns])


_MEMO: dict = {}


def memo(spark: SparkSession, key: tuple, build):
    """Reuse an already materialised (checkpointed) intermediate table within
    one session - e.g. the card matrix that several model queries read."""
    k = (id(spark), spark.sparkContext.applicationId) + tuple(key)
    if k not in _MEMO:
        _MEMO[k] = build()
    return _MEMO[k]
