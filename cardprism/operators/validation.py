"""Schema, key, feature and table checks.  Each check returns rows
(a report DataFrame) instead of a log line, so it can be stored and joined."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cardprism.config import EXPECTED_COLUMNS
from cardprism.session import cut_lineage


def missing_columns(spark: SparkSession, df: DataFrame, expected=EXPECTED_COLUMNS) -> DataFrame:
    """Expected - actual column names, via a left anti join of two name tables."""
    exp = spark.createDataFrame([(c,) for c in expected], "column_name string")
    act = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    return exp.join(act, "column_name", "left_anti")


def column_report(df: DataFrame, expected=EXPECTED_COLUMNS) -> DataFrame:
    """V01 over the data: per expected column whether the table has it, and how
    many of its rows hold a value (0 if it is missing).  One scan."""
    have = set(df.columns)
    counts = df.agg(*[F.count(F.col(c) if c in have else F.lit(None)).alias(c) for c in expected])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c in have).alias("present"), F.col(c).alias("n_values")) for c in expected]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def type_violations(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Timestamp must be a timestamp, amount must be numeric."""
    rows = []
    if "transaction_timestamp" in df.columns and not isinstance(
            df.schema["transaction_timestamp"].dataType, (T.TimestampType, T.TimestampNTZType)):
        rows.append(("transaction_timestamp", "not a timestamp"))
    if "transaction_amount_kzt" in df.columns and not isinstance(
            df.schema["transaction_amount_kzt"].dataType, T.NumericType):
        rows.append(("transaction_amount_kzt", "not numeric"))
    return spark.createDataFrame(rows, "column_name string, problem string")


def null_keys(df: DataFrame, key: str = "card_id") -> DataFrame:
    """Rows whose key is NULL (one aggregation)."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"),
                  F.count_if(F.col(key).isNull()).alias("null_keys"))


def feature_quality(features: DataFrame, key: str = "card_id") -> DataFrame:
    """Per feature the number of missing (NULL/NaN) and infinite cells,
    from one aggregation pass, unpivoted to (feature, n_missing, n_inf)."""
    cols = [f.name for f in features.schema.fields if f.name != key and isinstance(f.dataType, T.NumericType)]
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs.append(F.count_if(x.isNull() | F.isnan(x)).alias(f"m__{c}"))
        aggs.append(F.count_if(F.abs(x) == float("inf")).alias(f"i__{c}"))
    wide = features.agg(*aggs)
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(f"m__{c}").alias("n_missing"), F.col(f"i__{c}").alias("n_inf"))
             for c in cols]
    return wide.select(F.explode(F.array(*pairs)).alias("s")).select("s.*")


def field_names(df: DataFrame, json_col: str | None = None, attribute_col: str | None = None) -> DataFrame:
    """(name): the fields that the data hold: the table's columns, the keys
    found in a column of JSON objects, and the attributes named by a column of
    a long table.  Keys and attributes are distinct values, summed up before
    they are shuffled."""
    names = df.sparkSession.createDataFrame([(c,) for c in df.columns if c not in (json_col, attribute_col)], "name string")
    if json_col:
        names = names.unionByName(df.select(F.explode(F.json_object_keys(F.col(json_col))).alias("name")).distinct())
    if attribute_col:
        names = names.unionByName(df.select(F.col(attribute_col).cast("string").alias("name")).where("name is not null").distinct())
    return names.distinct()


def dictionary_audit(spark: SparkSession, dictionary: DataFrame, columns, raw_category: str,
                     engineered=()) -> DataFrame:
    """Names documented but absent, and present but undocumented, for raw
    and engineered fields.  ``columns`` and ``engineered`` are lists or, for
    names found in the data, frames (name).  Anti joins over name tables."""
    def names(found):
        return found.select("name") if isinstance(found, DataFrame) else spark.createDataFrame([(c,) for c in found], "name string")

    def tag(d, kind, side):
        return d.select(F.lit(kind).alias("kind"), F.lit(side).alias("problem"), "name")

    out = []
    for kind, found, documented in (("raw", columns, F.col("category") == raw_category), ("engineered", engineered, F.col("category") != raw_category)):
        have, doc = names(found), dictionary.where(documented).select("name")
        out += [tag(have.join(doc, "name", "left_anti"), kind, "undocumented"), tag(doc.join(have, "name", "left_anti"), kind, "superfluous")]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def dictionary_categories(dictionary: DataFrame) -> DataFrame:
    """Number of fields per category, descending."""
    return dictionary.groupBy("category").agg(F.count(F.lit(1)).alias("n_fields")).orderBy(F.desc("n_fields"), "category")


def table_profile(df: DataFrame) -> DataFrame:
    """Shape, type histogram, missing cells and duplicate rows.  Rows are
    counted by two 64-bit hashes, pre-aggregated, so 24 bytes a row travel and
    not the row.  Only where a pair of hashes occurs twice are whole rows
    compared: equal ones are duplicates, chance hits are not."""
    types = {}
    for f in df.schema.fields:
        types[f.dataType.simpleString()] = types.get(f.dataType.simpleString(), 0) + 1
    cols = [F.col(c) for c in df.columns]
    nulls = sum((c.isNull().cast("long") for c in cols), F.lit(0).cast("long"))
    marks = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in cols])   # hashes skip nulls
    hashed = df.withColumns({"_h": F.xxhash64(marks, *cols), "_g": F.xxhash64(F.lit(1), *reversed(cols), marks), "_m": nulls})
    groups = hashed.groupBy("_h", "_g").agg(F.count(F.lit(1)).alias("_c"), F.sum("_m").alias("_m"))
    groups = cut_lineage(groups)
    total = groups.agg(F.coalesce(F.sum("_c"), F.lit(0)).alias("n"), F.count_if(F.col("_c") == 1).alias("single"), F.coalesce(F.sum("_m"), F.lit(0)).alias("m"))
    again = hashed.join(groups.where("_c > 1").select("_h", "_g"), ["_h", "_g"], "left_semi").select(*df.columns)
    distinct = again.groupBy(*df.columns).agg(F.lit(1).alias("_one")).agg(F.count(F.lit(1)).alias("d"))   # one row
    th = F.to_json(F.create_map(*[x for k, v in sorted(types.items()) for x in (F.lit(k), F.lit(v))]))
    return total.withColumn("_k", F.lit(1)).join(distinct.withColumn("_k", F.lit(1)), "_k").select(
        F.col("n").cast("long").alias("n_rows"), F.lit(len(df.columns)).cast("long").alias("n_columns"), th.alias("type_histogram"),
        F.col("m").cast("long").alias("missing_cells"), (F.col("n") - F.col("single") - F.col("d")).cast("long").alias("duplicate_rows"))
