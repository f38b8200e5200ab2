"""Report tables and the data behind the charts.

All are one aggregation keyed by the cluster (k rows out); text columns are
formatted from values first rounded half-up with plain arithmetic, so the
output does not depend on an engine's tie-breaking in ``round``/``printf``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardprism.operators.preprocess import pca_fit, pca_project
from cardprism.operators.profiles import fmt_fixed, fmt_grouped
from cardprism.operators.quantiles import grouped_quantiles

# --- Fixed values of the reference's rule-based insight texts -------------------
INSIGHT_RULES = [
    # (rule order, business name, description, recommendations, revenue opportunity)
    (1, "High-Value Outliers", "Customers with unusual transaction patterns requiring individual attention",
     ["Individual analysis", "Fraud monitoring", "Premium service"]),
    (2, "Premium Customers", "High-value customers with large transaction amounts",
     ["VIP service", "Premium products", "Exclusive offers"]),
    (3, "Digital Natives", "Tech-savvy customers preferring digital payments",
     ["Mobile banking features", "Digital-first products", "App promotions"]),
    (4, "Active Users", "Highly engaged customers with frequent transactions",
     ["Loyalty programs", "Transaction bonuses", "Cashback offers"]),
    (5, "Standard Customers", "Regular banking customers with typical patterns",
     ["Standard products", "Education campaigns", "Engagement programs"]),
]
REVENUE_OPPORTUNITY = "Targeted banking products and services"
PREMIUM_AMOUNT = 20000          # avg_amount above -> premium
DIGITAL_NATIVE_WALLET = 0.6     # digital_wallet_ratio above -> digital natives
ACTIVE_TRANSACTIONS = 1000      # avg_transactions above -> active users
KEY_OPPORTUNITIES = ["Digital transformation acceleration", "Premium customer retention",
                     "Cross-selling optimization", "Risk management enhancement"]
EXPECTED_IMPACT = {"revenue_growth": "15-20%", "customer_retention": "+10%", "cross_sell_rate": "+25%"}
# ---------------------------------------------------------------------------------


def segment_label(c="segment"):
    return F.when(F.col(c) == -1, F.lit("Outliers")).otherwise(F.concat(F.lit("Segment_"), F.col(c).cast("string")))


def segment_stats(labelled: DataFrame, seg: str = "segment") -> DataFrame:
    """Twelve measures per segment; -1 is named Outliers."""
    total = F.sum("size").over(Window.partitionBy())
    g = labelled.groupBy(F.col(seg).alias("segment")).agg(
        F.count(F.lit(1)).alias("size"), F.avg("tx_count").alias("avg_transactions"),
        F.avg("avg_amount").alias("avg_amount"), F.sum("total_amount").alias("total_revenue"),
        *[F.avg(c).alias(c) for c in ("digital_wallet_ratio", "international_ratio", "contactless_ratio",
                                      "weekend_ratio", "city_diversity", "country_diversity", "payment_sophistication")])
    return g.select("segment", segment_label().alias("segment_name"), "size",
                    (F.col("size") * 100.0 / total).alias("percentage"), *g.columns[2:])


def insight_rules(stats: DataFrame) -> DataFrame:
    """Ordered rules outlier -> premium -> digital -> active -> standard."""
    rule = (F.when(F.col("segment") == -1, 1).when(F.col("avg_amount") > PREMIUM_AMOUNT, 2)
             .when(F.col("digital_wallet_ratio") > DIGITAL_NATIVE_WALLET, 3)
             .when(F.col("avg_transactions") > ACTIVE_TRANSACTIONS, 4).otherwise(5))
    t = stats.sparkSession.createDataFrame(
        INSIGHT_RULES, "rule int, business_name string, description string, recommendations array<string>")
    return (stats.select("segment", "segment_name", rule.alias("rule")).join(F.broadcast(t), "rule")
            .select("segment", "segment_name", "business_name", "description", "recommendations",
                    F.lit(REVENUE_OPPORTUNITY).alias("revenue_opportunity")))


def insight_summary(insights: DataFrame) -> DataFrame:
    """Number of segments, their business names in segment order, key
    opportunities and expected impact."""
    return insights.agg(F.count(F.lit(1)).alias("total_segments"),
                        F.transform(F.sort_array(F.collect_list(F.struct("segment", "business_name"))),
                                    lambda s: s["business_name"]).alias("segment_names"),
                        F.array(*[F.lit(x) for x in KEY_OPPORTUNITIES]).alias("key_opportunities"),
                        *[F.lit(v).alias(k) for k, v in EXPECTED_IMPACT.items()])


SUMMARY_COLS = ("segment", "segment_name", "size", "percentage", "avg_amount", "total_revenue", "avg_transactions",
                "digital_wallet_ratio", "contactless_ratio", "international_ratio", "city_diversity",
                "payment_sophistication")


def segment_summary(labelled: DataFrame, seg: str = "segment") -> DataFrame:
    """The segment summary export table."""
    return segment_stats(labelled, seg).select(*SUMMARY_COLS)


def summary_table(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Formatted summary (12 text columns) plus the raw numbers."""
    total = F.sum("size").over(Window.partitionBy())
    g = labelled.groupBy(F.col(cluster_col).alias("cluster")).agg(
        F.count(F.lit(1)).alias("size"), F.avg("avg_amount").alias("avg_amount"),
        F.avg("tx_count").alias("avg_tx"), F.avg("digital_wallet_ratio").alias("wallet"),
        F.avg("contactless_ratio").alias("contactless"), F.avg("international_ratio").alias("intl"),
        F.avg("days_active").alias("days"), F.avg("city_diversity").alias("cities"),
        F.avg("payment_sophistication").alias("soph"))
    from cardprism.operators.profiles import grouped_medians
    med = grouped_medians(labelled.withColumnRenamed(cluster_col, "cluster"), "cluster", ["avg_amount"], ["median_amount"])
    g = g.join(med, "cluster", "left").withColumn("share", F.col("size") * 100.0 / total)
    pct = lambda c: F.concat(fmt_fixed(F.col(c) * 100.0, 1), F.lit("%"))
    return g.select(
        "cluster",
        F.concat(F.lit("Cluster "), F.col("cluster").cast("string")).alias("label"),
        F.col("size").cast("string").alias("size_text"),
        F.concat(fmt_fixed(F.col("share"), 1), F.lit("%")).alias("share_text"),
        fmt_grouped(F.col("avg_amount")).alias("avg_check"),
        fmt_grouped(F.col("median_amount")).alias("median_check"),
        fmt_fixed(F.col("avg_tx"), 0).alias("avg_transactions"),
        pct("wallet").alias("digital_wallet"), pct("contactless").alias("contactless_text"),
        pct("intl").alias("international"), fmt_fixed(F.col("days"), 0).alias("active_days"),
        fmt_fixed(F.col("cities"), 1).alias("geo_diversity"), fmt_fixed(F.col("soph"), 2).alias("sophistication"),
        "size", "share", "avg_amount", "median_amount")


def chart_overview(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Sizes and shares."""
    total = F.sum("size").over(Window.partitionBy())
    g = labelled.groupBy(F.col(cluster_col).alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return g.select("cluster", "size", (F.col("size") * 100.0 / total).alias("share"))


CHART_METRICS = ("avg_amount", "tx_count", "digital_wallet_ratio", "contactless_ratio", "international_ratio",
                 "city_diversity", "payment_sophistication", "days_active")


def chart_means(labelled: DataFrame, cluster_col: str = "cluster", metrics=CHART_METRICS) -> DataFrame:
    """Mean of each chart metric by cluster, long form (cluster, metric, value)."""
    g = labelled.groupBy(F.col(cluster_col).alias("cluster")).agg(*[F.avg(m).alias(m) for m in metrics])
    return g.unpivot(["cluster"], list(metrics), "metric", "value")


def chart_box(labelled: DataFrame, cluster_col: str = "cluster", metrics=("avg_amount", "tx_count")) -> DataFrame:
    """Quartiles, IQR, 1.5 IQR fences and whiskers (most extreme values
    inside the fences) per (cluster, metric)."""
    long = labelled.select(F.col(cluster_col).alias("cluster"), *[F.col(m).cast("double") for m in metrics]) \
                   .unpivot(["cluster"], list(metrics), "metric", "x")
    q = grouped_quantiles(long, ["cluster", "metric"], "x", [0.25, 0.5, 0.75], ["q1", "median", "q3"],
                          bounded_groups=True)
    q = q.withColumn("iqr", F.col("q3") - F.col("q1")) \
         .withColumn("lower_fence", F.col("q1") - 1.5 * F.col("iqr")) \
         .withColumn("upper_fence", F.col("q3") + 1.5 * F.col("iqr"))
    wk = long.join(F.broadcast(q.select("cluster", "metric", "lower_fence", "upper_fence")), ["cluster", "metric"]) \
             .groupBy("cluster", "metric").agg(
                 F.min(F.when(F.col("x") >= F.col("lower_fence"), F.col("x"))).alias("lower_whisker"),
                 F.max(F.when(F.col("x") <= F.col("upper_fence"), F.col("x"))).alias("upper_whisker"),
                 F.count_if((F.col("x") < F.col("lower_fence")) | (F.col("x") > F.col("upper_fence"))).alias("n_outliers"))
    return q.join(wk, ["cluster", "metric"])


HEATMAP_METRICS = ("avg_amount", "tx_count", "digital_wallet_ratio", "contactless_ratio", "city_diversity",
                   "payment_sophistication")


def chart_heatmap(labelled: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """Metric x cluster matrix of means, a column for each cluster of the
    data (``pivot`` reads the distinct ids of the k-row table of means)."""
    long = chart_means(labelled, cluster_col, HEATMAP_METRICS)
    name = F.when(F.col("cluster") == -1, F.lit("cluster_noise")).otherwise(F.concat(F.lit("cluster_"), F.col("cluster").cast("string")))
    return long.withColumn("name", name).groupBy("metric").pivot("name").agg(F.first("value"))


def chart_hist(labelled: DataFrame, cluster_col: str = "cluster", col: str = "digital_wallet_ratio",
               bins: int = 10) -> DataFrame:
    """Fixed-width histogram of a [0, 1] ratio by cluster."""
    b = F.least(F.floor(F.col(col) * bins), F.lit(bins - 1)).cast("int")
    return labelled.groupBy(F.col(cluster_col).alias("cluster"), b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _matrix_columns(points: DataFrame) -> tuple[DataFrame, list[str]]:
    d = points.select(F.max(F.size("v"))).first()[0] or 0
    cols = [f"x{i}" for i in range(d)]
    return points.select("id", *[F.col("v")[i].alias(c) for i, c in enumerate(cols)]), cols


def chart_pca(points: DataFrame, labels: DataFrame, dims: int = 3) -> DataFrame:
    """Scores of the clustering matrix ``points`` (id, v) on its first
    ``dims`` principal components (the first two are the 2-D chart), with the
    cluster of each point."""
    wide, cols = _matrix_columns(points)
    fit = pca_fit(wide, cols, min(dims, len(cols)))
    return pca_project(wide, cols, fit, keep=("id",)).join(labels.select("id", "cluster"), "id")


def chart_pca_variance(points: DataFrame, charts=(2, 3)) -> DataFrame:
    """Explained and cumulative variance of each chart's components."""
    wide, cols = _matrix_columns(points)
    ratio = pca_fit(wide, cols, None)["all_ratio"]
    rows = [(n, k, float(ratio[k]), float(ratio[:k + 1].sum())) for n in charts for k in range(min(n, len(cols)))]
    return points.sparkSession.createDataFrame(rows, "dims int, component int, ratio double, cumulative double")
