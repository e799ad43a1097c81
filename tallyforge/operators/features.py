"""Per-customer features for segmentation and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.exact import mean, rounded, total
from tallyforge.operators.aggregates import known
from tallyforge.sources.sinks import materialized

CHURN_DAYS = 90
#: What features and labels are made of.
SOURCE_COLUMNS = ("customer_id", "purchase_date", "total_amount", "category", "payment_method", "customer_age", "region", "customer_segment")


def mode_per_customer(df: DataFrame, column: str) -> DataFrame:
    """Each customer's most frequent value, the least of equals; customers without any value are absent."""
    counted = df.filter(F.col(column).isNotNull()).groupBy("customer_id", column).agg(F.count("*").alias("n"))
    return counted.groupBy("customer_id").agg(F.min_by(column, F.struct(-F.col("n"), F.col(column))).alias(column))


def category_diversity(df: DataFrame) -> DataFrame:
    """Distinct categories and the entropy of their counts."""
    counted = df.filter("category is not null").groupBy("customer_id", "category").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("customer_id"))
    each = counted.withColumn("h", -share * F.log(share))
    return each.groupBy("customer_id").agg(F.count("*").alias("distinct_categories"), rounded(F.sum("h"), 4).alias("category_entropy"))


def core_features(df: DataFrame) -> DataFrame:
    return df.groupBy("customer_id").agg(
        F.count("*").alias("frequency"),
        rounded(total()).alias("monetary"),
        rounded(mean()).alias("avg_order_value"),
        F.min("purchase_date").alias("first_purchase_date"),
        F.max("purchase_date").alias("last_purchase_date"),
        F.count_distinct("payment_method").alias("distinct_payment_methods"),
        rounded(F.sum(F.col("customer_age").cast("long")) / F.count("customer_age"), 1).alias("customer_age"),
        F.date_diff(F.max("purchase_date"), F.min("purchase_date")).alias("tenure_days"),
    )


def _joined(rows: DataFrame) -> DataFrame:
    core = core_features(rows)
    out = core.join(category_diversity(rows), "customer_id", "left")
    for column in ("region", "customer_segment"):
        out = out.join(mode_per_customer(rows, column), "customer_id", "left")
    return out


def clustering_features(df: DataFrame, rfm: DataFrame) -> DataFrame:
    rows = _joined(known(df)).drop("frequency", "monetary")
    return rfm.join(rows, "customer_id").select(
        "customer_id", "recency_days", "frequency", "monetary", "rfm_score", "customer_segment_label", "avg_order_value", "tenure_days",
        "distinct_payment_methods", "customer_age", "distinct_categories", "category_entropy", "region", "customer_segment",
    )


def _cutoff(df: DataFrame, days: int) -> DataFrame:
    return F.broadcast(known(df).agg(F.date_sub(F.max("purchase_date"), days).alias("cutoff")))  # one row


def temporal_split(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Known rows with ``cutoff`` (last date minus days) and ``is_feature``: whether they are on or before it."""
    return known(df).crossJoin(_cutoff(df, days)).withColumn("is_feature", F.col("purchase_date") <= F.col("cutoff"))


def churn_label(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Customers with a purchase on or before the cutoff, and whether none follows it."""
    split = temporal_split(df, days)
    each = split.groupBy("customer_id").agg(F.max(F.col("is_feature").cast("int")).alias("before"), F.max((~F.col("is_feature")).cast("int")).alias("after"))
    return each.filter("before = 1").select("customer_id", (1 - F.col("after")).alias("churned"))


def churned_customers(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    split = temporal_split(df, days)
    later = split.filter("not is_feature").select("customer_id").distinct()
    return split.filter("is_feature").select("customer_id").distinct().join(later, "customer_id", "left_anti")


def retained_customers(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    split = temporal_split(df, days)
    later = split.filter("not is_feature").select("customer_id").distinct()
    return split.filter("is_feature").select("customer_id").distinct().join(later, "customer_id", "left_semi")


def churn_features(df: DataFrame, days: int = CHURN_DAYS) -> DataFrame:
    """Features from before the cutoff only, recency counted from it, and the label from after it.

    The rows are written once, so the joins behind them do not run again for each of the aggregations.
    """
    df = materialized(known(df).select(*SOURCE_COLUMNS))
    before = temporal_split(df, days).filter("is_feature").drop("cutoff", "is_feature")
    rows = _joined(before).join(churn_label(df, days), "customer_id").crossJoin(_cutoff(df, days))
    return rows.withColumn("recency_days", F.date_diff("cutoff", "last_purchase_date")).select(
        "customer_id", "frequency", "monetary", "avg_order_value", "distinct_payment_methods", "customer_age", "tenure_days", "recency_days",
        "distinct_categories", "category_entropy", "region", "customer_segment", "churned",
    )
