"""Data sets behind a dashboard."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.exact import SENTINEL, mean, rounded, total
from tallyforge.operators.aggregates import dated


def masked(df: DataFrame, start: str, end: str, regions: tuple[str, ...], categories: tuple[str, ...]) -> DataFrame:
    """Rows from start to end, both included, of the regions and categories; undated rows fall out."""
    return df.filter(F.col("purchase_date").between(F.lit(start).cast("date"), F.lit(end).cast("date")) & F.col("region").isin(*regions) & F.col("category").isin(*categories))


def kpis(df: DataFrame) -> DataFrame:
    who = F.when(F.col("customer_id") != SENTINEL, F.col("customer_id"))
    return df.agg(rounded(total()).alias("revenue"), F.count("*").alias("orders"), rounded(mean()).alias("avg_order_value"), F.count_distinct(who).alias("customers"))


def period(frequency: str) -> Column:
    """The label of a date's day, its week (the Sunday that ends it) or its month (the first)."""
    d = F.col("purchase_date")
    return {"D": d, "W": F.date_add(F.trunc(d, "week"), 6), "MS": F.trunc(d, "MM")}[frequency]


def revenue_by_period(df: DataFrame, frequency: str) -> DataFrame:
    return dated(df).groupBy(period(frequency).alias("period"), "region").agg(rounded(total()).alias("revenue"))


def revenue_pivot(df: DataFrame, regions: tuple[str, ...], frequency: str = "MS") -> DataFrame:
    """Revenue per period with one column per region; named regions save a pass that looks for them."""
    wide = revenue_by_period(df, frequency).groupBy("period").pivot("region", list(regions)).agg(F.max("revenue"))
    return wide.select("period", *[F.col(r).alias(r.lower().replace(" ", "_")) for r in regions])


def top(df: DataFrame, by: tuple[str, ...], n: int = 10) -> DataFrame:
    """The n groups of most revenue; names settle ties."""
    return df.groupBy(*by).agg(rounded(total()).alias("revenue"), F.sum("quantity").cast("long").alias("units_sold")).orderBy(F.desc("revenue"), *by).limit(n)


def churn_histogram(scored: DataFrame, bins: int = 30) -> DataFrame:
    """Counts per score bin and label; a score of 1 falls in the last bin."""
    at = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scored.groupBy(at.alias("bin"), F.col("label").cast("int").alias("label")).agg(F.count("*").alias("customers"))


def at_risk(scored: DataFrame, threshold: float = 0.7) -> DataFrame:
    return scored.filter(F.col("score") >= threshold).select("customer_id", "region", "customer_segment", "score").orderBy(F.desc("score"), "customer_id")


def churn_rates(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.agg(rounded(F.sum(F.col("label").cast("double")) / F.count("*"), 6).alias("actual_rate"), rounded(F.sum((F.col("score") >= threshold).cast("double")) / F.count("*"), 6).alias("predicted_rate"))
