"""The aggregate tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.exact import SENTINEL, mean, rounded, share, total
from tallyforge.operators.cleansing import quantile


def known(df: DataFrame) -> DataFrame:
    """Dated rows of known customers."""
    return df.filter((F.col("customer_id") != SENTINEL) & F.col("purchase_date").isNotNull())


def dated(df: DataFrame) -> DataFrame:
    return df.filter(F.col("purchase_date").isNotNull())


def with_territory(df: DataFrame, regions: DataFrame) -> DataFrame:
    """Left join: unknown regions stay, without a territory. The dimension has a row per region, a handful."""
    return df.join(F.broadcast(regions), "region", "left")


def with_date_parts(df: DataFrame) -> DataFrame:
    d = F.col("purchase_date")
    return df.withColumns({"purchase_year": F.year(d), "purchase_month": F.month(d), "purchase_year_month": F.date_format(d, "yyyy-MM")})


def base_dataset(df: DataFrame, regions: DataFrame, partitions: int | None = None) -> DataFrame:
    """What the tables share: dealt by customer, so that customer aggregations need no second exchange."""
    dealt = df.repartition(partitions, "customer_id") if partitions else df
    return with_date_parts(with_territory(dealt, regions))


def _measures() -> list[Column]:
    return [rounded(total()).alias("revenue"), F.sum("quantity").cast("long").alias("units_sold"), F.count("*").alias("num_transactions"), rounded(mean()).alias("avg_order_value")]


def daily_revenue(df: DataFrame) -> DataFrame:
    return dated(df).groupBy("purchase_date", "region", "category").agg(*_measures())


def monthly_revenue(df: DataFrame) -> DataFrame:
    return with_date_parts(dated(df)).groupBy("purchase_year", "purchase_month", "purchase_year_month", "region", "category").agg(*_measures())


def rfm_values(df: DataFrame) -> DataFrame:
    """Recency in days before the day after the last purchase of all, frequency and money of each customer."""
    rows = known(df)
    last = rows.agg(F.max("purchase_date").alias("last"))  # one row
    each = rows.groupBy("customer_id").agg(F.max("purchase_date").alias("latest"), F.count("*").alias("frequency"), rounded(total()).alias("monetary"))
    return each.crossJoin(F.broadcast(last)).select("customer_id", F.date_diff(F.date_add("last", 1), F.col("latest")).alias("recency_days"), "frequency", "monetary")


def score(value: Column, cuts: list[Column], high_is_good: bool) -> Column:
    """Quarter from 1 to 4 by inclusive upper cuts."""
    marks = (1, 2, 3, 4) if high_is_good else (4, 3, 2, 1)
    return F.when(value <= cuts[0], marks[0]).when(value <= cuts[1], marks[1]).when(value <= cuts[2], marks[2]).otherwise(marks[3])


def label(points: Column) -> Column:
    # The least points of each label.
    return F.when(points >= 10, "Champions").when(points >= 8, "Loyal Customers").when(points >= 6, "Potential Loyalists").when(points >= 4, "At Risk").otherwise("Lost / Hibernating")


def customer_rfm(df: DataFrame, exact: bool = False) -> DataFrame:
    values = rfm_values(df)
    names = ("recency_days", "frequency", "monetary")
    cuts = values.agg(*[quantile(c, p, exact).alias(f"{c}_{k}") for c in names for k, p in enumerate((0.25, 0.5, 0.75))])  # one row
    joined = values.crossJoin(F.broadcast(cuts))
    marks = {n.split("_")[0]: score(F.col(n), [F.col(f"{n}_{k}") for k in range(3)], n != "recency_days") for n in names}
    scored = joined.withColumns({f"{k}_score": v for k, v in marks.items()})
    three = [F.col(f"{k}_score") for k in marks]
    return scored.select("customer_id", *names, *[f"{k}_score" for k in marks], F.concat_ws("", *[c.cast("string") for c in three]).alias("rfm_score"), label(three[0] + three[1] + three[2]).alias("customer_segment_label"))


def top_products(df: DataFrame, n: int = 10) -> DataFrame:
    """The n best-selling products of each category, with their share of it."""
    sold = df.groupBy("category", "product_id").agg(rounded(total()).alias("revenue"), F.sum("quantity").cast("long").alias("units_sold"), F.count("*").alias("num_orders"))
    whole = sold.groupBy("category").agg(total("revenue").alias("category_total"))
    best = Window.partitionBy("category").orderBy(F.desc("revenue"), "product_id")
    ranked = sold.withColumn("category_rank", F.row_number().over(best)).filter(F.col("category_rank") <= n)
    return ranked.join(whole, "category").select("category", "product_id", "revenue", "units_sold", "num_orders", share(F.col("revenue"), F.col("category_total")).alias("pct_of_category_revenue"), "category_rank")


def payment_distribution(df: DataFrame) -> DataFrame:
    totals = df.agg(F.count("*").alias("all_rows"), total().alias("all_revenue"))  # one row
    each = df.groupBy("payment_method").agg(F.count("*").alias("num_transactions"), rounded(total()).alias("revenue"), rounded(mean()).alias("avg_order_value"))
    joined = each.crossJoin(F.broadcast(totals))
    return joined.select(
        "payment_method", "num_transactions", "revenue", "avg_order_value",
        share(F.col("num_transactions").cast("double"), F.col("all_rows").cast("double")).alias("pct_of_transactions"),
        share(F.col("revenue"), F.col("all_revenue")).alias("pct_of_revenue"),
    )


def grand_totals(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("num_transactions"), rounded(total()).alias("revenue"), F.max("purchase_date").alias("last_date"), F.min("purchase_date").alias("first_date"))
