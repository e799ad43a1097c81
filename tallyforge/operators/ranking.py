"""Running totals and ranks over all rows without a window that has them all in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, column: str, parts: int | None = None) -> list:
    """Values that cut the rows of ``df`` into about equal ranges of ``column``: one small aggregate, run once."""
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shares = [k / parts for k in range(1, parts)] or [0.5]
    found = df.agg(F.percentile_approx(column, shares, 20 * len(shares)).alias("b")).first()["b"]
    return sorted(set(found or []))


def with_below(df: DataFrame, column: str, weights: list[str], bounds: list) -> DataFrame:
    """``df`` with below_<weight>: the total of each weight over all rows whose ``column`` is smaller.

    ``column`` is a number that no two rows share. The rows are dealt by ``bounds``, which are constants of the plan,
    so every branch deals them alike; each range's totals are carried to the ranges above it.
    """
    kind = df.schema[column].dataType

    def place(low: int, high: int):  # by halves, between the ranges low and high
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col(column) <= F.lit(bounds[mid]).cast(kind), place(low, mid)).otherwise(place(mid + 1, high))

    dealt = df.withColumn("_range", place(0, len(bounds)))
    each = dealt.groupBy("_range").agg(*[F.sum(w).alias(f"_sum_{w}") for w in weights])  # a row for each range
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select("_range", *[F.coalesce(F.sum(f"_sum_{w}").over(before), F.lit(0)).alias(f"_carried_{w}") for w in weights])
    inside = Window.partitionBy("_range").orderBy(column).rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumns({f"_inside_{w}": F.coalesce(F.sum(w).over(inside), F.lit(0)) for w in weights}).join(F.broadcast(carried), "_range")
    return out.select(*df.columns, *[(F.col(f"_inside_{w}") + F.col(f"_carried_{w}")).alias(f"below_{w}") for w in weights])
