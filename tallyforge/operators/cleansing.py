"""The cleansing algebra: duplicates, dates, types, ranges, outliers, nulls.

Each step is a function from DataFrame to DataFrame, and a twin that gives its metrics as one row. Statistics are
one-row or few-row tables that are joined in; no rows come to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import canonical, parse_date
from tallyforge.functions.exact import SENTINEL, rounded
from tallyforge.sources.schema import COLUMNS, Vocabulary
from tallyforge.sources.sinks import materialized

CATEGORICAL = ("category", "region", "payment_method", "customer_segment")
MONEY = ("unit_price", "total_amount")
UNKNOWN = "Unknown"


def dedup_exact(df: DataFrame) -> DataFrame:
    return df.distinct()


def dedup_conflicting_ids(df: DataFrame) -> DataFrame:
    """One row per transaction_id: most values, then greatest amount, then the other columns in order; rows without an id stay."""
    filled = sum((F.col(c).isNotNull().cast("int") for c in df.columns), F.lit(0))
    order = [filled.desc(), F.col("total_amount").desc_nulls_last(), *[F.col(c).asc_nulls_last() for c in df.columns if c not in ("transaction_id", "total_amount")]]
    best = Window.partitionBy("transaction_id").orderBy(*order)
    kept = df.filter("transaction_id is not null").withColumn("_n", F.row_number().over(best)).filter("_n = 1").drop("_n")
    return kept.unionByName(df.filter("transaction_id is null"))


def deduplicate(df: DataFrame) -> DataFrame:
    return dedup_conflicting_ids(dedup_exact(df))


def standardize_dates(df: DataFrame, column: str = "purchase_date") -> DataFrame:
    return df.withColumn(column, parse_date(F.col(column)))


def enforce_types(df: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    out = {c: canonical(F.col(c), getattr(vocabulary, c)) for c in CATEGORICAL}
    out |= {c: F.round(F.col(c).cast("decimal(30,10)"), 0).cast("int") for c in ("quantity", "customer_age")}
    out |= {c: rounded(F.col(c)) for c in MONEY}
    return df.withColumns(out)


def change_counts(df: DataFrame, vocabulary: Vocabulary = Vocabulary()) -> DataFrame:
    """How many values of each categorical column canonicalization changes, nulls compared as values."""
    changed = [F.count_if(~F.col(c).eqNullSafe(canonical(F.col(c), getattr(vocabulary, c)))).alias(f"{c}_changed") for c in CATEGORICAL]
    return df.agg(*changed)


def _out_of_range(low: int, high: int) -> dict[str, Column]:
    return {"customer_age": ~F.col("customer_age").between(low, high), "quantity": F.col("quantity") <= 0, "unit_price": F.col("unit_price") < 0, "total_amount": F.col("total_amount") < 0}


def enforce_ranges(df: DataFrame, low: int = 18, high: int = 100) -> DataFrame:
    """Impossible values become null."""
    return df.withColumns({c: F.when(~bad, F.col(c)) for c, bad in _out_of_range(low, high).items()})


def range_counts(df: DataFrame, low: int = 18, high: int = 100) -> DataFrame:
    return df.agg(*[F.count_if(bad).alias(f"{c}_nulled") for c, bad in _out_of_range(low, high).items()])


def quantile(column: str, p: float, exact: bool) -> Column:
    """Discrete quantile; the approximate one keeps a sketch of bounded size and is the choice at scale."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})") if exact else F.percentile_approx(column, p, 10_000)


def iqr_bounds(df: DataFrame, columns: tuple[str, ...] = ("total_amount", "quantity"), factor: float = 1.5, exact: bool = False) -> DataFrame:
    """One row: q1, q3, lower and upper fence of each column; fences of integer columns are whole."""
    stats = df.agg(*[quantile(c, p, exact).cast("double").alias(f"{c}_{n}") for c in columns for n, p in (("q1", 0.25), ("q3", 0.75))])
    whole = {f.name for f in df.schema if f.dataType.typeName() in ("integer", "long", "short", "byte")}
    spread = lambda c: (F.col(f"{c}_q3") - F.col(f"{c}_q1")) * factor
    fences = {}
    for c in columns:
        digits = 0 if c in whole else 2
        fences[f"{c}_lower"] = rounded(F.col(f"{c}_q1") - spread(c), digits)
        fences[f"{c}_upper"] = rounded(F.col(f"{c}_q3") + spread(c), digits)
    return stats.withColumns(fences)


def treat_outliers(df: DataFrame, columns: tuple[str, ...] = ("total_amount", "quantity"), factor: float = 1.5, exact: bool = False) -> DataFrame:
    """Values beyond the fences move to the fence; nulls, and columns without any value, stay."""
    joined = df.crossJoin(F.broadcast(iqr_bounds(df, columns, factor, exact)))  # one row
    kinds = {f.name: f.dataType for f in df.schema}
    capped = {
        c: F.when(F.col(c) < F.col(f"{c}_lower"), F.col(f"{c}_lower").cast(kinds[c])).when(F.col(c) > F.col(f"{c}_upper"), F.col(f"{c}_upper").cast(kinds[c])).otherwise(F.col(c))
        for c in columns
    }
    return joined.withColumns(capped).select(*df.columns)


def outlier_counts(df: DataFrame, columns: tuple[str, ...] = ("total_amount", "quantity"), factor: float = 1.5, exact: bool = False) -> DataFrame:
    bounds = iqr_bounds(df, columns, factor, exact)
    joined = df.select(*columns).crossJoin(F.broadcast(bounds))
    return joined.agg(*[F.count_if(F.col(c) < F.col(f"{c}_lower")).alias(f"{c}_capped_low") for c in columns], *[F.count_if(F.col(c) > F.col(f"{c}_upper")).alias(f"{c}_capped_high") for c in columns])


def modes(df: DataFrame, columns: tuple[str, ...] = CATEGORICAL) -> DataFrame:
    """One row: the most frequent value of each column, the least of equals; null where there is none."""
    counted = df.select(*columns).unpivot([], list(columns), "name", "value").filter("value is not null").groupBy("name", "value").agg(F.count("*").alias("n"))
    best = counted.groupBy("name").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))  # a row for each column
    return best.agg(*[F.max(F.when(F.col("name") == c, F.col("value"))).alias(c) for c in columns])


def group_medians(df: DataFrame, exact: bool = False) -> DataFrame:
    return df.filter("category is not null").groupBy("category").agg(*[quantile(c, 0.5, exact).alias(f"{c}_median") for c in MONEY])


#: Categories up to which their medians are broadcast.
FEW_CATEGORIES = 10_000


def _medians(df: DataFrame, columns: tuple[str, ...], exact: bool) -> DataFrame:
    return df.agg(*[quantile(c, 0.5, exact).cast(df.schema[c].dataType).alias(f"{c}_overall") for c in columns])


def impute_money(df: DataFrame, exact: bool = False) -> DataFrame:
    """Missing prices and amounts from the category's median, else from the global one."""
    medians = materialized(group_medians(df, exact).withColumnRenamed("category", "_category"))
    if medians.count() <= FEW_CATEGORIES:
        medians = F.broadcast(medians)
    joined = df.join(medians, F.col("category") == F.col("_category"), "left").crossJoin(F.broadcast(_medians(df, MONEY, exact)))
    return joined.withColumns({c: F.coalesce(c, f"{c}_median", f"{c}_overall") for c in MONEY}).select(*df.columns)


def impute(df: DataFrame, exact: bool = False) -> DataFrame:
    """Numbers from medians, categories from modes, unknown customers from the sentinel; dates and ids stay null."""
    counts = _medians(df, ("quantity", "customer_age"), exact)
    common = modes(df).select(*[F.col(c).alias(f"{c}_mode") for c in CATEGORICAL])
    filled = impute_money(df, exact).crossJoin(F.broadcast(counts)).crossJoin(F.broadcast(common))  # one row each
    filled = filled.withColumns({c: F.coalesce(c, f"{c}_overall") for c in ("quantity", "customer_age")} | {c: F.coalesce(c, f"{c}_mode", F.lit(UNKNOWN)) for c in CATEGORICAL})
    return filled.withColumn("customer_id", F.coalesce("customer_id", F.lit(SENTINEL))).select(*df.columns)


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: how many nulls."""
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return one.unpivot([], df.columns, "column_name", "nulls")


class DataCleanser:
    """The steps in their order; ``report`` gives the metrics of all as rows (step, metric, value).

    The typed rows without duplicates, and the capped ones, are written once, for the statistics of later steps read
    them several times.
    """

    def __init__(self, df: DataFrame, vocabulary: Vocabulary = Vocabulary(), exact: bool = False, ages: tuple[int, int] = (18, 100), factor: float = 1.5):
        self.raw, self.vocabulary, self.exact, self.ages, self.factor = df.select(*COLUMNS), vocabulary, exact, ages, factor
        self.dated = standardize_dates(deduplicate(self.raw))
        spelt = [F.col(c).alias(f"_{c}") for c in CATEGORICAL]  # as they were, for the report
        self.both = materialized(enforce_types(self.dated.select("*", *spelt), vocabulary))
        self.typed = self.both.select(*COLUMNS)
        self.ranged = enforce_ranges(self.typed, *ages)
        self.capped = materialized(treat_outliers(self.ranged, factor=factor, exact=exact))

    def run(self) -> DataFrame:
        return impute(self.capped, self.exact).select(*COLUMNS)

    def report(self) -> DataFrame:
        def rows(step: str, one: DataFrame) -> DataFrame:
            return one.select(*[F.col(c).cast("long") for c in one.columns]).unpivot([], one.columns, "metric", "value").select(F.lit(step).alias("step"), "metric", "value")

        count = lambda df, name: df.agg(F.count("*").alias(name))
        parts = [
            rows("dedup", count(self.raw, "rows_before")),
            rows("dedup", count(dedup_exact(self.raw), "rows_distinct")),
            rows("dedup", count(self.typed, "rows_after")),
            rows("dates", self.typed.agg(F.count_if(F.col("purchase_date").isNull()).alias("nulls_after"))),
            rows("types", change_counts(self.both.select(*[F.col(f"_{c}").alias(c) for c in CATEGORICAL]), self.vocabulary)),
            rows("ranges", range_counts(self.typed, *self.ages)),
            rows("outliers", outlier_counts(self.ranged, factor=self.factor, exact=self.exact)),
            rows("impute", self.capped.agg(*[F.count_if(F.col(c).isNull()).alias(f"{c}_nulls") for c in COLUMNS])),
        ]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out
