"""Every retail query by name, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.cleaning import canonical, parse_date
from tallyforge.operators import aggregates as A
from tallyforge.operators import cleansing as C
from tallyforge.operators import features as X
from tallyforge.operators import metrics as E
from tallyforge.operators import models as M
from tallyforge.operators import serving as S
from tallyforge.oracle import ORACLE_SQL
from tallyforge.plans import catalog, pairs
from tallyforge.sources import readers, sinks
from tallyforge.sources.schema import Vocabulary
from tallyforge.streaming import revenue

__all__ = ["ORACLE_SQL", "QUERIES"]

_V = Vocabulary()
_MASK = ("1996-01-01", "1997-12-31", ("ASIA", "EUROPE"), ("PROMO", "SMALL", "LARGE"))


def _scratch(spark: SparkSession) -> str:
    """A fresh folder that executors see too."""
    return f"{sinks.shared_folder(spark)}/retail/{uuid.uuid4().hex}"


def _tx(f):
    return lambda spark, d: f(readers.transactions(spark, d))


def _dirty(f):
    return lambda spark, d: f(readers.dirty_transactions(spark, d))


def _typed(df: DataFrame) -> DataFrame:
    return C.enforce_types(C.standardize_dates(df), _V)


def _ranged(f):
    return _dirty(lambda df: f(C.enforce_ranges(_typed(df))))


def _scored(df: DataFrame) -> DataFrame:
    """A fixed rule as score, so that metrics are tested apart from any model."""
    rows = X.churn_features(df)
    return rows.select("customer_id", F.col("churned").alias("label"), ((F.col("recency_days") % 100).cast("double") / 100.0).alias("score"), "region", "customer_segment")


def _csv(spark: SparkSession, d: str) -> str:
    """The dirty rows as CSV with header."""
    path = _scratch(spark)
    readers.dirty_transactions(spark, d).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def _sink_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    sinks.write_table(readers.region_dimension(spark), path)
    return readers.read_table(spark, path)


def _sink_prune(spark: SparkSession, d: str) -> DataFrame:
    path = _scratch(spark)
    sinks.write_table(A.daily_revenue(readers.transactions(spark, d)), path, partition_by=("region",))
    return readers.read_table(spark, path).filter("region = 'ASIA'").select("purchase_date", "category", "region", "revenue", "units_sold", "num_transactions", "avg_order_value")


def _audit(spark: SparkSession, d: str) -> DataFrame:
    _, counts = readers.ingest(spark, _csv(spark, d))
    return spark.range(1).select(F.lit(counts["rows"]).cast("long").alias("rows"), F.lit(counts["corrupt"]).cast("long").alias("corrupt"))


def _clustering(df: DataFrame) -> DataFrame:
    return X.clustering_features(df, A.customer_rfm(df, exact=True))


def _segments(df: DataFrame) -> DataFrame:
    rows = _clustering(df)
    return M.assign(M.fit_segments(rows), rows).select("customer_id", F.col("cluster").cast("int").alias("cluster"))


def _churn_model(df: DataFrame) -> DataFrame:
    split = M.churn_split(X.churn_features(df))
    model = M.fit_churn(split.filter("not is_test"))
    return M.churn_scores(model, split.filter("is_test")).select("customer_id", "label", "score")


QUERIES = {
    **{name: (lambda spark, d, n=name: catalog.run(spark, n, d)) for name in catalog.catalog()},
    **{name: (lambda spark, d, n=name: pairs.run(spark, n, d)) for name in pairs.SQL},
    # sources and sinks
    "scan_filter_project": lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").filter((F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_returnflag") == "R")).select("l_orderkey", "l_linenumber", "l_extendedprice"),
    "region_dimension": lambda spark, d: readers.region_dimension(spark),
    "dirty_transactions": readers.dirty_transactions,
    "src_csv_permissive": lambda spark, d: readers.read_csv(spark, _csv(spark, d)).drop("_corrupt_record"),
    "ingest_row_audit": _audit,
    "sink_roundtrip": _sink_roundtrip,
    "sink_partitioned_prune": _sink_prune,
    # projections, filters, joins
    "filter_known_customer": _tx(A.known),
    "temporal_split": _tx(lambda df: X.temporal_split(df).select("transaction_id", "purchase_date", "cutoff", "is_feature")),
    "derive_date_parts": _tx(lambda df: A.with_date_parts(df).select("transaction_id", "purchase_year", "purchase_month", "purchase_year_month")),
    "join_region_left_broadcast": lambda spark, d: A.with_territory(readers.transactions(spark, d), readers.region_dimension(spark)).select("transaction_id", "region", "sales_territory"),
    "base_dataset": lambda spark, d: A.base_dataset(readers.transactions(spark, d), readers.region_dimension(spark)),
    "churn_label": _tx(X.churn_label),
    "churned_customers_anti": _tx(X.churned_customers),
    "retained_customers_semi": _tx(X.retained_customers),
    # aggregations
    "grand_totals": _tx(A.grand_totals),
    "dq_null_profile": _dirty(C.null_profile),
    "quantile_profile": _ranged(lambda df: df.agg(*[C.quantile(c, p, True).cast("double").alias(f"{c}_{n}") for c in ("total_amount", "quantity") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))])),
    "mode_global": _ranged(C.modes),
    "mode_per_customer": _tx(lambda df: X.mode_per_customer(A.known(df), "payment_method")),
    "category_diversity": _tx(lambda df: X.category_diversity(A.known(df))),
    "core_behavioral_features": _tx(lambda df: X.core_features(A.known(df))),
    # cleansing
    "dedup_exact": _dirty(C.dedup_exact),
    "dedup_conflicting_ids": _dirty(C.deduplicate),
    "clean_dates": _dirty(lambda df: C.standardize_dates(df).select("transaction_id", "product_id", "purchase_date")),
    "clean_types": _dirty(_typed),
    "canonicalization_change_counts": _dirty(lambda df: C.change_counts(df, _V)),
    "clean_valid_ranges": _ranged(lambda df: df),
    "iqr_bounds": _ranged(lambda df: C.iqr_bounds(df, exact=True)),
    "clean_outliers_iqr": _ranged(lambda df: C.treat_outliers(df, exact=True)),
    "impute_group_median": _ranged(lambda df: C.impute_money(df, exact=True)),
    "clean_impute": _ranged(lambda df: C.impute(df, exact=True)),
    "cleansed_transactions": _dirty(lambda df: C.DataCleanser(df, _V, exact=True).run()),
    "dq_report": _dirty(lambda df: C.DataCleanser(df, _V, exact=True).report()),
    # scalar functions
    "fn_parse_dates": _dirty(lambda df: df.groupBy(F.col("purchase_date").alias("raw"), parse_date(F.col("purchase_date")).alias("parsed")).agg(F.count("*").alias("n"))),
    "fn_canonicalize_categories": _dirty(lambda df: df.groupBy(F.col("category").alias("raw"), canonical(F.col("category"), _V.category).alias("canonical")).agg(F.count("*").alias("n"))),
    "fn_month_distance": _tx(lambda df: A.known(df).select("purchase_date").distinct().select("purchase_date", ((F.year("purchase_date") - 1995) * 12 + F.month("purchase_date") - 1).alias("months"))),
    "fn_rfm_score_string": _tx(lambda df: A.customer_rfm(df, exact=True).groupBy("rfm_score", "customer_segment_label").agg(F.count("*").alias("customers"))),
    # aggregate tables
    "daily_revenue": _tx(A.daily_revenue),
    "monthly_revenue": _tx(A.monthly_revenue),
    "customer_rfm": _tx(lambda df: A.customer_rfm(df, exact=True)),
    "top_products_by_category": _tx(A.top_products),
    "payment_method_distribution": _tx(A.payment_distribution),
    # features, models, metrics
    "clustering_features": _tx(_clustering),
    "churn_features": _tx(X.churn_features),
    "churn_split": _tx(lambda df: M.churn_split(X.churn_features(df)).select("customer_id", "churned", "is_test")),
    "confusion_matrix": _tx(lambda df: E.confusion_matrix(_scored(df))),
    "binary_metrics": _tx(lambda df: E.binary_metrics(_scored(df))),
    "roc_auc_rank": _tx(lambda df: E.roc_auc(_scored(df))),
    "cluster_profile": _tx(lambda df: E.cluster_profile(A.customer_rfm(df, exact=True).withColumn("cluster", F.substring("rfm_score", 1, 1)), ("recency_days", "frequency", "monetary"))),
    "kmeans_k_sweep": _tx(lambda df: M.k_sweep(_clustering(df))),
    "segmentation_assignments": _tx(_segments),
    "churn_scores": _tx(_churn_model),
    "dash_pca": _tx(lambda df: M.principal_components(_clustering(df))),
    # serving
    "dash_filtered_kpis": _tx(lambda df: S.kpis(S.masked(df, *_MASK))),
    "dash_revenue_daily": _tx(lambda df: S.revenue_by_period(df, "D")),
    "dash_revenue_weekly": _tx(lambda df: S.revenue_by_period(df, "W")),
    "dash_revenue_monthly": _tx(lambda df: S.revenue_by_period(df, "MS")),
    "dash_revenue_pivot": _tx(lambda df: S.revenue_pivot(df, _V.region)),
    "dash_top_products": _tx(lambda df: S.top(df, ("product_id", "category"), 15)),
    "dash_top_categories": _tx(lambda df: S.top(df, ("category",), 5)),
    "dash_churn_histogram": _tx(lambda df: S.churn_histogram(_scored(df))),
    "dash_at_risk": _tx(lambda df: S.at_risk(_scored(df))),
    "dash_churn_rates": _tx(lambda df: S.churn_rates(_scored(df))),
    "event_windows": lambda spark, d: revenue.windowed(spark.read.parquet(f"{d}/events.parquet")),
}
