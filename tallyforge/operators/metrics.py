"""Metrics of a scored table (label, score) and of clusters, as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.exact import rounded
from tallyforge.operators.ranking import range_bounds, with_below


def confusion_matrix(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The four cells (actual, predicted, n), empty ones with 0."""
    cells = scored.sparkSession.sql("SELECT * FROM VALUES (0, 0), (0, 1), (1, 0), (1, 1) AS c(actual, predicted)")
    seen = scored.groupBy(F.col("label").cast("int").alias("actual"), (F.col("score") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    return cells.join(seen, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def binary_metrics(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per class: precision, recall, f1 (0 where undefined), support, and the accuracy of all."""
    cells = confusion_matrix(scored, threshold)
    n = lambda a, p: F.coalesce(F.sum(F.when((F.col("actual") == a) & (F.col("predicted") == p), F.col("n"))), F.lit(0)).cast("double")
    one = cells.agg(n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(1, 1).alias("tp"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    out = None
    for label, right, missed, wrong in ((0, "tn", "fp", "fn"), (1, "tp", "fn", "fp")):
        precision, recall = ratio(F.col(right), F.col(right) + F.col(wrong)), ratio(F.col(right), F.col(right) + F.col(missed))
        row = one.select(
            F.lit(label).alias("class"),
            rounded(precision, 6).alias("precision"),
            rounded(recall, 6).alias("recall"),
            rounded(ratio(2 * precision * recall, precision + recall), 6).alias("f1"),
            (F.col(right) + F.col(missed)).cast("long").alias("support"),
            rounded(ratio(F.col("tn") + F.col("tp"), F.col("tn") + F.col("tp") + F.col("fn") + F.col("fp")), 6).alias("accuracy"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def roc_auc(scored: DataFrame) -> DataFrame:
    """One row: the chance that a positive scores above a negative, ties counting half; null with one class only.

    Scores are counted per distinct value first. Running totals go over these values, dealt by range, so no task
    gets all of them. Rows without a score do not count.
    """
    values = scored.filter("score is not null").groupBy("score").agg(F.sum((F.col("label") == 1).cast("long")).alias("pos"), F.sum((F.col("label") == 0).cast("long")).alias("neg"))
    ranked = with_below(values, "score", ["neg"], range_bounds(values, "score"))
    wins = F.sum(F.col("pos").cast("decimal(18,0)") * (2 * F.col("below_neg") + F.col("neg")).cast("decimal(19,0)"))
    sums = ranked.agg(wins.cast("double").alias("w"), F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return sums.select(rounded(F.try_divide(F.col("w"), 2.0 * F.col("p") * F.col("n")), 6).alias("roc_auc"), F.col("p").alias("positives"), F.col("n").alias("negatives"))


def cluster_profile(assigned: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """Size and mean of each column per cluster."""
    mean = lambda c: rounded(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count(c)).alias(c)
    return assigned.groupBy("cluster").agg(F.count("*").alias("customers"), *[mean(c) for c in columns])
