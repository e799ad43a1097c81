import math

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import aggregates as A
from tallyforge.operators import features as X
from tallyforge.operators import metrics as E
from tallyforge.operators import models as M
from tallyforge.operators import serving as S
from tallyforge.sources import readers
from tests.factories import clean, day


def test_daily_revenue(spark):
    df = clean(spark, {"total_amount": 100.0}, {"total_amount": 50.0, "quantity": 1}, {"region": "AFRICA", "total_amount": 20.0}, {"purchase_date": None, "total_amount": 999.0})
    found = {r.region: r for r in A.daily_revenue(df).collect()}
    assert len(found) == 2 and (found["ASIA"].revenue, found["ASIA"].units_sold, found["ASIA"].avg_order_value) == (150.0, 3, 75.0)


def rfm_rows(spark):
    return clean(
        spark,
        {"customer_id": "C1", "total_amount": 100.0, "purchase_date": day("2024-01-01")},
        {"customer_id": "C1", "total_amount": 50.0, "purchase_date": day("2024-01-10")},
        {"customer_id": "C2", "total_amount": 200.0, "purchase_date": day("2024-01-05")},
        {"customer_id": "UNKNOWN_CUSTOMER"},
        {"customer_id": "C9", "purchase_date": None},
    )


def test_rfm(spark):
    found = {r.customer_id: (r.recency_days, r.frequency, r.monetary) for r in A.rfm_values(rfm_rows(spark)).collect()}
    assert found == {"C1": (1, 2, 150.0), "C2": (6, 1, 200.0)}
    assert A.customer_rfm(rfm_rows(spark).limit(0)).count() == 0


@pytest.mark.parametrize("points,label", [(12, "Champions"), (10, "Champions"), (9, "Loyal Customers"), (7, "Potential Loyalists"), (5, "At Risk"), (3, "Lost / Hibernating")])
def test_labels(spark, points, label):
    from pyspark.sql import functions as F

    assert spark.range(1).select(A.label(F.lit(points))).first()[0] == label


def test_top_products(spark):
    df = clean(spark, *[{"category": c, "product_id": p, "total_amount": a} for c, p, a in (("S", "P1", 300.0), ("S", "P2", 100.0), ("S", "P3", 200.0), ("B", "P4", 50.0))])
    found = {r.product_id: r for r in A.top_products(df, 2).collect()}
    assert set(found) == {"P1", "P3", "P4"} and found["P1"].pct_of_category_revenue == 50.0


def test_unknown_region_stays_without_territory(spark):
    out = A.with_territory(clean(spark, {"region": "Offshore"}), readers.region_dimension(spark)).first()
    assert (out.region, out.sales_territory) == ("Offshore", None)


def test_entropy(spark):
    df = clean(spark, {"customer_id": "A"}, {"customer_id": "B"}, {"customer_id": "B", "category": "SMALL"})
    found = {r.customer_id: (r.distinct_categories, r.category_entropy) for r in X.category_diversity(df).collect()}
    assert found == {"A": (1, 0.0), "B": (2, round(math.log(2), 4))}


def churn_rows(spark):
    return clean(spark, *[{"customer_id": c, "purchase_date": day(d)} for c, d in (("C1", "2024-01-01"), ("C2", "2024-01-01"), ("C2", "2024-03-25"), ("C3", "2024-03-25"), ("C4", "2024-02-24"))])


def test_churn(spark):
    found = {r.customer_id: r.churned for r in X.churn_features(churn_rows(spark), 30).collect()}
    assert found == {"C1": 1, "C2": 0, "C4": 1}  # C4 bought on the cutoff itself
    assert {r[0] for r in X.churned_customers(churn_rows(spark), 30).collect()} == {"C1", "C4"}
    assert {r[0] for r in X.retained_customers(churn_rows(spark), 30).collect()} == {"C2"}


def test_metrics(spark):
    scored = spark.createDataFrame([(1, 0.9), (1, 0.4), (0, 0.6), (0, 0.1)], "label int, score double")
    assert E.roc_auc(scored).first().roc_auc == 0.75
    one = {r["class"]: r for r in E.binary_metrics(scored).collect()}[1]
    assert (one.precision, one.recall, one.accuracy, one.support) == (0.5, 0.5, 0.5, 2)
    assert E.roc_auc(scored.filter("label = 1")).first().roc_auc is None
    ties = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, score double")
    assert E.roc_auc(ties).first().roc_auc == 0.5


def test_models(spark, tmp_path):
    rows = X.clustering_features(df := readers.transactions(spark, "/root/testdata/sf0.001"), A.customer_rfm(df)).cache()
    model = M.fit_segments(rows, 3, starts=1)
    M.save(model, str(tmp_path / "m"))
    assert {r.cluster for r in M.assign(M.load(spark, str(tmp_path / "m")), rows).select("cluster").collect()} == {0, 1, 2}
    with pytest.raises(FileNotFoundError):
        M.load(spark, str(tmp_path / "none"))
    split = M.churn_split(X.churn_features(df)).cache()
    assert abs(split.filter("is_test").count() / split.count() - 0.2) < 0.02
    scores = M.churn_scores(M.fit_churn(split.filter("not is_test"), trees=5, depth=3), split.filter("is_test"))
    assert scores.filter("score < 0 or score > 1").count() == 0


def test_weeks_end_on_sunday(spark):
    df = clean(spark, {"purchase_date": day("2024-01-15")}, {"purchase_date": day("2024-01-21")}, {"purchase_date": day("2024-01-22")})
    assert sorted(str(r.period) for r in S.revenue_by_period(df, "W").collect()) == ["2024-01-21", "2024-01-28"]


def test_mask_drops_undated(spark):
    df = clean(spark, {}, {"purchase_date": None}, {"region": "AFRICA"})
    assert S.masked(df, "2024-01-15", "2024-01-15", ("ASIA",), ("PROMO",)).count() == 1


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_auc_of_many_distinct_scores(spark, coalesce):
    """1.5 million distinct scores, against ranks worked out by numpy."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, coalesce)
    try:
        rows = spark.range(1_500_000).select(F.rand(3).alias("score"), F.rand(4).alias("u")).select("score", (F.col("u") < F.col("score") * F.col("score")).cast("int").alias("label"))
        frame = rows.toPandas()
        found = E.roc_auc(rows).first()
    finally:
        spark.conf.set(name, before)
    ranks = frame.score.rank()
    p, n = int((frame.label == 1).sum()), int((frame.label == 0).sum())
    want = (ranks[frame.label == 1].sum() - p * (p + 1) / 2) / (p * n)
    assert abs(found.roc_auc - want) <= 1e-6 and (found.positives, found.negatives) == (p, n)
