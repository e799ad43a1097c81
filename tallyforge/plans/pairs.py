"""Two plans for one question, and a report of what they cost."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from tallyforge.plans import catalog

_REGION = """
SELECT {hint} d.sales_territory, t.region, CAST(SUM(CAST(t.total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS num_transactions
FROM transactions t JOIN region_dim d ON t.region = d.region GROUP BY d.sales_territory, t.region"""

_WORTH = "worth AS (SELECT customer_id, SUM(CAST(total_amount AS DECIMAL(18,2))) AS v FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY customer_id)"

#: Who is worth more: counted by bins of the logarithm, and within a bin customer by customer.
_SELF_JOIN = f"""
WITH {_WORTH},
binned AS (SELECT customer_id, v, CAST(FLOOR(LN(GREATEST(CAST(v AS DOUBLE), 0) + 1) * 512) AS INT) AS bin FROM worth),
bins AS (SELECT bin, COUNT(*) AS n FROM binned GROUP BY bin),
higher AS (SELECT a.bin, COALESCE(SUM(b.n), 0) AS above FROM bins a LEFT JOIN bins b ON b.bin > a.bin GROUP BY a.bin)
SELECT a.customer_id, CAST(a.v AS DOUBLE) AS lifetime_value, CAST(MAX(h.above) + COUNT(b.customer_id) + 1 AS INT) AS ltv_rank
FROM binned a JOIN higher h ON a.bin = h.bin LEFT JOIN binned b ON b.bin = a.bin AND b.v > a.v GROUP BY a.customer_id, a.v"""

_COHORT = """
WITH dated AS (SELECT customer_id, CAST(trunc(purchase_date, 'MM') AS DATE) AS month FROM transactions WHERE purchase_date IS NOT NULL {more}),
first AS (SELECT customer_id, MIN(month) AS cohort_month FROM dated GROUP BY customer_id)
SELECT cohort_month, month AS activity_month, COUNT(DISTINCT customer_id) AS active_customers
FROM dated JOIN first USING (customer_id) GROUP BY cohort_month, month"""

SQL = {
    "join_region_sort_merge": _REGION.format(hint="/*+ MERGE(t, d) */"),
    "join_region_broadcast": _REGION.format(hint="/*+ BROADCAST(d) */"),
    "ltv_rank_self_join": _SELF_JOIN,
    "ltv_rank_window": f"WITH {_WORTH} SELECT customer_id, CAST(v AS DOUBLE) AS lifetime_value, CAST(RANK() OVER (ORDER BY v DESC) AS INT) AS ltv_rank FROM worth",
    "cohort_activity_unfiltered": _COHORT.format(more=""),
    "cohort_activity_prefiltered": _COHORT.format(more="AND customer_id <> 'UNKNOWN_CUSTOMER'"),
}
PAIRS = (("join_region_sort_merge", "join_region_broadcast"), ("ltv_rank_self_join", "ltv_rank_window"), ("cohort_activity_unfiltered", "cohort_activity_prefiltered"))


def run(spark: SparkSession, name: str, sf_dir: str) -> DataFrame:
    return catalog.query(spark, SQL[name], sf_dir)


def explained(df: DataFrame) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain(mode="formatted")
    return out.getvalue()


def compare(spark: SparkSession, sf_dir: str, repeats: int = 3) -> str:
    """Plans and median times of each pair as Markdown; the first run of each plan warms up and does not count."""
    parts = []
    for pair in PAIRS:
        for name in pair:
            df = run(spark, name, sf_dir)
            times = sorted([catalog.timed(df) for _ in range(repeats + 1)][1:])
            parts.append(f"## {name}\n\n{df.count()} rows, median {times[len(times) // 2]:.2f} s\n\n```\n{explained(df)}```\n")
    return "\n".join(parts)
