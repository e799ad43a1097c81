"""SQL that gives the rows of each retail query, for an engine other than Spark."""

from __future__ import annotations

TX = """transactions AS (
  SELECT 'TXN' || l_orderkey || '-' || l_linenumber AS transaction_id,
    CASE WHEN o_custkey % 97 = 0 THEN 'UNKNOWN_CUSTOMER' ELSE 'CUST' || o_custkey END AS customer_id,
    'PROD' || l_partkey AS product_id, p_type AS category,
    CASE WHEN o_orderkey % 211 <> 0 THEN CAST(o_orderdate AS DATE) END AS purchase_date,
    CAST(l_quantity AS INTEGER) AS quantity, p_retailprice AS unit_price, l_extendedprice AS total_amount, r_name AS region,
    o_orderpriority AS payment_method, CAST(18 + o_custkey % 63 AS INTEGER) AS customer_age, c_mktsegment AS customer_segment
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
region_dim AS (SELECT * FROM (VALUES ('AFRICA', 'Territory 1'), ('AMERICA', 'Territory 1'), ('ASIA', 'Territory 2'), ('EUROPE', 'Territory 2'), ('MIDDLE EAST', 'Territory 3')) d(region, sales_territory)),
known AS (SELECT * FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' AND purchase_date IS NOT NULL)"""

_FORMATS = ("%Y-%m-%d", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d", "%d %b %Y", "%B %d, %Y", "%Y-%m-%dT%H:%M:%S", "%m-%d-%Y %H:%M")


def r(x: str, digits: int = 2) -> str:
    return f"CAST(ROUND(CAST({x} AS DECIMAL(30,10)), {digits}) AS DOUBLE)"


def money(c: str = "total_amount") -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE)"


def avg(c: str = "total_amount") -> str:
    return r(f"{money(c)} / COUNT({c})")


MEASURES = f"{r(money())} AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold, COUNT(*) AS num_transactions, {avg()} AS avg_order_value"

_DATE = "CASE " + " ".join(f"WHEN h % 8 = {k} THEN strftime(o_orderdate, '{f}')" for k, f in enumerate(_FORMATS)) + " END"
DIRTY = f"""star AS (
  SELECT *, (31 * l_orderkey + 17 * l_partkey + 7 * l_suppkey + l_linenumber) % 1000 AS h
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
once AS (
  SELECT 'TXN' || l_orderkey || '-' || l_linenumber AS transaction_id,
    CASE WHEN h BETWEEN 100 AND 104 THEN NULL ELSE 'CUST' || o_custkey END AS customer_id,
    'PROD' || l_partkey AS product_id,
    CASE WHEN h BETWEEN 110 AND 129 THEN NULL WHEN h BETWEEN 130 AND 139 THEN upper(p_type) WHEN h BETWEEN 140 AND 149 THEN lower(p_type)
      WHEN h BETWEEN 150 AND 159 THEN '  ' || p_type || ' ' WHEN h BETWEEN 160 AND 164 THEN 'mystery_box' ELSE p_type END AS category,
    CASE WHEN h <= 9 THEN '31/02/2024' WHEN h <= 24 THEN NULL ELSE {_DATE} END AS purchase_date,
    CASE WHEN h BETWEEN 200 AND 209 THEN NULL WHEN h BETWEEN 210 AND 214 THEN -1.0 WHEN h BETWEEN 215 AND 219 THEN CAST(l_quantity AS DOUBLE) * 100 ELSE CAST(l_quantity AS DOUBLE) END AS quantity,
    CAST(p_retailprice AS DOUBLE) AS unit_price,
    CASE WHEN h BETWEEN 300 AND 319 THEN NULL WHEN h BETWEEN 320 AND 324 THEN l_extendedprice * 10 WHEN h BETWEEN 325 AND 329 THEN -l_extendedprice ELSE l_extendedprice END AS total_amount,
    CASE WHEN h BETWEEN 400 AND 409 THEN NULL WHEN h BETWEEN 410 AND 419 THEN replace(lower(r_name), ' ', '_') ELSE r_name END AS region,
    CASE WHEN h BETWEEN 430 AND 434 THEN NULL WHEN h BETWEEN 435 AND 444 THEN lower(o_orderpriority) ELSE o_orderpriority END AS payment_method,
    CASE WHEN h BETWEEN 500 AND 509 THEN NULL WHEN h BETWEEN 510 AND 514 THEN 200.0 WHEN h BETWEEN 515 AND 519 THEN -5.0 ELSE CAST(18 + o_custkey % 63 AS DOUBLE) END AS customer_age,
    CASE WHEN h BETWEEN 520 AND 524 THEN NULL ELSE c_mktsegment END AS customer_segment, h
  FROM star),
dirty AS (SELECT * EXCLUDE (h) FROM once UNION ALL SELECT * EXCLUDE (h) FROM once WHERE h < 10)"""

PARSED = f"CAST(try_strptime(NULLIF(TRIM(purchase_date), ''), [{', '.join(repr(f) for f in _FORMATS)}]) AS DATE)"
_VOCABULARY = {
    "category": ("PROMO", "ECONOMY", "STANDARD", "MEDIUM", "SMALL", "LARGE"),
    "region": ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"),
    "payment_method": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"),
    "customer_segment": ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"),
}


def canonical(c: str) -> str:
    key = f"regexp_replace(lower(trim({c})), '[\\s_]+', '', 'g')"
    cases = " ".join(f"WHEN {key} = '{w.lower().replace(' ', '')}' THEN '{w}'" for w in _VOCABULARY[c])
    other = f"array_to_string(list_transform(string_split(trim(replace({c}, '_', ' ')), ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ')"
    return f"CASE WHEN {c} IS NULL THEN NULL {cases} ELSE {other} END"


_OTHERS = "customer_id, product_id, category, purchase_date, quantity, unit_price, region, payment_method, customer_age, customer_segment"
_ALL = "transaction_id, customer_id, product_id, category, purchase_date, quantity, unit_price, total_amount, region, payment_method, customer_age, customer_segment"
_FILLED = " + ".join(f"CAST({c} IS NOT NULL AS INTEGER)" for c in _ALL.split(", "))
UNIQUE = f"""uniq AS (SELECT DISTINCT * FROM dirty),
best AS (
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_FILLED} DESC, total_amount DESC NULLS LAST, {', '.join(f'{c} ASC NULLS LAST' for c in _OTHERS.split(', '))}) AS n
    FROM uniq WHERE transaction_id IS NOT NULL) WHERE n = 1
  UNION ALL SELECT * FROM uniq WHERE transaction_id IS NULL)"""


def typed(source: str) -> str:
    return f"""SELECT transaction_id, customer_id, product_id, {canonical('category')} AS category, {PARSED} AS purchase_date,
    CAST(ROUND(CAST(quantity AS DECIMAL(30,10)), 0) AS INTEGER) AS quantity, {r('unit_price')} AS unit_price, {r('total_amount')} AS total_amount,
    {canonical('region')} AS region, {canonical('payment_method')} AS payment_method, CAST(ROUND(CAST(customer_age AS DECIMAL(30,10)), 0) AS INTEGER) AS customer_age,
    {canonical('customer_segment')} AS customer_segment FROM {source}"""


_RANGED = """SELECT * REPLACE (CASE WHEN customer_age BETWEEN 18 AND 100 THEN customer_age END AS customer_age, CASE WHEN NOT quantity <= 0 THEN quantity END AS quantity,
    CASE WHEN NOT unit_price < 0 THEN unit_price END AS unit_price, CASE WHEN NOT total_amount < 0 THEN total_amount END AS total_amount) FROM"""
_CAP = lambda c, kind: f"CASE WHEN {c} < {c}_lower THEN CAST({c}_lower AS {kind}) WHEN {c} > {c}_upper THEN CAST({c}_upper AS {kind}) ELSE {c} END"


def bounds(source: str) -> str:
    q = lambda c, p: f"CAST(quantile_disc({c}, {p}) AS DOUBLE)"
    parts = []
    for c, digits in (("total_amount", 2), ("quantity", 0)):
        lo, hi = q(c, 0.25), q(c, 0.75)
        parts += [f"{lo} AS {c}_q1", f"{hi} AS {c}_q3", f"{r(f'{lo} - ({hi} - {lo}) * 1.5', digits)} AS {c}_lower", f"{r(f'{hi} + ({hi} - {lo}) * 1.5', digits)} AS {c}_upper"]
    return f"SELECT {', '.join(parts)} FROM {source}"


def modes(source: str) -> str:
    return ", ".join(f"(SELECT {c} FROM {source} WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY COUNT(*) DESC, {c} LIMIT 1) AS {c}" for c in _VOCABULARY)


def imputed_money(source: str) -> str:
    return f"""SELECT s.* REPLACE (coalesce(s.unit_price, g.u, (SELECT quantile_disc(unit_price, 0.5) FROM {source})) AS unit_price, coalesce(s.total_amount, g.t, (SELECT quantile_disc(total_amount, 0.5) FROM {source})) AS total_amount)
  FROM {source} s LEFT JOIN (SELECT category, quantile_disc(unit_price, 0.5) AS u, quantile_disc(total_amount, 0.5) AS t FROM {source} WHERE category IS NOT NULL GROUP BY category) g ON s.category = g.category"""


def imputed(source: str) -> str:
    words = ", ".join(f"coalesce({c}, (SELECT {c} FROM common), 'Unknown') AS {c}" for c in _VOCABULARY)
    return f"""SELECT * REPLACE (coalesce(customer_id, 'UNKNOWN_CUSTOMER') AS customer_id, coalesce(quantity, (SELECT quantile_disc(quantity, 0.5) FROM {source})) AS quantity,
    coalesce(customer_age, (SELECT quantile_disc(customer_age, 0.5) FROM {source})) AS customer_age, {words}) FROM priced"""


CLEAN = f"""{DIRTY}, {UNIQUE}, typed AS ({typed('best')}), ranged AS ({_RANGED} typed), fences AS ({bounds('ranged')}),
capped AS (SELECT r.* REPLACE ({_CAP('total_amount', 'DOUBLE')} AS total_amount, {_CAP('quantity', 'INTEGER')} AS quantity) FROM ranged r CROSS JOIN fences),
common AS (SELECT {modes('capped')}), priced AS ({imputed_money('capped')}), cleansed AS ({imputed('capped')})"""
#: The steps one by one work on the typed rows before duplicates go.
STEPS = f"{DIRTY}, typed AS ({typed('dirty')}), ranged AS ({_RANGED} typed)"

RFM = f"""rfm0 AS (
  SELECT customer_id, CAST(datediff('day', MAX(purchase_date), (SELECT MAX(purchase_date) FROM known) + 1) AS INTEGER) AS recency_days, COUNT(*) AS frequency, {r(money())} AS monetary FROM known GROUP BY customer_id),
cuts AS (SELECT {', '.join(f'quantile_disc({c}, {p}) AS {c}_{k}' for c in ('recency_days', 'frequency', 'monetary') for k, p in enumerate((0.25, 0.5, 0.75)))} FROM rfm0),
rfm1 AS (
  SELECT customer_id, recency_days, frequency, monetary,
    CAST(CASE WHEN recency_days <= recency_days_0 THEN 4 WHEN recency_days <= recency_days_1 THEN 3 WHEN recency_days <= recency_days_2 THEN 2 ELSE 1 END AS INTEGER) AS recency_score,
    CAST(CASE WHEN frequency <= frequency_0 THEN 1 WHEN frequency <= frequency_1 THEN 2 WHEN frequency <= frequency_2 THEN 3 ELSE 4 END AS INTEGER) AS frequency_score,
    CAST(CASE WHEN monetary <= monetary_0 THEN 1 WHEN monetary <= monetary_1 THEN 2 WHEN monetary <= monetary_2 THEN 3 ELSE 4 END AS INTEGER) AS monetary_score
  FROM rfm0 CROSS JOIN cuts),
rfm AS (
  SELECT *, recency_score || '' || frequency_score || '' || monetary_score AS rfm_score,
    CASE WHEN recency_score + frequency_score + monetary_score >= 10 THEN 'Champions' WHEN recency_score + frequency_score + monetary_score >= 8 THEN 'Loyal Customers'
      WHEN recency_score + frequency_score + monetary_score >= 6 THEN 'Potential Loyalists' WHEN recency_score + frequency_score + monetary_score >= 4 THEN 'At Risk' ELSE 'Lost / Hibernating' END AS customer_segment_label
  FROM rfm1)"""


def mode_of(source: str, c: str) -> str:
    return f"SELECT customer_id, {c} FROM (SELECT customer_id, {c}, row_number() OVER (PARTITION BY customer_id ORDER BY COUNT(*) DESC, {c}) AS n FROM {source} WHERE {c} IS NOT NULL GROUP BY customer_id, {c}) WHERE n = 1"


def diversity(source: str) -> str:
    return f"""SELECT customer_id, COUNT(*) AS distinct_categories, {r('SUM(h)', 4)} AS category_entropy FROM (
    SELECT customer_id, -(n / SUM(n) OVER (PARTITION BY customer_id)) * ln(n / SUM(n) OVER (PARTITION BY customer_id)) AS h FROM (SELECT customer_id, category, COUNT(*) AS n FROM {source} GROUP BY ALL)) GROUP BY customer_id"""


def core(source: str) -> str:
    return f"""SELECT customer_id, COUNT(*) AS frequency, {r(money())} AS monetary, {avg()} AS avg_order_value, MIN(purchase_date) AS first_purchase_date, MAX(purchase_date) AS last_purchase_date,
    COUNT(DISTINCT payment_method) AS distinct_payment_methods, {r('CAST(SUM(customer_age) AS DOUBLE) / COUNT(customer_age)', 1)} AS customer_age,
    CAST(datediff('day', MIN(purchase_date), MAX(purchase_date)) AS INTEGER) AS tenure_days FROM {source} GROUP BY customer_id"""


SPLIT = """split AS (SELECT *, CAST((SELECT MAX(purchase_date) FROM known) - 90 AS DATE) AS cutoff, purchase_date <= (SELECT MAX(purchase_date) FROM known) - 90 AS is_feature FROM known),
before AS (SELECT * FROM split WHERE is_feature), later AS (SELECT DISTINCT customer_id FROM split WHERE NOT is_feature),
labels0 AS (SELECT customer_id, CAST(CASE WHEN customer_id IN (SELECT customer_id FROM later) THEN 0 ELSE 1 END AS INTEGER) AS churned FROM before GROUP BY customer_id)"""
CHURN = f"""{SPLIT}, core0 AS ({core('before')}), div0 AS ({diversity('before')}), reg0 AS ({mode_of('before', 'region')}), seg0 AS ({mode_of('before', 'customer_segment')}),
churn AS (
  SELECT c.customer_id, frequency, monetary, avg_order_value, distinct_payment_methods, customer_age, tenure_days,
    CAST(datediff('day', last_purchase_date, (SELECT MAX(cutoff) FROM split)) AS INTEGER) AS recency_days, distinct_categories, category_entropy, region, customer_segment, churned
  FROM core0 c LEFT JOIN div0 USING (customer_id) LEFT JOIN reg0 USING (customer_id) LEFT JOIN seg0 USING (customer_id) JOIN labels0 USING (customer_id))"""
#: A fixed rule as score, so that metrics are tested apart from any model.
SCORED = "scored AS (SELECT customer_id, churned AS label, CAST(recency_days % 100 AS DOUBLE) / 100.0 AS score, region, customer_segment FROM churn)"


def _tx(sql: str, *ctes: str) -> str:
    return f"WITH {', '.join([TX, *ctes])} {sql}"


def _revenue(expression: str) -> str:
    return _tx(f"SELECT {expression} AS period, region, {r(money())} AS revenue FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2")


_SUM = "SUM(CAST(total_amount AS DECIMAL(18,2)))"
_WORTH = f"worth AS (SELECT customer_id, {_SUM} AS v, COUNT(*) AS total_orders, MIN(purchase_date) AS first_purchase_date, MAX(purchase_date) AS last_purchase_date FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY customer_id)"
_PERIODS = "{name} AS (SELECT *, row_number() OVER (ORDER BY {by}) AS n FROM (SELECT {key}, " + money() + " AS v FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1))"
#: One row per purchase: its customer's first month, its own, and the months between.
_VISITS = """visits AS (
  SELECT customer_id, cohort_month, CAST(date_trunc('month', purchase_date) AS DATE) AS activity_month, datediff('month', cohort_month, CAST(date_trunc('month', purchase_date) AS DATE)) AS k
  FROM (SELECT *, CAST(date_trunc('month', MIN(purchase_date) OVER (PARTITION BY customer_id)) AS DATE) AS cohort_month FROM known))"""
_ACTIVITY = "SELECT cohort_month, activity_month, COUNT(DISTINCT customer_id) AS active_customers FROM visits GROUP BY ALL"


def _growth(now: str, before: str) -> str:
    return r(f"({now} - {before}) / NULLIF({before}, 0) * 100")


def _share(k: int) -> str:
    return r(f"CAST(NULLIF(COUNT(DISTINCT customer_id) FILTER (k = {k}), 0) AS DOUBLE) / COUNT(DISTINCT customer_id) * 100")


MASK = "purchase_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND region IN ('ASIA', 'EUROPE') AND category IN ('PROMO', 'SMALL', 'LARGE')"
_REGIONS = _VOCABULARY["region"]
_CELLS = "cells AS (SELECT label AS actual, CAST(score >= 0.5 AS INTEGER) AS predicted, COUNT(*) AS n FROM scored GROUP BY 1, 2), one AS (SELECT " + ", ".join(f"CAST(coalesce(SUM(n) FILTER (actual = {a} AND predicted = {p}), 0) AS DOUBLE) AS {name}" for a, p, name in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))) + " FROM cells)"


def _class(label: int, right: str, missed: str, wrong: str) -> str:
    p, q = f"coalesce({right} / NULLIF({right} + {wrong}, 0), 0)", f"coalesce({right} / NULLIF({right} + {missed}, 0), 0)"
    return f"SELECT CAST({label} AS INTEGER) AS class, {r(p, 6)} AS precision, {r(q, 6)} AS recall, {r(f'coalesce(2 * {p} * {q} / NULLIF({p} + {q}, 0), 0)', 6)} AS f1, CAST({right} + {missed} AS BIGINT) AS support, {r('(tn + tp) / (tn + tp + fn + fp)', 6)} AS accuracy FROM one"


_NULLS = lambda source, columns: " UNION ALL ".join(f"SELECT '{c}' AS column_name, COUNT(*) FILTER ({c} IS NULL) AS nulls FROM {source}" for c in columns)
_COLUMNS = tuple(_ALL.split(", "))


def _report() -> str:
    rows = [
        ("dedup", "rows_before", "COUNT(*)", "dirty"),
        ("dedup", "rows_distinct", "COUNT(*)", "uniq"),
        ("dedup", "rows_after", "COUNT(*)", "best"),
        ("dates", "nulls_after", "COUNT(*) FILTER (purchase_date IS NULL)", "typed"),
        *[("types", f"{c}_changed", f"COUNT(*) FILTER ({c} IS DISTINCT FROM {canonical(c)})", "best") for c in _VOCABULARY],
        *[("ranges", f"{c}_nulled", f"COUNT(*) FILTER ({bad})", "typed") for c, bad in (("customer_age", "NOT customer_age BETWEEN 18 AND 100"), ("quantity", "quantity <= 0"), ("unit_price", "unit_price < 0"), ("total_amount", "total_amount < 0"))],
        *[("outliers", f"{c}_capped_{end}", f"COUNT(*) FILTER ({c} {sign} {c}_{edge})", "ranged CROSS JOIN fences") for c in ("total_amount", "quantity") for end, sign, edge in (("low", "<", "lower"), ("high", ">", "upper"))],
        *[("impute", f"{c}_nulls", f"COUNT(*) FILTER ({c} IS NULL)", "capped") for c in _COLUMNS],
    ]
    return f"WITH {CLEAN} " + " UNION ALL ".join(f"SELECT '{s}' AS step, '{m}' AS metric, CAST({e} AS BIGINT) AS value FROM {t}" for s, m, e, t in rows)


ORACLE_SQL: dict[str, str] = {
    # the SQL catalog and the pairs of plans, each question asked anew
    "revenue_trend_daily": _tx(
        f"""SELECT d.purchase_date, d.v AS daily_revenue, {r('(SELECT CAST(SUM(CAST(w.v AS DECIMAL(18,2))) AS DOUBLE) / COUNT(*) FROM days w WHERE w.n BETWEEN d.n - 6 AND d.n)')} AS revenue_7day_moving_avg FROM days d""",
        f"days AS (SELECT purchase_date, {money()} AS v, row_number() OVER (ORDER BY purchase_date) AS n FROM transactions WHERE purchase_date IS NOT NULL GROUP BY purchase_date)",
    ),
    "revenue_trend_monthly_growth": _tx(f"SELECT m.month AS purchase_year_month, m.v AS monthly_revenue, p.v AS prior_month_revenue, {_growth('m.v', 'p.v')} AS mom_growth_pct FROM months m LEFT JOIN months p ON p.n = m.n - 1", _PERIODS.format(name="months", key="strftime(purchase_date, '%Y-%m') AS month", by="month")),
    "revenue_trend_category_share": _tx(f"SELECT s.month AS purchase_year_month, s.category, s.v AS category_revenue, {r('s.v / NULLIF(m.v, 0) * 100')} AS pct_of_month_revenue FROM (SELECT strftime(purchase_date, '%Y-%m') AS month, category, {money()} AS v FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2) s JOIN months m USING (month)", _PERIODS.format(name="months", key="strftime(purchase_date, '%Y-%m') AS month", by="month")),
    "customer_ltv_ranking": _tx(
        "SELECT customer_id, CAST(v AS DOUBLE) AS lifetime_value, total_orders, first_purchase_date, last_purchase_date, CAST(last_purchase_date - first_purchase_date AS INTEGER) AS customer_tenure_days, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS ltv_rank, CAST(ntile(4) OVER (ORDER BY v DESC, customer_id) AS INTEGER) AS ltv_quartile FROM worth",
        _WORTH,
    ),
    "customer_ltv_by_segment": _tx(
        f"SELECT customer_segment, COUNT(*) AS customer_count, CAST(SUM(v) AS DOUBLE) AS segment_revenue, {r('CAST(SUM(v) AS DOUBLE) / COUNT(*)')} AS avg_customer_ltv, CAST(quantile_disc(v, 0.5) AS DOUBLE) AS median_customer_ltv FROM each_one GROUP BY customer_segment",
        f"each_one AS (SELECT customer_id, customer_segment, {_SUM} AS v FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY ALL)",
    ),
    "customer_ltv_top_per_region": _tx(
        "SELECT a.region, a.customer_id, CAST(a.v AS DOUBLE) AS lifetime_value, CAST(COUNT(b.v) + 1 AS INTEGER) AS region_ltv_rank FROM local a LEFT JOIN local b ON a.region = b.region AND b.v > a.v GROUP BY a.region, a.customer_id, a.v HAVING COUNT(b.v) < 5",
        f"local AS (SELECT region, customer_id, {_SUM} AS v FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY ALL)",
    ),
    "cohort_retention_rate": _tx(
        f"SELECT cohort_month, CAST(k AS INTEGER) AS month_number, cohort_size, COUNT(DISTINCT customer_id) AS active_customers, {r('CAST(COUNT(DISTINCT customer_id) AS DOUBLE) / cohort_size * 100')} AS retention_rate_pct FROM visits JOIN (SELECT cohort_month, COUNT(DISTINCT customer_id) AS cohort_size FROM visits GROUP BY cohort_month) USING (cohort_month) GROUP BY cohort_month, k, cohort_size",
        _VISITS,
    ),
    "cohort_retention_summary": _tx(
        "SELECT cohort_month, COUNT(DISTINCT customer_id) AS cohort_size, " + ", ".join(f"{_share(k)} AS month_{k}_retention_pct" for k in (1, 3, 6)) + " FROM visits GROUP BY cohort_month",
        _VISITS,
    ),
    "regional_performance_summary": _tx(
        f"SELECT region, sales_territory, {money()} AS revenue, COUNT(*) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers, {avg()} AS avg_order_value, CAST(1 + (SELECT COUNT(*) FROM (SELECT region AS other, {_SUM} AS v FROM transactions GROUP BY region) o WHERE o.v > {_SUM} AND o.other IN (SELECT region FROM region_dim)) AS INTEGER) AS revenue_rank FROM transactions NATURAL JOIN region_dim GROUP BY region, sales_territory"
    ),
    "regional_category_breakdown": _tx(f"SELECT region, category, {money()} AS revenue, {r(f'{money()} / NULLIF(CAST(MAX(whole) AS DOUBLE), 0) * 100')} AS pct_of_region_revenue FROM transactions JOIN (SELECT region, {_SUM} AS whole FROM transactions GROUP BY region) USING (region) GROUP BY region, category"),
    "regional_yoy_comparison": _tx(
        f"SELECT y.region, y.purchase_year, y.v AS yearly_revenue, p.v AS prior_year_revenue, {_growth('y.v', 'p.v')} AS yoy_growth_pct FROM years y LEFT JOIN years p ON p.region = y.region AND p.purchase_year = (SELECT MAX(q.purchase_year) FROM years q WHERE q.region = y.region AND q.purchase_year < y.purchase_year)",
        f"years AS (SELECT region, CAST(date_part('year', purchase_date) AS INTEGER) AS purchase_year, {money()} AS v FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2)",
    ),
    **{name: _tx(f"SELECT sales_territory, region, {money()} AS revenue, COUNT(*) AS num_transactions FROM region_dim NATURAL JOIN transactions GROUP BY ALL") for name in ("join_region_sort_merge", "join_region_broadcast")},
    **{name: _tx("SELECT customer_id, CAST(v AS DOUBLE) AS lifetime_value, CAST(rank() OVER (ORDER BY v DESC) AS INTEGER) AS ltv_rank FROM worth", _WORTH) for name in ("ltv_rank_self_join", "ltv_rank_window")},
    "cohort_activity_unfiltered": _tx(_ACTIVITY, _VISITS.replace("known", "dated").replace("visits AS", "dated AS (SELECT * FROM transactions WHERE purchase_date IS NOT NULL), visits AS")),
    "cohort_activity_prefiltered": _tx(_ACTIVITY, _VISITS),
    # sources and sinks
    "scan_filter_project": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_returnflag = 'R'",
    "region_dimension": _tx("SELECT * FROM region_dim"),
    "dirty_transactions": f"WITH {DIRTY} SELECT * FROM dirty",
    "src_csv_permissive": f"WITH {DIRTY} SELECT * FROM dirty",
    "ingest_row_audit": f"WITH {DIRTY} SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS corrupt FROM dirty",
    "sink_roundtrip": _tx("SELECT * FROM region_dim"),
    "sink_partitioned_prune": _tx(f"SELECT purchase_date, category, region, {MEASURES} FROM transactions WHERE purchase_date IS NOT NULL AND region = 'ASIA' GROUP BY purchase_date, region, category"),
    # projections, filters, joins
    "filter_known_customer": _tx("SELECT * FROM known"),
    "temporal_split": _tx("SELECT transaction_id, purchase_date, cutoff, is_feature FROM split", SPLIT),
    "derive_date_parts": _tx("SELECT transaction_id, CAST(year(purchase_date) AS INTEGER) AS purchase_year, CAST(month(purchase_date) AS INTEGER) AS purchase_month, strftime(purchase_date, '%Y-%m') AS purchase_year_month FROM transactions"),
    "join_region_left_broadcast": _tx("SELECT transaction_id, region, sales_territory FROM transactions LEFT JOIN region_dim USING (region)"),
    "base_dataset": _tx("SELECT t.*, d.sales_territory, CAST(year(purchase_date) AS INTEGER) AS purchase_year, CAST(month(purchase_date) AS INTEGER) AS purchase_month, strftime(purchase_date, '%Y-%m') AS purchase_year_month FROM transactions t LEFT JOIN region_dim d USING (region)"),
    "churn_label": _tx("SELECT * FROM labels0", SPLIT),
    "churned_customers_anti": _tx("SELECT customer_id FROM labels0 WHERE churned = 1", SPLIT),
    "retained_customers_semi": _tx("SELECT customer_id FROM labels0 WHERE churned = 0", SPLIT),
    # aggregations
    "grand_totals": _tx(f"SELECT COUNT(*) AS num_transactions, {r(money())} AS revenue, MAX(purchase_date) AS last_date, MIN(purchase_date) AS first_date FROM transactions"),
    "dq_null_profile": f"WITH {DIRTY} {_NULLS('dirty', _COLUMNS)}",
    "quantile_profile": f"WITH {STEPS} SELECT " + ", ".join(f"CAST(quantile_disc({c}, {p}) AS DOUBLE) AS {c}_{n}" for c in ("total_amount", "quantity") for n, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))) + " FROM ranged",
    "mode_global": f"WITH {STEPS} SELECT {modes('ranged')}",
    "mode_per_customer": _tx(mode_of("known", "payment_method")),
    "category_diversity": _tx(diversity("known")),
    "core_behavioral_features": _tx(core("known")),
    # cleansing
    "dedup_exact": f"WITH {DIRTY} SELECT DISTINCT * FROM dirty",
    "dedup_conflicting_ids": f"WITH {DIRTY}, {UNIQUE} SELECT * FROM best",
    "clean_dates": f"WITH {DIRTY} SELECT transaction_id, product_id, {PARSED} AS purchase_date FROM dirty",
    "clean_types": f"WITH {STEPS} SELECT * FROM typed",
    "canonicalization_change_counts": f"WITH {DIRTY} SELECT " + ", ".join(f"COUNT(*) FILTER ({c} IS DISTINCT FROM {canonical(c)}) AS {c}_changed" for c in _VOCABULARY) + " FROM dirty",
    "clean_valid_ranges": f"WITH {STEPS} SELECT * FROM ranged",
    "iqr_bounds": f"WITH {STEPS} {bounds('ranged')}",
    "clean_outliers_iqr": f"WITH {STEPS}, fences AS ({bounds('ranged')}) SELECT r.* REPLACE ({_CAP('total_amount', 'DOUBLE')} AS total_amount, {_CAP('quantity', 'INTEGER')} AS quantity) FROM ranged r CROSS JOIN fences",
    "impute_group_median": f"WITH {STEPS} {imputed_money('ranged')}",
    "clean_impute": f"WITH {STEPS}, common AS (SELECT {modes('ranged')}), priced AS ({imputed_money('ranged')}) {imputed('ranged')}",
    "cleansed_transactions": f"WITH {CLEAN} SELECT * FROM cleansed",
    "dq_report": _report(),
    # scalar functions
    "fn_parse_dates": f"WITH {DIRTY} SELECT purchase_date AS raw, {PARSED} AS parsed, COUNT(*) AS n FROM dirty GROUP BY ALL",
    "fn_canonicalize_categories": f"WITH {DIRTY} SELECT category AS raw, {canonical('category')} AS canonical, COUNT(*) AS n FROM dirty GROUP BY ALL",
    "fn_month_distance": _tx("SELECT purchase_date, CAST((year(purchase_date) - 1995) * 12 + month(purchase_date) - 1 AS INTEGER) AS months FROM known GROUP BY purchase_date"),
    "fn_rfm_score_string": _tx("SELECT rfm_score, customer_segment_label, COUNT(*) AS customers FROM rfm GROUP BY ALL", RFM),
    # aggregate tables
    "daily_revenue": _tx(f"SELECT purchase_date, region, category, {MEASURES} FROM transactions WHERE purchase_date IS NOT NULL GROUP BY purchase_date, region, category"),
    "monthly_revenue": _tx(f"SELECT CAST(year(purchase_date) AS INTEGER) AS purchase_year, CAST(month(purchase_date) AS INTEGER) AS purchase_month, strftime(purchase_date, '%Y-%m') AS purchase_year_month, region, category, {MEASURES} FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2, 3, region, category"),
    "customer_rfm": _tx("SELECT * FROM rfm", RFM),
    "top_products_by_category": _tx(
        f"""SELECT category, product_id, revenue, units_sold, num_orders, {r('revenue / NULLIF(whole, 0) * 100')} AS pct_of_category_revenue, CAST(n AS INTEGER) AS category_rank
    FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY revenue DESC, product_id) AS n, CAST(SUM(CAST(revenue AS DECIMAL(18,2))) OVER (PARTITION BY category) AS DOUBLE) AS whole FROM sold) WHERE n <= 10""",
        f"sold AS (SELECT category, product_id, {r(money())} AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold, COUNT(*) AS num_orders FROM transactions GROUP BY category, product_id)",
    ),
    "payment_method_distribution": _tx(
        f"""SELECT payment_method, COUNT(*) AS num_transactions, {r(money())} AS revenue, {avg()} AS avg_order_value,
    {r('CAST(COUNT(*) AS DOUBLE) / (SELECT COUNT(*) FROM transactions) * 100')} AS pct_of_transactions, {r(f'{r(money())} / (SELECT {money()} FROM transactions) * 100')} AS pct_of_revenue FROM transactions GROUP BY payment_method"""
    ),
    # features and metrics
    "clustering_features": _tx(
        """SELECT customer_id, recency_days, r.frequency, r.monetary, rfm_score, customer_segment_label, avg_order_value, tenure_days, distinct_payment_methods, customer_age, distinct_categories, category_entropy, region, customer_segment
    FROM rfm r JOIN core1 USING (customer_id) LEFT JOIN div1 USING (customer_id) LEFT JOIN reg1 USING (customer_id) LEFT JOIN seg1 USING (customer_id)""",
        RFM, f"core1 AS ({core('known')})", f"div1 AS ({diversity('known')})", f"reg1 AS ({mode_of('known', 'region')})", f"seg1 AS ({mode_of('known', 'customer_segment')})",
    ),
    "churn_features": _tx("SELECT * FROM churn", CHURN),
    "churn_split": _tx("SELECT customer_id, churned, row_number() OVER (PARTITION BY churned ORDER BY md5('42:' || customer_id), customer_id) <= floor(COUNT(*) OVER (PARTITION BY churned) * 0.2 + 0.5) AS is_test FROM churn", CHURN),
    "confusion_matrix": _tx("SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted, CAST(coalesce(n, 0) AS BIGINT) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(a, p) LEFT JOIN cells ON actual = a AND predicted = p", CHURN, SCORED, _CELLS),
    "binary_metrics": _tx(f"{_class(0, 'tn', 'fp', 'fn')} UNION ALL {_class(1, 'tp', 'fn', 'fp')}", CHURN, SCORED, _CELLS),
    "roc_auc_rank": _tx(
        f"SELECT {r('CAST(SUM(pos * (2 * lower + neg)) AS DOUBLE) / (2.0 * SUM(pos) * SUM(neg))', 6)} AS roc_auc, CAST(SUM(pos) AS BIGINT) AS positives, CAST(SUM(neg) AS BIGINT) AS negatives FROM (SELECT *, coalesce(SUM(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lower FROM (SELECT score, COUNT(*) FILTER (label = 1) AS pos, COUNT(*) FILTER (label = 0) AS neg FROM scored GROUP BY score))",
        CHURN, SCORED,
    ),
    "cluster_profile": _tx(
        f"SELECT rfm_score[1:1] AS cluster, COUNT(*) AS customers, " + ", ".join(f"{r(f'CAST(SUM(CAST({c} AS DECIMAL(20,4))) AS DOUBLE) / COUNT({c})')} AS {c}" for c in ("recency_days", "frequency", "monetary")) + " FROM rfm GROUP BY 1",
        RFM,
    ),
    # serving
    "dash_filtered_kpis": _tx(f"SELECT {r(money())} AS revenue, COUNT(*) AS orders, {avg()} AS avg_order_value, COUNT(DISTINCT CASE WHEN customer_id <> 'UNKNOWN_CUSTOMER' THEN customer_id END) AS customers FROM transactions WHERE {MASK}"),
    "dash_revenue_daily": _revenue("purchase_date"),
    "dash_revenue_weekly": _revenue("CAST(date_trunc('week', purchase_date) AS DATE) + 6"),
    "dash_revenue_monthly": _revenue("CAST(date_trunc('month', purchase_date) AS DATE)"),
    "dash_revenue_pivot": _tx(
        "SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS period, "
        + ", ".join(f"CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) FILTER (region = '{x}') AS DOUBLE) AS {x.lower().replace(' ', '_')}" for x in _REGIONS)
        + " FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1"
    ),
    "dash_top_products": _tx(f"SELECT product_id, category, {r(money())} AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold FROM transactions GROUP BY product_id, category ORDER BY revenue DESC, product_id, category LIMIT 15"),
    "dash_top_categories": _tx(f"SELECT category, {r(money())} AS revenue, CAST(SUM(quantity) AS BIGINT) AS units_sold FROM transactions GROUP BY category ORDER BY revenue DESC, category LIMIT 5"),
    "dash_churn_histogram": _tx("SELECT CAST(least(floor(score * 30), 29) AS INTEGER) AS bin, label, COUNT(*) AS customers FROM scored GROUP BY 1, 2", CHURN, SCORED),
    "dash_at_risk": _tx("SELECT customer_id, region, customer_segment, score FROM scored WHERE score >= 0.7", CHURN, SCORED),
    "dash_churn_rates": _tx(f"SELECT {r('CAST(SUM(label) AS DOUBLE) / COUNT(*)', 6)} AS actual_rate, {r('CAST(COUNT(*) FILTER (score >= 0.5) AS DOUBLE) / COUNT(*)', 6)} AS predicted_rate FROM scored", CHURN, SCORED),
    "event_windows": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, COUNT(*) AS events, CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value FROM events GROUP BY 1, 2",
}
