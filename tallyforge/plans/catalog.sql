-- Named queries over the views transactions and region_dim.
-- Money is summed as DECIMAL(18,2), so that sums do not depend on the order of rows.

-- @name: revenue_trend_daily
-- @description: Revenue per day and its mean over the last seven days that have sales.
WITH days AS (
  SELECT purchase_date, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS daily_revenue
  FROM transactions WHERE purchase_date IS NOT NULL GROUP BY purchase_date)
SELECT purchase_date, daily_revenue,
       CAST(ROUND(CAST(CAST(SUM(CAST(daily_revenue AS DECIMAL(18,2))) OVER week AS DOUBLE) / COUNT(*) OVER week AS DECIMAL(30,10)), 2) AS DOUBLE) AS revenue_7day_moving_avg
FROM days
WINDOW week AS (ORDER BY purchase_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW);

-- @name: revenue_trend_monthly_growth
-- @description: Revenue per month and its growth on the month before that has sales.
WITH months AS (
  SELECT date_format(purchase_date, 'yyyy-MM') AS purchase_year_month, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS monthly_revenue
  FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1),
lagged AS (SELECT *, LAG(monthly_revenue) OVER (ORDER BY purchase_year_month) AS prior_month_revenue FROM months)
SELECT purchase_year_month, monthly_revenue, prior_month_revenue,
       CAST(ROUND(CAST((monthly_revenue - prior_month_revenue) / NULLIF(prior_month_revenue, 0) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS mom_growth_pct
FROM lagged;

-- @name: revenue_trend_category_share
-- @description: Each category's share of its month.
WITH sold AS (
  SELECT date_format(purchase_date, 'yyyy-MM') AS purchase_year_month, category, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS category_revenue
  FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2)
SELECT purchase_year_month, category, category_revenue,
       CAST(ROUND(CAST(category_revenue / NULLIF(CAST(SUM(CAST(category_revenue AS DECIMAL(18,2))) OVER (PARTITION BY purchase_year_month) AS DOUBLE), 0) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS pct_of_month_revenue
FROM sold;

-- @name: customer_ltv_ranking
-- @description: Known customers by lifetime value, with rank and quartile.
WITH bought AS (
  SELECT customer_id, SUM(CAST(total_amount AS DECIMAL(18,2))) AS worth, COUNT(*) AS total_orders, MIN(purchase_date) AS first_purchase_date, MAX(purchase_date) AS last_purchase_date
  FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY customer_id),
-- Bins of the logarithm deal the customers, so that no window holds all; the counts of higher bins are carried in.
binned AS (SELECT *, CAST(FLOOR(LN(GREATEST(CAST(worth AS DOUBLE), 0) + 1) * 512) AS INT) AS bin FROM bought),
bins AS (SELECT bin, COUNT(*) AS n FROM binned GROUP BY bin),
higher AS (SELECT bin, SUM(n) OVER (ORDER BY bin DESC) - n AS above, SUM(n) OVER () AS whole FROM bins),
placed AS (
  SELECT b.*, above, whole, above + RANK() OVER (PARTITION BY b.bin ORDER BY worth DESC) AS ltv_rank, above + ROW_NUMBER() OVER (PARTITION BY b.bin ORDER BY worth DESC, customer_id) AS place
  FROM binned b JOIN higher h ON b.bin = h.bin)
SELECT customer_id, CAST(worth AS DOUBLE) AS lifetime_value, total_orders, first_purchase_date, last_purchase_date,
       CAST(datediff(last_purchase_date, first_purchase_date) AS INT) AS customer_tenure_days,
       CAST(ltv_rank AS INT) AS ltv_rank,
       -- Four quarters of the places; the first ones are larger by one where the customers do not divide.
       CAST(CASE WHEN place <= (whole % 4) * (whole DIV 4 + 1) THEN CEIL(place / (whole DIV 4 + 1))
                 ELSE whole % 4 + CEIL((place - (whole % 4) * (whole DIV 4 + 1)) / (whole DIV 4)) END AS INT) AS ltv_quartile
FROM placed;

-- @name: customer_ltv_by_segment
-- @description: Lifetime value by segment; a customer counts in each of their segments.
WITH bought AS (
  SELECT customer_segment, customer_id, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS worth
  FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY customer_segment, customer_id)
SELECT customer_segment, COUNT(DISTINCT customer_id) AS customer_count, CAST(SUM(worth) AS DOUBLE) AS segment_revenue,
       CAST(ROUND(CAST(CAST(SUM(worth) AS DOUBLE) / COUNT(*) AS DECIMAL(30,10)), 2) AS DOUBLE) AS avg_customer_ltv,
       CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY worth) AS DOUBLE) AS median_customer_ltv
FROM bought GROUP BY customer_segment;

-- @name: customer_ltv_top_per_region
-- @description: The customers of the five highest ranks of each region; ties share a rank.
WITH bought AS (
  SELECT region, customer_id, SUM(CAST(total_amount AS DECIMAL(18,2))) AS worth
  FROM transactions WHERE customer_id <> 'UNKNOWN_CUSTOMER' GROUP BY region, customer_id),
ranked AS (SELECT *, RANK() OVER (PARTITION BY region ORDER BY worth DESC) AS place FROM bought)
SELECT region, customer_id, CAST(worth AS DOUBLE) AS lifetime_value, CAST(place AS INT) AS region_ltv_rank
FROM ranked WHERE place <= 5;

-- @name: cohort_retention_rate
-- @description: Share of each monthly cohort that buys again, by months since.
WITH known AS (
  SELECT customer_id, CAST(trunc(purchase_date, 'MM') AS DATE) AS month FROM transactions
  WHERE customer_id <> 'UNKNOWN_CUSTOMER' AND purchase_date IS NOT NULL),
cohorts AS (SELECT customer_id, MIN(month) AS cohort_month FROM known GROUP BY customer_id),
sizes AS (SELECT cohort_month, COUNT(*) AS cohort_size FROM cohorts GROUP BY cohort_month),
active AS (
  SELECT cohort_month, CAST((YEAR(month) - YEAR(cohort_month)) * 12 + MONTH(month) - MONTH(cohort_month) AS INT) AS month_number, COUNT(DISTINCT customer_id) AS active_customers
  FROM known JOIN cohorts USING (customer_id) GROUP BY 1, 2)
SELECT cohort_month, month_number, cohort_size, active_customers,
       CAST(ROUND(CAST(CAST(active_customers AS DOUBLE) / cohort_size * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS retention_rate_pct
FROM active JOIN sizes USING (cohort_month);

-- @name: cohort_retention_summary
-- @description: Each cohort's share that buys one, three and six months on; null where nobody does.
WITH known AS (
  SELECT customer_id, CAST(trunc(purchase_date, 'MM') AS DATE) AS month FROM transactions
  WHERE customer_id <> 'UNKNOWN_CUSTOMER' AND purchase_date IS NOT NULL),
cohorts AS (SELECT customer_id, MIN(month) AS cohort_month FROM known GROUP BY customer_id),
sizes AS (SELECT cohort_month, COUNT(*) AS cohort_size FROM cohorts GROUP BY cohort_month),
active AS (
  SELECT cohort_month, (YEAR(month) - YEAR(cohort_month)) * 12 + MONTH(month) - MONTH(cohort_month) AS month_number, COUNT(DISTINCT customer_id) AS n
  FROM known JOIN cohorts USING (customer_id) GROUP BY 1, 2)
SELECT cohort_month, cohort_size,
       CAST(ROUND(CAST(CAST(SUM(CASE WHEN month_number = 1 THEN n END) AS DOUBLE) / cohort_size * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS month_1_retention_pct,
       CAST(ROUND(CAST(CAST(SUM(CASE WHEN month_number = 3 THEN n END) AS DOUBLE) / cohort_size * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS month_3_retention_pct,
       CAST(ROUND(CAST(CAST(SUM(CASE WHEN month_number = 6 THEN n END) AS DOUBLE) / cohort_size * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS month_6_retention_pct
FROM sizes LEFT JOIN active USING (cohort_month) GROUP BY cohort_month, cohort_size;

-- @name: regional_performance_summary
-- @description: Regions with a territory by revenue.
SELECT /*+ BROADCAST(d) */ region, sales_territory, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue, COUNT(*) AS total_orders, COUNT(DISTINCT customer_id) AS unique_customers,
       CAST(ROUND(CAST(CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / COUNT(total_amount) AS DECIMAL(30,10)), 2) AS DOUBLE) AS avg_order_value,
       CAST(RANK() OVER (ORDER BY SUM(CAST(total_amount AS DECIMAL(18,2))) DESC) AS INT) AS revenue_rank
FROM transactions JOIN region_dim d USING (region) GROUP BY region, sales_territory;

-- @name: regional_category_breakdown
-- @description: Each category's share of its region.
SELECT region, category, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
       CAST(ROUND(CAST(CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(CAST(SUM(SUM(CAST(total_amount AS DECIMAL(18,2)))) OVER (PARTITION BY region) AS DOUBLE), 0) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS pct_of_region_revenue
FROM transactions GROUP BY region, category;

-- @name: regional_yoy_comparison
-- @description: Revenue per region and year and its growth on the year before that has sales.
WITH years AS (
  SELECT region, CAST(YEAR(purchase_date) AS INT) AS purchase_year, CAST(SUM(CAST(total_amount AS DECIMAL(18,2))) AS DOUBLE) AS yearly_revenue
  FROM transactions WHERE purchase_date IS NOT NULL GROUP BY 1, 2),
lagged AS (SELECT *, LAG(yearly_revenue) OVER (PARTITION BY region ORDER BY purchase_year) AS prior_year_revenue FROM years)
SELECT region, purchase_year, yearly_revenue, prior_year_revenue,
       CAST(ROUND(CAST((yearly_revenue - prior_year_revenue) / NULLIF(prior_year_revenue, 0) * 100 AS DECIMAL(30,10)), 2) AS DOUBLE) AS yoy_growth_pct
FROM lagged;
