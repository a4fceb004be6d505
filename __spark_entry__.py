"""

``entry(spark)`` runs the flagship query (the single customer view with RFM
segments, CLV and churn) on /root/testdata/sf0.001. ``queries()`` maps every
implemented operator to a callable ``(spark, sf_dir) -> DataFrame`` built from
the library in ``tillscope``; ``oracle_sql()`` gives, for the same keys, an
independent DuckDB statement over the raw driver tables.

The retail entities are derived from the TPC-H-like tables by
``tillscope.sources.testdata``; the SQL below re-derives them with the same
definitions (CTEs ``sales``, ``customers``, ``products``, ``inventory``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.operators import baskets as B
from tillscope.operators import churn_model as CM
from tillscope.operators import customers as C
from tillscope.operators import inventory as I
from tillscope.operators import quality as Q
from tillscope.operators import recommend as RC
from tillscope.operators import sales as S
from tillscope.operators import series as SE
from tillscope.operators import skew as SK
from tillscope.operators import temporal as TP
from tillscope.plans import bi as BI
from tillscope.plans import incremental as IN
from tillscope.plans import medallion as M
from tillscope.plans import sketches as SH
from tillscope.session import fresh_path, materialize
from tillscope.sources import loaders as L
from tillscope.sources import sinks as K
from tillscope.sources import testdata as T
from tillscope.streaming import jobs as ST

SMOKE_DIR = "/root/testdata/sf0.001"
REF = T.REFERENCE_DATE

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _register(key: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[key] = fn
        if sql is not None:
            _SQL[key] = sql
        return fn
    return deco


# ----------------------------------------------------------------------------
# DuckDB re-derivation of the retail entities (mirror of tillscope.sources.testdata)

_SALES_BODY = """
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR){extra_id} AS transaction_id,
         CAST(o.o_orderdate AS TIMESTAMP) AS transaction_date,
         o.o_custkey AS customer_id,
         l.l_partkey AS product_id,
         CAST(l.l_quantity AS INTEGER) AS quantity,
         l.l_extendedprice / l.l_quantity AS unit_price,
         l.l_discount AS discount_percentage,
         CAST(l.l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS total_amount,
         o.o_orderstatus AS payment_method,
         o.o_orderpriority AS sales_channel,
         r.r_name AS region,
         CAST(l.l_suppkey AS VARCHAR) AS store_id
  FROM lineitem l
  JOIN orders o ON l.l_orderkey = o.o_orderkey
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey"""

SALES_CTE = "sales AS (" + _SALES_BODY.format(
    extra_id=" || '-' || CAST(l.l_partkey AS VARCHAR) || '-' || CAST(l.l_suppkey AS VARCHAR)") + ")"
DIRTY_CTE = "dirty_sales AS (" + _SALES_BODY.format(extra_id="") + ")"

CUSTOMERS_CTE = """customers AS (
  SELECT c.c_custkey AS customer_id, 'Customer' AS first_name,
         split_part(c.c_name, '#', 2) AS last_name,
         'customer' || CAST(c.c_custkey AS VARCHAR) || '@example.com' AS email,
         n.n_name AS country, r.r_name AS region, c.c_mktsegment AS market_segment,
         CASE WHEN c.c_acctbal >= 0 THEN 'Y' ELSE 'N' END AS is_active
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

PRODUCTS_CTE = """products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         p_type || '_' || CAST(p_size AS VARCHAR) AS subcategory, p_brand AS brand,
         1.2 * p_retailprice AS unit_cost, p_retailprice AS unit_price
  FROM part)"""

INVENTORY_CTE = """inventory AS (
  SELECT p_partkey AS product_id, 'W1' AS warehouse_id, CAST(p_size * 10 AS INTEGER) AS quantity_on_hand,
         CAST(p_size AS INTEGER) AS quantity_reserved, CAST(p_size * 10 - p_size AS INTEGER) AS quantity_available,
         CASE WHEN p_size % 2 = 0 THEN NULL ELSE 100 END AS reorder_point, DATE '2001-07-01' AS snapshot_date
  FROM part
  UNION ALL
  SELECT p_partkey, 'W1', CAST(p_size * 20 AS INTEGER), CAST(p_size AS INTEGER), CAST(p_size * 20 - p_size AS INTEGER),
         CASE WHEN p_size % 2 = 0 THEN NULL ELSE 100 END, DATE '2001-08-01'
  FROM part)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _mb(a: str, b: str) -> str:
    """DuckDB equivalent of Spark months_between(a, b) for midnight timestamps."""
    return (f"ROUND((year({a}) - year({b})) * 12 + (month({a}) - month({b})) + "
            f"CASE WHEN day({a}) = day({b}) OR (day({a}) = day(last_day({a})) AND day({b}) = day(last_day({b}))) "
            f"THEN 0 ELSE (day({a}) - day({b})) / 31.0 END, 8)")


_FACT = """fact AS (
  SELECT customer_id, MIN(transaction_date) AS first_purchase_date, MAX(transaction_date) AS last_purchase_date,
         COUNT(transaction_id) AS transaction_count, SUM(total_amount) AS revenue, COUNT(total_amount) AS amount_count
  FROM sales GROUP BY customer_id)"""

_RFM = f"""rfm AS (
  SELECT customer_id, CAST(datediff('day', last_purchase_date, DATE '{REF}') AS INTEGER) AS recency_days,
         transaction_count AS frequency, CAST(revenue AS DOUBLE) AS monetary_value
  FROM fact)"""

_THR = """thr AS (
  SELECT quantile_disc(recency_days, [0.2, 0.4, 0.6, 0.8]) AS tr,
         quantile_disc(frequency, [0.2, 0.4, 0.6, 0.8]) AS tf,
         quantile_disc(monetary_value, [0.2, 0.4, 0.6, 0.8]) AS tm FROM rfm)"""

_SCORED = """scored AS (
  SELECT rfm.*,
    CASE WHEN recency_days <= tr[1] THEN 5 WHEN recency_days <= tr[2] THEN 4 WHEN recency_days <= tr[3] THEN 3
         WHEN recency_days <= tr[4] THEN 2 ELSE 1 END AS recency_score,
    CASE WHEN frequency >= tf[4] THEN 5 WHEN frequency >= tf[3] THEN 4 WHEN frequency >= tf[2] THEN 3
         WHEN frequency >= tf[1] THEN 2 ELSE 1 END AS frequency_score,
    CASE WHEN monetary_value >= tm[4] THEN 5 WHEN monetary_value >= tm[3] THEN 4 WHEN monetary_value >= tm[2] THEN 3
         WHEN monetary_value >= tm[1] THEN 2 ELSE 1 END AS monetary_score
  FROM rfm CROSS JOIN thr)"""

_SCORED2 = """scored2 AS (
  SELECT *, CAST(recency_score AS VARCHAR) || CAST(frequency_score AS VARCHAR) || CAST(monetary_score AS VARCHAR)
            AS rfm_score FROM scored)"""

_SEGMENT = """CASE
    WHEN recency_score >= 4 AND frequency_score >= 4 AND monetary_score >= 4 THEN 'Champions'
    WHEN recency_score >= 3 AND frequency_score >= 3 AND monetary_score >= 3 THEN 'Loyal Customers'
    WHEN recency_score >= 4 AND frequency_score <= 2 THEN 'New Customers'
    WHEN recency_score <= 2 AND frequency_score >= 4 THEN 'At Risk'
    WHEN recency_score <= 2 AND frequency_score <= 2 AND monetary_score >= 4 THEN 'Hibernating High Value'
    WHEN recency_score <= 2 THEN 'Lost Customers'
    ELSE 'Potential Loyalists' END"""

_CLV = f"""clv0 AS (
  SELECT customer_id, CAST(revenue AS DOUBLE) AS total_revenue, transaction_count AS total_transactions,
         CAST(revenue AS DOUBLE) / NULLIF(amount_count, 0) AS avg_transaction_value,
         first_purchase_date, last_purchase_date,
         {_mb('last_purchase_date', 'first_purchase_date')} AS customer_age_months
  FROM fact),
clv1 AS (
  SELECT *, CASE WHEN customer_age_months > 0 THEN CAST(total_transactions AS DOUBLE) / NULLIF(customer_age_months, 0)
                 ELSE CAST(total_transactions AS DOUBLE) END AS purchase_frequency_monthly FROM clv0),
clv AS (
  SELECT customer_id, total_revenue, total_transactions, avg_transaction_value, first_purchase_date,
         last_purchase_date, customer_age_months, purchase_frequency_monthly,
         avg_transaction_value * purchase_frequency_monthly * 12.0 AS projected_clv,
         total_revenue AS historical_clv FROM clv1)"""

_CHURN = f"""churn AS (
  SELECT customer_id, last_purchase_date,
         CAST(datediff('day', last_purchase_date, DATE '{REF}') AS INTEGER) AS days_since_last_purchase,
         CASE WHEN datediff('day', last_purchase_date, DATE '{REF}') >= 180 THEN 'High'
              WHEN datediff('day', last_purchase_date, DATE '{REF}') >= 126.0 THEN 'Medium' ELSE 'Low' END AS churn_risk
  FROM fact)"""

_CUSTOMER_VIEW = f"""{_with(SALES_CTE, CUSTOMERS_CTE, _FACT, _RFM, _THR, _SCORED, _SCORED2, _CLV, _CHURN)}"""

C360_SQL = _CUSTOMER_VIEW + f"""SELECT c.*, s.recency_days, s.frequency, s.monetary_value, s.rfm_score,
       {_SEGMENT} AS customer_segment,
       v.projected_clv, v.historical_clv, h.churn_risk, h.days_since_last_purchase
FROM customers c LEFT JOIN scored2 s ON c.customer_id = s.customer_id
LEFT JOIN clv v ON c.customer_id = v.customer_id
LEFT JOIN churn h ON c.customer_id = h.customer_id"""


def _sales(spark, d, dirty=False):
    return T.sales(spark, d, dirty)


# ----------------------------------------------------------------------------
# customer analytics

@_register("rfm_metrics", _with(SALES_CTE, _FACT, _RFM) + "SELECT * FROM rfm")
def _rfm_metrics(spark, d):
    return C.rfm_metrics(_sales(spark, d), REF)


@_register("rfm_scores", _with(SALES_CTE, _FACT, _RFM, _THR, _SCORED, _SCORED2) + "SELECT * FROM scored2")
def _rfm_scores(spark, d):
    return C.rfm_scores(C.rfm_metrics(_sales(spark, d), REF))


@_register("customer_rfm", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _RFM, _THR, _SCORED, _SCORED2)
           + "SELECT c.*, s.* EXCLUDE (customer_id) FROM customers c LEFT JOIN scored2 s USING (customer_id)")
def _customer_rfm(spark, d):
    return C.calculate_rfm(_sales(spark, d), T.customers(spark, d), REF)


@_register("customer_segments", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _RFM, _THR, _SCORED, _SCORED2)
           + f"SELECT c.*, s.* EXCLUDE (customer_id), "
             f"{_SEGMENT.replace('recency_score', 's.recency_score').replace('frequency_score', 's.frequency_score').replace('monetary_score', 's.monetary_score')} AS customer_segment "
             "FROM customers c LEFT JOIN scored2 s USING (customer_id)")
def _customer_segments(spark, d):
    return C.segment_customers(C.calculate_rfm(_sales(spark, d), T.customers(spark, d), REF))


@_register("customer_clv", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _CLV)
           + "SELECT c.*, v.* EXCLUDE (customer_id) FROM customers c LEFT JOIN clv v USING (customer_id)")
def _customer_clv(spark, d):
    return C.calculate_clv(_sales(spark, d), T.customers(spark, d))


@_register("top_clv", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _CLV)
           + "SELECT c.*, v.* EXCLUDE (customer_id) FROM customers c LEFT JOIN clv v USING (customer_id) "
             "ORDER BY projected_clv DESC NULLS LAST, customer_id LIMIT 10")
def _top_clv(spark, d):
    return C.top_clv(_sales(spark, d), T.customers(spark, d), 10)


@_register("churn_risk", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _CHURN)
           + "SELECT c.*, h.* EXCLUDE (customer_id) FROM customers c LEFT JOIN churn h USING (customer_id)")
def _churn_risk(spark, d):
    return C.identify_churn_risk(_sales(spark, d), T.customers(spark, d), REF)


@_register("customer_360", C360_SQL)
def _customer_360(spark, d):
    return C.customer_360_from_sales(_sales(spark, d), T.customers(spark, d), REF)


@_register("top_customers", _with(SALES_CTE, _FACT) + """
SELECT * FROM (
  SELECT customer_id, CAST(revenue AS DOUBLE) AS total_revenue, transaction_count,
         CAST(revenue AS DOUBLE) / NULLIF(amount_count, 0) AS avg_order_value,
         first_purchase_date AS first_purchase, last_purchase_date AS last_purchase,
         CAST(row_number() OVER (ORDER BY CAST(revenue AS DOUBLE) DESC NULLS LAST, customer_id) AS INTEGER) AS revenue_rank
  FROM fact) t WHERE revenue_rank <= 100""")
def _top_customers(spark, d):
    return C.top_customers(_sales(spark, d), 100)


@_register("top_customers_named", _with(SALES_CTE, CUSTOMERS_CTE) + """
SELECT t.customer_id, t.total_spent, t.purchase_count, c.first_name, c.last_name, c.region FROM (
  SELECT customer_id, CAST(SUM(total_amount) AS DOUBLE) AS total_spent, COUNT(transaction_id) AS purchase_count
  FROM sales GROUP BY customer_id ORDER BY SUM(total_amount) DESC NULLS LAST, customer_id LIMIT 20) t
LEFT JOIN customers c ON t.customer_id = c.customer_id""")
def _top_customers_named(spark, d):
    return C.top_customers_named(_sales(spark, d), T.customers(spark, d), 20)


@_register("customers_by_region", _with(CUSTOMERS_CTE)
           + "SELECT region, COUNT(customer_id) AS customer_count FROM customers GROUP BY region")
def _customers_by_region(spark, d):
    return C.customers_by_region(T.customers(spark, d))


@_register("customer_status", _with(CUSTOMERS_CTE)
           + "SELECT is_active, COUNT(customer_id) AS count FROM customers GROUP BY is_active")
def _customer_status(spark, d):
    return C.customer_status(T.customers(spark, d))


@_register("high_value_customers", _with(SALES_CTE, CUSTOMERS_CTE, _FACT, _CLV) + """
SELECT c.*, v.* EXCLUDE (customer_id), COALESCE(v.projected_clv >= 400000.0, FALSE) AS is_high_value
FROM customers c LEFT JOIN clv v USING (customer_id)""")
def _high_value_customers(spark, d):
    return C.high_value_customers(C.calculate_clv(_sales(spark, d), T.customers(spark, d)), threshold=400000.0)


@_register("customers_masked", _with(CUSTOMERS_CTE) + """
SELECT * REPLACE (CASE WHEN email IS NULL THEN NULL ELSE '***@' || split_part(email, '@', -1) END AS email)
FROM customers""")
def _customers_masked(spark, d):
    return C.mask_emails(T.customers(spark, d), privileged=False)


@_register("rfm_scores_approx")
def _rfm_scores_approx(spark, d):
    """The sketch-based quintiles (relative error 1/accuracy): no exact oracle."""
    return C.rfm_scores(C.rfm_metrics(_sales(spark, d), REF), mode="approx")


@_register("churn_model")
def _churn_model(spark, d):
    """Logistic regression with a time split: no SQL form (tests check its held-out accuracy)."""
    return CM.churn_scores(_sales(spark, d), "2000-06-30", "2001-01-31")


# ----------------------------------------------------------------------------
# sales, product, regional and time analytics

_DBL = "CAST(SUM(total_amount) AS DOUBLE)"
_AVG = "CAST(SUM(total_amount) AS DOUBLE) / NULLIF(COUNT(total_amount), 0)"


@_register("daily_sales", _with(SALES_CTE) + f"""
SELECT CAST(transaction_date AS DATE) AS sale_date, region, sales_channel, {_DBL} AS total_revenue,
       COUNT(transaction_id) AS transaction_count, {_AVG} AS avg_transaction_value,
       CAST(SUM(quantity) AS BIGINT) AS total_units_sold, COUNT(DISTINCT customer_id) AS unique_customers,
       {_DBL} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer
FROM sales GROUP BY 1, 2, 3""")
def _daily_sales(spark, d):
    return S.daily_sales(_sales(spark, d))


@_register("daily_trend", _with(SALES_CTE) + f"""
SELECT CAST(transaction_date AS DATE) AS sale_date, {_DBL} AS daily_revenue, COUNT(transaction_id) AS transaction_count
FROM sales GROUP BY 1""")
def _daily_trend(spark, d):
    return S.daily_trend(_sales(spark, d))


_MONTHLY = f"""m AS (
  SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
         strftime(transaction_date, '%Y-%m') AS year_month, region, {_DBL} AS monthly_revenue,
         COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT customer_id) AS unique_customers,
         {_AVG} AS avg_order_value
  FROM sales GROUP BY 1, 2, 3, 4),
m2 AS (
  SELECT *, LAG(monthly_revenue) OVER (PARTITION BY region ORDER BY year, month) AS prev_month_revenue,
            LAG(monthly_revenue) OVER (PARTITION BY region, month ORDER BY year) AS prev_year_revenue FROM m)"""


@_register("monthly_trends", _with(SALES_CTE, _MONTHLY) + """
SELECT year, month, year_month, region, monthly_revenue, transaction_count, unique_customers, avg_order_value,
       prev_month_revenue, (monthly_revenue - prev_month_revenue) / NULLIF(prev_month_revenue, 0) * 100.0 AS mom_growth_pct,
       prev_year_revenue, (monthly_revenue - prev_year_revenue) / NULLIF(prev_year_revenue, 0) * 100.0 AS yoy_growth_pct
FROM m2""")
def _monthly_trends(spark, d):
    return S.monthly_trends(_sales(spark, d))


@_register("monthly_trends_strict", _with(SALES_CTE, _MONTHLY) + """,
m3 AS (SELECT *, LAG(year * 12 + month) OVER (PARTITION BY region ORDER BY year, month) AS prev_idx,
              LAG(year) OVER (PARTITION BY region, month ORDER BY year) AS prev_year FROM m2),
m4 AS (SELECT * EXCLUDE (prev_month_revenue, prev_year_revenue, prev_idx, prev_year),
              CASE WHEN prev_idx = year * 12 + month - 1 THEN prev_month_revenue END AS prev_month_revenue,
              CASE WHEN prev_year = year - 1 THEN prev_year_revenue END AS prev_year_revenue FROM m3)
SELECT year, month, year_month, region, monthly_revenue, transaction_count, unique_customers, avg_order_value,
       prev_month_revenue, (monthly_revenue - prev_month_revenue) / NULLIF(prev_month_revenue, 0) * 100.0 AS mom_growth_pct,
       prev_year_revenue, (monthly_revenue - prev_year_revenue) / NULLIF(prev_year_revenue, 0) * 100.0 AS yoy_growth_pct
FROM m4""")
def _monthly_trends_strict(spark, d):
    return S.monthly_trends(_sales(spark, d), calendar_strict=True)


@_register("monthly_mom", _with(SALES_CTE) + f"""
SELECT *, (monthly_revenue - prev_month_revenue) / NULLIF(prev_month_revenue, 0) * 100.0 AS mom_growth_pct FROM (
  SELECT *, LAG(monthly_revenue) OVER (PARTITION BY region ORDER BY year, month) AS prev_month_revenue FROM (
    SELECT CAST(year(transaction_date) AS INTEGER) AS year, CAST(month(transaction_date) AS INTEGER) AS month,
           date_trunc('month', transaction_date) AS year_month, region, {_DBL} AS monthly_revenue,
           COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT customer_id) AS unique_customers
    FROM sales GROUP BY 1, 2, 3, 4) a) b""")
def _monthly_mom(spark, d):
    return S.monthly_mom(_sales(spark, d))


_PRODUCT_SALES = f"""ps AS (
  SELECT product_id, {_DBL} AS total_revenue, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold,
         COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT customer_id) AS unique_buyers,
         {_AVG} AS avg_sale_amount
  FROM sales GROUP BY product_id)"""

_PRODUCT_PERF = """pp0 AS (
  SELECT p.*, ps.* EXCLUDE (product_id),
         CASE WHEN p.unit_cost IS NOT NULL THEN p.unit_cost * ps.total_quantity_sold END AS total_cost
  FROM products p LEFT JOIN ps USING (product_id)),
pp1 AS (SELECT *, CASE WHEN total_cost IS NOT NULL THEN total_revenue - total_cost END AS gross_profit FROM pp0),
pp AS (
  SELECT *, CASE WHEN total_revenue > 0 AND gross_profit IS NOT NULL
                 THEN gross_profit / NULLIF(total_revenue, 0) * 100.0 END AS profit_margin_pct,
         CAST(row_number() OVER (ORDER BY total_revenue DESC NULLS LAST, product_id) AS BIGINT) AS revenue_rank
  FROM pp1)"""


@_register("product_performance", _with(SALES_CTE, PRODUCTS_CTE, _PRODUCT_SALES, _PRODUCT_PERF) + "SELECT * FROM pp")
def _product_performance(spark, d):
    return S.product_performance(_sales(spark, d), T.products(spark, d))


@_register("monthly_latest", _SQL["monthly_mom"].rstrip() + " ORDER BY year_month DESC, region LIMIT 20")
def _monthly_latest(spark, d):
    return S.latest_months(S.monthly_mom(_sales(spark, d)), 20)


@_register("top_ranked_products", _with(SALES_CTE, PRODUCTS_CTE, _PRODUCT_SALES, _PRODUCT_PERF)
           + "SELECT * FROM pp WHERE revenue_rank <= 10")
def _top_ranked_products(spark, d):
    return S.top_ranked_products(S.product_performance(_sales(spark, d), T.products(spark, d)), 10)


@_register("best_worst_products", _with(SALES_CTE, PRODUCTS_CTE, _PRODUCT_SALES) + """,
x AS (SELECT ps.*, p.product_name, p.category FROM ps LEFT JOIN products p USING (product_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC, product_id) AS INTEGER) AS position,
                      'best' AS performance FROM x) WHERE position <= 10
UNION ALL
SELECT * FROM (SELECT *, CAST(row_number() OVER (ORDER BY total_revenue ASC, product_id) AS INTEGER) AS position,
                      'worst' AS performance FROM x) WHERE position <= 10""")
def _best_worst_products(spark, d):
    return S.best_worst_products(_sales(spark, d), T.products(spark, d), 10)


@_register("category_performance", _with(SALES_CTE, PRODUCTS_CTE) + f"""
SELECT p.category, {_DBL} AS category_revenue, CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
       COUNT(DISTINCT s.product_id) AS product_count, COUNT(DISTINCT customer_id) AS unique_customers,
       {_AVG} AS avg_transaction_value,
       {_DBL} / NULLIF(CAST(SUM(SUM(total_amount)) OVER () AS DOUBLE), 0) * 100.0 AS revenue_contribution_pct
FROM sales s LEFT JOIN products p ON s.product_id = p.product_id GROUP BY p.category""")
def _category_performance(spark, d):
    return S.category_performance(_sales(spark, d), T.products(spark, d))


@_register("regional_performance", _with(SALES_CTE) + f"""
SELECT *, CAST(row_number() OVER (ORDER BY total_revenue DESC NULLS LAST, region) AS INTEGER) AS revenue_rank FROM (
  SELECT region, {_DBL} AS total_revenue, COUNT(transaction_id) AS transaction_count,
         COUNT(DISTINCT customer_id) AS unique_customers, {_AVG} AS avg_order_value,
         CAST(SUM(quantity) AS BIGINT) AS total_units_sold,
         {_DBL} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer,
         CAST(COUNT(transaction_id) AS DOUBLE) / NULLIF(COUNT(DISTINCT customer_id), 0) AS transactions_per_customer
  FROM sales GROUP BY region) t""")
def _regional_performance(spark, d):
    return S.regional_performance(_sales(spark, d))


@_register("sales_velocity", _with(SALES_CTE) + """
SELECT sale_date, product_id, daily_quantity, CAST(rev AS DOUBLE) AS daily_revenue,
       CAST(SUM(daily_quantity) OVER w AS DOUBLE) / NULLIF(COUNT(daily_quantity) OVER w, 0) AS avg_daily_quantity_30d,
       CAST(SUM(rev) OVER w AS DOUBLE) / NULLIF(COUNT(rev) OVER w, 0) AS avg_daily_revenue_30d
FROM (SELECT CAST(transaction_date AS DATE) AS sale_date, product_id, CAST(SUM(quantity) AS BIGINT) AS daily_quantity,
             SUM(total_amount) AS rev FROM sales GROUP BY 1, 2) d
WINDOW w AS (PARTITION BY product_id ORDER BY sale_date RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)""")
def _sales_velocity(spark, d):
    return S.sales_velocity(_sales(spark, d), 30)


@_register("sales_velocity_filled", _with(SALES_CTE) + """,
d AS (SELECT CAST(transaction_date AS DATE) AS sale_date, product_id, CAST(SUM(quantity) AS BIGINT) AS q,
             SUM(total_amount) AS rev FROM sales GROUP BY 1, 2),
b AS (SELECT product_id, MIN(sale_date) AS lo, MAX(sale_date) AS hi FROM d GROUP BY product_id),
g AS (SELECT product_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS sale_date FROM b),
f AS (SELECT g.sale_date, g.product_id, COALESCE(d.q, 0) AS daily_quantity, COALESCE(d.rev, 0) AS rev
      FROM g LEFT JOIN d ON g.product_id = d.product_id AND g.sale_date = d.sale_date)
SELECT sale_date, product_id, daily_quantity, CAST(rev AS DOUBLE) AS daily_revenue,
       CAST(SUM(daily_quantity) OVER w AS DOUBLE) / NULLIF(COUNT(daily_quantity) OVER w, 0) AS avg_daily_quantity_7d,
       CAST(SUM(rev) OVER w AS DOUBLE) / NULLIF(COUNT(rev) OVER w, 0) AS avg_daily_revenue_7d
FROM f WINDOW w AS (PARTITION BY product_id ORDER BY sale_date RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)""")
def _sales_velocity_filled(spark, d):
    return S.sales_velocity(_sales(spark, d), 7, fill_missing_days=True)


@_register("sales_by_region", _with(SALES_CTE) + f"""
SELECT region, {_DBL} AS total_revenue, COUNT(transaction_id) AS transaction_count, {_AVG} AS avg_transaction_value
FROM sales GROUP BY region""")
def _sales_by_region(spark, d):
    return S.sales_by_region(_sales(spark, d))


@_register("sales_by_channel", _with(SALES_CTE) + f"""
SELECT sales_channel, {_DBL} AS total_revenue, COUNT(transaction_id) AS transaction_count
FROM sales GROUP BY sales_channel""")
def _sales_by_channel(spark, d):
    return S.sales_by_channel(_sales(spark, d))


@_register("products_by_category", _with(PRODUCTS_CTE) + """
SELECT category, COUNT(product_id) AS product_count, AVG(unit_price) AS avg_price FROM products GROUP BY category""")
def _products_by_category(spark, d):
    return S.products_by_category(T.products(spark, d))


@_register("price_distribution", _with(PRODUCTS_CTE) + """
SELECT MIN(unit_price) AS min_price, MAX(unit_price) AS max_price, AVG(unit_price) AS avg_price,
       quantile_disc(unit_price, 0.5) AS median_price FROM products""")
def _price_distribution(spark, d):
    return S.price_distribution(T.products(spark, d))


@_register("top_products_named", _with(SALES_CTE, PRODUCTS_CTE) + """
SELECT t.product_id, t.total_revenue, t.total_quantity_sold, p.product_name, p.category FROM (
  SELECT product_id, CAST(SUM(total_amount) AS DOUBLE) AS total_revenue, CAST(SUM(quantity) AS BIGINT) AS total_quantity_sold
  FROM sales GROUP BY product_id ORDER BY SUM(total_amount) DESC NULLS LAST, product_id LIMIT 20) t
LEFT JOIN products p ON t.product_id = p.product_id""")
def _top_products_named(spark, d):
    return S.top_products_named(_sales(spark, d), T.products(spark, d), 20)


@_register("key_metrics", _with(SALES_CTE) + f"""
SELECT {_DBL} AS total_revenue, COUNT(*) AS total_transactions, COUNT(DISTINCT customer_id) AS unique_customers,
       {_DBL} / NULLIF(COUNT(*), 0) AS avg_transaction_value,
       {_DBL} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer FROM sales""")
def _key_metrics(spark, d):
    return S.key_metrics(_sales(spark, d))


def _summary_sql() -> str:
    cols = ["quantity", "unit_price", "discount_percentage", "total_amount"]
    stats = {
        "count": "CAST(COUNT({c}) AS DOUBLE)", "mean": "AVG(CAST({c} AS DOUBLE))",
        "stddev": "STDDEV_SAMP(CAST({c} AS DOUBLE))", "min": "CAST(MIN({c}) AS DOUBLE)",
        "25%": "CAST(quantile_disc({c}, 0.25) AS DOUBLE)", "50%": "CAST(quantile_disc({c}, 0.5) AS DOUBLE)",
        "75%": "CAST(quantile_disc({c}, 0.75) AS DOUBLE)", "max": "CAST(MAX({c}) AS DOUBLE)",
    }
    parts = []
    for name, tmpl in stats.items():
        sel = ", ".join(tmpl.format(c=c) + f" AS {c}" for c in cols)
        parts.append(f"SELECT '{name}' AS summary, {sel} FROM sales")
    return _with(SALES_CTE) + "\nUNION ALL\n".join(parts)


@_register("numeric_summary", _summary_sql())
def _numeric_summary(spark, d):
    return S.numeric_summary(_sales(spark, d))


@_register("dataset_overview", _with(SALES_CTE, CUSTOMERS_CTE, PRODUCTS_CTE) + """
SELECT 'sales' AS dataset, COUNT(*) AS record_count, 12 AS column_count,
       'transaction_id, transaction_date, customer_id, product_id, quantity' AS first_columns FROM sales
UNION ALL SELECT 'customers', COUNT(*), 8, 'customer_id, first_name, last_name, email, country' FROM customers
UNION ALL SELECT 'products', COUNT(*), 7, 'product_id, product_name, category, subcategory, brand' FROM products""")
def _dataset_overview(spark, d):
    return S.dataset_overview({"sales": _sales(spark, d), "customers": T.customers(spark, d),
                               "products": T.products(spark, d)})


@_register("region_revenue_since", _with(SALES_CTE) + f"""
SELECT region, {_DBL} AS revenue, COUNT(transaction_id) AS transaction_count FROM sales
WHERE transaction_date >= TIMESTAMP '2000-01-01 00:00:00' GROUP BY region""")
def _region_revenue_since(spark, d):
    return S.region_revenue_since(_sales(spark, d), "2000-01-01")


@_register("weekly_sales", _with(SALES_CTE) + f"""
SELECT CAST(date_trunc('week', transaction_date) AS DATE) AS week_start, region, {_DBL} AS weekly_revenue,
       COUNT(transaction_id) AS transaction_count, COUNT(DISTINCT customer_id) AS unique_customers
FROM sales GROUP BY 1, 2""")
def _weekly_sales(spark, d):
    return S.weekly_sales(_sales(spark, d))


@_register("fiscal_year_sales", _with(SALES_CTE) + f"""
SELECT CAST(year(CAST(transaction_date AS DATE) + INTERVAL 9 MONTH) AS INTEGER) AS fiscal_year, region,
       {_DBL} AS revenue, COUNT(transaction_id) AS transaction_count FROM sales GROUP BY 1, 2""")
def _fiscal_year_sales(spark, d):
    return S.fiscal_year_sales(_sales(spark, d), fiscal_year_start_month=4)


@_register("sales_region_filtered", _with(SALES_CTE) + """
SELECT * FROM sales WHERE region IN ('EUROPE', 'ASIA')""")
def _sales_region_filtered(spark, d):
    return S.sales_region_filtered(_sales(spark, d), ["EUROPE", "ASIA"])


@_register("demand_forecast", _with(SALES_CTE) + """,
d AS (SELECT product_id, CAST(transaction_date AS DATE) AS sale_date,
             CAST(datediff('day', DATE '1970-01-01', CAST(transaction_date AS DATE)) AS DECIMAL(38,0)) AS x,
             CAST(SUM(quantity) AS DECIMAL(38,0)) AS q FROM sales GROUP BY 1, 2, 3),
s AS (SELECT product_id, CAST(COUNT(q) AS DECIMAL(38,0)) AS n, SUM(x) AS sx, SUM(q) AS sy, SUM(x * x) AS sxx,
             SUM(x * q) AS sxy, MAX(sale_date) AS last_sale_date, MAX(x) AS last_x FROM d GROUP BY product_id),
f AS (SELECT product_id,
             CAST(n * sxy - sx * sy AS DOUBLE) / NULLIF(CAST(n * sxx - sx * sx AS DOUBLE), 0) AS trend_slope,
             CAST(sy * sxx - sx * sxy AS DOUBLE) / NULLIF(CAST(n * sxx - sx * sx AS DOUBLE), 0) AS trend_intercept,
             CAST(sy AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) AS mean_daily_quantity,
             CAST(n AS BIGINT) AS sale_days, last_sale_date, CAST(last_x AS DOUBLE) AS last_x FROM s)
SELECT product_id, trend_slope, trend_intercept, mean_daily_quantity, sale_days, last_sale_date,
       CASE WHEN trend_slope IS NULL THEN mean_daily_quantity * 30.0
            ELSE greatest(0.0, trend_intercept + trend_slope * (last_x + 15.5)) * 30.0 END AS forecast_quantity_30d
FROM f""")
def _demand_forecast(spark, d):
    return S.demand_forecast(_sales(spark, d), 30)


@_register("cross_sell_rules", _with(SALES_CTE) + """,
l AS (SELECT DISTINCT split_part(transaction_id, '-', 1) AS basket, product_id FROM sales),
t AS (SELECT COUNT(DISTINCT basket) AS n FROM l),
i AS (SELECT product_id, COUNT(*) AS n FROM l GROUP BY product_id),
p AS (SELECT a.product_id AS antecedent, b.product_id AS consequent, COUNT(*) AS pair_count
      FROM l a JOIN l b ON a.basket = b.basket AND a.product_id <> b.product_id GROUP BY 1, 2
      HAVING COUNT(*) >= (SELECT greatest(1, ceil(round(0.0001 * n, 6))) FROM t))
SELECT antecedent, consequent, pair_count, pair_count / CAST(t.n AS DOUBLE) AS support,
       pair_count / CAST(a.n AS DOUBLE) AS confidence,
       pair_count * CAST(t.n AS DOUBLE) / (a.n * CAST(c.n AS DOUBLE)) AS lift
FROM p, t, i a, i c WHERE a.product_id = antecedent AND c.product_id = consequent""")
def _cross_sell_rules(spark, d):
    baskets = _sales(spark, d).withColumn("basket_id", F.split("transaction_id", "-")[0])
    return B.cross_sell_rules(baskets, min_support=0.0001)


@_register("popular_recommendations", _with(SALES_CTE) + """,
b AS (SELECT DISTINCT customer_id, product_id FROM sales),
n AS (SELECT product_id, COUNT(*) AS n FROM b GROUP BY product_id),
c AS (SELECT DISTINCT customer_id FROM b),
f AS (SELECT c.customer_id, n.product_id, n.n FROM c CROSS JOIN n
      ANTI JOIN b ON b.customer_id = c.customer_id AND b.product_id = n.product_id)
SELECT customer_id, CAST(row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_id) AS INTEGER) AS rank,
       product_id, CAST(n AS DOUBLE) AS score
FROM f QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, product_id) <= 10""")
def _popular_recommendations(spark, d):
    return RC.popular_recommendations(_sales(spark, d), 10)


@_register("product_recommendations")
def _product_recommendations(spark, d):
    """Alternating least squares: no SQL form (tests check its held-out recall against popularity)."""
    return RC.product_recommendations(_sales(spark, d), 10, rank=8, iterations=5)


@_register("seasonal_forecast", "WITH RECURSIVE " + SALES_CTE + """,
m AS (SELECT product_id, date_trunc('month', transaction_date) AS m, CAST(SUM(quantity) AS DOUBLE) AS q
      FROM sales GROUP BY 1, 2),
f AS (SELECT product_id, MIN(m) AS first_month FROM m GROUP BY product_id),
g AS (SELECT product_id, first_month,
             unnest(generate_series(first_month, (SELECT MAX(m) FROM m), INTERVAL 1 MONTH)) AS m FROM f),
s AS (SELECT g.product_id, g.first_month, list(coalesce(m.q, 0.0) ORDER BY g.m) AS y
      FROM g LEFT JOIN m ON m.product_id = g.product_id AND m.m = g.m GROUP BY 1, 2),
r(product_id, i, level, trend, season, error, line_error, sy, sty) AS (
  SELECT product_id, 13, list_sum(y[1:12]) / 12.0, CAST(0 AS DOUBLE),
         list_transform(y[1:12], lambda v: v - list_sum(y[1:12]) / 12.0), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE),
         list_sum(y[1:12]), list_sum(list_transform(y[1:12], lambda v, k: v * k))
  FROM s WHERE len(y) > 12
  UNION ALL
  SELECT product_id, i + 1, new_level, 0.05 * (new_level - level) + (1.0 - 0.05) * trend,
         list_transform(season, lambda v, k: CASE WHEN k = pos THEN 0.2 * (v1 - new_level) + (1.0 - 0.2) * v ELSE v END),
         error + abs(v1 - (level + trend + season[pos])),
         line_error + abs(v1 - ((sy - slope * sx) / n + slope * (n + 1.0))), sy + v1, sty + i * v1
  FROM (SELECT *, (n * sty - sx * sy) / (n * sxx - sx * sx) AS slope,
               0.3 * (v1 - season[pos]) + (1.0 - 0.3) * (level + trend) AS new_level
        FROM (SELECT r.*, s.y[i] AS v1, (i - 1) % 12 + 1 AS pos, CAST(i - 1 AS DOUBLE) AS n,
                     CAST(i - 1 AS DOUBLE) * i / 2.0 AS sx,
                     CAST(i - 1 AS DOUBLE) * i * (2.0 * (i - 1) + 1.0) / 6.0 AS sxx
              FROM r JOIN s ON s.product_id = r.product_id WHERE i <= len(s.y))))
SELECT s.product_id, CAST(s.first_month AS DATE) AS first_month, CAST(len(s.y) AS INTEGER) AS periods, r.level, r.trend,
       greatest(0.0, r.level + 1.0 * r.trend + r.season[(len(s.y) + 0) % 12 + 1]) AS forecast_1,
       greatest(0.0, r.level + 2.0 * r.trend + r.season[(len(s.y) + 1) % 12 + 1]) AS forecast_2,
       greatest(0.0, r.level + 3.0 * r.trend + r.season[(len(s.y) + 2) % 12 + 1]) AS forecast_3,
       r.error / (len(s.y) - 12) AS mae, r.line_error / (len(s.y) - 12) AS line_mae
FROM s LEFT JOIN r ON r.product_id = s.product_id AND r.i = len(s.y) + 1""")
def _seasonal_forecast(spark, d):
    out = SE.seasonal_forecast(_sales(spark, d))
    return out.select("product_id", "first_month", "periods", "level", "trend",
                      *[F.col("forecast")[k].alias(f"forecast_{k + 1}") for k in range(3)], "mae", "line_mae")


@_register("revenue_change_points", "WITH RECURSIVE " + SALES_CTE + """,
x AS (SELECT region, CAST(transaction_date AS DATE) AS day, CAST(SUM(total_amount) AS DOUBLE) AS x
      FROM sales GROUP BY 1, 2),
c AS (SELECT region, CAST(COUNT(*) AS DOUBLE) AS n, CAST(SUM(CAST(round(x * 100) AS HUGEINT)) AS DOUBLE) AS s,
             CAST(SUM(CAST(round(x * 100) AS HUGEINT) * CAST(round(x * 100) AS HUGEINT)) AS DOUBLE) AS ss
      FROM x GROUP BY region),
p AS (SELECT region, s / n / 100.0 AS mean, sqrt(greatest(0.0, ss / n - (s / n) * (s / n))) / 100.0 AS sd FROM c),
d AS (SELECT x.region, day, (x - mean) / sd AS z, row_number() OVER (PARTITION BY x.region ORDER BY day) AS i
      FROM x JOIN p ON p.region = x.region WHERE sd > 0),
r(region, i, up, down, up_since, down_since, change_day, direction, shift_began, score) AS (
  SELECT DISTINCT region, CAST(0 AS BIGINT), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), CAST(NULL AS DATE), CAST(NULL AS DATE),
         CAST(NULL AS DATE), CAST(NULL AS VARCHAR), CAST(NULL AS DATE), CAST(NULL AS DOUBLE) FROM d
  UNION ALL
  SELECT region, i, CASE WHEN hit THEN 0 ELSE u END, CASE WHEN hit THEN 0 ELSE w END,
         CASE WHEN NOT hit THEN us END, CASE WHEN NOT hit THEN ws END,
         CASE WHEN hit THEN day END, CASE WHEN hit THEN CASE WHEN u > 5.0 THEN 'up' ELSE 'down' END END,
         CASE WHEN hit THEN CASE WHEN u > 5.0 THEN us ELSE ws END END,
         CASE WHEN hit THEN CASE WHEN u > 5.0 THEN u ELSE w END END
  FROM (SELECT *, CASE WHEN u > 0 THEN coalesce(up_since, day) END AS us,
               CASE WHEN w > 0 THEN coalesce(down_since, day) END AS ws, u > 5.0 OR w > 5.0 AS hit
        FROM (SELECT r.region, d.i, d.day, r.up_since, r.down_since, greatest(0.0, r.up + d.z - 0.5) AS u,
                     greatest(0.0, r.down - d.z - 0.5) AS w
              FROM r JOIN d ON d.region = r.region AND d.i = r.i + 1)))
SELECT region, change_day, direction, shift_began, score FROM r WHERE change_day IS NOT NULL""")
def _revenue_change_points(spark, d):
    return SE.change_points(_sales(spark, d))


@_register("retention_curve", "WITH RECURSIVE " + SALES_CTE + """,
f AS (SELECT customer_id, region, CAST(MIN(transaction_date) AS DATE) AS a, CAST(MAX(transaction_date) AS DATE) AS z
      FROM sales WHERE CAST(transaction_date AS DATE) <= DATE '2001-06-30' GROUP BY 1, 2),
s AS (SELECT region, CAST(floor(datediff('day', a, z) / 30.0) AS INTEGER) AS step, COUNT(*) AS n,
             SUM(CASE WHEN datediff('day', z, DATE '2001-06-30') >= 180 THEN 1 ELSE 0 END) AS lapsed FROM f GROUP BY 1, 2),
o AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY step) AS i,
             SUM(n) OVER (PARTITION BY region ORDER BY step DESC) AS at_risk FROM s),
r(region, i, survival) AS (
  SELECT DISTINCT region, CAST(0 AS BIGINT), CAST(1 AS DOUBLE) FROM o
  UNION ALL
  SELECT r.region, o.i, r.survival * (1.0 - CAST(o.lapsed AS DOUBLE) / CAST(o.at_risk AS DOUBLE))
  FROM r JOIN o ON o.region = r.region AND o.i = r.i + 1)
SELECT o.region, o.step, CAST(o.at_risk AS BIGINT) AS at_risk, CAST(o.lapsed AS BIGINT) AS lapsed,
       CAST(o.n - o.lapsed AS BIGINT) AS censored, r.survival
FROM o JOIN r ON r.region = o.region AND r.i = o.i""")
def _retention_curve(spark, d):
    return SE.retention_curve(_sales(spark, d), "2001-06-30", by="region")


_PRICES = """prices AS (
  SELECT product_id, date_trunc('month', transaction_date) + INTERVAL 1 MONTH AS valid_from,
         MAX(unit_price) AS list_price
  FROM sales GROUP BY 1, 2)"""
_PROMOTIONS = """promotions AS (
  SELECT s_suppkey AS promotion_id, CAST(DATE '1995-01-01' + CAST(s_suppkey * 97 % 2400 AS INTEGER) AS TIMESTAMP) AS starts,
         CAST(DATE '1995-01-01' + CAST(s_suppkey * 97 % 2400 + s_suppkey % 14 + 1 AS INTEGER) AS TIMESTAMP) AS ends
  FROM supplier)"""


@_register("price_in_force", _with(SALES_CTE, _PRICES) + """
SELECT s.transaction_id, s.product_id, CAST(s.transaction_date AS DATE) AS sale_date, s.unit_price, p.list_price
FROM sales s ASOF LEFT JOIN prices p ON s.product_id = p.product_id AND s.transaction_date >= p.valid_from""")
def _price_in_force(spark, d):
    """The highest price of the product's last earlier month with sales, as of each sale."""
    sales = _sales(spark, d)
    month = F.trunc("transaction_date", "month")
    prices = sales.groupBy("product_id", F.add_months(month, 1).cast("timestamp").alias("valid_from")) \
        .agg(F.max("unit_price").alias("list_price"))
    rows = sales.select("transaction_id", "product_id", "transaction_date", "unit_price")
    return TP.asof_join(rows, prices, "product_id", "transaction_date", "valid_from", ["list_price"], "365 days") \
        .withColumn("sale_date", F.to_date("transaction_date")).drop("transaction_date")


@_register("promotion_revenue", _with(SALES_CTE, _PROMOTIONS) + f"""
SELECT promotion_id, CAST(starts AS DATE) AS first_day, COUNT(*) AS transaction_count, {_DBL} AS revenue
FROM promotions JOIN sales ON transaction_date >= starts AND transaction_date < ends GROUP BY 1, 2""")
def _promotion_revenue(spark, d):
    """Sales in the windows of promotions of 1 to 14 days, one for each supplier."""
    key = F.col("s_suppkey")
    day = lambda n: F.date_add(F.to_date(F.lit("1995-01-01")), n.cast("int")).cast("timestamp")
    promotions = T.read(spark, d, "supplier").select(
        key.alias("promotion_id"), day(key * 97 % 2400).alias("starts"), day(key * 97 % 2400 + key % 14 + 1).alias("ends"))
    sales = _sales(spark, d).select("transaction_date", "total_amount")
    by = ["promotion_id", F.to_date("starts").alias("first_day")]
    return TP.interval_totals(sales, promotions, "transaction_date", "starts", "ends", by, "total_amount") \
        .select("promotion_id", "first_day", "transaction_count", F.col("total_amount").cast("double").alias("revenue"))


@_register("sketch_periods", _with(SALES_CTE) + f"""
SELECT region, CAST(year(transaction_date) AS INTEGER) AS sale_year, COUNT(transaction_id) AS transaction_count, {_DBL} AS revenue,
       COUNT(DISTINCT customer_id) AS exact_customers, TRUE AS customers_within_5_percent, TRUE AS median_within_5_percent
FROM sales GROUP BY 1, 2""")
def _sketch_periods(spark, d):
    """Yearly measures from stored daily sketches, held against exact counts and ranks."""
    sales = _sales(spark, d)
    stored = materialize(SH.daily_sketches(sales), "daily-sketches").withColumn("sale_year", F.year("sale_date"))
    years = SH.period_measures(stored, by=["region", "sale_year"])
    rows = sales.select("region", F.year("transaction_date").alias("sale_year"), "customer_id", "total_amount")
    both = rows.join(years.select("region", "sale_year", "q50"), ["region", "sale_year"])
    exact = both.groupBy("region", "sale_year").agg(
        F.countDistinct("customer_id").alias("exact_customers"),
        F.avg((F.col("total_amount").cast("double") <= F.col("q50")).cast("double")).alias("rank"))
    near = F.abs(F.col("customers") - F.col("exact_customers")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact_customers"))
    return years.join(exact, ["region", "sale_year"]).select(
        "region", "sale_year", "transaction_count", "revenue", "exact_customers",
        near.alias("customers_within_5_percent"), (F.abs(F.col("rank") - 0.5) <= 0.05).alias("median_within_5_percent"))


@_register("records_per_file", _with(SALES_CTE) + """
SELECT COUNT(*) AS records, TRUE AS every_file_within_limit, TRUE AS more_than_one_file FROM sales""")
def _records_per_file(spark, d):
    """Sales written with at most 5,000 records a file, counted by file."""
    path = fresh_path(spark, "records-per-file")
    K.write_table(_sales(spark, d), path, max_records_per_file=5000)
    files = K.read_table(spark, path).groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n"))
    return files.agg(F.sum("n").alias("records"), (F.max("n") <= 5000).alias("every_file_within_limit"),
                     (F.count("*") > 1).alias("more_than_one_file"))


# ----------------------------------------------------------------------------
# data quality and cleaning

SALES_COLS = ["transaction_id", "transaction_date", "customer_id", "product_id", "quantity", "unit_price",
              "discount_percentage", "total_amount", "payment_method", "sales_channel", "region", "store_id"]
NULLS_CTE = DIRTY_CTE + """,
nsales AS (SELECT * REPLACE (NULLIF(sales_channel, '5-LOW') AS sales_channel, NULLIF(store_id, '1') AS store_id)
           FROM dirty_sales)"""
_ORDER_REST = ", ".join(f"{c} NULLS FIRST" for c in SALES_COLS[1:])
DEDUP_CTE = f"""dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_id ORDER BY {_ORDER_REST}) AS rn FROM dirty_sales) x
  WHERE rn = 1)"""
# independent of the dedup CTE: the rules first, so any valid copy keeps its id
VALID_SALE = ("transaction_id IS NOT NULL AND customer_id IS NOT NULL AND product_id IS NOT NULL "
              "AND total_amount IS NOT NULL AND total_amount > 0 AND total_amount < 100000 "
              "AND quantity > 0 AND quantity <= 1000")
SILVER_CTE = f"""silver AS (
  SELECT *, TRUE AS is_valid_amount, TRUE AS is_valid_quantity FROM dirty_sales WHERE {VALID_SALE}
  QUALIFY row_number() OVER (PARTITION BY transaction_id ORDER BY {_ORDER_REST}) = 1)"""
RECONCILED = f"""
SELECT b.n AS bronze_records, s.n AS silver_records, v.n - s.n AS duplicate_records, r.n AS rejected_records,
       b.n = s.n + (v.n - s.n) + r.n AS balanced, b.n - s.n AS records_filtered
FROM (SELECT COUNT(*) AS n FROM dirty_sales) b,
     (SELECT COUNT(DISTINCT transaction_id) AS n FROM dirty_sales WHERE {VALID_SALE}) s,
     (SELECT COUNT(*) AS n FROM dirty_sales WHERE {VALID_SALE}) v,
     (SELECT COUNT(*) AS n FROM dirty_sales WHERE NOT COALESCE({VALID_SALE}, FALSE)) r"""


def _three_batches(spark, d) -> IN.IncrementalTables:
    """All sales with repeated ids, dealt to three batches by their content, and the second loaded again."""
    tables = IN.IncrementalTables(spark, fresh_path(spark, "incremental"))
    sales = _sales(spark, d, dirty=True)
    part = F.pmod(F.xxhash64(*sales.columns), F.lit(3))
    tables.land(sales, F.concat(F.lit("b"), part))
    for n in (0, 1, 2, 1):
        tables.load(sales.where(part == n), f"b{n}")
    return tables


@_register("incremental_silver", _with(DIRTY_CTE, SILVER_CTE) + """
SELECT strftime(transaction_date, '%Y-%m') AS sale_month, COUNT(*) AS sales, COUNT(DISTINCT transaction_id) AS ids,
       CAST(SUM(quantity) AS BIGINT) AS units, CAST(SUM(total_amount) AS DOUBLE) AS revenue,
       MIN(transaction_id) AS first_id, MAX(customer_id) AS last_customer
FROM silver GROUP BY 1""")
def _incremental_silver(spark, d):
    silver = _three_batches(spark, d).table("silver")
    measures = silver.groupBy("sale_month").agg(
        F.count("*").alias("sales"), F.sum("quantity").alias("units"),
        F.sum("total_amount").cast("double").alias("revenue"), F.min("transaction_id").alias("first_id"),
        F.max("customer_id").alias("last_customer"))
    # counted beside the measures, which would be carried along with every id
    ids = silver.groupBy("sale_month").agg(F.countDistinct("transaction_id").alias("ids"))
    return measures.join(ids, "sale_month").select("sale_month", "sales", "ids", "units", "revenue", "first_id", "last_customer")


@_register("incremental_gold", _with(DIRTY_CTE, SILVER_CTE) + """
SELECT customer_id, CAST(COUNT(*) AS BIGINT) AS transaction_count, CAST(SUM(total_amount) AS DOUBLE) AS revenue,
       CAST(SUM(quantity) AS BIGINT) AS units, CAST(MIN(transaction_date) AS DATE) AS first_purchase,
       CAST(MAX(transaction_date) AS DATE) AS last_purchase
FROM silver GROUP BY customer_id""")
def _incremental_gold(spark, d):
    return _three_batches(spark, d).totals("customer_months", "customer_id").select(
        "customer_id", "transaction_count", "revenue", "units", F.to_date("first_purchase_date").alias("first_purchase"),
        F.to_date("last_purchase_date").alias("last_purchase"))



def _null_rows(table: str, bound: float) -> str:
    parts = []
    for c in SALES_COLS:
        parts.append(f"SELECT '{c}' AS column_name, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS null_count, "
                     f"CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) - COUNT({c}) AS DOUBLE) / COUNT(*) ELSE 0.0 END "
                     f"AS null_fraction FROM {table}")
    return "SELECT *, null_fraction <= " + str(bound) + " AS passed FROM (" + " UNION ALL ".join(parts) + ") n"


@_register("null_profile", _with(NULLS_CTE) + _null_rows("nsales", 0.05))
def _null_profile(spark, d):
    return Q.null_profile(T.sales_with_nulls(spark, d))


_DUP_PROFILE = """SELECT total_records, distinct_records, total_records - distinct_records AS duplicate_count,
       CASE WHEN total_records > 0 THEN CAST(total_records - distinct_records AS DOUBLE) / total_records ELSE 0.0 END
         AS duplicate_fraction,
       CASE WHEN total_records > 0 THEN CAST(total_records - distinct_records AS DOUBLE) / total_records ELSE 0.0 END
         <= 0.01 AS passed
FROM (SELECT CAST(COALESCE(SUM(c), 0) AS BIGINT) AS total_records, COUNT(*) AS distinct_records
      FROM (SELECT {keys}, COUNT(*) AS c FROM {table} GROUP BY ALL) g) t"""


@_register("duplicate_profile", _with(DIRTY_CTE) + _DUP_PROFILE.format(keys="transaction_id", table="dirty_sales"))
def _duplicate_profile(spark, d):
    return Q.duplicate_profile(_sales(spark, d, dirty=True), ["transaction_id"])


@_register("duplicate_keys", _with(DIRTY_CTE) + """
SELECT COUNT(*) AS total_records, COUNT(DISTINCT transaction_id) AS distinct_keys,
       COUNT(*) - COUNT(DISTINCT transaction_id) AS duplicate_count FROM dirty_sales""")
def _duplicate_keys(spark, d):
    return Q.duplicate_keys(_sales(spark, d, dirty=True))


def _quality_report_sql() -> str:
    cols = ", ".join(SALES_COLS)
    return _with(NULLS_CTE) + f""",
nr AS ({_null_rows('nsales', 0.05)}),
dp AS ({_DUP_PROFILE.format(keys=cols, table='nsales')}),
r AS (
  SELECT 'record_count' AS "check", CAST(NULL AS VARCHAR) AS column_name, CAST(COUNT(*) AS DOUBLE) AS observed,
         100.0 AS threshold, COUNT(*) >= 100 AS passed FROM nsales
  UNION ALL SELECT 'required_columns', NULL, 0.0, 0.0, TRUE
  UNION ALL SELECT 'null_values', column_name, null_fraction, 0.05, passed FROM nr
  UNION ALL SELECT 'duplicates', NULL, duplicate_fraction, 0.01, passed FROM dp
  UNION ALL SELECT 'data_types', NULL, 0.0, 0.0, TRUE)
SELECT 'sales' AS dataset, "check", column_name, observed, CAST(threshold AS DOUBLE) AS threshold, passed FROM r
UNION ALL
SELECT 'sales', 'overall', NULL, CAST(MIN(CAST(passed AS INTEGER)) AS DOUBLE), CAST(1.0 AS DOUBLE),
       MIN(CAST(passed AS INTEGER)) = 1 FROM r"""


@_register("quality_report", _quality_report_sql())
def _quality_report(spark, d):
    return Q.quality_report(T.sales_with_nulls(spark, d), "sales", ["transaction_id", "customer_id"])


@_register("quality_report_hashed", _quality_report_sql())
def _quality_report_hashed(spark, d):
    from tillscope.settings import Settings
    return Q.quality_report(T.sales_with_nulls(spark, d), "sales", ["transaction_id", "customer_id"],
                            Settings(duplicate_mode="hash"))


_SWAPPED = """swapped AS (
  SELECT l_orderkey AS k, CAST(NULL AS BIGINT) AS a, l_suppkey AS b FROM lineitem
  UNION ALL SELECT l_orderkey, l_suppkey, CAST(NULL AS BIGINT) FROM lineitem)"""


@_register("duplicates_swapped_nulls", _with(_SWAPPED) + """
SELECT total_records, distinct_records, total_records - distinct_records AS duplicate_count,
       CAST(total_records - distinct_records AS DOUBLE) / total_records AS duplicate_fraction,
       CAST(total_records - distinct_records AS DOUBLE) / total_records <= 0.01 AS passed
FROM (SELECT COUNT(*) AS total_records, (SELECT COUNT(*) FROM (SELECT DISTINCT k, a, b FROM swapped) u) AS distinct_records
      FROM swapped) t""")
def _duplicates_swapped_nulls(spark, d):
    """The fingerprint mode on rows that differ only in which of two columns is NULL."""
    from tillscope.settings import Settings
    li = T.read(spark, d, "lineitem")
    null, key, value = F.lit(None).cast("long"), F.col("l_orderkey").alias("k"), F.col("l_suppkey")
    rows = li.select(key, null.alias("a"), value.alias("b")).unionAll(li.select(key, value.alias("a"), null.alias("b")))
    return Q.duplicate_profile(rows, settings=Settings(duplicate_mode="hash"))


@_register("remove_duplicates", _with(DIRTY_CTE, DEDUP_CTE) + "SELECT * FROM dedup")
def _remove_duplicates(spark, d):
    return Q.remove_duplicates(_sales(spark, d, dirty=True), ["transaction_id"])


@_register("null_drop", _with(NULLS_CTE) + "SELECT * FROM nsales WHERE "
           + " AND ".join(f"{c} IS NOT NULL" for c in SALES_COLS))
def _null_drop(spark, d):
    return Q.handle_null_values(T.sales_with_nulls(spark, d), "drop")


@_register("null_fill", _with(NULLS_CTE) + """
SELECT * REPLACE (COALESCE(sales_channel, 'UNKNOWN') AS sales_channel, COALESCE(store_id, '0') AS store_id)
FROM nsales""")
def _null_fill(spark, d):
    return Q.handle_null_values(T.sales_with_nulls(spark, d), "fill", {"sales_channel": "UNKNOWN", "store_id": "0"})


_LO, _HI = T.DATE_RANGE


@_register("date_range_filter", _with(SALES_CTE) + f"""
SELECT * FROM sales WHERE CAST(transaction_date AS DATE) >= DATE '{_LO}'
                      AND CAST(transaction_date AS DATE) <= DATE '{_HI}'""")
def _date_range_filter(spark, d):
    return Q.date_range_filter(_sales(spark, d), "transaction_date", _LO, _HI)


@_register("date_range_report", _with(SALES_CTE) + f"""
SELECT total_records, valid_records, total_records - valid_records AS invalid_records, null_dates,
       '{_LO} to {_HI}' AS date_range, total_records = valid_records AS passed
FROM (SELECT COUNT(*) AS total_records,
             COUNT(*) FILTER (WHERE CAST(transaction_date AS DATE) BETWEEN DATE '{_LO}' AND DATE '{_HI}') AS valid_records,
             COUNT(*) FILTER (WHERE transaction_date IS NULL) AS null_dates FROM sales) t""")
def _date_range_report(spark, d):
    return Q.date_range_report(_sales(spark, d), "transaction_date", _LO, _HI)


@_register("silver_sales", _with(DIRTY_CTE, SILVER_CTE) + "SELECT * FROM silver")
def _silver_sales(spark, d):
    return Q.silver_sales(_sales(spark, d, dirty=True))


@_register("silver_reconciliation", _with(DIRTY_CTE) + RECONCILED)
def _silver_reconciliation(spark, d):
    return Q.silver_reconciliation(_sales(spark, d, dirty=True))


@_register("quality_metrics", _with(DIRTY_CTE, CUSTOMERS_CTE, PRODUCTS_CTE) + """
SELECT CAST(nn AS DOUBLE) / NULLIF(CAST(n AS DOUBLE) * 4, 0) * 100.0 AS completeness_pct,
       CAST(d AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) * 100.0 AS uniqueness_pct,
       CAST(v AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) * 100.0 AS validity_pct,
       CAST(m AS DOUBLE) / NULLIF(CAST(n AS DOUBLE), 0) * 100.0 AS consistency_pct
FROM (SELECT COUNT(*) AS n,
             COUNT(s.transaction_id) + COUNT(s.customer_id) + COUNT(s.product_id) + COUNT(s.total_amount) AS nn,
             COUNT(DISTINCT s.transaction_id) AS d,
             COUNT(*) FILTER (WHERE COALESCE(s.total_amount > 0 AND s.total_amount < 100000
                                             AND s.quantity > 0 AND s.quantity <= 1000, FALSE)) AS v,
             COUNT(*) FILTER (WHERE c.customer_id IS NOT NULL AND p.product_id IS NOT NULL) AS m
      FROM dirty_sales s
      LEFT JOIN (SELECT DISTINCT customer_id FROM customers) c ON s.customer_id = c.customer_id
      LEFT JOIN (SELECT DISTINCT product_id FROM products) p ON s.product_id = p.product_id) t""")
def _quality_metrics(spark, d):
    return Q.quality_metrics(_sales(spark, d, dirty=True), T.customers(spark, d), T.products(spark, d))


@_register("orphan_sales", _with(SALES_CTE) + """
SELECT * FROM sales WHERE customer_id NOT IN (SELECT user_id FROM events)""")
def _orphan_sales(spark, d):
    """Sales of customers unknown to the event system: the whole event table is the master."""
    master = T.read(spark, d, "events").select(F.col("user_id").alias("customer_id"))
    return Q.orphan_sales(_sales(spark, d), master, "customer_id")


@_register("discount_violations", _with(SALES_CTE) + "SELECT * FROM sales WHERE discount_percentage > 0.08")
def _discount_violations(spark, d):
    return Q.discount_violations(_sales(spark, d), max_discount=0.08)


@_register("reject_summary", _with(NULLS_CTE) + """
SELECT reason, COUNT(*) AS rejected_records FROM (
  SELECT unnest(list_filter([
    CASE WHEN transaction_id IS NULL THEN 'transaction_id_not_null' END,
    CASE WHEN customer_id IS NULL THEN 'customer_id_not_null' END,
    CASE WHEN product_id IS NULL THEN 'product_id_not_null' END,
    CASE WHEN total_amount IS NULL THEN 'total_amount_not_null' END,
    CASE WHEN NOT COALESCE(total_amount > 0 AND total_amount < 100000, FALSE) THEN 'valid_amount' END,
    CASE WHEN NOT COALESCE(quantity > 0 AND quantity <= 1000, FALSE) THEN 'valid_quantity' END], lambda x: x IS NOT NULL))
    AS reason FROM nsales) r GROUP BY reason""")
def _reject_summary(spark, d):
    _, bad = Q.split_quarantine(T.sales_with_nulls(spark, d))
    return Q.reject_summary(bad)


@_register("daily_revenue_anomaly", _with(SALES_CTE) + """,
t AS (
SELECT sale_date, CAST(u AS DOUBLE) / 10000.0 AS daily_revenue,
       CAST(SUM(u) OVER w AS DOUBLE) / NULLIF(CAST(COUNT(u) OVER w AS DOUBLE), 0) / 10000.0 AS trailing_mean,
       CASE WHEN COUNT(u) OVER w > 1 THEN sqrt(CAST(COUNT(u) OVER w * SUM(u * u) OVER w - SUM(u) OVER w * SUM(u) OVER w AS DOUBLE)
            / CAST(COUNT(u) OVER w * (COUNT(u) OVER w - 1) AS DOUBLE)) / 10000.0 END AS trailing_stddev
FROM (SELECT CAST(transaction_date AS DATE) AS sale_date, CAST(SUM(total_amount) * 10000 AS DECIMAL(38,0)) AS u
      FROM sales GROUP BY 1) d
WINDOW w AS (ORDER BY sale_date RANGE BETWEEN INTERVAL 28 DAYS PRECEDING AND INTERVAL 1 DAYS PRECEDING))
SELECT *, (daily_revenue - trailing_mean) / NULLIF(trailing_stddev, 0) AS z_score,
       COALESCE(abs((daily_revenue - trailing_mean) / NULLIF(trailing_stddev, 0)) >= 3.0, FALSE) AS is_anomaly
FROM t""")
def _daily_revenue_anomaly(spark, d):
    return Q.daily_revenue_anomaly(_sales(spark, d))


# ----------------------------------------------------------------------------
# SQL dashboard statements over the sales / customers / products views

def _bi(spark, d, views: str = "sales"):
    """Register only the views a statement reads (the customer view writes an
    intermediate table when built)."""
    sales = _sales(spark, d)
    BI.register_views(
        spark, sales=sales,
        customers=C.customer_360_from_sales(sales, T.customers(spark, d), REF) if "customers" in views else None,
        products=S.product_margins(sales, T.products(spark, d)) if "products" in views else None)


_C360_CTE = "c360 AS (" + C360_SQL + ")"
_PP_CTE = "ppv AS (" + _with(SALES_CTE, PRODUCTS_CTE, _PRODUCT_SALES, _PRODUCT_PERF) + "SELECT * FROM pp)"
_KPI_LO = T.KPI_MONTH_START


@_register("sql_kpi_month", _with(SALES_CTE) + f"""
SELECT COUNT(DISTINCT transaction_id) AS total_transactions, COUNT(DISTINCT customer_id) AS unique_customers,
       {_DBL} AS total_revenue, {_AVG} AS avg_order_value,
       {_DBL} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer
FROM sales WHERE year(transaction_date) = year(DATE '{_KPI_LO}') AND month(transaction_date) = month(DATE '{_KPI_LO}')""")
def _sql_kpi_month(spark, d):
    _bi(spark, d)
    return BI.kpi_month(spark, _KPI_LO)


@_register("sql_monthly_growth", _with(SALES_CTE) + """
SELECT month, CAST(revenue AS DOUBLE) AS revenue, CAST(prev AS DOUBLE) AS prev_month_revenue,
       ROUND(CAST(revenue - prev AS DOUBLE) / NULLIF(CAST(prev AS DOUBLE), 0) * 100.0, 2) AS mom_growth_pct
FROM (SELECT month, revenue, LAG(revenue) OVER (ORDER BY month) AS prev FROM (
        SELECT date_trunc('month', transaction_date) AS month, SUM(total_amount) AS revenue FROM sales GROUP BY 1) a) b
ORDER BY month DESC LIMIT 12""")
def _sql_monthly_growth(spark, d):
    _bi(spark, d)
    return BI.monthly_growth(spark, 12)


@_register("sql_revenue_by_region", _with(SALES_CTE) + f"""
SELECT region, COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT transaction_id) AS transactions,
       {_DBL} AS total_revenue, {_AVG} AS avg_order_value,
       {_DBL} / NULLIF(COUNT(DISTINCT customer_id), 0) AS revenue_per_customer
FROM sales GROUP BY region""")
def _sql_revenue_by_region(spark, d):
    _bi(spark, d)
    return BI.revenue_by_region(spark)


@_register("sql_segment_summary", _with(_C360_CTE) + """
SELECT customer_segment, COUNT(*) AS customer_count,
       ROUND(CAST(COUNT(*) AS DOUBLE) * 100.0 / SUM(COUNT(*)) OVER (), 2) AS percentage,
       AVG(projected_clv) AS avg_clv, AVG(frequency) AS avg_purchases
FROM c360 WHERE customer_segment IS NOT NULL GROUP BY customer_segment""")
def _sql_segment_summary(spark, d):
    _bi(spark, d, "customers")
    return BI.segment_summary(spark)


@_register("sql_high_value_at_risk", _with(_C360_CTE) + f"""
SELECT customer_id, first_name, last_name, email, projected_clv, days_since_last_purchase, churn_risk
FROM c360 WHERE projected_clv > {T.HIGH_VALUE_AT_RISK_CLV} AND churn_risk IN ('High', 'Medium')
ORDER BY projected_clv DESC, customer_id LIMIT 50""")
def _sql_high_value_at_risk(spark, d):
    _bi(spark, d, "customers")
    return BI.high_value_at_risk(spark, T.HIGH_VALUE_AT_RISK_CLV, 50)


@_register("sql_cohort_retention", _with(SALES_CTE) + """,
first_purchase AS (
  SELECT customer_id, date_trunc('month', MIN(transaction_date)) AS cohort_month FROM sales GROUP BY customer_id),
cohort_activity AS (
  SELECT fp.cohort_month, date_trunc('month', s.transaction_date) AS activity_month,
         COUNT(DISTINCT s.customer_id) AS active_customers
  FROM first_purchase fp JOIN sales s ON fp.customer_id = s.customer_id
  GROUP BY fp.cohort_month, date_trunc('month', s.transaction_date))
SELECT cohort_month, activity_month, active_customers,
       CAST(datediff('month', cohort_month, activity_month) AS DOUBLE) AS months_since_first_purchase
FROM cohort_activity""")
def _sql_cohort_retention(spark, d):
    _bi(spark, d)
    return BI.cohort_retention(spark)


@_register("sql_top20_products", _with(_PP_CTE) + """
SELECT product_id, product_name, category, total_revenue, total_quantity_sold, unique_buyers,
       ROUND(profit_margin_pct, 2) AS profit_margin_pct, revenue_rank
FROM ppv WHERE revenue_rank <= 20""")
def _sql_top20_products(spark, d):
    _bi(spark, d, "products")
    return BI.top_products(spark, 20)


@_register("sql_category_comparison", _with(_PP_CTE) + """
SELECT category, COUNT(DISTINCT product_id) AS product_count,
       CAST(SUM(CAST(total_revenue AS DECIMAL(38, 4))) AS DOUBLE) AS category_revenue,
       CAST(SUM(total_quantity_sold) AS BIGINT) AS units_sold, AVG(profit_margin_pct) AS avg_profit_margin,
       COUNT(DISTINCT unique_buyers) AS distinct_buyer_counts
FROM ppv WHERE category IS NOT NULL GROUP BY category""")
def _sql_category_comparison(spark, d):
    _bi(spark, d, "products")
    return BI.category_comparison(spark)


@_register("sql_underperforming", _with(_PP_CTE) + f"""
SELECT product_id, product_name, category, total_revenue, profit_margin_pct, total_quantity_sold
FROM ppv WHERE total_revenue < {T.UNDERPERFORMING_REVENUE} OR profit_margin_pct < {T.UNDERPERFORMING_MARGIN}
ORDER BY total_revenue ASC NULLS FIRST, product_id LIMIT 20""")
def _sql_underperforming(spark, d):
    _bi(spark, d, "products")
    return BI.underperforming(spark, T.UNDERPERFORMING_REVENUE, T.UNDERPERFORMING_MARGIN, 20)


@_register("sql_channel_comparison", _with(SALES_CTE) + f"""
SELECT sales_channel, COUNT(DISTINCT transaction_id) AS transactions, COUNT(DISTINCT customer_id) AS customers,
       {_DBL} AS revenue, {_AVG} AS avg_order_value,
       ROUND({_DBL} * 100.0 / CAST(SUM(SUM(total_amount)) OVER () AS DOUBLE), 2) AS revenue_share_pct
FROM sales GROUP BY sales_channel""")
def _sql_channel_comparison(spark, d):
    _bi(spark, d)
    return BI.channel_comparison(spark)


@_register("sql_day_of_week", _with(SALES_CTE) + f"""
SELECT CAST(dayofweek(transaction_date) + 1 AS INTEGER) AS day_of_week,
       CASE dayofweek(transaction_date) + 1 WHEN 1 THEN 'Sunday' WHEN 2 THEN 'Monday' WHEN 3 THEN 'Tuesday'
         WHEN 4 THEN 'Wednesday' WHEN 5 THEN 'Thursday' WHEN 6 THEN 'Friday' WHEN 7 THEN 'Saturday' END AS day_name,
       COUNT(*) AS transactions, {_DBL} AS revenue, {_AVG} AS avg_order_value
FROM sales GROUP BY 1, 2""")
def _sql_day_of_week(spark, d):
    _bi(spark, d)
    return BI.day_of_week(spark)


@_register("sql_hour_of_day", """
SELECT CAST(hour(ts) AS INTEGER) AS hour, COUNT(*) AS transactions,
       CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS revenue
FROM events GROUP BY 1""")
def _sql_hour_of_day(spark, d):
    BI.register_views(spark, sales=T.event_sales(spark, d))
    return BI.hour_of_day(spark)


@_register("vw_executive_dashboard", _with(SALES_CTE) + f"""
SELECT date_trunc('month', transaction_date) AS month, region, sales_channel,
       COUNT(DISTINCT transaction_id) AS transactions, COUNT(DISTINCT customer_id) AS customers,
       {_DBL} AS revenue, {_AVG} AS avg_order_value
FROM sales GROUP BY 1, 2, 3""")
def _vw_executive_dashboard(spark, d):
    _bi(spark, d)
    return BI.executive_dashboard(spark)


@_register("dashboard_rollup", _with(SALES_CTE) + f"""
SELECT date_trunc('month', transaction_date) AS month, region, sales_channel,
       COUNT(DISTINCT transaction_id) AS transactions, COUNT(DISTINCT customer_id) AS customers,
       {_DBL} AS revenue, {_AVG} AS avg_order_value,
       CAST(GROUPING(date_trunc('month', transaction_date)) + GROUPING(region) + GROUPING(sales_channel) AS INTEGER)
         AS grouping_level
FROM sales GROUP BY ROLLUP (date_trunc('month', transaction_date), region, sales_channel)""")
def _dashboard_rollup(spark, d):
    return S.dashboard_rollup(_sales(spark, d))


@_register("vw_customer_health", _with(_C360_CTE) + """
SELECT customer_id, first_name || ' ' || last_name AS customer_name, email, region, customer_segment, projected_clv,
       frequency AS total_purchases, monetary_value AS lifetime_spend, days_since_last_purchase, churn_risk
FROM c360""")
def _vw_customer_health(spark, d):
    _bi(spark, d, "customers")
    return BI.customer_health(spark)


@_register("cohort_retention", _SQL["sql_cohort_retention"])
def _cohort_df(spark, d):
    return C.first_purchase_cohorts(_sales(spark, d))


# ----------------------------------------------------------------------------
# inventory

_LATEST = """latest AS (
  SELECT product_id, warehouse_id, arg_max(quantity_on_hand, snapshot_date) AS quantity_on_hand,
         arg_max(quantity_reserved, snapshot_date) AS quantity_reserved,
         arg_max(quantity_available, snapshot_date) AS quantity_available,
         arg_max(reorder_point, snapshot_date) AS reorder_point, MAX(snapshot_date) AS snapshot_date
  FROM inventory GROUP BY product_id, warehouse_id)"""


@_register("stock_levels", _with(INVENTORY_CTE, _LATEST) + """
SELECT product_id, COUNT(warehouse_id) AS warehouse_count, CAST(SUM(quantity_on_hand) AS BIGINT) AS quantity_on_hand,
       CAST(SUM(quantity_reserved) AS BIGINT) AS quantity_reserved,
       CAST(SUM(quantity_available) AS BIGINT) AS quantity_available, MAX(snapshot_date) AS snapshot_date
FROM latest GROUP BY product_id""")
def _stock_levels(spark, d):
    return I.stock_levels(T.inventory(spark, d))


@_register("reorder_alerts", _with(INVENTORY_CTE, _LATEST) + """
SELECT *, CAST(greatest(0, ceil(effective_reorder_point * 1.5) - quantity_available) AS INTEGER)
          AS suggested_order_quantity
FROM (SELECT *, CAST(COALESCE(reorder_point, 50) AS INTEGER) AS effective_reorder_point FROM latest) l
WHERE quantity_available <= effective_reorder_point""")
def _reorder_alerts(spark, d):
    return I.reorder_alerts(T.inventory(spark, d))


@_register("inventory_turnover", _with(SALES_CTE, PRODUCTS_CTE, INVENTORY_CTE) + """,
sold AS (SELECT product_id, CAST(SUM(quantity) AS BIGINT) AS units_sold FROM sales
         WHERE CAST(transaction_date AS DATE) BETWEEN DATE '2001-07-01' AND DATE '2001-08-01' GROUP BY product_id),
inv AS (SELECT product_id, AVG(oh) AS avg_units_on_hand FROM (
          SELECT product_id, snapshot_date, CAST(SUM(quantity_on_hand) AS BIGINT) AS oh FROM inventory
          WHERE snapshot_date BETWEEN DATE '2001-07-01' AND DATE '2001-08-01' GROUP BY 1, 2) x GROUP BY product_id),
j AS (SELECT p.product_id, p.unit_cost, i.avg_units_on_hand, s.units_sold,
             p.unit_cost * COALESCE(s.units_sold, 0) AS cogs, p.unit_cost * i.avg_units_on_hand AS avg_stock_value
      FROM products p LEFT JOIN inv i ON p.product_id = i.product_id LEFT JOIN sold s ON p.product_id = s.product_id),
t AS (SELECT *, cogs / NULLIF(avg_stock_value, 0) AS turnover FROM j)
SELECT *, 32.0 / CASE WHEN turnover > 0 THEN turnover END AS days_of_inventory FROM t""")
def _inventory_turnover(spark, d):
    return I.inventory_turnover(_sales(spark, d), T.products(spark, d), T.inventory(spark, d),
                                "2001-07-01", "2001-08-01")


@_register("inventory_turnover_no_snapshot", _SQL["inventory_turnover"].replace(
    "'2001-07-01'", "'2001-07-02'").replace("'2001-08-01'", "'2001-07-31'").replace("32.0 /", "30.0 /")
    .replace(INVENTORY_CTE.replace("'2001-07-01'", "'2001-07-02'").replace("'2001-08-01'", "'2001-07-31'"), INVENTORY_CTE))
def _inventory_turnover_no_snapshot(spark, d):
    """A period without any snapshot: every product stays, without stock figures."""
    return I.inventory_turnover(_sales(spark, d), T.products(spark, d), T.inventory(spark, d),
                                "2001-07-02", "2001-07-31")


@_register("stock_cover_days", _with(SALES_CTE, INVENTORY_CTE, _LATEST) + """,
vel AS (SELECT sale_date, product_id,
               CAST(SUM(daily_quantity) OVER w AS DOUBLE) / NULLIF(COUNT(daily_quantity) OVER w, 0) AS aq
        FROM (SELECT CAST(transaction_date AS DATE) AS sale_date, product_id,
                     CAST(SUM(quantity) AS BIGINT) AS daily_quantity FROM sales GROUP BY 1, 2) d
        WINDOW w AS (PARTITION BY product_id ORDER BY sale_date
                     RANGE BETWEEN INTERVAL 30 DAYS PRECEDING AND CURRENT ROW)),
rate AS (SELECT product_id, arg_max(aq, sale_date) AS avg_daily_quantity, MAX(sale_date) AS last_sale_date
         FROM vel GROUP BY product_id),
stock AS (SELECT product_id, CAST(SUM(quantity_available) AS BIGINT) AS quantity_available FROM latest
          GROUP BY product_id)
SELECT s.product_id, s.quantity_available, r.avg_daily_quantity, r.last_sale_date,
       CAST(s.quantity_available AS DOUBLE) / CASE WHEN r.avg_daily_quantity > 0 THEN r.avg_daily_quantity END
         AS stock_cover_days
FROM stock s LEFT JOIN rate r ON s.product_id = r.product_id""")
def _stock_cover_days(spark, d):
    return I.stock_cover(_sales(spark, d), T.inventory(spark, d), 30)


# ----------------------------------------------------------------------------
# sources and sinks: round trips through files in the shared folder

@_register("load_sales", _with(SALES_CTE) + """
SELECT transaction_id, transaction_date, CAST(customer_id AS VARCHAR) AS customer_id,
       CAST(product_id AS VARCHAR) AS product_id, quantity, unit_price, discount_percentage,
       CAST(total_amount AS DOUBLE) AS total_amount, payment_method, sales_channel, region, store_id FROM sales""")
def _load_sales(spark, d):
    path = K.write_table(_sales(spark, d), fresh_path(spark, "sales-csv"), "csv")
    return L.load_sales(spark, path, "csv")


@_register("load_customers", _with(CUSTOMERS_CTE) + """
SELECT CAST(customer_id AS VARCHAR) AS customer_id, first_name, last_name, email, CAST(NULL AS VARCHAR) AS phone,
       CAST(NULL AS DATE) AS registration_date, country, region, CAST(NULL AS VARCHAR) AS city, market_segment,
       is_active FROM customers""")
def _load_customers(spark, d):
    path = K.write_table(T.customers(spark, d), fresh_path(spark, "customers-json"), "json")
    return L.load_customers(spark, path, "json")


@_register("load_customers_segment", _SQL["load_customers"])
def _load_customers_segment(spark, d):
    """JSON whose segment column has the source's own name."""
    c = T.customers(spark, d).withColumnRenamed("market_segment", "customer_segment")
    return L.load_customers(spark, K.write_table(c, fresh_path(spark, "customers-json"), "json"), "json")


_BAD_TEXT = "CASE WHEN l_linenumber = 2 THEN 'many' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"


@_register("load_malformed", """
SELECT l_orderkey || '-' || l_linenumber AS transaction_id,
       CASE WHEN l_linenumber = 2 THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS quantity,
       CAST(l_partkey AS VARCHAR) AS product_id, l_linenumber = 2 AS is_corrupt, COUNT(*) AS record_count
FROM lineitem GROUP BY ALL""")
def _load_malformed(spark, d):
    """A CSV with its columns in another order and an unreadable quantity: every record is loaded, and the
    malformed ones are parted with their text."""
    li = T.read(spark, d, "lineitem")
    rows = li.select(F.col("l_partkey").alias("product_id"), F.expr(_BAD_TEXT).alias("quantity"),
                     F.concat_ws("-", "l_orderkey", "l_linenumber").alias("transaction_id"))
    path = K.write_table(rows, fresh_path(spark, "sales-malformed"), "csv")
    good, bad = L.split_corrupt(L.load_sales(spark, path, "csv", keep_corrupt=True))
    keys = ["transaction_id", "quantity", "product_id"]
    both = good.select(*keys, F.lit(False).alias("is_corrupt")).unionByName(
        bad.select(*keys, F.col("_corrupt_record").contains("many").alias("is_corrupt")))
    return both.groupBy(*keys, "is_corrupt").agg(F.count(F.lit(1)).alias("record_count"))


@_register("load_products", _with(PRODUCTS_CTE) + """
SELECT CAST(product_id AS VARCHAR) AS product_id, product_name, category, subcategory, brand, unit_cost, unit_price,
       CAST(NULL AS DATE) AS launch_date, CAST(NULL AS VARCHAR) AS is_active FROM products""")
def _load_products(spark, d):
    path = K.write_table(T.products(spark, d), fresh_path(spark, "products-parquet"), "parquet")
    return L.load_products(spark, path, "parquet")


@_register("load_inventory", _with(INVENTORY_CTE) + """
SELECT CAST(product_id AS VARCHAR) AS product_id, warehouse_id, quantity_on_hand, quantity_reserved,
       quantity_available, reorder_point, snapshot_date FROM inventory""")
def _load_inventory(spark, d):
    path = K.write_table(T.inventory(spark, d), fresh_path(spark, "inventory-csv"), "csv")
    return L.load_inventory(spark, path, "csv")


@_register("medallion_counts", _with(DIRTY_CTE, CUSTOMERS_CTE, PRODUCTS_CTE, SILVER_CTE) + """
SELECT 'bronze' AS layer, 'sales' AS table_name, (SELECT COUNT(*) FROM dirty_sales) AS record_count
UNION ALL SELECT 'bronze', 'customers', (SELECT COUNT(*) FROM customers)
UNION ALL SELECT 'bronze', 'products', (SELECT COUNT(*) FROM products)
UNION ALL SELECT 'silver', 'sales', (SELECT COUNT(*) FROM silver)
UNION ALL SELECT 'silver', 'customers', (SELECT COUNT(*) FROM customers)
UNION ALL SELECT 'silver', 'products', (SELECT COUNT(*) FROM products)
UNION ALL SELECT 'gold', 'customer_analytics', (SELECT COUNT(*) FROM customers)
UNION ALL SELECT 'gold', 'product_performance', (SELECT COUNT(*) FROM products)
UNION ALL SELECT 'gold', 'monthly_trends',
  (SELECT COUNT(*) FROM (SELECT DISTINCT year(transaction_date), month(transaction_date), region FROM silver) m)
UNION ALL SELECT 'gold', 'regional_performance', (SELECT COUNT(DISTINCT region) FROM silver)""")
def _medallion_counts(spark, d):
    _, counts = _medallion(spark, d, customer_buckets=8)
    return counts


def _medallion(spark, d, **kw):
    return M.run(spark, _sales(spark, d, dirty=True), T.customers(spark, d), T.products(spark, d), **kw)


@_register("run_metrics", _SQL["medallion_counts"] + f"""
UNION ALL SELECT 'quarantine', 'rejected_sales',
  (SELECT COUNT(*) FROM dirty_sales WHERE NOT COALESCE({VALID_SALE}, FALSE))""")
def _run_metrics(spark, d):
    lay, _ = _medallion(spark, d)
    m = M.metrics_table(spark, lay)
    return m.select(F.split("stage", r"\.")[0].alias("layer"), F.split("stage", r"\.")[1].alias("table_name"),
                    "record_count")


@_register("medallion_reconciliation", _with(DIRTY_CTE) + RECONCILED)
def _medallion_reconciliation(spark, d):
    """The written bronze, silver and quarantine tables against each other."""
    lay, _ = _medallion(spark, d)
    return M.reconciliation(spark, lay)


def _gold(table: str):
    def query(spark, d):
        lay, _ = _medallion(spark, d)
        return K.read_table(spark, lay.path("gold", table))
    return query


# the gold tables' contents: the statements of the same operators over the silver rows
_GOLD_BASE = _with(DIRTY_CTE, CUSTOMERS_CTE, PRODUCTS_CTE, SILVER_CTE, "sales AS (SELECT * FROM silver)")
for _table, _key, _pick in (("customer_analytics", "customer_clv", "*"), ("product_performance", "product_performance", "*"),
                            ("monthly_trends", "monthly_mom", "*"),
                            ("regional_performance", "regional_performance",
                             "region, total_revenue, transaction_count, unique_customers, avg_order_value, "
                             "revenue_per_customer")):
    _body = _SQL[_key]
    for _cte in (SALES_CTE, CUSTOMERS_CTE, PRODUCTS_CTE):
        _body = _body.replace(_cte, "").strip()
    _body = _body.removeprefix("WITH").lstrip(" ,\n")
    _sep = "" if _body.upper().startswith("SELECT") else ",\n"
    _register(f"gold_{_table}", f"SELECT {_pick} FROM ({_GOLD_BASE.rstrip()}{_sep}\n{_body}) g")(_gold(_table))


@_register("partitioned_scan", _with(SALES_CTE) + f"""
SELECT region, {_DBL} AS revenue, COUNT(transaction_id) AS transaction_count FROM sales
WHERE year(transaction_date) = 2000 AND month(transaction_date) = 3 GROUP BY region""")
def _partitioned_scan(spark, d):
    s = _sales(spark, d).withColumns({"year": F.year("transaction_date"), "month": F.month("transaction_date")})
    path = K.write_table(s, fresh_path(spark, "sales-by-month"), partition_by=["year", "month"])
    back = K.read_table(spark, path).where((F.col("year") == 2000) & (F.col("month") == 3))
    return S.region_revenue_since(back, "1900-01-01")


@_register("bronze_ingest", _with(SALES_CTE) + """
SELECT CASE WHEN transaction_date < TIMESTAMP '1998-01-01 00:00:00' THEN 'b1' ELSE 'b2' END AS batch_id,
       'erp' AS source_system, COUNT(*) AS record_count, COUNT(*) AS with_ingest_ts
FROM sales GROUP BY 1""")
def _bronze_ingest(spark, d):
    s = _sales(spark, d)
    path = fresh_path(spark, "bronze-append")
    early = F.col("transaction_date") < F.to_timestamp(F.lit("1998-01-01"))
    K.append_bronze(s.where(early), path, "erp", "b1")
    K.append_bronze(s.where(~early), path, "erp", "b2")
    back = K.read_table(spark, path)
    return back.groupBy("batch_id", "source_system").agg(F.count(F.lit(1)).alias("record_count"),
                                                         F.count("ingest_ts").alias("with_ingest_ts"))


@_register("quarantine", _SQL["reject_summary"])
def _quarantine(spark, d):
    clean, bad = Q.split_quarantine(T.sales_with_nulls(spark, d))
    path = K.write_quarantine(bad, fresh_path(spark, "quarantine"))
    return Q.reject_summary(K.read_table(spark, path))


@_register("salted_join", _with(SALES_CTE, CUSTOMERS_CTE) + f"""
SELECT c.market_segment, {_DBL} AS revenue, COUNT(*) AS transaction_count
FROM sales s JOIN customers c ON s.customer_id = c.customer_id GROUP BY c.market_segment""")
def _salted_join(spark, d):
    j = SK.salted_join(_sales(spark, d).select("customer_id", "transaction_id", "total_amount"),
                       T.customers(spark, d).select("customer_id", "market_segment"), "customer_id", 8)
    return j.groupBy("market_segment").agg(F.sum("total_amount").cast("double").alias("revenue"),
                                           F.count(F.lit(1)).alias("transaction_count"))


# ----------------------------------------------------------------------------
# streaming tier: events as a file stream, availableNow into a Parquet sink

_EV_MAX = "(SELECT MAX(CAST(ts AS TIMESTAMP)) FROM events)"
_EV_REV = "CAST(SUM(CAST(value AS DECIMAL(12,2))) AS DOUBLE)"


@_register("stream_silver", """
SELECT CAST(event_id AS VARCHAR) AS transaction_id, CAST(ts AS TIMESTAMP) AS transaction_date, user_id AS customer_id,
       CAST(value AS DECIMAL(12,2)) AS total_amount, event_type AS sales_channel
FROM events WHERE CAST(value AS DECIMAL(12,2)) > 0 AND CAST(value AS DECIMAL(12,2)) < 100000""")
def _stream_silver(spark, d):
    # the same feed delivered twice: duplicates are removed within the watermark
    feed = ST.event_sales_stream(spark, d).unionByName(ST.event_sales_stream(spark, d))
    return ST.run_available(ST.stream_silver(feed, "1 day"), "stream-silver")


@_register("stream_daily_revenue", f"""
SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
       event_type AS sales_channel, {_EV_REV} AS revenue, COUNT(*) AS transaction_count
FROM events GROUP BY 1, 2, 3""")
def _stream_daily_revenue(spark, d):
    return ST.run_bounded(ST.stream_revenue(ST.event_sales_stream(spark, d), "1 day", None, "1 day"), "stream-daily")


@_register("stream_sliding", f"""
SELECT ws AS window_start, ws + INTERVAL 2 DAY AS window_end, event_type AS sales_channel,
       {_EV_REV} AS revenue, COUNT(*) AS transaction_count
FROM (SELECT date_trunc('day', ts) AS ws, * FROM events
      UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY AS ws, * FROM events) e
GROUP BY 1, 2, 3""")
def _stream_sliding(spark, d):
    return ST.run_bounded(ST.stream_revenue(ST.event_sales_stream(spark, d), "2 days", "1 day", "1 day"),
                          "stream-sliding")


@_register("stream_daily_closed", f"""
SELECT * FROM ({_SQL["stream_daily_revenue"]}) w WHERE window_end <= {_EV_MAX} - INTERVAL 1 DAY""")
def _stream_daily_closed(spark, d):
    """Append mode, as for an endless feed: the windows that the watermark has closed."""
    return ST.run_available(ST.stream_revenue(ST.event_sales_stream(spark, d), "1 day", None, "1 day"),
                            "stream-closed")


@_register("stream_sessions", f"""
WITH f AS (
  SELECT user_id AS customer_id, CAST(ts AS TIMESTAMP) AS ts, value,
         CASE WHEN LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL
                OR ts >= LAG(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new_s
  FROM events),
g AS (SELECT *, SUM(new_s) OVER (PARTITION BY customer_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM f)
SELECT customer_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end,
       COUNT(*) AS transaction_count, {_EV_REV} AS revenue
FROM g GROUP BY customer_id, sid""")
def _stream_sessions(spark, d):
    return ST.run_bounded(ST.stream_sessions(ST.event_sales_stream(spark, d), "30 minutes", "1 hour"),
                          "stream-sessions")


@_register("stream_view_to_purchase", """
SELECT v.user_id AS customer_id, CAST(v.event_id AS VARCHAR) AS first_id, CAST(v.ts AS TIMESTAMP) AS first_at,
       CAST(p.event_id AS VARCHAR) AS second_id, CAST(p.ts AS TIMESTAMP) AS second_at,
       CAST(floor(epoch(CAST(p.ts AS TIMESTAMP))) - floor(epoch(CAST(v.ts AS TIMESTAMP))) AS BIGINT) AS seconds_between
FROM events v JOIN events p ON v.user_id = p.user_id AND p.ts > v.ts AND p.ts <= v.ts + INTERVAL 6 HOUR
WHERE v.event_type = 'view' AND p.event_type = 'purchase'""")
def _stream_view_to_purchase(spark, d):
    of = lambda kind: ST.event_sales_stream(spark, d).where(F.col("sales_channel") == kind)
    return ST.run_available(ST.stream_followed_by(of("view"), of("purchase"), "6 hours"), "stream-view-to-purchase")


@_register("stream_enriched", _with(CUSTOMERS_CTE) + """
SELECT e.user_id AS customer_id, CAST(e.event_id AS VARCHAR) AS transaction_id,
       CAST(e.ts AS TIMESTAMP) AS transaction_date, CAST(e.value AS DECIMAL(12,2)) AS total_amount,
       e.event_type AS sales_channel, c.region, c.market_segment
FROM events e LEFT JOIN customers c ON e.user_id = c.customer_id""")
def _stream_enriched(spark, d):
    return ST.run_available(ST.stream_enriched(ST.event_sales_stream(spark, d), T.customers(spark, d)),
                            "stream-enriched")


# ----------------------------------------------------------------------------
# operators for training data: there only if their subpackage is

try:
    import corpus_pipeline
    from tillscope.llm import queries as LLM
except ImportError:
    LLM = None
else:
    _QUERIES.update(LLM.QUERIES)
    _SQL.update(LLM.SQL)
    _QUERIES["pipeline"] = corpus_pipeline.run


# ----------------------------------------------------------------------------
# contract

def entry(spark: SparkSession) -> DataFrame:
    """Flagship: the single customer view (RFM scores and segment, CLV, churn) at sf0.001."""
    return _customer_360(spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["entry", "queries", "oracle_sql"]
