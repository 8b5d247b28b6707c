"""Routines that are called from SQL: functions that return tables, and scripts with named parameters.

register() makes the tables of a database views (retail_<table>) and the functions temporary ones of the session, so that `spark.sql` can join, filter and page what they return. Scripts hold what needs statements
one after another: values that aren't given, refusals, and text that is put together from whitelisted names, with all values bound by USING.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.catalog import Database
from .patterns import EXCLUDED

PREFIX = "retail_"
_NOT_COUNTED = ", ".join(f"'{s}'" for s in EXCLUDED)

#: name, parameters, columns and query of each function.
FUNCTIONS = {
    "monthly_sales_summary": (
        "p_year INT, p_month INT",
        "category STRING, product_name STRING, units_sold BIGINT, revenue DECIMAL(19,4), avg_selling_price DECIMAL(19,4), order_count BIGINT, category_revenue DECIMAL(19,4), rank_in_category BIGINT",
        """
        WITH sold AS (
          SELECT p.category, p.product_id, p.product_name, sum(l.quantity) AS units, CAST(sum(CAST(l.quantity * l.unit_price AS DECIMAL(19,4))) AS DECIMAL(19,4)) AS revenue, CAST(avg(l.unit_price) AS DECIMAL(19,4)) AS price, count(DISTINCT o.order_id) AS orders
          FROM retail_orders o JOIN retail_order_lines l ON l.order_id = o.order_id JOIN retail_products p ON p.product_id = l.product_id
          WHERE o.created_at BETWEEN CAST(make_date(p_year, p_month, 1) AS TIMESTAMP_NTZ) AND CAST(last_day(make_date(p_year, p_month, 1)) AS TIMESTAMP_NTZ) AND o.status <> 'Cancelled'
          GROUP BY p.category, p.product_id, p.product_name)
        SELECT category, product_name, CAST(units AS BIGINT), revenue, price, orders, CAST(sum(revenue) OVER (PARTITION BY category) AS DECIMAL(19,4)), CAST(rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS BIGINT) FROM sold""",
    ),
    "revenue_by_month": (
        "p_start DATE, p_end DATE",
        "period_start DATE, order_count INT, revenue DECIMAL(19,4)",
        f"""
        WITH months AS (SELECT explode(CASE WHEN p_start < p_end THEN sequence(trunc(p_start, 'MM'), date_sub(p_end, 1), INTERVAL 1 MONTH) ELSE CAST(array() AS ARRAY<DATE>) END) AS m),
        sums AS (SELECT trunc(created_at, 'MM') AS m, count(total_amount) AS n, sum(total_amount) AS total FROM retail_orders WHERE created_at >= CAST(p_start AS TIMESTAMP_NTZ) AND created_at < CAST(p_end AS TIMESTAMP_NTZ) AND status NOT IN ({_NOT_COUNTED}) GROUP BY 1)
        SELECT months.m, CAST(coalesce(n, 0) AS INT), CAST(coalesce(total, 0) AS DECIMAL(19,4)) FROM months LEFT JOIN sums ON sums.m = months.m""",
    ),
    "top_products_per_category": (
        "p_start DATE, p_end DATE, p_n INT DEFAULT 3",
        "category STRING, sku STRING, units BIGINT, rnk BIGINT",
        f"""
        WITH sold AS (
          SELECT p.category, p.sku, CAST(sum(l.quantity) AS BIGINT) AS units FROM retail_orders o JOIN retail_order_lines l ON l.order_id = o.order_id JOIN retail_products p ON p.product_id = l.product_id
          WHERE o.created_at >= CAST(p_start AS TIMESTAMP_NTZ) AND o.created_at < CAST(p_end AS TIMESTAMP_NTZ) AND o.status NOT IN ({_NOT_COUNTED}) GROUP BY p.category, p.sku),
        ranked AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY category ORDER BY units DESC) AS BIGINT) AS rnk FROM sold)
        SELECT category, sku, units, rnk FROM ranked WHERE rnk <= p_n""",
    ),
    "customer_orders": (
        "p_customer BIGINT",
        "order_id BIGINT, created_at TIMESTAMP_NTZ, status STRING, total_amount DECIMAL(19,4)",
        "SELECT o.order_id, o.created_at, o.status, o.total_amount FROM retail_orders o WHERE o.customer_id = p_customer",
    ),
}

#: search_products: the sort column is looked up, all else is bound.
SEARCH_PRODUCTS = """
BEGIN
  DECLARE wanted STRING DEFAULT lower(replace(coalesce(:sort_column, 'price'), '_', ''));
  DECLARE sort_by STRING DEFAULT CASE wanted WHEN 'productname' THEN 'product_name' WHEN 'createdat' THEN 'created_at' WHEN 'sku' THEN 'sku' ELSE 'price' END;
  DECLARE way STRING DEFAULT CASE WHEN upper(coalesce(:sort_dir, '')) = 'DESC' THEN 'DESC' ELSE 'ASC' END;
  DECLARE low DECIMAL(19,4) DEFAULT CAST(:min_price AS DECIMAL(19,4));
  DECLARE high DECIMAL(19,4) DEFAULT CAST(:max_price AS DECIMAL(19,4));
  DECLARE needle STRING DEFAULT :search_text;
  DECLARE pattern STRING DEFAULT '%' || replace(needle, '\\\\', '\\\\\\\\') || '%';
  DECLARE day DATE DEFAULT CAST(:as_of AS DATE);
  DECLARE skipped BIGINT DEFAULT CAST((:page_number - 1) * :page_size AS BIGINT);
  DECLARE upto BIGINT DEFAULT skipped + :page_size;
  DECLARE text STRING DEFAULT 'WITH first_ones AS (SELECT p.*, c.category_name FROM retail_products p JOIN retail_categories c ON c.category_id = p.category_id
    WHERE p.is_active AND (:low IS NULL OR p.price >= :low) AND (:high IS NULL OR p.price <= :high) AND (:pattern IS NULL OR p.product_name ILIKE :pattern) ORDER BY ' || sort_by || ' ' || way || ', product_id LIMIT ' || upto || '),
    numbered AS (SELECT *, row_number() OVER (ORDER BY ' || sort_by || ' ' || way || ', product_id) AS k FROM first_ones)
    SELECT CAST(product_id AS INT) AS product_id, product_name, sku, price, CAST(category_id AS INT) AS category_id, category_name, CASE WHEN coalesce(:needle, '''') = '''' THEN 0 ELSE instr(lower(product_name), lower(:needle)) END AS match_position, datediff(:day, CAST(created_at AS DATE)) AS age_days
    FROM numbered WHERE k > ' || skipped || ' ORDER BY k';
  IF :page_number < 1 OR :page_size < 1 THEN SELECT raise_error('pages and their sizes begin at 1'); END IF;
  EXECUTE IMMEDIATE text USING low AS low, high AS high, pattern AS pattern, needle AS needle, day AS day;
END"""

#: process_pending_orders as its caller sees it: the batch after the call. Without a time the script refuses.
PROCESS_PENDING = """
BEGIN
  DECLARE at TIMESTAMP_NTZ DEFAULT CAST(coalesce(:processed_date, :as_of) AS TIMESTAMP_NTZ);
  DECLARE text STRING DEFAULT 'SELECT order_id, customer_id, created_at, total_amount, discount_pct, notes, ''Processed'' AS status, CASE WHEN total_amount > 1000 THEN true ELSE requires_approval END AS requires_approval, invoice_id, :at AS updated_at, :at AS processed_at
    FROM (SELECT * FROM retail_orders WHERE status = ''Pending'' ORDER BY order_id LIMIT ' || CAST(:batch_size AS INT) || ') WHERE customer_id IS NOT NULL AND total_amount IS NOT NULL ORDER BY order_id';
  IF at IS NULL THEN SELECT raise_error('a time is needed'); END IF;
  EXECUTE IMMEDIATE text USING at AS at;
END"""

SCRIPTS = {
    "search_products": (SEARCH_PRODUCTS, {"as_of": None, "min_price": None, "max_price": None, "search_text": None, "sort_column": "price", "sort_dir": "ASC", "page_number": 1, "page_size": 20}),
    "process_pending_orders": (PROCESS_PENDING, {"as_of": None, "processed_date": None, "batch_size": 100}),
}


def register(db: Database) -> None:
    """Views of all tables and the functions, in the database's session."""
    db.views(PREFIX)
    for name, (parameters, columns, query) in FUNCTIONS.items():
        db.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")


def call(db: Database, name: str, **given) -> DataFrame:
    """Runs a script by name over the registered views. Parameters that aren't given have their defaults; unknown ones are refused."""
    script, defaults = SCRIPTS[name]
    if unknown := set(given) - set(defaults):
        raise TypeError(f"{name} has no parameters {sorted(unknown)}")
    return db.spark.sql(script, args={**defaults, **given})
