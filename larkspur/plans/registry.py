"""Queries over the driver tables and their SQL, by name.

The SQL is written apart from the plans: whole ten-thousandths for money and half-up division in integers, so that neither side rounds in floating point.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage, relational, validation
from ..sources.star import bind, half_up_sql, money_sql, read, with_views
from ..schemas import FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS
from . import commands, data_jobs, patterns, reports

AS_OF = datetime(2001, 8, 1, 12, 0, 0)
FROM, TO = date(1998, 1, 1), date(1999, 1, 1)
REV = "b_rev AS (SELECT * FROM b_orders WHERE created_at >= TIMESTAMP '1998-01-01' AND created_at < TIMESTAMP '1999-01-01' AND status NOT IN ('Cancelled', 'Refunded'))"
MONTHS = "months AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 MONTH)) AS DATE) AS period_start)"
MONTHLY = f"{REV}, {MONTHS}, monthly AS (SELECT period_start, count(order_id) AS order_count, coalesce(sum(total_m), 0) AS rev_m FROM months LEFT JOIN b_rev ON date_trunc('month', created_at) = period_start GROUP BY 1)"
CATEGORY_LINES = f"{REV}, lines AS (SELECT p.category, p.sku, l.quantity, l.amount_m FROM b_lines l JOIN b_rev USING (order_id) JOIN b_products p USING (product_id))"


def _pct(part: str, whole: str) -> str:
    """100 * part / whole to two places, half-up away from 0, as decimal(19,4); null for 0."""
    scaled = f"(2 * abs(CAST({part} AS HUGEINT)) * 10000 + abs({whole})) // (2 * abs({whole}))"
    return f"CASE WHEN {whole} <> 0 THEN {money_sql(f'sign({part}) * ({scaled}) * 100')} END"


def _tier(total: str) -> str:
    return f"CASE WHEN {total} >= 100000000 THEN 'Platinum' WHEN {total} >= 50000000 THEN 'Gold' WHEN {total} >= 10000000 THEN 'Silver' ELSE 'Bronze' END"


def _performance(period: str) -> str:
    return with_views(f"""
        SELECT CAST(product_id AS INTEGER) AS product_id, product_name, category, CAST({period} AS DATE) AS period_start, CAST(sum(quantity) AS BIGINT) AS units_sold, {money_sql('sum(amount_m)')} AS revenue,
          count(DISTINCT order_id) AS order_count, avg(CAST(quantity AS DOUBLE)) AS avg_units_per_order
        FROM b_lines JOIN b_orders o USING (order_id) JOIN b_products USING (product_id)
        WHERE o.created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-03-31' AND status <> 'Cancelled' GROUP BY product_id, product_name, category, 4""")


SPEND = "b_spend AS (SELECT sum(total_m) AS total, count(*) AS n, min(created_at) AS first_at, max(created_at) AS last_at FROM b_orders WHERE customer_id = 7 AND status <> 'Cancelled')"
TENURE = "CAST((2001 - year(first_at)) * 12 + 8 - month(first_at) AS INTEGER)"
MEAN = f"CASE WHEN n > 0 THEN {money_sql(half_up_sql('total', 'n'))} ELSE 0 END"
TREE = """WITH RECURSIVE tree AS (
  SELECT customer_id, first_name || ' ' || last_name AS name, 1 AS level FROM b_customers WHERE referred_by = 1
  UNION ALL SELECT c.customer_id, c.first_name || ' ' || c.last_name, level + 1 FROM b_customers c JOIN tree t ON c.referred_by = t.customer_id WHERE level < 5)
SELECT CAST(customer_id AS INTEGER) AS customer_id, name AS {name}, CAST(level AS INTEGER) AS {level}, {money} AS referral_revenue
FROM tree LEFT JOIN (SELECT customer_id, sum(total_m) AS m FROM b_orders WHERE status <> 'Cancelled' GROUP BY 1) USING (customer_id)"""
HISTORY = f"FROM b_orders o JOIN b_customers c USING (customer_id) WHERE o.created_at BETWEEN TIMESTAMP '2001-02-01 12:00:00' AND TIMESTAMP '2001-08-01 12:00:00' AND (first_name ILIKE '%build%' OR last_name ILIKE '%build%' OR email ILIKE '%build%')"
VALID_STAGED = """staged AS (SELECT CASE WHEN p_partkey % 5 = 2 THEN 'NEW-' ELSE 'SKU-' END || p_partkey AS sku, p_name AS product_name, CAST(round(p_retailprice * 100) AS BIGINT) * 100 + CASE WHEN p_partkey % 3 = 0 THEN 10000 ELSE 0 END AS price_m, p_partkey % 4 <> 0 AS is_active FROM part WHERE p_partkey % 5 < 3 AND p_partkey % 11 <> 0)"""
SYNC = f"""WITH {VALID_STAGED}, acts AS (SELECT p.sku AS old_sku, s.sku AS new_sku, p.product_name, CASE WHEN p.sku IS NOT NULL AND s.sku IS NOT NULL AND NOT s.is_active THEN 'UPDATE'
    WHEN p.sku IS NOT NULL AND s.sku IS NOT NULL AND (p.price_m <> s.price_m OR p.product_name <> s.product_name) THEN 'UPDATE' WHEN p.sku IS NULL AND s.is_active THEN 'INSERT' WHEN s.sku IS NULL THEN 'UPDATE' END AS action,
    coalesce(s.price_m, p.price_m) AS price_m, p.price_m AS old_m, CASE WHEN p.sku IS NULL THEN true WHEN s.sku IS NULL OR NOT s.is_active THEN false ELSE p.is_active END AS is_active FROM b_products p FULL JOIN staged s USING (sku))"""
LOW = "low AS (SELECT i.product_id, i.warehouse_id, i.quantity_on_hand, i.last_restocked, p.product_name, p.sku, coalesce(p.reorder_point, 10) AS point FROM b_inventory i JOIN b_products p USING (product_id) WHERE p.is_active AND i.quantity_on_hand <= coalesce(p.reorder_point, 10))"
FUNNEL_STEPS = ("view", "click", "purchase")


def _db(f):
    """A query over the bound database."""
    return lambda spark, sf_dir: f(bind(spark, sf_dir))


def _result(f):
    """The result of a command over the bound database."""
    return _db(lambda db: f(db)[1])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


def _latest_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = relational.latest_per_key(_events(spark, sf_dir).select("user_id", "event_type", "ts", "event_id"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")])
    return rows.select("user_id", "event_type", "event_id", "ts")


def _grouping_sets(db) -> DataFrame:
    lines = patterns.revenue_lines(db, FROM, TO).withColumn("m", F.month("created_at"))
    rows = lines.groupingSets([[F.col("category")], [F.col("m")], []], F.col("category"), F.col("m")).agg(F.grouping_id().cast("int").alias("grouping_id"), F.sum("quantity").cast("bigint").alias("units"))
    return rows.select("category", F.col("m").cast("int").alias("month"), "grouping_id", "units")


def _skus(db) -> DataFrame:
    return db["products"].where("is_active").groupBy("category").agg(F.expr("listagg(sku, ',') WITHIN GROUP (ORDER BY product_id)").alias("skus"), F.count("*").alias("n"))


def _above_average(db) -> DataFrame:
    """Orders over their customer's mean: aggregate first, then join."""
    mean = db["orders"].groupBy("customer_id").agg(F.sum("total_amount").alias("s"), F.count("*").alias("n"))
    return db["orders"].join(mean, "customer_id").where(F.col("total_amount") * F.col("n") > F.col("s")).groupBy("customer_id").agg(F.count("*").alias("orders_above"))


def _staged_prices(db) -> DataFrame:
    """Products after the merge of the staged catalogue, with what was done to each."""
    return commands.catalog_merge(db, date(2001, 3, 1), AS_OF).select("sku", "price", "is_active", "merge_action")


def _merge_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' latest values merged over their values of the first ten days."""
    events = _events(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    half = F.lit(2000)
    target = relational.latest_per_key(events.where(F.col("version") < half), ["user_id"], [F.desc("version")])
    return commands.merge_latest(target, events.where(F.col("version") >= half), "user_id", "version")[0]


def _schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the stored orders against those of the model, with rows and nulls of the stored ones."""
    stored = read(spark, sf_dir, "orders")
    model = bind(spark, sf_dir)["orders"].withColumnsRenamed({"order_id": "o_orderkey", "customer_id": "o_custkey", "created_at": "o_orderdate", "total_amount": "o_totalprice", "status": "o_orderstatus"}).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", "notes")
    compared = validation.compare_schemas(*(validation.schema_rows(spark, "orders", df) for df in (stored, model)), spark.createDataFrame([("double", "decimal(19,4)")], "source_type string, target_type string"))
    refs = lineage.references(spark, {"stored": stored})
    counts = lineage.profiled_references(refs, {"orders": stored}).drop("n_queries")
    return compared.join(counts, ["table_name", "column_name"], "left")


#: Coupons of the first suppliers: one of 10 percent, and one that has expired.
GOOD, EXPIRED = "Supplier#000000001", "Supplier#000000002"


def _after(command, name: str, *columns: str):
    """A table as a command leaves it."""
    return _db(lambda db: command(db)[0][name].selectExpr(*columns))


def _couponed(code: str):
    return lambda db: commands.create_customer_order(db, 7, 11, 3, AS_OF, coupon_code=code)


def _refund(db):
    """The refund of the first completed order."""
    first = db["orders"].where("status = 'Completed'").agg(F.min("order_id")).first()[0]
    return commands.process_refund(db, first, "damaged", "clerk", AS_OF)


def _faulty(db):
    """Every seventh order lacks its customer."""
    return db.replaced(orders=db["orders"].withColumn("customer_id", F.when(F.col("order_id") % 7 != 0, F.col("customer_id"))))


def _renamed(db):
    known = db["customers"].withColumn("external_id", F.concat(F.lit("e-"), "customer_id")).withColumn("phone", F.lit("555"))
    return commands.upsert_customer(db.replaced(customers=known), "e-7", "Ann", "Lee", "ann@example.com", AS_OF)


def _first_shipping(db) -> DataFrame:
    first = db["orders"].agg(F.min("order_id")).first()[0]
    return reports.calculate_shipping(db, first, "60614", AS_OF, True, "0F8FAD5B-D9CB-469F-A165-70867728950E")


def _latest_orders(db) -> DataFrame:
    customers = db["customers"].select("customer_id", "last_name")
    orders = db["orders"].select("customer_id", "order_id", "status", "created_at")
    return relational.outer_apply_first(customers, orders, ["customer_id"], [F.desc("created_at"), F.desc("order_id")])


QUERIES = {
    "r01_monthly_sales_summary": _db(lambda db: reports.monthly_sales_summary(db, 1998, 1)),
    "r02_customer_lifetime_value": _db(lambda db: reports.customer_lifetime_value(db, 7, AS_OF)),
    "r03_lifetime_value_referrals": _db(lambda db: reports.customer_lifetime_value_referrals(db, 1)),
    "r04_product_performance_month": _db(lambda db: reports.product_performance(db, FROM, date(1998, 3, 31))),
    "r04_product_performance_week": _db(lambda db: reports.product_performance(db, FROM, date(1998, 3, 31), "week")),
    "r04_product_performance_quarter": _db(lambda db: reports.product_performance(db, FROM, date(1998, 3, 31), "quarter")),
    "r05_adjust_stock": _result(lambda db: commands.adjust_stock(db, 26, 1, 5, "count", "auditor", AS_OF)),
    "r06_low_stock_alerts": _db(lambda db: reports.low_stock_alerts(db, AS_OF)),
    "r07_process_reorders": _result(lambda db: commands.process_reorders(db, "system", AS_OF, 50)),
    "r08_create_customer_order": _result(lambda db: commands.create_customer_order(db, 7, 11, 3, AS_OF, coupon_code="NONE")),
    "r09_order_history": _db(lambda db: reports.order_history(db, AS_OF, search_text="build", page_number=2)),
    "r10_process_refund": _result(_refund),
    "r11_customer_summary": _db(lambda db: reports.customer_summary(db, 7, AS_OF)),
    "r12_customer_summary_referrals": _db(lambda db: reports.customer_referrals(db, 1)),
    "r13_sync_product_catalog": _result(lambda db: commands.sync_product_catalog(db, AS_OF, date(2001, 3, 1))),
    "r13_catalog_merge_rows": _db(_staged_prices),
    "r14_search_products": _db(lambda db: reports.search_products(db, AS_OF, min_price=950, search_text="e", sort_column="Product_Name", sort_dir="desc", page_number=2)),
    "r15_shipping_quotes": _db(lambda db: reports.shipping_quotes(db, db["orders"].where("status = 'Completed'").withColumn("total_amount", (F.col("order_id") % 100).cast("decimal(19,4)")), F.format_string("%05d", (F.col("order_id") * 7919 % 100000).cast("int")), F.col("order_id") % 2 == 0, AS_OF)),
    "r16_create_order": _result(lambda db: commands.create_order(db, 7, 11, 3, AS_OF)),
    "r17_process_pending_orders": _result(lambda db: commands.process_pending_orders(db, AS_OF, 100)),
    "r18_upsert_customer": _result(lambda db: commands.upsert_customer(db, "e-1", "Ann", "Lee", "ann@example.com", AS_OF)),
    "r19_search_orders": _db(lambda db: reports.search_orders(db, AS_OF, status="Pending", page_size=50)),
    "r20_active_customers": _db(lambda db: reports.active_customers(db, 5)),
    "rp01_revenue_by_month": _db(lambda db: patterns.revenue_by_month(db, FROM, TO)),
    "rp02_category_revenue": _db(lambda db: patterns.category_revenue(db, FROM, TO)),
    "rp03_running_revenue": _db(lambda db: patterns.running_revenue(db, FROM, TO)),
    "rp04_revenue_growth": _db(lambda db: patterns.revenue_growth(db, date(1997, 1, 1), TO)),
    "rp05_top_products_per_category": _db(lambda db: patterns.top_products_per_category(db, FROM, TO)),
    "rp06_customer_pareto": _db(lambda db: patterns.customer_pareto(db, FROM, TO)),
    "rp07_order_value_stats": _db(lambda db: patterns.order_value_stats(db, FROM, TO)),
    "rp08_orders_by_month_status": _db(lambda db: patterns.orders_by_month_status(db, FROM, TO, ("Pending", "Completed"))),
    "rp09_cohort_retention": _db(lambda db: patterns.cohort_retention(db, FROM, TO)),
    "rp10_stock_as_of": lambda spark, sf_dir: patterns.stock_as_of(bind(spark, sf_dir).replaced(inventory_audit=_events(spark, sf_dir).select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("product_id"), (F.col("event_id") % 3).alias("warehouse_id"), (F.col("event_id") % 50).alias("new_qty"), F.col("ts").alias("adjusted_at"))), date(2024, 1, 15)),
    "rp11_funnel": lambda spark, sf_dir: patterns.funnel(_events(spark, sf_dir), FUNNEL_STEPS),
    "rp12_customer_activity_streaks": _db(lambda db: patterns.customer_activity_streaks(db, FROM, TO)),
    "rp13_revenue_rollup": _db(lambda db: patterns.revenue_rollup(db, FROM, TO)),
    "rp14_customer_first_last_order": _db(lambda db: patterns.customer_first_last_order(db, FROM, TO)),
    "rp15_order_value_histogram": _db(lambda db: patterns.order_value_histogram(db, FROM, TO, 10000)),
    "op_grouping_sets": _db(_grouping_sets),
    "op_string_agg": _db(_skus),
    "op_latest_per_key": _latest_event,
    "op_aggregate_then_join": _db(_above_average),
    "op_merge_latest": _merge_latest,
    "op_integrity": _db(validation.integrity),
    "op_schema_compare": _schemas,
    "r05_inventory_after": _after(lambda db: commands.adjust_stock(db, 26, 1, 5, "count", "auditor", AS_OF), "inventory", "cast(product_id as int) as product_id", "cast(warehouse_id as int) as warehouse_id", "quantity_on_hand", "last_updated"),
    "r05_new_place_after": _after(lambda db: commands.adjust_stock(db, 26, 5, 8, "found", "auditor", AS_OF), "inventory", "cast(product_id as int) as product_id", "cast(warehouse_id as int) as warehouse_id", "quantity_on_hand", "last_updated"),
    "r05_audit_after": _after(lambda db: commands.adjust_stock(db, 26, 1, 5, "count", "auditor", AS_OF), "inventory_audit", "audit_id", "product_id", "warehouse_id", "previous_qty", "adjustment", "new_qty", "reason", "adjusted_by", "adjusted_at"),
    "r07_purchase_orders_after": _after(lambda db: commands.process_reorders(db, "system", AS_OF, 50), "purchase_orders", "purchase_order_id", "product_id", "warehouse_id", "quantity", "status", "created_by", "created_at"),
    "r08_order_with_coupon": _result(_couponed(GOOD)),
    "r08_order_with_expired_coupon": _result(_couponed(EXPIRED)),
    "r08_orders_after": _after(_couponed(GOOD), "orders", "cast(order_id as bigint) as order_id", "cast(customer_id as bigint) as customer_id", "total_amount", "discount_pct", "status", "requires_approval"),
    "r08_lines_after": _db(lambda db: _couponed(GOOD)(db)[0]["order_lines"].where("line_total is not null").groupBy("product_id").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("bigint")).alias("quantity"), F.sum("line_total").cast("decimal(19,4)").alias("line_total"))),
    "r08_coupons_after": _after(_couponed(EXPIRED), "coupons", "code", "use_count"),
    "r10_orders_after": _after(_refund, "orders", "cast(order_id as bigint) as order_id", "status", "updated_at"),
    "r10_inventory_after": _after(_refund, "inventory", "cast(product_id as int) as product_id", "cast(warehouse_id as int) as warehouse_id", "quantity_on_hand", "last_updated"),
    "r10_refunds_after": _after(_refund, "refunds", "refund_id", "cast(order_id as bigint) as order_id", "amount", "reason", "processed_by", "processed_at", "status"),
    "r15_calculate_shipping": _db(_first_shipping),
    "r16_lines_after": _db(lambda db: commands.create_order(db, 7, 11, 3, AS_OF)[0]["order_lines"].groupBy("product_id").agg(F.count("*").alias("n"), F.sum(F.col("quantity").cast("bigint")).alias("quantity"))),
    "r17_orders_after": _after(lambda db: commands.process_pending_orders(_faulty(db), AS_OF, 100), "orders", "cast(order_id as bigint) as order_id", "status", "requires_approval", "processed_at"),
    "r17_errors_after": _after(lambda db: commands.process_pending_orders(_faulty(db), AS_OF, 100), "processing_errors", "error_id", "order_id", "error_message", "occurred_at"),
    "r18_upsert_known_customer": _result(_renamed),
    "r18_customers_after": _after(_renamed, "customers", "cast(customer_id as bigint) as customer_id", "external_id", "first_name", "last_name", "email", "phone", "birth_date", "updated_at"),
    "rp01_revenue_by_week": _db(lambda db: patterns.revenue_by_week(db, FROM, TO, "sunday")),
    "rp07_order_value_percentiles": _db(lambda db: patterns.order_value_percentiles(db, FROM, TO, accuracy=1_000_000)),
    "op_outer_apply": _db(_latest_orders),
    "op_regex_match": _db(lambda db: relational.matching(db["products"], "sku", "^SKU-[0-9]*7$").select("sku", "product_name")),
    "op_json_report": _db(lambda db: patterns.as_json(patterns.revenue_by_month(db, FROM, TO))),
}

#: The model's tables as far as the star fills them, for the checks of keys.
FILLED = {
    "categories": "SELECT DISTINCT p_size AS category_id, 'Size ' || p_size AS category_name FROM part", "warehouses": "SELECT n_nationkey AS warehouse_id FROM nation", "customers": "SELECT *, NULL AS external_id FROM b_customers",
    "products": "SELECT *, product_id % 25 AS default_warehouse_id FROM b_products", "inventory": "SELECT * FROM b_inventory", "orders": "SELECT *, NULL AS invoice_id FROM b_orders", "order_lines": "SELECT *, NULL AS line_id FROM b_lines",
    "product_staging": "SELECT p_partkey AS staging_id FROM part WHERE p_partkey % 5 < 3", "coupons": "SELECT * FROM b_coupons",
}


def _integrity_sql() -> str:
    def counted(rule: str, name: str, table: str, sql: str) -> str:
        return f"SELECT '{rule}' AS rule, '{name}' AS table_name, {f'(SELECT count(*) FROM ({sql}))' if table in FILLED else '0'} AS violations"

    parts = []
    for table, keys in PRIMARY_KEYS.items():
        names, unset = ", ".join(keys), " OR ".join(f"{k} IS NULL" for k in keys)
        parts.append(counted("primary key", f"{table}({names})", table, f"SELECT {names} FROM ({FILLED.get(table)}) GROUP BY {names} HAVING count(*) > 1 OR {unset}"))
    for table, column in UNIQUE_KEYS:
        parts.append(counted("unique", f"{table}({column})", table, f"SELECT {column} FROM ({FILLED.get(table)}) WHERE {column} IS NOT NULL GROUP BY 1 HAVING count(*) > 1"))
    for child, column, parent, key in FOREIGN_KEYS:
        there = f"SELECT {key} FROM ({FILLED[parent]})" if parent in FILLED else "SELECT NULL WHERE false"
        parts.append(counted("foreign key", f"{child}({column})", child, f"SELECT 1 FROM ({FILLED.get(child)}) c WHERE {column} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM ({there}) p(k) WHERE k = c.{column})"))
    return with_views(" UNION ALL ".join(parts))


NEW_ORDER = "(SELECT max(order_id) + 1 FROM b_orders)"
FIRST_DONE = "(SELECT min(order_id) FROM b_orders WHERE status = 'Completed')"
NOON = "TIMESTAMP '2001-08-01 12:00:00'"
PRICE = "(SELECT price_m * 3 FROM b_products WHERE product_id = 11)"
PLACE = "CAST(product_id AS INTEGER) AS product_id, CAST(warehouse_id AS INTEGER) AS warehouse_id"
TYPES = "CASE column_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' WHEN 'VARCHAR' THEN 'string' WHEN 'DATE' THEN 'date' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' END"

ORACLES = {
    "r01_monthly_sales_summary": with_views(f"""
        SELECT category, product_name, units_sold, {money_sql('rev')} AS revenue, {money_sql('price')} AS avg_selling_price, order_count, {money_sql('sum(rev) OVER (PARTITION BY category)')} AS category_revenue, rank() OVER (PARTITION BY category ORDER BY rev DESC) AS rank_in_category
        FROM (SELECT category, product_id, product_name, CAST(sum(quantity) AS BIGINT) AS units_sold, sum(amount_m) AS rev, {half_up_sql('sum(unit_m)', 'count(*)')} AS price, count(DISTINCT order_id) AS order_count
          FROM b_lines JOIN b_orders o USING (order_id) JOIN b_products USING (product_id) WHERE o.created_at BETWEEN TIMESTAMP '1998-01-01' AND TIMESTAMP '1998-01-31' AND status <> 'Cancelled' GROUP BY category, product_id, product_name)"""),
    "r02_customer_lifetime_value": with_views(f"WITH {SPEND} SELECT CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS customer_name, email, {money_sql('total')} AS lifetime_revenue, CAST(n AS INTEGER) AS total_orders, {MEAN} AS avg_order_value, {TENURE} AS tenure_months, strftime(first_at, '%Y-%m-%d') AS first_order_date, strftime(last_at, '%Y-%m-%d') AS last_order_date, {_tier('total')} AS tier FROM b_customers, b_spend WHERE customer_id = 7"),
    "r03_lifetime_value_referrals": with_views(TREE.format(name="customer_name", level="referral_level", money=money_sql("coalesce(m, 0)"))),
    "r04_product_performance_month": _performance("date_trunc('month', o.created_at)"),
    "r04_product_performance_week": _performance("date_trunc('week', o.created_at + INTERVAL 1 DAY)"),
    "r04_product_performance_quarter": _performance("date_trunc('quarter', o.created_at)"),
    "r05_adjust_stock": with_views("SELECT 1 AS adjustment_id, quantity_on_hand AS previous_stock, quantity_on_hand + 5 AS new_stock FROM b_inventory WHERE product_id = 26 AND warehouse_id = 1"),
    "r06_low_stock_alerts": with_views(f"WITH {LOW} SELECT CAST(product_id AS INTEGER) AS product_id, product_name, sku, CAST(warehouse_id AS INTEGER) AS warehouse_id, n_name AS warehouse_name, quantity_on_hand AS current_stock, CAST(point AS INTEGER) AS reorder_point, CAST(point - quantity_on_hand AS INTEGER) AS shortfall_qty, strftime(last_restocked, '%m/%d/%Y') AS last_restocked_formatted, CAST(date_diff('day', CAST(last_restocked AS DATE), DATE '2001-08-01') AS INTEGER) AS days_since_restock FROM low JOIN nation ON n_nationkey = warehouse_id"),
    "r07_process_reorders": with_views(f"WITH {LOW}, q AS (SELECT *, row_number() OVER (ORDER BY quantity_on_hand, product_id, warehouse_id) AS k FROM low QUALIFY k <= 50) SELECT CAST(a.k AS INTEGER) AS purchase_order_id, CAST(a.product_id AS INTEGER) AS product_id, a.product_name, 50 AS reorder_qty, b.quantity_on_hand AS current_stock FROM q a JOIN q b USING (product_id)"),
    "r08_create_customer_order": with_views(f"SELECT CAST((SELECT max(order_id) + 1 FROM b_orders) AS BIGINT) AS order_id, customer_id, first_name || ' ' || last_name AS customer_name, {money_sql('(SELECT price_m * 3 FROM b_products WHERE product_id = 11)')} AS total_amount, CAST(0 AS DECIMAL(5,2)) AS discount_pct, 'Pending' AS status, '2001-08-01 12:00:00' AS created_at_formatted FROM b_customers WHERE customer_id = 7"),
    "r09_order_history": with_views(f"""
        SELECT CAST(order_id AS INTEGER) AS order_id, CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS customer_name, email, {money_sql('total_m')} AS total_amount, CAST(0 AS DECIMAL(5,2)) AS discount_pct, status,
          CAST(date_diff('day', CAST(created_at AS DATE), DATE '2001-08-01') AS INTEGER) AS days_ago, strftime(created_at, '%b %-d, %Y') AS order_date_display, strftime(last_day(created_at), '%m/%d/%Y') AS month_end,
          CASE WHEN total_m >= 10000000 THEN 'High Value' WHEN total_m >= 1000000 THEN 'Medium Value' ELSE 'Low Value' END AS value_tier, repeat('★', CASE WHEN total_m >= 10000000 THEN 3 WHEN total_m >= 1000000 THEN 2 ELSE 1 END) AS star_rating, row_num, total_count
        FROM (SELECT *, row_number() OVER (ORDER BY created_at DESC, order_id) AS row_num, count(*) OVER () AS total_count {HISTORY}) WHERE row_num BETWEEN 26 AND 50"""),
    "r10_process_refund": with_views(f"SELECT 1 AS refund_id, {money_sql('total_m')} AS refund_amount, 'Completed' AS status FROM b_orders WHERE order_id = {FIRST_DONE}"),
    "r11_customer_summary": with_views(f"WITH {SPEND} SELECT CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS full_name, left(email, 1) || repeat('*', strpos(email, '@') - 2) || substr(email, strpos(email, '@')) AS masked_email, CAST(2001 - year(birth_date) AS INTEGER) AS age, {money_sql('total')} AS total_spend, CAST(n AS INTEGER) AS order_count, {MEAN} AS avg_order_value, {_tier('total')} AS tier, {TENURE} AS tenure_months, strftime(first_at, '%Y-%m-%d') AS first_order_date, strftime(last_at, '%Y-%m-%d') AS last_order_date, strftime(last_at + INTERVAL 30 DAY, '%Y-%m-%d') AS estimated_next_order FROM b_customers, b_spend WHERE customer_id = 7"),
    "r12_customer_summary_referrals": with_views(TREE.format(name="name", level="level", money=money_sql("coalesce(m, 0)"))),
    "r13_sync_product_catalog": with_views(f"{SYNC} SELECT action, CAST(count(*) AS INTEGER) AS count, CAST(count(*) FILTER (action = 'INSERT') AS INTEGER) AS inserted, CAST(count(*) FILTER (action = 'UPDATE') AS INTEGER) AS updated, 0 AS deleted FROM acts WHERE action IS NOT NULL GROUP BY action"),
    "r13_catalog_merge_rows": with_views(f"{SYNC} SELECT coalesce(old_sku, new_sku) AS sku, {money_sql('CASE WHEN old_sku IS NOT NULL AND NOT is_active AND action IS NOT NULL AND new_sku IS NOT NULL AND NOT (SELECT s.is_active FROM staged s WHERE s.sku = acts.new_sku) THEN old_m ELSE price_m END')} AS price, is_active, action AS merge_action FROM acts WHERE old_sku IS NOT NULL OR action IS NOT NULL"),
    "r14_search_products": with_views(f"SELECT CAST(product_id AS INTEGER) AS product_id, product_name, sku, {money_sql('price_m')} AS price, CAST(category_id AS INTEGER) AS category_id, 'Size ' || category_id AS category_name, CAST(strpos(lower(product_name), 'e') AS INTEGER) AS match_position, CAST(date_diff('day', CAST(created_at AS DATE), DATE '2001-08-01') AS INTEGER) AS age_days FROM b_products WHERE is_active AND price_m >= 9500000 AND product_name ILIKE '%e%' ORDER BY product_name DESC, product_id LIMIT 20 OFFSET 20"),
    "r15_shipping_quotes": with_views(f"""
        WITH w AS (SELECT order_id, sum(weight * quantity) AS kg FROM b_lines JOIN b_products USING (product_id) GROUP BY 1), z AS (SELECT order_id, lpad(CAST(order_id * 7919 % 100000 AS VARCHAR), 5, '0')[1:3] AS zip, order_id % 2 = 0 AS fast, kg FROM b_orders JOIN w USING (order_id) WHERE status = 'Completed'),
        base AS (SELECT *, kg * CASE WHEN zip BETWEEN '100' AND '199' THEN 85 WHEN zip BETWEEN '300' AND '399' THEN 105 WHEN zip BETWEEN '600' AND '699' THEN 120 WHEN zip BETWEEN '900' AND '999' THEN 145 ELSE 110 END * 100 AS m FROM z)
        SELECT CAST(order_id AS INTEGER) AS order_id, CAST(kg AS DECIMAL(10,3)) AS total_weight_lbs, {money_sql('CASE WHEN order_id % 100 >= 50 THEN 0 WHEN fast THEN m + m // 2 ELSE m END')} AS shipping_cost, fast AS is_expedited, DATE '2001-08-01' + CASE WHEN fast THEN 1 ELSE 5 END AS estimated_delivery FROM base"""),
    "r16_create_order": with_views(f"SELECT CAST(max(order_id) + 1 AS BIGINT) AS order_id, {money_sql('(SELECT price_m * 3 FROM b_products WHERE product_id = 11)')} AS total_amount, TIMESTAMP '2001-08-01 12:00:00' AS created_at FROM b_orders"),
    "r17_process_pending_orders": with_views(f"SELECT order_id, customer_id, created_at, {money_sql('total_m')} AS total_amount, CAST(0 AS DECIMAL(5,2)) AS discount_pct, CAST(NULL AS VARCHAR) AS notes, 'Processed' AS status, total_m > 10000000 AS requires_approval, CAST(NULL AS INTEGER) AS invoice_id, TIMESTAMP '2001-08-01 12:00:00' AS updated_at, TIMESTAMP '2001-08-01 12:00:00' AS processed_at FROM b_orders WHERE status = 'Pending' ORDER BY order_id LIMIT 100"),
    "r18_upsert_customer": with_views("SELECT 'INSERT' AS action, CAST(max(customer_id) + 1 AS BIGINT) AS customer_id, 'ann@example.com' AS email FROM b_customers"),
    "r19_search_orders": with_views(f"SELECT CAST(order_id AS INTEGER) AS order_id, CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS customer_name, {money_sql('total_m')} AS total_amount, status, strftime(created_at, '%Y-%m-%d') AS order_date, CAST(date_diff('day', CAST(created_at AS DATE), DATE '2001-08-01') AS INTEGER) AS days_old FROM b_orders JOIN b_customers USING (customer_id) WHERE created_at BETWEEN TIMESTAMP '2001-05-01 12:00:00' AND TIMESTAMP '2001-08-01 12:00:00' AND status = 'Pending' ORDER BY created_at DESC, order_id LIMIT 50"),
    "r20_active_customers": with_views("SELECT CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS customer_name, count(*) AS order_count FROM b_orders JOIN b_customers USING (customer_id) GROUP BY ALL HAVING count(*) >= 5 ORDER BY count(*) DESC, 1 LIMIT 10"),
    "rp01_revenue_by_month": with_views(f"WITH {MONTHLY} SELECT period_start, CAST(order_count AS INTEGER) AS order_count, {money_sql('rev_m')} AS revenue FROM monthly"),
    "rp02_category_revenue": with_views(f"WITH {CATEGORY_LINES}, c AS (SELECT coalesce(lower(trim(category)), 'unknown') AS category, CAST(sum(quantity) AS BIGINT) AS units, sum(amount_m) AS m FROM lines GROUP BY 1) SELECT category, units, {money_sql('m')} AS revenue, {_pct('m', '(SELECT sum(m) FROM c)')} AS share_pct FROM c"),
    "rp03_running_revenue": with_views(f"WITH {MONTHLY}, w AS (SELECT period_start, rev_m, sum(rev_m) OVER (ORDER BY period_start ROWS UNBOUNDED PRECEDING) AS run, sum(rev_m) OVER (ORDER BY period_start ROWS 2 PRECEDING) AS s, count(*) OVER (ORDER BY period_start ROWS 2 PRECEDING) AS n FROM monthly) SELECT period_start, {money_sql('rev_m')} AS revenue, {money_sql('run')} AS running_total, {money_sql(half_up_sql('s', 'n'))} AS moving_avg FROM w"),
    "rp04_revenue_growth": with_views(f"WITH {MONTHLY.replace('1998-01-01', '1997-01-01')}, g AS (SELECT period_start, rev_m, lag(rev_m) OVER (ORDER BY period_start) AS a, lag(rev_m, 12) OVER (ORDER BY period_start) AS b FROM monthly) SELECT period_start, {money_sql('rev_m')} AS revenue, {_pct('(rev_m - a)', 'a')} AS mom_pct, {_pct('(rev_m - b)', 'b')} AS yoy_pct FROM g"),
    "rp05_top_products_per_category": with_views(f"WITH {CATEGORY_LINES} SELECT * FROM (SELECT category, sku, CAST(sum(quantity) AS BIGINT) AS units, dense_rank() OVER (PARTITION BY category ORDER BY sum(quantity) DESC) AS rnk FROM lines GROUP BY 1, 2) WHERE rnk <= 3"),
    "rp06_customer_pareto": with_views(f"WITH {REV}, s AS (SELECT customer_id, sum(total_m) AS m FROM b_rev GROUP BY 1), r AS (SELECT customer_id, m, {_pct('sum(m) OVER (ORDER BY m DESC, customer_id ROWS UNBOUNDED PRECEDING)', '(SELECT sum(m) FROM s)')} AS running_pct FROM s) SELECT CAST(customer_id AS INTEGER) AS customer_id, {money_sql('m')} AS revenue, running_pct, CASE WHEN running_pct <= 80 THEN 'A' WHEN running_pct <= 95 THEN 'B' ELSE 'C' END AS abc FROM r"),
    "rp07_order_value_stats": with_views(f"WITH {REV} SELECT count(*) AS orders, {money_sql(half_up_sql('sum(total_m)', 'count(*)'))} AS average, round(quantile_cont(CAST(total_m AS DOUBLE) / 10000, 0.5), 4) AS median, round(quantile_disc(CAST(total_m AS DOUBLE) / 10000, 0.5), 4) AS median_actual, round(quantile_cont(CAST(total_m AS DOUBLE) / 10000, 0.9), 4) AS p90 FROM b_rev"),
    "rp08_orders_by_month_status": with_views(f"WITH {MONTHS} SELECT period_start, count(*) FILTER (status = 'Pending') AS pending, count(*) FILTER (status = 'Completed') AS completed, count(*) FILTER (status NOT IN ('Pending', 'Completed')) AS other, count(order_id) AS total FROM months LEFT JOIN b_orders ON date_trunc('month', created_at) = period_start GROUP BY 1"),
    "rp09_cohort_retention": with_views(f"WITH {REV}, m AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', created_at) AS DATE) AS m FROM b_rev), f AS (SELECT customer_id, min(m) AS cohort_month FROM m GROUP BY 1), s AS (SELECT cohort_month, count(*) AS cohort_size FROM f GROUP BY 1), a AS (SELECT cohort_month, CAST(date_diff('month', cohort_month, m) AS INTEGER) AS month_offset, count(*) AS active_customers FROM m JOIN f USING (customer_id) GROUP BY 1, 2) SELECT cohort_month, month_offset, active_customers, cohort_size, {_pct('active_customers', 'cohort_size')} AS retention_pct FROM a JOIN s USING (cohort_month)"),
    "rp10_stock_as_of": "SELECT user_id AS product_id, event_id % 3 AS warehouse_id, event_id % 50 AS quantity, event_id AS as_of_audit FROM events WHERE ts < TIMESTAMP '2024-01-16' QUALIFY row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY ts DESC, event_id DESC) = 1",
    "rp11_funnel": f"WITH a AS (SELECT user_id, min(ts) AS t FROM events WHERE event_type = 'view' GROUP BY 1), b AS (SELECT user_id, min(ts) AS t FROM events e JOIN a USING (user_id) WHERE event_type = 'click' AND ts >= t GROUP BY 1), c AS (SELECT user_id, min(ts) AS t FROM events e JOIN b USING (user_id) WHERE event_type = 'purchase' AND ts >= t GROUP BY 1), n AS (SELECT 1 AS step, 'view' AS name, count(*) AS users FROM a UNION ALL SELECT 2, 'click', count(*) FROM b UNION ALL SELECT 3, 'purchase', count(*) FROM c) SELECT step, name, users, {_pct('users', '(SELECT count(*) FROM a)')} AS pct_of_first FROM n",
    "rp12_customer_activity_streaks": with_views(f"WITH {REV}, m AS (SELECT DISTINCT customer_id, CAST(date_trunc('month', created_at) AS DATE) AS m FROM b_rev), g AS (SELECT customer_id, m, year(m) * 12 + month(m) - row_number() OVER (PARTITION BY customer_id ORDER BY m) AS g FROM m), r AS (SELECT customer_id, g, count(*) AS n, min(m) AS a, max(m) AS b FROM g GROUP BY 1, 2) SELECT CAST(customer_id AS INTEGER) AS customer_id, CAST(n AS INTEGER) AS streak_months, a AS streak_start, b AS streak_end FROM r QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, a) = 1"),
    "rp13_revenue_rollup": with_views(f"WITH {CATEGORY_LINES} SELECT CASE WHEN grouping(category) = 1 THEN 'total' WHEN grouping(sku) = 1 THEN 'category' ELSE 'product' END AS level, category, sku, CAST(sum(quantity) AS BIGINT) AS units, {money_sql('sum(amount_m)')} AS revenue FROM lines GROUP BY ROLLUP (category, sku)"),
    "rp14_customer_first_last_order": with_views(f"WITH {REV} SELECT CAST(customer_id AS INTEGER) AS customer_id, first_name || ' ' || last_name AS customer_name, CAST(fo AS INTEGER) AS first_order_id, CAST(f.created_at AS DATE) AS first_order_date, {money_sql('f.total_m')} AS first_amount, CAST(lo AS INTEGER) AS last_order_id, CAST(l.created_at AS DATE) AS last_order_date, {money_sql('l.total_m')} AS last_amount, orders FROM (SELECT customer_id, arg_min(order_id, struct_pack(t := created_at, i := order_id)) AS fo, arg_max(order_id, struct_pack(t := created_at, i := order_id)) AS lo, count(*) AS orders FROM b_rev GROUP BY 1) e JOIN b_rev f ON f.order_id = fo JOIN b_rev l ON l.order_id = lo JOIN b_customers c ON c.customer_id = e.customer_id".replace("CAST(customer_id AS INTEGER) AS customer_id, first_name", "CAST(e.customer_id AS INTEGER) AS customer_id, first_name")),
    "rp15_order_value_histogram": with_views(f"WITH {REV}, h AS (SELECT total_m // 100000000 AS b, count(*) AS orders FROM b_rev GROUP BY 1), e AS (SELECT unnest(range(0, (SELECT max(b) + 1 FROM h))) AS b) SELECT b * 10000 AS bucket_from, (b + 1) * 10000 AS bucket_to, coalesce(orders, 0) AS orders FROM e LEFT JOIN h USING (b)"),
    "op_grouping_sets": with_views(f"WITH {REV} SELECT category, CAST(month(o.created_at) AS INTEGER) AS month, CAST(grouping(category) * 2 + grouping(month(o.created_at)) AS INTEGER) AS grouping_id, CAST(sum(quantity) AS BIGINT) AS units FROM b_lines JOIN b_rev o USING (order_id) JOIN b_products USING (product_id) GROUP BY GROUPING SETS ((category), (month(o.created_at)), ())"),
    "op_string_agg": with_views("SELECT category, string_agg(sku, ',' ORDER BY product_id) AS skus, count(*) AS n FROM b_products WHERE is_active GROUP BY category"),
    "op_latest_per_key": "SELECT user_id, event_type, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "op_aggregate_then_join": with_views("SELECT customer_id, count(*) AS orders_above FROM (SELECT customer_id, total_m, sum(total_m) OVER (PARTITION BY customer_id) AS s, count(*) OVER (PARTITION BY customer_id) AS n FROM b_orders) WHERE total_m * n > s GROUP BY customer_id"),
    "op_merge_latest": "SELECT user_id, event_id AS version, CAST(round(value * 100) AS BIGINT) AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "r05_inventory_after": with_views(f"SELECT {PLACE}, quantity_on_hand + CASE WHEN product_id = 26 AND warehouse_id = 1 THEN 5 ELSE 0 END AS quantity_on_hand, CASE WHEN product_id = 26 AND warehouse_id = 1 THEN {NOON} END AS last_updated FROM b_inventory"),
    "r05_new_place_after": with_views(f"SELECT {PLACE}, quantity_on_hand, CAST(NULL AS TIMESTAMP) AS last_updated FROM b_inventory UNION ALL SELECT 26, 5, 8, {NOON}"),
    "r05_audit_after": with_views(f"SELECT 1 AS audit_id, 26 AS product_id, 1 AS warehouse_id, quantity_on_hand AS previous_qty, 5 AS adjustment, quantity_on_hand + 5 AS new_qty, 'count' AS reason, 'auditor' AS adjusted_by, {NOON} AS adjusted_at FROM b_inventory WHERE product_id = 26 AND warehouse_id = 1"),
    "r07_purchase_orders_after": with_views(f"WITH {LOW} SELECT CAST(row_number() OVER (ORDER BY quantity_on_hand, product_id, warehouse_id) AS INTEGER) AS purchase_order_id, {PLACE}, 50 AS quantity, 'Draft' AS status, 'system' AS created_by, {NOON} AS created_at FROM low QUALIFY purchase_order_id <= 50"),
    "r08_order_with_coupon": with_views(f"SELECT CAST({NEW_ORDER} AS BIGINT) AS order_id, customer_id, first_name || ' ' || last_name AS customer_name, {money_sql(PRICE + ' * 9 // 10')} AS total_amount, CAST(10 AS DECIMAL(5,2)) AS discount_pct, 'Pending' AS status, '2001-08-01 12:00:00' AS created_at_formatted FROM b_customers WHERE customer_id = 7"),
    "r08_orders_after": with_views(f"SELECT order_id, customer_id, {money_sql('total_m')} AS total_amount, CAST(0 AS DECIMAL(5,2)) AS discount_pct, status, false AS requires_approval FROM b_orders UNION ALL SELECT {NEW_ORDER}, 7, {money_sql(PRICE + ' * 9 // 10')}, 10, 'Pending', false"),
    "r08_lines_after": with_views(f"SELECT product_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity, {money_sql('sum(m)')} AS line_total FROM (SELECT product_id, quantity, stored_m AS m FROM b_lines UNION ALL SELECT 11, 3, {PRICE} * 9 // 10) GROUP BY 1"),
    "r08_coupons_after": with_views(f"SELECT code, CAST(use_count + CASE code WHEN '{EXPIRED}' THEN 1 ELSE 0 END AS INTEGER) AS use_count FROM b_coupons"),
    "r08_order_with_expired_coupon": with_views(f"SELECT CAST({NEW_ORDER} AS BIGINT) AS order_id, customer_id, first_name || ' ' || last_name AS customer_name, {money_sql(PRICE)} AS total_amount, CAST(0 AS DECIMAL(5,2)) AS discount_pct, 'Pending' AS status, '2001-08-01 12:00:00' AS created_at_formatted FROM b_customers WHERE customer_id = 7"),
    "r10_orders_after": with_views(f"SELECT order_id, CASE WHEN order_id = {FIRST_DONE} THEN 'Refunded' ELSE status END AS status, CASE WHEN order_id = {FIRST_DONE} THEN {NOON} END AS updated_at FROM b_orders"),
    "r10_inventory_after": with_views(f"WITH back AS (SELECT product_id, product_id % 25 AS warehouse_id, min(quantity) AS q, count(*) AS n FROM b_lines WHERE order_id = {FIRST_DONE} GROUP BY 1, 2) SELECT CAST(i.product_id AS INTEGER) AS product_id, CAST(i.warehouse_id AS INTEGER) AS warehouse_id, CAST(quantity_on_hand + coalesce(q, 0) AS INTEGER) AS quantity_on_hand, CASE WHEN q IS NOT NULL THEN {NOON} END AS last_updated FROM b_inventory i LEFT JOIN back b ON b.product_id = i.product_id AND b.warehouse_id = i.warehouse_id"),
    "r10_refunds_after": with_views(f"SELECT 1 AS refund_id, order_id, {money_sql('total_m')} AS amount, 'damaged' AS reason, 'clerk' AS processed_by, {NOON} AS processed_at, 'Completed' AS status FROM b_orders WHERE order_id = {FIRST_DONE}"),
    "r15_calculate_shipping": with_views(f"WITH w AS (SELECT order_id, sum(weight * quantity) AS kg FROM b_lines JOIN b_products USING (product_id) WHERE order_id = (SELECT min(order_id) FROM b_orders) GROUP BY 1) SELECT CAST(order_id AS INTEGER) AS order_id, '0f8fad5bd9cb469fa16570867728950e' AS tracking_number, CAST(kg AS DECIMAL(10,3)) AS total_weight_lbs, {money_sql('CASE WHEN total_m >= 500000 THEN 0 ELSE kg * 12000 + kg * 6000 END')} AS shipping_cost, true AS is_expedited, DATE '2001-08-02' AS estimated_delivery, '2001-08-01T12:00:00' AS calculated_at FROM w JOIN b_orders USING (order_id)"),
    "r16_lines_after": with_views("SELECT product_id, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM (SELECT product_id, quantity FROM b_lines UNION ALL SELECT 11, 3) GROUP BY 1"),
    "r17_orders_after": with_views(f"WITH batch AS (SELECT order_id FROM b_orders WHERE status = 'Pending' ORDER BY order_id LIMIT 100), good AS (SELECT order_id FROM batch WHERE order_id % 7 <> 0) SELECT o.order_id, CASE WHEN g.order_id IS NOT NULL THEN 'Processed' ELSE status END AS status, g.order_id IS NOT NULL AND total_m > 10000000 AS requires_approval, CASE WHEN g.order_id IS NOT NULL THEN {NOON} END AS processed_at FROM b_orders o LEFT JOIN good g ON g.order_id = o.order_id"),
    "r17_errors_after": with_views(f"WITH batch AS (SELECT order_id FROM b_orders WHERE status = 'Pending' ORDER BY order_id LIMIT 100) SELECT CAST(row_number() OVER (ORDER BY order_id) AS INTEGER) AS error_id, CAST(order_id AS INTEGER) AS order_id, 'a required value is null' AS error_message, {NOON} AS occurred_at FROM batch WHERE order_id % 7 = 0"),
    "r18_upsert_known_customer": "SELECT 'UPDATE' AS action, CAST(7 AS BIGINT) AS customer_id, 'ann@example.com' AS email",
    "r18_customers_after": with_views(f"SELECT customer_id, 'e-' || customer_id AS external_id, CASE customer_id WHEN 7 THEN 'Ann' ELSE first_name END AS first_name, CASE customer_id WHEN 7 THEN 'Lee' ELSE last_name END AS last_name, CASE customer_id WHEN 7 THEN 'ann@example.com' ELSE email END AS email, CASE customer_id WHEN 7 THEN NULL ELSE '555' END AS phone, birth_date, CASE customer_id WHEN 7 THEN {NOON} END AS updated_at FROM b_customers"),
    "rp01_revenue_by_week": with_views(f"WITH {REV}, weeks AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1997-12-28', TIMESTAMP '1998-12-31', INTERVAL 7 DAY)) AS DATE) AS period_start) SELECT period_start, CAST(count(order_id) AS INTEGER) AS order_count, {money_sql('coalesce(sum(total_m), 0)')} AS revenue FROM weeks LEFT JOIN b_rev ON CAST(created_at AS DATE) >= period_start AND CAST(created_at AS DATE) < period_start + 7 GROUP BY 1"),
    "rp07_order_value_percentiles": with_views(f"WITH {REV}, v AS (SELECT total_m, row_number() OVER (ORDER BY total_m) AS k, count(*) OVER () AS n FROM b_rev) SELECT CAST(p AS DOUBLE) AS share, {money_sql('min(total_m)')} AS value FROM v, (VALUES (0.5), (0.9)) s(p) WHERE k >= CAST(ceil(CAST(p AS DOUBLE) * n) AS BIGINT) GROUP BY 1"),
    "op_outer_apply": with_views("SELECT c.customer_id, last_name, order_id, status, created_at FROM b_customers c LEFT JOIN LATERAL (SELECT order_id, status, created_at FROM b_orders o WHERE o.customer_id = c.customer_id ORDER BY created_at DESC, order_id DESC LIMIT 1) ON true"),
    "op_regex_match": with_views("SELECT sku, product_name FROM b_products WHERE product_id % 10 = 7"),
    "op_integrity": _integrity_sql(),
    "op_schema_compare": f"WITH s AS (SELECT column_name, {TYPES} AS source_type FROM (DESCRIBE orders)), t AS (SELECT column_name, CASE column_name WHEN 'o_totalprice' THEN 'decimal(19,4)' WHEN 'o_orderdate' THEN 'timestamp_ntz' ELSE source_type END AS target_type FROM s WHERE column_name IN ('o_orderkey', 'o_custkey', 'o_orderdate', 'o_totalprice', 'o_orderstatus') UNION ALL SELECT 'notes', 'string') SELECT 'orders' AS table_name, column_name, source_type, target_type, CASE WHEN target_type IS NULL THEN 'MISSING_TARGET' WHEN source_type IS NULL THEN 'MISSING_SOURCE' WHEN source_type = target_type THEN 'EXACT' WHEN source_type = 'double' AND target_type = 'decimal(19,4)' THEN 'APPROVED_TRANSFORM' ELSE 'CONFLICT' END AS verdict, n_rows, n_nulls FROM s FULL JOIN t USING (column_name) LEFT JOIN (" + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) - count({c}) AS n_nulls FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")) + ") p USING (column_name)",
    "op_json_report": with_views(f"""WITH {MONTHLY} SELECT '[' || string_agg('{{"period_start":"' || period_start || '","order_count":' || order_count || ',"revenue":' || {money_sql('rev_m')} || '}}', ',' ORDER BY period_start) || ']' AS report FROM monthly"""),
}

QUERIES |= data_jobs.QUERIES
ORACLES |= data_jobs.ORACLES
ORACLES |= {q: ORACLES[same] for q, same in data_jobs.SAME_AS.items()}
