"""Queries over the jobs around the tables: schema changes, references, snapshots, keys, percentiles; and their SQL."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import charindex, money, replicate
from ..operators import changes, lineage, ordered, relational, snapshots
from ..sources.scratch import dealt, new_path, parts_for
from ..sources.star import STAR, bind, money_sql, read, with_views
from ..sources.store import Store
from ..streaming import events_stream, merge_job
from . import commands, patterns, reports, sql_surface

AS_OF = datetime(2001, 8, 1, 12, 0, 0)
NOON = "TIMESTAMP '2001-08-01 12:00:00'"
YEAR = (date(1998, 1, 1), date(1999, 1, 1))

#: A wish list of all kinds: keys and what refers to them, types and names at once, two names that change places, and changes that must be refused.
CHANGES = [
    changes.Change("orders", "o_custkey", "int"), changes.Change("customer", "c_custkey", "int"), changes.Change("orders", "o_totalprice", "decimal(19,4)", "total_amount"), changes.Change("orders", "o_orderdate", "date", "ordered_on"),
    changes.Change("lineitem", "l_quantity", "smallint"), changes.Change("lineitem", "l_linenumber", "bigint"), changes.Change("lineitem", "l_shipdate", "int"), changes.Change("lineitem", "l_extendedprice", "float"),
    changes.Change("part", "p_name", None, "p_type"), changes.Change("part", "p_type", None, "p_name"), changes.Change("part", "p_size", "string", "p_size_text"), changes.Change("supplier", "s_name", None, "s_acctbal"),
    changes.Change("nation", "n_comment", "string", "remark"), changes.Change("region", "r_name", None, "region_name"), changes.Change("events", "ts", "date", "day"), changes.Change("events", "value", "decimal(4,1)"),
]
STAR_KEYS = [("orders", "o_custkey", "customer", "c_custkey"), ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey"), ("customer", "c_nationkey", "nation", "n_nationkey")]


def star_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return {t: read(spark, sf_dir, t) for t in STAR}


def _as_audits(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("product_id"), (F.col("event_id") % 3).alias("warehouse_id"), (F.col("event_id") % 50).alias("new_qty"), F.col("ts").alias("adjusted_at"))


#: Every read-only routine and pattern over the bound star that is a plan of its own.
REPORTS = {
    "active_customers": lambda db, events: reports.active_customers(db, 5), "monthly_sales": lambda db, events: reports.monthly_sales_summary(db, 1998, 1), "lifetime_value": lambda db, events: reports.customer_lifetime_value(db, 7, AS_OF), "product_performance": lambda db, events: reports.product_performance(db, *YEAR), "low_stock": lambda db, events: reports.low_stock_alerts(db, AS_OF),
    "order_history": lambda db, events: reports.order_history(db, AS_OF, search_text="build"), "customer_summary": lambda db, events: reports.customer_summary(db, 7, AS_OF), "referrals": lambda db, events: reports.customer_referrals(db, 1), "search_products": lambda db, events: reports.search_products(db, AS_OF), "search_orders": lambda db, events: reports.search_orders(db, AS_OF),
    "shipping": lambda db, events: reports.shipping_quotes(db, db["orders"], F.lit("60614"), F.lit(True), AS_OF), "revenue_by_month": lambda db, events: patterns.revenue_by_month(db, *YEAR), "category_revenue": lambda db, events: patterns.category_revenue(db, *YEAR), "running_revenue": lambda db, events: patterns.running_revenue(db, *YEAR), "revenue_growth": lambda db, events: patterns.revenue_growth(db, *YEAR),
    "top_products": lambda db, events: patterns.top_products_per_category(db, *YEAR), "orders_by_status": lambda db, events: patterns.orders_by_month_status(db, *YEAR, ("Pending", "Completed")), "cohorts": lambda db, events: patterns.cohort_retention(db, *YEAR), "stock_as_of": lambda db, events: patterns.stock_as_of(db.replaced(inventory_audit=_as_audits(events)), date(2024, 1, 15)),
    "funnel": lambda db, events: patterns.funnel(events, ("view", "click", "purchase")), "streaks": lambda db, events: patterns.customer_activity_streaks(db, *YEAR), "rollup": lambda db, events: patterns.revenue_rollup(db, *YEAR), "first_last_order": lambda db, events: patterns.customer_first_last_order(db, *YEAR), "percentiles": lambda db, events: patterns.order_value_percentiles(db, *YEAR),
}
#: Those that stand for the readers of a changed schema.
READERS = ("active_customers", "category_revenue", "funnel", "low_stock", "monthly_sales", "orders_by_status", "revenue_by_month")


def all_reports(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(REPORTS)) -> dict[str, DataFrame]:
    """The reports as plans; none of them is run."""
    db, events = bind(spark, sf_dir), read(spark, sf_dir, "events")
    return {q: REPORTS[q](db, events) for q in names}


def change_steps(spark: SparkSession, sf_dir: str) -> list[changes.Step]:
    readers = {q: lineage.columns_read(df) for q, df in all_reports(spark, sf_dir, READERS).items()}
    return changes.planned_steps(star_tables(spark, sf_dir), CHANGES, frozenset({"region"}), STAR_KEYS, readers)


def _change_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan for CHANGES, each cast tried on all rows, with the reports that have to be adapted."""
    return changes.plan_rows(spark, change_steps(spark, sf_dir))


def _changed_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts and sums over the tables after the plan, under their new names and types."""
    after = changes.applied(star_tables(spark, sf_dir), change_steps(spark, sf_dir))
    orders = after["orders"].groupBy("ordered_on").agg(F.count("*").alias("n"), money(F.sum("total_amount")).alias("total"))
    return orders.select("ordered_on", "n", "total")


def _restored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders after the plan and its rollback: a report for the old schema runs on them."""
    steps = change_steps(spark, sf_dir)
    back = changes.rolled_back(changes.applied(star_tables(spark, sf_dir), steps), steps)["orders"]
    return back.groupBy("o_orderstatus").agg(F.count("*").alias("n"), money(F.sum(money("o_totalprice"))).alias("total"), F.min("o_orderdate").alias("first"), F.max("o_custkey").alias("last_customer"))


def _reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the reports read, against the schema after the plan: named before anything runs on it."""
    tables = star_tables(spark, sf_dir)
    steps = changes.planned_steps(tables, CHANGES, frozenset({"region"}), STAR_KEYS, profile=False)
    after = changes.applied(tables, steps)
    schemas = [_schema_table(spark, t) for t in (tables, after)]
    checked = lineage.checked_references(lineage.references(spark, all_reports(spark, sf_dir)), schemas[1], schemas[0])
    rows = lineage.profiled_references(checked.select("query", "table_name", "column_name"), tables).drop("n_queries")
    return checked.join(rows, ["table_name", "column_name"]).select("query", "table_name", "column_name", "expected_type", "data_type", "status", "n_rows", "n_nulls")


def _schema_table(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def _two_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders before and after a hundred are processed, the cancelled ones go and one comes: all differences, by bucket."""
    before = bind(spark, sf_dir)["orders"]
    after = commands.process_pending_orders(bind(spark, sf_dir), AS_OF, 100)[0]["orders"]
    extra = after.where("order_id = 1").withColumn("order_id", F.lit(-1).cast("long"))
    a, b = new_path(spark, "snapshot"), new_path(spark, "snapshot")
    snapshots.take_snapshot(before, ["order_id"], a)
    snapshots.take_snapshot(after.where("status <> 'Cancelled'").unionByName(extra), ["order_id"], b)
    return snapshots.snapshot_differences(spark, a, b, ["order_id"])


def _difference_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.difference_report(_two_snapshots(spark, sf_dir), ["order_id"])


def _line_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys for all lines of the star, which have none: a batch of any size."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return ordered.numbered_in_order(lines, [F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")], "line_id")


def _line_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of what lines cost: share, continuous (interpolated) and discrete (a price that occurs)."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("decimal(19,2)").alias("price"))
    n, low, high = lines.agg(F.count("price"), F.min("price"), F.max("price")).first()
    shares = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0]
    cont, disc = ordered.exact_percentiles(lines, "price", shares, shares, n, low, high)
    return spark.createDataFrame(list(zip(shares, cont, disc)), "share double, continuous double, discrete decimal(19,2)").withColumn("continuous", F.round("continuous", 4))


def _running_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running sum of all orders by time, a prefix sum over partitions."""
    orders = bind(spark, sf_dir)["orders"].select("order_id", "created_at", "total_amount")
    rows = ordered.running_sums(orders, [F.asc("created_at"), F.asc("order_id")], "total_amount")
    return rows.select("order_id", F.col("running").cast("decimal(28,4)").alias("running"))


QUERIES = {
    "op_change_plan": _change_plan,
    "op_change_applied": _changed_tables,
    "op_change_rolled_back": _restored_tables,
    "op_reference_check": _reference_check,
    "op_snapshot_differences": _two_snapshots,
    "op_snapshot_report": _difference_report,
    "op_keys_of_a_batch": _line_keys,
    "op_exact_percentiles": _line_percentiles,
    "op_running_sums": _running_revenue,
}


def _tried(table: str, column: str, new: str, old: str) -> str:
    """Rows, rows that come back otherwise and rows without a place, of one cast."""
    return f"SELECT '{table}' AS t, '{column}' AS c, count(*) AS n, count(*) FILTER ({column} IS NOT NULL AND TRY_CAST({column} AS {new}) IS NOT NULL AND CAST(TRY_CAST({column} AS {new}) AS {old}) <> {column}) AS changed, count(*) FILTER ({column} IS NOT NULL AND TRY_CAST({column} AS {new}) IS NULL) AS failed FROM {table}"


#: The casts and renames of CHANGES in their order, and the reports that read a changed column.
CAST_STEPS = [
    (1, "customer", "c_custkey", "bigint", "int", "HIGH_RISK", "INTEGER", "BIGINT"), (2, "orders", "o_custkey", "bigint", "int", "HIGH_RISK", "INTEGER", "BIGINT"), (3, "orders", "o_totalprice", "double", "decimal(19,4)", "HIGH_RISK", "DECIMAL(19,4)", "DOUBLE"),
    (4, "orders", "o_orderdate", "timestamp_ntz", "date", "LOSSY", "DATE", "TIMESTAMP"), (5, "lineitem", "l_quantity", "double", "smallint", "HIGH_RISK", "SMALLINT", "DOUBLE"), (6, "lineitem", "l_linenumber", "int", "bigint", "SAFE", "BIGINT", "INTEGER"),
    (7, "lineitem", "l_extendedprice", "double", "float", "LOSSY", "FLOAT", "DOUBLE"), (8, "part", "p_size", "int", "string", "SAFE", "VARCHAR", "INTEGER"), (9, "events", "ts", "timestamp_ntz", "date", "LOSSY", "DATE", "TIMESTAMP"),
    (10, "events", "value", "double", "decimal(4,1)", "HIGH_RISK", "DECIMAL(4,1)", "DOUBLE"),
]
RENAME_STEPS = [(11, "orders", "o_totalprice", "total_amount"), (12, "orders", "o_orderdate", "ordered_on"), (13, "part", "p_size", "p_size_text"), (14, "part", "p_name", "p_name_0"), (15, "part", "p_type", "p_name"), (16, "part", "p_name_0", "p_type"), (17, "events", "ts", "day")]
REFUSED = [("lineitem", "l_shipdate", "CAST", "'timestamp_ntz'", "'int'", "UNSUPPORTED"), ("nation", "n_comment", "CAST", "NULL", "'string'", "METADATA_NOT_FOUND"), ("nation", "n_comment", "RENAME", "NULL", "'remark'", "METADATA_NOT_FOUND"), ("region", "r_name", "RENAME", "NULL", "'region_name'", "PROTECTED"), ("supplier", "s_name", "RENAME", "'s_name'", "'s_acctbal'", "RENAME_COLLISION")]
ADAPTED = [
    ("active_customers", "customer.c_custkey, orders.o_custkey", "HIGH_RISK"), ("category_revenue", "lineitem.l_extendedprice, lineitem.l_quantity, orders.o_orderdate, part.p_type", "HIGH_RISK"), ("funnel", "events.ts", "LOSSY"), ("low_stock", "part.p_name", "SAFE"),
    ("monthly_sales", "lineitem.l_extendedprice, lineitem.l_quantity, orders.o_orderdate, part.p_name, part.p_type", "HIGH_RISK"), ("orders_by_status", "orders.o_orderdate", "LOSSY"), ("revenue_by_month", "orders.o_orderdate, orders.o_totalprice", "HIGH_RISK"),
]
#: Columns that reports read together, and what each report reads.
_DATED = "orders.o_orderdate orders.o_orderstatus"
_REVENUE = f"{_DATED} orders.o_totalprice"
_WHO = "customer.c_custkey customer.c_mktsegment customer.c_name"
_SPENT = f"{_WHO} orders.o_custkey {_REVENUE}"
_SOLD = f"lineitem.l_orderkey lineitem.l_partkey lineitem.l_quantity {_DATED} orders.o_orderkey part.p_partkey part.p_type"
READS = {
    "active_customers": f"{_WHO} orders.o_custkey", "category_revenue": f"{_SOLD} lineitem.l_extendedprice", "cohorts": f"orders.o_custkey {_DATED}", "customer_summary": _SPENT, "first_last_order": f"{_SPENT} orders.o_orderkey", "funnel": "events.event_type events.ts events.user_id",
    "lifetime_value": _SPENT, "low_stock": "nation.n_name nation.n_nationkey part.p_name part.p_partkey", "monthly_sales": f"{_SOLD} lineitem.l_extendedprice part.p_name", "order_history": f"{_SPENT} orders.o_orderkey", "orders_by_status": _DATED, "percentiles": _REVENUE,
    "product_performance": f"{_SOLD} lineitem.l_extendedprice part.p_name", "referrals": f"{_WHO} orders.o_custkey orders.o_orderstatus orders.o_totalprice", "revenue_by_month": _REVENUE, "revenue_growth": _REVENUE, "rollup": f"{_SOLD} lineitem.l_extendedprice", "running_revenue": _REVENUE,
    "search_orders": f"{_SPENT} orders.o_orderkey", "search_products": "part.p_name part.p_partkey part.p_retailprice part.p_size", "shipping": "lineitem.l_orderkey lineitem.l_partkey lineitem.l_quantity orders.o_orderkey orders.o_totalprice part.p_partkey part.p_size",
    "stock_as_of": "events.event_id events.ts events.user_id", "streaks": f"orders.o_custkey {_DATED}", "top_products": _SOLD,
}
#: Types of the columns that the reports read, before and (where they differ, NULL for none of that name) after the plan.
TYPES_READ = {
    "customer.c_custkey": ("bigint", "int"), "customer.c_mktsegment": ("string", None), "customer.c_name": ("string", None), "orders.o_custkey": ("bigint", "int"), "orders.o_orderdate": ("timestamp_ntz", ""), "orders.o_orderkey": ("bigint", None), "orders.o_orderstatus": ("string", None), "orders.o_totalprice": ("double", ""),
    "lineitem.l_extendedprice": ("double", "float"), "lineitem.l_orderkey": ("bigint", None), "lineitem.l_partkey": ("bigint", None), "lineitem.l_quantity": ("double", "smallint"), "part.p_name": ("string", None), "part.p_partkey": ("bigint", None), "part.p_type": ("string", None), "events.event_type": ("string", None),
    "part.p_retailprice": ("double", None), "part.p_size": ("int", ""), "events.event_id": ("bigint", None), "events.ts": ("timestamp_ntz", ""), "events.user_id": ("bigint", None), "nation.n_name": ("string", None), "nation.n_nationkey": ("int", None),
}


def _plan_sql() -> str:
    names = "step, rollback_step, table_name, column_name, action, from_value, to_value, verdict, disposition, rows_checked, rows_changed, rows_failed, statement, rollback"
    tried = " UNION ALL ".join(_tried(t, c, new, old) for _, t, c, _, _, _, new, old in CAST_STEPS)
    values = ", ".join(f"({k}, '{t}', '{c}', '{a}', '{b}', '{v}')" for k, t, c, a, b, v, _, _ in CAST_STEPS)
    casts = f"SELECT k, 18 - k, s.t, s.c, 'CAST', a, b, v, CASE v WHEN 'SAFE' THEN 'APPLY' ELSE 'REVIEW' END, n, changed, failed, 'ALTER TABLE ' || s.t || ' ALTER COLUMN ' || s.c || ' TYPE ' || b, 'ALTER TABLE ' || s.t || ' ALTER COLUMN ' || s.c || ' TYPE ' || a FROM (VALUES {values}) s(k, t, c, a, b, v) JOIN ({tried}) p ON p.t = s.t AND p.c = s.c"
    values = ", ".join(f"({k}, '{t}', '{a}', '{b}')" for k, t, a, b in RENAME_STEPS)
    renames = f"SELECT k, 18 - k, t, a, 'RENAME', a, b, 'SAFE', 'APPLY', NULL, NULL, NULL, 'ALTER TABLE ' || t || ' RENAME COLUMN ' || a || ' TO ' || b, 'ALTER TABLE ' || t || ' RENAME COLUMN ' || b || ' TO ' || a FROM (VALUES {values}) s(k, t, a, b)"
    refused = " UNION ALL ".join(f"SELECT NULL, NULL, '{t}', '{c}', '{x}', {a}, {b}, '{v}', 'BLOCKED', NULL, NULL, NULL, NULL, NULL" for t, c, x, a, b, v in REFUSED)
    adapted = " UNION ALL ".join(f"SELECT NULL, NULL, NULL, '{q}', 'ADAPT', '{hit}', NULL, '{v}', '{'APPLY' if v == 'SAFE' else 'REVIEW'}', NULL, NULL, NULL, NULL, NULL" for q, hit, v in ADAPTED)
    return f"SELECT * FROM ({casts} UNION ALL {renames} UNION ALL {refused} UNION ALL {adapted}) p({names})"


def _reference_sql() -> str:
    pairs = [(q, *c.split(".")) for q, columns in READS.items() for c in columns.split()]
    values = ", ".join(f"('{q}', '{t}', '{c}')" for q, t, c in pairs)
    kinds = ", ".join(f"('{x.split('.')[0]}', '{x.split('.')[1]}', '{a}', {f"'{a}'" if b is None else f"nullif('{b}', '')"})" for x, (a, b) in TYPES_READ.items())
    counted = " UNION ALL ".join(f"SELECT '{t}', '{c}', count(*), count(*) - count({c}) FROM {t}" for t, c in (x.split(".") for x in TYPES_READ))
    return f"SELECT query, r.table_name, r.column_name, expected_type, data_type, CASE WHEN data_type IS NULL THEN 'MISSING_COLUMN' WHEN data_type <> expected_type THEN 'TYPE_CHANGED' ELSE 'RESOLVED' END AS status, n_rows, n_nulls FROM (VALUES {values}) r(query, table_name, column_name) JOIN (VALUES {kinds}) k(t, c, expected_type, data_type) ON t = r.table_name AND c = r.column_name JOIN ({counted}) n(t2, c2, n_rows, n_nulls) ON t2 = t AND c2 = c"


DIFFERENCES = f"""WITH batch AS (SELECT order_id FROM b_orders WHERE status = 'Pending' ORDER BY order_id LIMIT 100), done AS (SELECT * FROM b_orders JOIN batch USING (order_id)),
    d AS (SELECT order_id, 'CHANGED' AS kind, 'status' AS column_name, 'Pending' AS before, 'Processed' AS after FROM done UNION ALL SELECT order_id, 'CHANGED', 'updated_at', NULL, '2001-08-01 12:00:00' FROM done UNION ALL SELECT order_id, 'CHANGED', 'processed_at', NULL, '2001-08-01 12:00:00' FROM done
    UNION ALL SELECT order_id, 'CHANGED', 'requires_approval', 'false', 'true' FROM done WHERE total_m > 10000000 UNION ALL SELECT order_id, 'REMOVED', NULL, NULL, NULL FROM b_orders WHERE status = 'Cancelled' UNION ALL SELECT -1, 'ADDED', NULL, NULL, NULL FROM b_orders WHERE order_id = 1)"""
_CELL = """'{"order_id":' || order_id || CASE WHEN before IS NULL THEN '' ELSE ',"before":"' || before || '"' END || CASE WHEN after IS NULL THEN '' ELSE ',"after":"' || after || '"' END || '}'"""

ORACLES = {
    "op_change_plan": _plan_sql(),
    "op_change_applied": "SELECT CAST(o_orderdate AS DATE) AS ordered_on, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) AS DECIMAL(19,4)) AS total FROM orders GROUP BY 1",
    "op_change_rolled_back": "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(19,4))) AS DECIMAL(19,4)) AS total, CAST(CAST(min(o_orderdate) AS DATE) AS TIMESTAMP) AS first, max(o_custkey) AS last_customer FROM orders GROUP BY 1",
    "op_reference_check": _reference_sql(),
    "op_snapshot_differences": with_views(f"{DIFFERENCES} SELECT * FROM d"),
    "op_snapshot_report": with_views(f"{DIFFERENCES} SELECT kind, column_name, count(*) AS n, '[' || array_to_string(list(cell ORDER BY k) FILTER (k <= 3), ',') || ']' AS sample FROM (SELECT kind, column_name, {_CELL} AS cell, row_number() OVER (PARTITION BY kind, column_name ORDER BY order_id) AS k FROM d) GROUP BY kind, column_name"),
    "op_keys_of_a_batch": "SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey) AS line_id FROM lineitem",
    "op_exact_percentiles": "WITH v AS (SELECT CAST(l_extendedprice AS DECIMAL(19,2)) AS price FROM lineitem) " + " UNION ALL ".join(f"SELECT CAST({p} AS DOUBLE) AS share, round(quantile_cont(CAST(price AS DOUBLE), {p}), 4) AS continuous, quantile_disc(price, {p}) AS discrete FROM v" for p in (0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 1.0)),
    "op_running_sums": with_views("SELECT order_id, CAST(CAST(sum(total_m) OVER (ORDER BY created_at, order_id ROWS UNBOUNDED PRECEDING) AS DECIMAL(28,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(28,4)) AS running FROM b_orders"),
}


def _audits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as audits of products in the time of the orders."""
    return read(spark, sf_dir, "events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("product_id"), (F.col("ts") - F.expr("interval 26 years")).alias("adjusted_at"))


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products by order. Lines and orders meet in tasks of a stated size, which group them too, as a product's lines of an order are there together."""
    db = bind(spark, sf_dir)
    lines, orders = db["order_lines"].select("order_id", "product_id", "quantity"), db["orders"].select("order_id", "created_at")
    parts = parts_for(lines, orders)
    orders = dealt(orders, parts, "order_id")
    # Spark would judge by compressed bytes and broadcast millions of orders to each task
    both = dealt(lines, parts, "order_id").join(orders.hint("merge") if parts else orders, "order_id")
    return both.groupBy("product_id", "order_id", "created_at").agg(F.sum("quantity").cast("bigint").alias("quantity"))


def _lateral_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three latest orders before each audit, by a lateral join."""
    sales = _sales(spark, sf_dir).withColumnRenamed("product_id", "sold_id")
    rows = relational.outer_apply(_audits(spark, sf_dir), sales, {"product_id": "sold_id"}, lambda outer: F.col("created_at") < outer("adjusted_at"), [F.desc("created_at"), F.desc("order_id")], 3)
    return rows.select("audit_id", "product_id", "order_id", "created_at", "quantity")


def _latest_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by counting in one order, for hot products, with the place of each order."""
    rows = relational.latest_before(_audits(spark, sf_dir), _sales(spark, sf_dir), ["product_id"], "adjusted_at", "created_at", 3, "order_id")
    return rows.select("audit_id", "product_id", "place", "order_id", "created_at", "quantity")


def _refunded_and_saved(spark: SparkSession, sf_dir: str):
    """The state after a refund as it is read back from a store, whose first version is the state before."""
    store = Store(spark, new_path(spark, "store"))
    first = store.save(bind(spark, sf_dir), store.load())
    order = first.database["orders"].where("status = 'Completed'").agg(F.min("order_id")).first()[0]
    store.save(commands.process_refund(first.database, order, "damaged", "clerk", AS_OF)[0], first)
    return store.load()


def _saved_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refunded_and_saved(spark, sf_dir).database["orders"].select("order_id", "status", "updated_at")


def _merged(spark: SparkSession, sf_dir: str) -> Store:
    """Users' latest values, merged from the stream of events by two starts of the job."""
    folder = new_path(spark, "merge-job")
    store = Store(spark, f"{folder}/store")
    values = events_stream(spark, sf_dir).select("user_id", F.col("event_id").alias("version"), F.round(F.col("value") * 100).cast("bigint").alias("cents"))
    for _ in range(2):  # the second finds nothing new
        merge_job.merge_job(values, store, "latest", "user_id", "version", f"{folder}/checkpoint").awaitTermination()
    return store


def _from_sql(statement: str):
    """A call of a registered function."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql_surface.register(bind(spark, sf_dir))
        return spark.sql(statement)

    return run


def _script(name: str, **given):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = bind(spark, sf_dir)
        sql_surface.register(db)
        return sql_surface.call(db, name, **given)

    return run


QUERIES |= {
    "op_lateral_top": _lateral_top,
    "op_latest_before": _latest_before,
    "op_saved_state": _saved_orders,
    "op_merge_job": lambda spark, sf_dir: _merged(spark, sf_dir).load().database["latest"],
    "op_merge_audit": lambda spark, sf_dir: merge_job.audited(_merged(spark, sf_dir)),
    "op_sql_monthly_sales": _from_sql("SELECT * FROM monthly_sales_summary(p_year => 1998, p_month => 1)"),
    "op_sql_revenue_by_month": _from_sql("SELECT * FROM revenue_by_month(DATE '1998-01-01', DATE '1999-01-01')"),
    "op_sql_top_products": _from_sql("SELECT * FROM top_products_per_category(p_end => DATE '1999-01-01', p_start => DATE '1998-01-01')"),
    "op_sql_lateral_function": _from_sql("SELECT c.customer_id, count(f.order_id) AS orders, CAST(sum(f.total_amount) AS DECIMAL(19,4)) AS total FROM retail_customers c LEFT JOIN LATERAL customer_orders(c.customer_id) f GROUP BY c.customer_id"),
    "op_sql_search_products": _script("search_products", as_of=str(AS_OF), min_price=950, search_text="e", sort_column="Product_Name", sort_dir="desc", page_number=2),
    "op_sql_process_orders": _script("process_pending_orders", as_of=str(AS_OF), batch_size=100),
}

SALES = "sales AS (SELECT product_id, order_id, created_at, CAST(sum(quantity) AS BIGINT) AS quantity FROM b_lines JOIN b_orders USING (order_id) GROUP BY ALL), audits AS (SELECT event_id AS audit_id, user_id AS product_id, ts - INTERVAL 26 YEAR AS adjusted_at FROM events)"
BEFORE = "SELECT row_number() OVER (ORDER BY created_at DESC, order_id DESC) AS place, order_id, created_at, quantity FROM sales s WHERE s.product_id = a.product_id AND s.created_at < a.adjusted_at ORDER BY created_at DESC, order_id DESC LIMIT 3"
ORACLES |= {
    "op_lateral_top": with_views(f"WITH {SALES} SELECT audit_id, product_id, order_id, created_at, quantity FROM audits a LEFT JOIN LATERAL ({BEFORE}) ON true"),
    "op_latest_before": with_views(f"WITH {SALES} SELECT audit_id, product_id, CAST(place AS INTEGER) AS place, order_id, created_at, quantity FROM audits a LEFT JOIN LATERAL ({BEFORE}) ON true"),
    "op_saved_state": with_views(f"WITH f AS (SELECT min(order_id) AS k FROM b_orders WHERE status = 'Completed') SELECT order_id, CASE WHEN order_id = k THEN 'Refunded' ELSE status END AS status, CASE WHEN order_id = k THEN {NOON} END AS updated_at FROM b_orders, f"),
    "op_merge_job": "SELECT user_id, event_id AS version, CAST(round(value * 100) AS BIGINT) AS cents FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1",
    "op_merge_audit": "SELECT 'merge' AS job, CAST(0 AS BIGINT) AS batch_id, count(*) AS changes, count(DISTINCT user_id) AS inserted, CAST(0 AS BIGINT) AS updated, count(*) - count(DISTINCT user_id) AS ignored FROM events",
    "op_sql_lateral_function": with_views(f"SELECT c.customer_id, count(order_id) AS orders, {money_sql('sum(total_m)')} AS total FROM b_customers c LEFT JOIN b_orders USING (customer_id) GROUP BY 1"),
}
#: Calls from SQL that must give what the routine gives.
SAME_AS = {"op_sql_monthly_sales": "r01_monthly_sales_summary", "op_sql_revenue_by_month": "rp01_revenue_by_month", "op_sql_top_products": "rp05_top_products_per_category", "op_sql_search_products": "r14_search_products", "op_sql_process_orders": "r17_process_pending_orders"}


def _local_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue by month of a shop whose clock is half past five ahead of the data's."""
    return patterns.revenue_by_month(bind(spark, sf_dir), *YEAR, zone="+05:30")


def _buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders in ten buckets of equal width from 50,000 to 150,000, and those below (0) and above (11)."""
    bucket = F.width_bucket(F.col("total_amount").cast("double"), F.lit(50_000.0), F.lit(150_000.0), F.lit(10))
    return bind(spark, sf_dir)["orders"].groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("orders"), F.min("total_amount").alias("least"), F.max("total_amount").alias("most"))


def _scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Functions whose edge cases differ between engines, over all products: a text repeated a negative number of times is null, positions begin at 1, a distance has no sign."""
    c = F.col
    off = c("category_id") - 25
    return bind(spark, sf_dir)["products"].select("product_id", replicate("*", off).alias("stars"), F.abs(off).alias("distance"), charindex("O", c("product_name")).alias("found_at"), charindex("", c("sku")).alias("nowhere"), F.length("product_name").alias("length"), F.left("product_name", F.lit(4)).alias("start"), nullif_divided(c("price"), off).alias("each"))


def nullif_divided(a: Column, b: Column) -> Column:
    """a / b as money; null for a b of 0."""
    return money(a / F.nullif(b.cast("decimal(10,0)"), F.lit(0).cast("decimal(10,0)")))


def _rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored stock after a withdrawal that the guard rejects: nothing is saved, the version before is read."""
    store = Store(spark, new_path(spark, "guarded"))
    db = bind(spark, sf_dir)
    first = store.save(db.replaced(**{t: db[t] for t in ("inventory", "inventory_audit")}), store.load())
    try:
        store.save(commands.adjust_stock(first.database, 26, 1, -1_000_000, "too much", "auditor", AS_OF)[0], first)
        raise AssertionError("the guard let it pass")
    except reports.RoutineError:
        pass
    return store.load().database["inventory"].select("product_id", "warehouse_id", "quantity_on_hand")


def _views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made by a query from views of the model, and read back with the types of its columns."""
    bind(spark, sf_dir).views("made_")
    path = new_path(spark, "table")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW made_totals AS SELECT o.customer_id, o.status, sum(o.total_amount) AS total, max(o.created_at) AS last_at FROM made_orders o GROUP BY o.customer_id, o.status")
    spark.sql("SELECT t.customer_id, c.last_name, t.status, CAST(t.total AS DECIMAL(19,4)) AS total, t.last_at FROM made_totals t JOIN made_customers c ON c.customer_id = t.customer_id").write.parquet(path)
    return spark.read.parquet(path)


QUERIES |= {
    "rp01_revenue_by_local_month": _local_months,
    "op_width_bucket": _buckets,
    "op_scalar_functions": _scalars,
    "op_guarded_save": _rejected,
    "op_made_table": _views,
}
_OFF = "(category_id - 25)"
ORACLES |= {
    "rp01_revenue_by_local_month": with_views(f"WITH local AS (SELECT created_at + INTERVAL 330 MINUTE AS here, total_m FROM b_orders WHERE status NOT IN ('Cancelled', 'Refunded')), months AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1998-01-01', TIMESTAMP '1998-12-31', INTERVAL 1 MONTH)) AS DATE) AS period_start) SELECT period_start, CAST(count(here) AS INTEGER) AS order_count, {money_sql('coalesce(sum(total_m), 0)')} AS revenue FROM months LEFT JOIN local ON date_trunc('month', here) = period_start GROUP BY 1"),
    "op_width_bucket": with_views(f"SELECT CAST(CASE WHEN total_m < 500000000 THEN 0 WHEN total_m >= 1500000000 THEN 11 ELSE (total_m - 500000000) // 100000000 + 1 END AS INTEGER) AS bucket, count(*) AS orders, {money_sql('min(total_m)')} AS least, {money_sql('max(total_m)')} AS most FROM b_orders GROUP BY 1"),
    "op_scalar_functions": with_views(f"SELECT product_id, CASE WHEN {_OFF} >= 0 THEN repeat('*', {_OFF}) END AS stars, abs({_OFF}) AS distance, CAST(strpos(lower(product_name), 'o') AS INTEGER) AS found_at, 0 AS nowhere, CAST(length(product_name) AS INTEGER) AS length, left(product_name, 4) AS start, CASE WHEN {_OFF} <> 0 THEN {money_sql(f'sign({_OFF}) * ((2 * price_m + abs({_OFF})) // (2 * abs({_OFF})))')} END AS each FROM b_products"),
    "op_guarded_save": with_views("SELECT product_id, CAST(warehouse_id AS INTEGER) AS warehouse_id, quantity_on_hand FROM b_inventory"),
    "op_made_table": with_views(f"SELECT o.customer_id, last_name, status, {money_sql('sum(total_m)')} AS total, max(created_at) AS last_at FROM b_orders o JOIN b_customers c ON c.customer_id = o.customer_id GROUP BY ALL"),
}
