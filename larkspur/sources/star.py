"""The driver's star schema bound to the retail model.

What the star lacks is derived from its keys, the same way here and in the SQL of SQL_VIEWS. The order status F is Completed, O Pending and P Cancelled. The
total of a line is l_extendedprice; its unit price is total / quantity. Lines have no key in the star, so line_id is null.
"""

from __future__ import annotations

from types import MappingProxyType

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from .catalog import Database


#: The tables of the star.
STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str) -> Database:
    """Orders, lines, products, categories, customers, warehouses, inventory, coupons and staged products over the driver tables."""
    t = {n: read(spark, sf_dir, n) for n in ("orders", "lineitem", "part", "customer", "nation", "supplier")}
    c = F.col
    status = F.when(c("o_orderstatus") == "F", "Completed").when(c("o_orderstatus") == "O", "Pending").otherwise("Cancelled")
    none = lambda kind: F.lit(None).cast(kind)
    epoch = F.lit("1995-01-01 00:00:00").cast("timestamp_ntz")
    orders = t["orders"].select(
        c("o_orderkey").alias("order_id"), c("o_custkey").alias("customer_id"), c("o_orderdate").cast("timestamp_ntz").alias("created_at"), money("o_totalprice").alias("total_amount"),
        F.lit(0).cast("decimal(5,2)").alias("discount_pct"), none("string").alias("notes"), status.alias("status"), F.lit(False).alias("requires_approval"), none("int").alias("invoice_id"), none("timestamp_ntz").alias("updated_at"), none("timestamp_ntz").alias("processed_at"),
    )
    amount = money("l_extendedprice")
    lines = t["lineitem"].select(none("int").alias("line_id"), c("l_orderkey").alias("order_id"), c("l_partkey").alias("product_id"), c("l_quantity").cast("smallint").alias("quantity"), money(amount / c("l_quantity").cast("decimal(5,0)")).alias("unit_price"), amount.alias("line_total"))
    key = c("p_partkey")
    products = t["part"].select(
        key.alias("product_id"), F.concat(F.lit("SKU-"), key).alias("sku"), c("p_name").alias("product_name"), c("p_type").alias("category"), c("p_size").alias("category_id"), money("p_retailprice").alias("price"), c("p_size").cast("decimal(10,3)").alias("weight_lbs"),
        (key % 10 != 0).alias("is_active"), F.when(key % 4 != 0, (key % 20).cast("int")).alias("reorder_point"), F.lit(50).alias("reorder_quantity"), (key % 25).cast("int").alias("default_warehouse_id"),
        (epoch + F.make_dt_interval((key % 1000).cast("int"))).alias("created_at"), none("timestamp_ntz").alias("updated_at"),
    )
    categories = t["part"].select(c("p_size").alias("category_id")).distinct().select("category_id", F.concat(F.lit("Size "), "category_id").alias("category_name"))
    who = c("c_custkey")
    customers = t["customer"].select(
        who.alias("customer_id"), none("string").alias("external_id"), c("c_mktsegment").alias("first_name"), c("c_name").alias("last_name"), F.concat(F.lower(F.replace(c("c_name"), F.lit("#"), F.lit("."))), F.lit("@example.com")).alias("email"),
        none("string").alias("phone"), F.date_add(F.lit("1950-01-01").cast("date"), (who % 18000).cast("int")).alias("birth_date"), F.when(who > 0, F.floor(who / 10).cast("bigint")).alias("referred_by"), epoch.alias("created_at"), none("timestamp_ntz").alias("updated_at"),
    )
    warehouses = t["nation"].select(c("n_nationkey").alias("warehouse_id"), c("n_name").alias("warehouse_name"))
    place = F.explode(F.array_distinct(F.array((key % 25).cast("int"), ((key * 7 + 3) % 25).cast("int"))))
    inventory = t["part"].select(key.alias("product_id"), place.alias("warehouse_id"), (key * 13).alias("_k"), key.alias("_p")).select(
        "product_id", "warehouse_id", ((c("_k") + c("warehouse_id")) % 40).cast("int").alias("quantity_on_hand"), none("timestamp_ntz").alias("last_updated"), F.when(c("_p") % 7 != 0, F.lit("2001-01-01 00:00:00").cast("timestamp_ntz") - F.make_dt_interval((c("_p") % 300).cast("int"))).alias("last_restocked")
    )
    staged = key % 5
    staging = t["part"].where(staged < 3).select(
        key.cast("int").alias("staging_id"), none("int").alias("product_id"), F.when(staged == 2, F.concat(F.lit("NEW-"), key)).otherwise(F.concat(F.lit("SKU-"), key)).alias("sku"), c("p_name").alias("product_name"),
        money(F.when(key % 3 == 0, money("p_retailprice") + 1).otherwise(money("p_retailprice"))).alias("price"), c("p_size").alias("category_id"), (key % 4 != 0).alias("is_active"), F.lit("2001-01-01").cast("date").alias("effective_date"), F.when(key % 11 == 0, F.lit("2001-02-01").cast("date")).alias("expires_date"),
    )
    giver = c("s_suppkey")
    coupons = t["supplier"].select(
        giver.alias("coupon_id"), c("s_name").alias("code"), (giver % 4 * 10).cast("decimal(5,2)").alias("discount_pct"), (giver % 5 != 4).alias("is_active"), F.when(giver % 2 == 0, F.lit("2001-01-01 00:00:00")).otherwise(F.lit("2002-01-01 00:00:00")).cast("timestamp_ntz").alias("expires_at"), c("s_nationkey").alias("use_count"),
    )
    return Database(spark, MappingProxyType({"coupons": coupons, "orders": orders, "order_lines": lines, "products": products, "categories": categories, "customers": customers, "warehouses": warehouses, "inventory": inventory, "product_staging": staging}))


#: The same bindings in SQL; money is whole ten-thousandths (bigint) here and becomes decimal at the end.
SQL_VIEWS = {
    "b_orders": "SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS created_at, CAST(round(o_totalprice * 100) AS BIGINT) * 100 AS total_m, CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Pending' ELSE 'Cancelled' END AS status FROM orders",
    "b_lines": "SELECT *, quantity * unit_m AS amount_m FROM (SELECT l_orderkey AS order_id, l_partkey AS product_id, CAST(l_quantity AS BIGINT) AS quantity, CAST(round(l_extendedprice * 100) AS BIGINT) * 100 AS stored_m, (CAST(round(l_extendedprice * 100) AS BIGINT) * 200 + CAST(l_quantity AS BIGINT)) // (2 * CAST(l_quantity AS BIGINT)) AS unit_m FROM lineitem)",
    "b_products": "SELECT p_partkey AS product_id, 'SKU-' || p_partkey AS sku, p_name AS product_name, p_type AS category, p_size AS category_id, CAST(round(p_retailprice * 100) AS BIGINT) * 100 AS price_m, p_size AS weight, p_partkey % 10 <> 0 AS is_active, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 20 END AS reorder_point, TIMESTAMP '1995-01-01' + to_days(CAST(p_partkey % 1000 AS INTEGER)) AS created_at FROM part",
    "b_customers": "SELECT c_custkey AS customer_id, c_mktsegment AS first_name, c_name AS last_name, lower(replace(c_name, '#', '.')) || '@example.com' AS email, DATE '1950-01-01' + CAST(c_custkey % 18000 AS INTEGER) AS birth_date, CASE WHEN c_custkey > 0 THEN c_custkey // 10 END AS referred_by FROM customer",
    "b_coupons": "SELECT s_suppkey AS coupon_id, s_name AS code, s_suppkey % 4 * 10 AS discount, s_suppkey % 5 <> 4 AS is_active, s_suppkey % 2 = 1 AS is_valid, s_nationkey AS use_count FROM supplier",
    "b_inventory": "SELECT product_id, warehouse_id, CAST((product_id * 13 + warehouse_id) % 40 AS INTEGER) AS quantity_on_hand, CASE WHEN product_id % 7 <> 0 THEN TIMESTAMP '2001-01-01' - to_days(CAST(product_id % 300 AS INTEGER)) END AS last_restocked FROM (SELECT DISTINCT p_partkey AS product_id, unnest([p_partkey % 25, (p_partkey * 7 + 3) % 25]) AS warehouse_id FROM part)",
}


def with_views(body: str) -> str:
    """The query with the bindings that it names in front."""
    used = [f"{name} AS ({sql})" for name, sql in SQL_VIEWS.items() if name in body]
    recursive = "RECURSIVE " if "RECURSIVE" in body else ""
    return f"WITH {recursive}{', '.join(used)}{',' if body.lstrip().startswith('WITH') else ''} {body.replace('WITH RECURSIVE ', '', 1) if recursive else body.replace('WITH ', '', 1) if body.lstrip().startswith('WITH') else body}"


def money_sql(expr: str) -> str:
    """Ten-thousandths as decimal(19,4)."""
    return f"CAST(CAST({expr} AS DECIMAL(19,0)) * CAST(0.0001 AS DECIMAL(4,4)) AS DECIMAL(19,4))"


def half_up_sql(total: str, n: str) -> str:
    """total / n in whole ten-thousandths, half-up, for values of 0 or more."""
    return f"(2 * CAST({total} AS HUGEINT) + {n}) // (2 * {n})"
