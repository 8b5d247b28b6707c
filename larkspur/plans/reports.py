"""The read-only routines: sales, customers, stock, search and shipping. All take explicit parameters and return a pinned schema.

as_of stands for the current time wherever a routine needs one.
"""

from __future__ import annotations

import logging
import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions import charindex, contains_text, days_between, full_name, iso_date, mask_email, money, month_boundaries, tier, week_after_sunday, year_boundaries, zero_money
from ..operators.relational import any_contains, page, where_given, with_total
from ..sources.catalog import Database

CANCELLED = ("Cancelled",)
#: Notices of the routines.
log = logging.getLogger(__name__)


class RoutineError(Exception):
    """A business rule that doesn't hold; nothing has been changed."""

    sqlstate = "P0001"


def _ts(value: date | datetime) -> Column:
    return F.lit(str(value)).cast("timestamp_ntz")


def _months_back(at: datetime, n: int) -> Column:
    """n months earlier, at the same time of day."""
    return _ts(at) - F.expr(f"interval {n} months")


def line_revenue() -> Column:
    """The amount of a line: quantity * unit price."""
    return F.col("quantity") * F.col("unit_price")


def sold_lines(db: Database, first: Column, last: Column, excluded: tuple[str, ...] = CANCELLED) -> DataFrame:
    """Lines of orders from first to last, both included, that aren't of an excluded status, with their product."""
    orders = db["orders"].where(F.col("created_at").between(first, last) & ~F.col("status").isin(*excluded)).select("order_id", "created_at")
    lines = db["order_lines"].select("order_id", "product_id", "quantity", "unit_price", line_revenue().alias("revenue"))
    return lines.join(orders, "order_id").join(db["products"].select("product_id", "product_name", "category", "sku"), "product_id")


def monthly_sales_summary(db: Database, year: int | None = None, month: int | None = None, as_of: datetime | None = None) -> DataFrame:
    """Products sold in a month: units, revenue, mean price, orders, and the revenue of and rank in their category.

    The month ends at midnight of its last day: an order at that moment counts, a later one of that day doesn't. Products are told apart by id,
    so two of one name are two rows. Without as_of, year and month must be given.
    """
    year, month = year or as_of.year, month or as_of.month
    first = date(year, month, 1)
    last = (first.replace(day=28) + timedelta(days=4)).replace(day=1) - timedelta(days=1)
    sold = sold_lines(db, _ts(first), _ts(last))
    rows = sold.groupBy("category", "product_id", "product_name").agg(
        F.sum("quantity").cast("bigint").alias("units_sold"), money(F.sum("revenue")).alias("revenue"), money(F.avg("unit_price")).alias("avg_selling_price"), F.countDistinct("order_id").alias("order_count")
    )
    category = Window.partitionBy("category")
    rows = rows.withColumn("category_revenue", money(F.sum("revenue").over(category))).withColumn("rank_in_category", F.rank().over(category.orderBy(F.desc("revenue"))).cast("bigint"))
    return rows.orderBy(F.desc("category_revenue"), "rank_in_category", "category", "product_id").drop("product_id")


def _spend(db: Database, customer_id: int) -> DataFrame:
    """One row, also without orders: total, orders, first_at, last_at of what wasn't cancelled."""
    mine = db["orders"].where((F.col("customer_id") == customer_id) & (F.col("status") != "Cancelled"))
    return mine.agg(money(F.sum("total_amount")).alias("total"), F.count("*").cast("int").alias("orders"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"))


def _average() -> Column:
    return F.when(F.col("orders") > 0, money(F.col("total") / F.col("orders"))).otherwise(zero_money())


def customer_lifetime_value(db: Database, customer_id: int, as_of: datetime) -> DataFrame:
    """One row of a customer; none for an unknown one. Without orders: count 0, mean 0, total null, tier Bronze, dates and tenure null."""
    who = db["customers"].where(F.col("customer_id") == customer_id)
    return who.crossJoin(F.broadcast(_spend(db, customer_id))).select(
        F.col("customer_id").cast("int").alias("customer_id"), full_name().alias("customer_name"), "email", F.col("total").alias("lifetime_revenue"), F.col("orders").alias("total_orders"), _average().alias("avg_order_value"),
        month_boundaries(F.col("first_at"), _ts(as_of)).alias("tenure_months"), iso_date(F.col("first_at")).alias("first_order_date"), iso_date(F.col("last_at")).alias("last_order_date"), tier(F.col("total")).alias("tier"),
    )


REFERRALS = """
WITH RECURSIVE tree AS (
  SELECT customer_id, concat(first_name, ' ', last_name) AS name, 1 AS level FROM {customers} WHERE referred_by = :root
  UNION ALL
  SELECT c.customer_id, concat(c.first_name, ' ', c.last_name), t.level + 1 FROM {customers} c JOIN tree t ON c.referred_by = t.customer_id WHERE t.level < 5
) SELECT * FROM tree
"""


def customer_referrals(db: Database, customer_id: int) -> DataFrame:
    """customer_id, name, level, referral_revenue of those a customer has brought in, over up to five levels; a cycle repeats at deeper levels."""
    tree = db.spark.sql(REFERRALS, args={"root": customer_id}, customers=db["customers"])
    paid = db["orders"].where("status <> 'Cancelled'").join(tree.select("customer_id").distinct(), "customer_id", "left_semi").groupBy("customer_id").agg(F.sum("total_amount").alias("spent"))
    rows = tree.distinct().join(paid, "customer_id", "left").select(F.col("customer_id").cast("int").alias("customer_id"), "name", "level", money(F.coalesce("spent", zero_money())).alias("referral_revenue"))
    return rows.orderBy("level", F.desc("referral_revenue"), "customer_id")


def customer_lifetime_value_referrals(db: Database, customer_id: int) -> DataFrame:
    """customer_referrals() by the names customer_name and referral_level."""
    return customer_referrals(db, customer_id).withColumnsRenamed({"name": "customer_name", "level": "referral_level"})


PERIODS = {"week": week_after_sunday, "month": lambda c: F.trunc(c, "month"), "quarter": lambda c: F.trunc(c, "quarter")}


def product_performance(db: Database, start: date, end: date, group_by: str = "month") -> DataFrame:
    """Products by week, month or quarter (anything else: month). Both bounds count, each at midnight; a Sunday is in the next Monday's week."""
    period = PERIODS.get(group_by, PERIODS["month"])(F.col("created_at"))
    sold = sold_lines(db, _ts(start), _ts(end)).withColumn("period_start", period)
    rows = sold.groupBy("product_id", "product_name", "category", "period_start").agg(
        F.sum("quantity").cast("bigint").alias("units_sold"), money(F.sum("revenue")).alias("revenue"), F.countDistinct("order_id").alias("order_count"), F.avg(F.col("quantity").cast("double")).alias("avg_units_per_order")
    )
    return rows.withColumn("product_id", F.col("product_id").cast("int")).orderBy("period_start", F.desc("revenue"), "product_id")


def low_stock_alerts(db: Database, as_of: datetime, threshold: int = 10, warehouse_id: int | None = None) -> DataFrame:
    """Active products at or under their reorder point (the threshold where they have none), largest shortfall first. If there are none, it is logged where notices are on."""
    stock = where_given(db["inventory"], F.col("warehouse_id") == warehouse_id if warehouse_id is not None else None)
    point = F.coalesce("reorder_point", F.lit(threshold))
    rows = stock.join(db["products"].where("is_active").select("product_id", "product_name", "sku", point.cast("int").alias("reorder_point")), "product_id").join(db["warehouses"], "warehouse_id").where("quantity_on_hand <= reorder_point")
    rows = rows.select(
        F.col("product_id").cast("int").alias("product_id"), "product_name", "sku", F.col("warehouse_id").cast("int").alias("warehouse_id"), "warehouse_name", F.col("quantity_on_hand").alias("current_stock"), "reorder_point",
        (F.col("reorder_point") - F.col("quantity_on_hand")).alias("shortfall_qty"), F.date_format("last_restocked", "MM/dd/yyyy").alias("last_restocked_formatted"), days_between(F.col("last_restocked"), _ts(as_of)).alias("days_since_restock"),
    )
    if log.isEnabledFor(logging.INFO) and rows.isEmpty():
        log.info("No low-stock alerts found.")
    return rows.orderBy(F.desc_nulls_last("shortfall_qty"), F.desc_nulls_last("days_since_restock"), "product_id", "warehouse_id")


def _found_orders(db: Database, customer_id: int | None, status: str | None, first: Column, last: Column, text: str | None) -> DataFrame:
    orders = where_given(db["orders"], F.col("created_at").between(first, last), F.col("customer_id") == customer_id if customer_id is not None else None, F.col("status") == status if status is not None else None)
    who = where_given(db["customers"], any_contains(["first_name", "last_name", "email"], text)).select("customer_id", full_name().alias("customer_name"), "email")
    return orders.join(who, "customer_id")


def order_history(db: Database, as_of: datetime, customer_id: int | None = None, status: str | None = None, date_from: datetime | None = None, date_to: datetime | None = None, search_text: str | None = None, page_number: int = 1, page_size: int = 25) -> DataFrame:
    """A page of orders, latest first, with row_num and total_count over all pages. Without dates: the last six months."""
    found = _found_orders(db, customer_id, status, _ts(date_from) if date_from else _months_back(as_of, 6), _ts(date_to or as_of), search_text)
    paged = with_total(found, page(found, [F.desc("created_at"), F.col("order_id")], page_number, page_size))
    amount = F.col("total_amount")
    return paged.select(
        F.col("order_id").cast("int").alias("order_id"), F.col("customer_id").cast("int").alias("customer_id"), "customer_name", "email", "total_amount", "discount_pct", "status", days_between(F.col("created_at"), _ts(as_of)).alias("days_ago"),
        F.date_format("created_at", "MMM d, yyyy").alias("order_date_display"), F.date_format(F.last_day("created_at"), "MM/dd/yyyy").alias("month_end"), F.when(amount >= 1000, "High Value").when(amount >= 100, "Medium Value").otherwise("Low Value").alias("value_tier"),
        F.repeat(F.lit("★"), F.when(amount >= 1000, 3).when(amount >= 100, 2).otherwise(1)).alias("star_rating"), "row_num", "total_count",
    ).orderBy("row_num")


def search_orders(db: Database, as_of: datetime, customer_id: int | None = None, status: str | None = None, date_from: datetime | None = None, date_to: datetime | None = None, search_text: str | None = None, page_number: int = 1, page_size: int = 20) -> DataFrame:
    """As order_history(), with fewer columns and the last three months by default."""
    found = _found_orders(db, customer_id, status, _ts(date_from) if date_from else _months_back(as_of, 3), _ts(date_to or as_of), search_text)
    paged = page(found, [F.desc("created_at"), F.col("order_id")], page_number, page_size).orderBy("row_num")
    return paged.select(F.col("order_id").cast("int").alias("order_id"), F.col("customer_id").cast("int").alias("customer_id"), "customer_name", "total_amount", "status", iso_date(F.col("created_at")).alias("order_date"), days_between(F.col("created_at"), _ts(as_of)).alias("days_old"))


def customer_summary(db: Database, customer_id: int, as_of: datetime) -> DataFrame:
    """One row of a customer with masked email, age (years apart), spending, tier and the next order expected 30 days after the last."""
    who = db["customers"].where(F.col("customer_id") == customer_id)
    return who.crossJoin(F.broadcast(_spend(db, customer_id))).select(
        F.col("customer_id").cast("int").alias("customer_id"), full_name().alias("full_name"), mask_email(F.col("email")).alias("masked_email"), year_boundaries(F.col("birth_date"), _ts(as_of)).alias("age"), F.col("total").alias("total_spend"), F.col("orders").alias("order_count"),
        _average().alias("avg_order_value"), tier(F.col("total")).alias("tier"), month_boundaries(F.col("first_at"), _ts(as_of)).alias("tenure_months"), iso_date(F.col("first_at")).alias("first_order_date"), iso_date(F.col("last_at")).alias("last_order_date"),
        iso_date(F.col("last_at") + F.expr("interval 30 days")).alias("estimated_next_order"),
    )


#: Sort columns by name without case and underscores; any other name sorts by price.
SORTABLE = {"price": "price", "productname": "product_name", "createdat": "created_at", "sku": "sku"}


def search_products(db: Database, as_of: datetime, category: str | None = None, min_price=None, max_price=None, search_text: str | None = None, sort_column: str = "Price", sort_dir: str = "ASC", page_number: int = 1, page_size: int = 20) -> DataFrame:
    """A page of active products that have a category. The sort column and direction are looked up, never put into a query."""
    column = F.col(SORTABLE.get((sort_column or "").replace("_", "").lower(), "price"))
    order = column.desc() if (sort_dir or "").upper() == "DESC" else column.asc()
    goods = where_given(
        db["products"], F.col("is_active"), F.col("price") >= F.lit(min_price).cast("decimal(19,4)") if min_price is not None else None, F.col("price") <= F.lit(max_price).cast("decimal(19,4)") if max_price is not None else None, contains_text(F.col("product_name"), search_text) if search_text is not None else None
    )
    found = goods.join(where_given(db["categories"], F.col("category_name") == category if category is not None else None), "category_id")
    paged = page(found, [order, F.col("product_id")], page_number, page_size).orderBy("row_num")
    return paged.select(F.col("product_id").cast("int").alias("product_id"), "product_name", "sku", "price", F.col("category_id").cast("int").alias("category_id"), "category_name", charindex(search_text, F.col("product_name")).alias("match_position"), days_between(F.col("created_at"), _ts(as_of)).alias("age_days"))


#: Rate for each pound by the first three characters of the zip code, as text ranges; others pay OTHER_RATE.
ZONES = [("100", "199", "0.85"), ("300", "399", "1.05"), ("600", "699", "1.20"), ("900", "999", "1.45")]
OTHER_RATE = "1.10"


def shipping_quotes(db: Database, orders: DataFrame, zip_code: Column, expedited: Column, as_of: datetime) -> DataFrame:
    """order_id, total_weight_lbs, shipping_cost, is_expedited, estimated_delivery for every order with lines. Orders of 50 or more ship free."""
    dec = lambda x: F.lit(x).cast("decimal(10,2)")
    lines = db["order_lines"].select("order_id", "product_id", "quantity").join(orders.select("order_id"), "order_id", "left_semi").join(db["products"].select("product_id", "weight_lbs"), "product_id")
    weight = lines.groupBy("order_id").agg(F.sum(F.col("weight_lbs") * F.col("quantity")).cast("decimal(10,3)").alias("total_weight_lbs"))
    prefix, rate = F.substring(zip_code, 1, 3), None
    for low, high, each in ZONES:
        rate = F.when(prefix.between(low, high), dec(each)) if rate is None else rate.when(prefix.between(low, high), dec(each))
    base = money(F.round(F.col("total_weight_lbs") * rate.otherwise(dec(OTHER_RATE)), 2))
    cost = F.when(F.col("total_amount") >= 50, zero_money()).otherwise(money(base + F.when(F.col("is_expedited"), money(base * dec("0.50"))).otherwise(zero_money())))
    rows = orders.withColumn("is_expedited", expedited).join(weight, "order_id")
    return rows.select(F.col("order_id").cast("int").alias("order_id"), "total_weight_lbs", cost.alias("shipping_cost"), "is_expedited", F.date_add(_ts(as_of).cast("date"), F.when(F.col("is_expedited"), 1).otherwise(5)).alias("estimated_delivery"))


def calculate_shipping(db: Database, order_id: int, ship_to_zip: str, as_of: datetime, is_expedited: bool = False, tracking_ref: str | None = None) -> DataFrame:
    """The quote of one order; an order without lines, or none at all, isn't found."""
    quote = shipping_quotes(db, db["orders"].where(F.col("order_id") == order_id), F.lit(ship_to_zip), F.lit(is_expedited), as_of)
    if quote.isEmpty():
        raise RoutineError(f"Order {order_id} not found.")
    tracking = (tracking_ref or str(uuid.uuid4())).replace("-", "").lower()
    return quote.select("order_id", F.lit(tracking).alias("tracking_number"), "total_weight_lbs", "shipping_cost", "is_expedited", "estimated_delivery", F.date_format(_ts(as_of), "yyyy-MM-dd'T'HH:mm:ss").alias("calculated_at"))


def active_customers(db: Database, min_orders: int) -> DataFrame:
    """The ten customers with most orders, of those with min_orders or more."""
    n = db["orders"].groupBy("customer_id").agg(F.count("*").alias("order_count")).where(F.col("order_count") >= min_orders)
    top = n.orderBy(F.desc("order_count"), "customer_id").limit(10)
    return top.join(db["customers"].select("customer_id", full_name().alias("customer_name")), "customer_id").select(F.col("customer_id").cast("int").alias("customer_id"), "customer_name", "order_count").orderBy(F.desc("order_count"), "customer_id")
