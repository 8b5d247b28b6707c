"""The routines that change state: each takes a database and returns the new one and a result.

A rule that doesn't hold raises RoutineError and leaves the database as it is. The tables of a batch command change by joins and projections over the whole
table, not row by row; single rows are looked up by key first, as their values decide what happens.
"""

from __future__ import annotations

from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import MONEY, full_name, money
from ..operators.merge import Clause, action_summary, merged
from ..operators.relational import allocated
from ..sources.catalog import Database
from ..schemas import schema
from .reports import RoutineError

Outcome = tuple[Database, DataFrame]


def _ts(at: datetime | date) -> Column:
    return F.lit(str(at)).cast("timestamp_ntz")


def _one(df: DataFrame):
    return df.limit(1).first()


def _appended(db: Database, name: str, key: str, **values) -> tuple[DataFrame, int]:
    """The table with one more row, and its new key. Columns that aren't given are null."""
    table, columns = db[name], {f.name: f.dataType for f in schema(name)}
    key_value = (table.agg(F.max(key)).first()[0] or 0) + 1
    values = {**values, key: F.lit(key_value)}
    extra = db.spark.range(1).select(*[(values[c] if isinstance(values.get(c), Column) else F.lit(values.get(c))).cast(table.schema[c].dataType if c in table.columns else columns[c]).alias(c) for c in table.columns])
    return table.unionByName(extra), key_value


def _set(df: DataFrame, where: Column, **values) -> DataFrame:
    return df.withColumns({c: F.when(where, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)).cast(df.schema[c].dataType) for c, v in values.items()})


def adjust_stock(db: Database, product_id: int, warehouse_id: int, quantity: int, reason: str | None, adjusted_by: str, as_of: datetime) -> Outcome:
    """Adds to (or takes from) a place's stock, which begins at 0, and writes the audit: adjustment_id, previous_stock, new_stock."""
    here = (F.col("product_id") == product_id) & (F.col("warehouse_id") == warehouse_id)
    row = _one(db["inventory"].where(here))
    before = row["quantity_on_hand"] if row and row["quantity_on_hand"] is not None else 0
    after = before + quantity
    if after < 0:
        raise RoutineError(f"Insufficient stock. Current: {before}, Requested: {abs(quantity)}")
    inventory = db["inventory"]
    if row is None:
        fresh = db.spark.createDataFrame([(product_id, warehouse_id, 0)], "product_id int, warehouse_id int, quantity_on_hand int")
        inventory = inventory.unionByName(fresh, allowMissingColumns=True)
    audit, key = _appended(db, "inventory_audit", "audit_id", product_id=product_id, warehouse_id=warehouse_id, previous_qty=before, adjustment=quantity, new_qty=after, reason=reason, adjusted_by=adjusted_by, adjusted_at=_ts(as_of))
    result = db.spark.createDataFrame([(key, before, after)], "adjustment_id int, previous_stock int, new_stock int")
    return db.replaced(inventory=_set(inventory, here, quantity_on_hand=after, last_updated=_ts(as_of)), inventory_audit=audit), result


#: Orders in these states block another reorder of the same place.
OPEN_STATES = ("Draft", "Submitted", "InTransit")


def reorder_queue(db: Database, max_orders: int) -> DataFrame:
    """The lowest stocks of active products at or under their reorder point (10 without one) that no open purchase order covers."""
    low = db["inventory"].join(db["products"].where("is_active").select("product_id", "product_name", "reorder_quantity", F.coalesce("reorder_point", F.lit(10)).alias("_point")), "product_id").where("quantity_on_hand <= _point")
    opened = db["purchase_orders"].where(F.col("status").isin(*OPEN_STATES)).select("product_id", "warehouse_id")
    return low.join(opened, ["product_id", "warehouse_id"], "left_anti").orderBy("quantity_on_hand", "product_id", "warehouse_id").limit(max_orders)


def process_reorders(db: Database, created_by: str, as_of: datetime, max_orders: int = 50) -> Outcome:
    """Drafts purchase orders. The result joins them to the queue by product alone, so a product low in two warehouses gives four rows."""
    queue = reorder_queue(db, max_orders)
    order = [F.col("quantity_on_hand"), F.col("product_id"), F.col("warehouse_id")]
    fresh = allocated(db["purchase_orders"], "purchase_order_id", queue, order)
    drafts = fresh.select("purchase_order_id", F.col("product_id").cast("int").alias("product_id"), F.col("warehouse_id").cast("int").alias("warehouse_id"), F.col("reorder_quantity").alias("quantity"), F.lit("Draft").alias("status"), F.lit(created_by).alias("created_by"), _ts(as_of).alias("created_at"))
    stock = queue.select(F.col("product_id").cast("int").alias("product_id"), "product_name", F.col("quantity_on_hand").alias("current_stock"))
    result = drafts.join(stock, "product_id").select("purchase_order_id", "product_id", "product_name", F.col("quantity").alias("reorder_qty"), "current_stock").orderBy("purchase_order_id", "current_stock")
    return db.replaced(purchase_orders=db["purchase_orders"].unionByName(drafts)), result


def _product_price(db: Database, product_id: int, message: str) -> Decimal:
    row = _one(db["products"].where((F.col("product_id") == product_id) & F.col("is_active")).select("price"))
    if row is None or row["price"] is None:
        raise RoutineError(message.format(product_id))
    return row["price"]


def create_customer_order(db: Database, customer_id: int, product_id: int, quantity: int, as_of: datetime, notes: str | None = None, coupon_code: str | None = None) -> Outcome:
    """A priced order of one line. An unknown, inactive or expired coupon gives no discount, and yet its use is counted."""
    price = _product_price(db, product_id, "Product {} is not available.")
    discount = Decimal("0")
    if coupon_code is not None:
        coupon = _one(db["coupons"].where((F.col("code") == coupon_code) & F.col("is_active") & (F.col("expires_at") > _ts(as_of))))
        if coupon is not None:
            discount = coupon["discount_pct"]
        if discount is None:
            raise RoutineError(f"Coupon {coupon_code} is invalid or expired.")
    total = F.lit(price).cast(MONEY) * F.lit(quantity) * (F.lit(1) - F.lit(discount).cast("decimal(5,2)") / F.lit(Decimal("100.0")))
    orders, order_id = _appended(db, "orders", "order_id", customer_id=customer_id, created_at=_ts(as_of), total_amount=money(total), discount_pct=discount, notes=notes, status="Pending", requires_approval=False)
    lines, _ = _appended(db, "order_lines", "line_id", order_id=order_id, product_id=product_id, quantity=quantity, unit_price=price, line_total=money(total))
    coupons = db["coupons"] if coupon_code is None else _set(db["coupons"], F.col("code") == coupon_code, use_count=F.col("use_count") + 1)
    after = db.replaced(orders=orders, order_lines=lines, coupons=coupons)
    made = orders.where(F.col("order_id") == order_id).join(db["customers"].select("customer_id", full_name().alias("customer_name")), "customer_id")
    return after, made.select("order_id", "customer_id", "customer_name", "total_amount", "discount_pct", "status", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at_formatted"))


def create_order(db: Database, customer_id: int, product_id: int, quantity: int, as_of: datetime, notes: str | None = None) -> Outcome:
    """A plain order: order_id, total_amount, created_at. Its line has no line_total."""
    price = _product_price(db, product_id, "Product {} not found or inactive.")
    total = money(F.lit(price).cast(MONEY) * F.lit(quantity))
    orders, order_id = _appended(db, "orders", "order_id", customer_id=customer_id, created_at=_ts(as_of), total_amount=total, discount_pct=0, notes=notes, status="Pending", requires_approval=False)
    lines, _ = _appended(db, "order_lines", "line_id", order_id=order_id, product_id=product_id, quantity=quantity, unit_price=price)
    return db.replaced(orders=orders, order_lines=lines), orders.where(F.col("order_id") == order_id).select("order_id", "total_amount", "created_at")


def process_refund(db: Database, order_id: int, reason: str | None, processed_by: str, as_of: datetime) -> Outcome:
    """Refunds a completed order and puts its lines back in their products' default warehouses.

    Only places that have a stock row are restocked. Of two lines of a product the one of the smaller line_id (then of the smaller quantity) counts, as one update touches a row once.
    """
    row = _one(db["orders"].where((F.col("order_id") == order_id) & (F.col("status") == "Completed")))
    if row is None or row["total_amount"] is None:
        raise RoutineError(f"Order {order_id} is not eligible for refund.")
    amount = row["total_amount"]
    refunds, refund_id = _appended(db, "refunds", "refund_id", order_id=order_id, amount=amount, reason=reason, processed_by=processed_by, processed_at=_ts(as_of), status="Completed")
    lines = db["order_lines"].where(F.col("order_id") == order_id).join(db["products"].select("product_id", F.col("default_warehouse_id").alias("warehouse_id")), "product_id").where("warehouse_id is not null")
    back = lines.groupBy("product_id", "warehouse_id").agg(F.min_by("quantity", F.struct("line_id", "quantity")).alias("_back"))
    stock = db["inventory"].join(back, ["product_id", "warehouse_id"], "left")
    there = F.col("_back").isNotNull()
    stock = _set(stock, there, quantity_on_hand=F.col("quantity_on_hand") + F.col("_back"), last_updated=_ts(as_of)).select(*db["inventory"].columns)
    orders = _set(db["orders"], F.col("order_id") == order_id, status="Refunded", updated_at=_ts(as_of))
    result = db.spark.createDataFrame([(refund_id, amount, "Completed")], f"refund_id int, refund_amount {MONEY}, status string")
    return db.replaced(refunds=refunds, orders=orders, inventory=stock), result


def process_pending_orders(db: Database, as_of: datetime, batch_size: int = 100, processed_date: datetime | None = None) -> Outcome:
    """Processes the pending orders of the smallest ids: over 1000 needs approval (which is never taken back); bad rows go to processing_errors.

    A row is bad if a required value of it is null. The result holds the orders of the batch as they are afterwards.
    """
    at = _ts(processed_date or as_of)
    batch = db["orders"].where("status = 'Pending'").orderBy("order_id").limit(batch_size)
    wrong = F.col("customer_id").isNull() | F.col("total_amount").isNull()
    good, bad = batch.where(~wrong).select("order_id"), batch.where(wrong)
    chosen = F.col("_chosen").isNotNull()
    orders = db["orders"].join(F.broadcast(good.withColumn("_chosen", F.lit(True))), "order_id", "left")  # batch_size rows at most
    orders = _set(orders, chosen, status="Processed", updated_at=at, processed_at=at, requires_approval=F.when(F.col("total_amount") > 1000, True).otherwise(F.col("requires_approval"))).select(*db["orders"].columns, "_chosen")
    errors = allocated(db["processing_errors"], "error_id", bad.select("order_id"), [F.col("order_id")]).select("error_id", F.col("order_id").cast("int").alias("order_id"), F.lit("a required value is null").alias("error_message"), _ts(as_of).alias("occurred_at"))
    result = orders.where(chosen).drop("_chosen").orderBy("order_id")
    return db.replaced(orders=orders.drop("_chosen"), processing_errors=db["processing_errors"].unionByName(errors)), result


def upsert_customer(db: Database, external_id: str | None, first_name: str, last_name: str, email: str, as_of: datetime, phone: str | None = None, birth_date: date | None = None) -> Outcome:
    """Changes the customer of that external id, or adds one: action, customer_id, email. A change leaves the birth date but sets the phone, even to null; a null id always adds."""
    source = db.spark.createDataFrame([(external_id, first_name, last_name, email, phone, birth_date)], "external_id string, first_name string, last_name string, email string, phone string, birth_date date")
    s = {c: F.col(f"s_{c}") for c in source.columns}
    key = (db["customers"].agg(F.max("customer_id")).first()[0] or 0) + 1
    names = {c: s[c] for c in ("first_name", "last_name", "email", "phone")}
    rows = merged(db["customers"], source, "external_id", [Clause("matched", "UPDATE", {**names, "updated_at": _ts(as_of)}), Clause("not_matched", "INSERT", {**names, "external_id": s["external_id"], "birth_date": s["birth_date"], "customer_id": F.lit(key), "created_at": _ts(as_of)})])
    return db.replaced(customers=rows.drop("merge_action")), rows.where("merge_action is not null").select(F.col("merge_action").alias("action"), "customer_id", "email")


def catalog_merge(db: Database, effective: date, as_of: datetime) -> DataFrame:
    """The products after the staged ones that are valid on the day, with merge_action.

    The first clause that holds: an inactive staged row deactivates; a new price or name is taken (without reactivating); an active row without a product
    is added, with a null category; a product without a staged row is deactivated, each time.
    """
    day = F.lit(str(effective)).cast("date")
    valid = db["product_staging"].where((F.col("effective_date") <= day) & (F.col("expires_date").isNull() | (F.col("expires_date") > day)))
    source = valid.select("sku", "product_name", "price", "category_id", "is_active")
    now, off = _ts(as_of), {"is_active": F.lit(False), "updated_at": _ts(as_of)}
    differs = (F.col("price") != F.col("s_price")) | (F.col("product_name") != F.col("s_product_name"))
    clauses = [
        Clause("matched", "UPDATE", off, ~F.col("s_is_active")),
        Clause("matched", "UPDATE", {"product_name": F.col("s_product_name"), "price": F.col("s_price"), "updated_at": now}, differs),
        Clause("not_matched", "INSERT", {"sku": F.col("s_sku"), "product_name": F.col("s_product_name"), "price": F.col("s_price"), "category_id": F.col("s_category_id"), "is_active": F.lit(True), "reorder_quantity": F.lit(50), "created_at": now}, F.col("s_is_active")),
        Clause("not_matched_by_source", "UPDATE", off),
    ]
    return merged(db["products"], source, "sku", clauses)


def sync_product_catalog(db: Database, as_of: datetime, effective_date: date | None = None) -> Outcome:
    """Merges the staged catalogue: action, count, inserted, updated, deleted (always 0). New products get keys in the order of their sku."""
    rows = catalog_merge(db, effective_date or as_of.date(), as_of)
    old, new = rows.where("product_id is not null"), rows.where("product_id is null")
    added = allocated(db["products"], "product_id", new.drop("product_id"), [F.col("sku")]).select(*rows.columns)
    products = old.unionByName(added.withColumn("product_id", F.col("product_id").cast(rows.schema["product_id"].dataType))).drop("merge_action")
    return db.replaced(products=products), action_summary(rows)


def merge_latest(target: DataFrame, changes: DataFrame, key: str, version: str) -> tuple[DataFrame, DataFrame]:
    """The merge-job template: of each key the change of the highest version wins, applied once; running it again changes nothing. Gives the table and audit counts.

    changes has the columns of target, version among them; a change that isn't newer than the row it meets is ignored.
    """
    from ..operators.relational import latest_per_key

    best = latest_per_key(changes.where(F.col(key).isNotNull()), [key], [F.desc(version), *[F.col(c).asc_nulls_first() for c in sorted(target.columns) if c not in (key, version)]])
    newer = F.col(version).isNull() | (F.col(f"s_{version}") > F.col(version))
    sets = {c: F.col(f"s_{c}") for c in target.columns}
    rows = merged(target, best, key, [Clause("matched", "UPDATE", sets, newer), Clause("not_matched", "INSERT", sets)])
    return rows.drop("merge_action"), action_summary(rows)
