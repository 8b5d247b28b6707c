from datetime import date, datetime
from decimal import Decimal as D

import pytest

from larkspur.operators.merge import Clause, merged
from larkspur.operators.relational import latest_per_key
from larkspur.operators import validation
from larkspur.plans import commands
from larkspur.plans.reports import RoutineError
from larkspur.schemas import DDL, PRIMARY_KEYS
from larkspur.sources.catalog import Database

from .fixtures import AS_OF, database


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.proves("TC-AS-01..07", "R-05")
def test_adjust_stock(db):
    after, got = commands.adjust_stock(db, 1, 1, -5, "sold", "me", AS_OF)
    assert rows(got) == [(1, 5, 0)] and after["inventory"].where("product_id = 1 and warehouse_id = 1").first().quantity_on_hand == 0
    after, got = commands.adjust_stock(after, 5, 2, 4, None, "me", AS_OF)
    assert rows(got) == [(2, 0, 4)] and after["inventory"].count() == 8 and after["inventory_audit"].count() == 2
    with pytest.raises(RoutineError, match="Insufficient stock. Current: 4, Requested: 9"):
        commands.adjust_stock(after, 5, 2, -9, None, "me", AS_OF)
    with pytest.raises(RoutineError, match="Insufficient stock. Current: 0, Requested: 1"):
        commands.adjust_stock(db, 77, 1, -1, None, "me", AS_OF)
    assert db["inventory_audit"].count() == 0  # the old state is as it was


@pytest.mark.proves("TC-RO-01..02", "TC-RO-05", "R-07")
def test_process_reorders_fans_out_by_product(db):
    after, got = commands.process_reorders(db, "sys", AS_OF)
    assert rows(got) == [(9, 5, "Cord", 10, 3), (10, 1, "Bolt", 50, 4), (10, 1, "Bolt", 50, 5), (11, 1, "Bolt", 50, 4), (11, 1, "Bolt", 50, 5)]
    assert after["purchase_orders"].count() == 5
    again, none = commands.process_reorders(after, "sys", AS_OF)
    assert none.count() == 0 and again["purchase_orders"].count() == 5
    assert commands.process_reorders(db, "sys", AS_OF, 1)[1].count() == 1


@pytest.mark.proves("TC-CO-01..10", "R-08")
def test_create_customer_order_and_coupons(db):
    after, got = commands.create_customer_order(db, 1, 5, 2, AS_OF, coupon_code="TEN")
    assert rows(got) == [(11, 1, "Ann Lee", D("53.9820"), D("10.00"), "Pending", "2025-07-15 09:30:00")]
    assert after["order_lines"].where("order_id = 11").first().line_total == D("53.9820")
    assert {r.code: r.use_count for r in after["coupons"].collect()} == {"TEN": 1, "OLD": 3, "OFF": 0}
    old, got = commands.create_customer_order(db, 1, 5, 2, AS_OF, coupon_code="OLD")
    assert got.first().total_amount == D("59.9800") and {r.code: r.use_count for r in old["coupons"].collect()}["OLD"] == 4
    assert commands.create_customer_order(db, 1, 5, 2, AS_OF, coupon_code="nope")[1].first().discount_pct == D("0.00")
    for product in (4, 99):
        with pytest.raises(RoutineError, match=f"Product {product} is not available."):
            commands.create_customer_order(db, 1, product, 1, AS_OF)


@pytest.mark.proves("TC-EO-01..03", "R-16")
def test_create_order_leaves_the_line_total_empty(db):
    after, got = commands.create_order(db, 1, 1, 3, AS_OF)
    assert rows(got) == [(11, D("60.0000"), AS_OF)] and after["order_lines"].where("order_id = 11").first().line_total is None
    with pytest.raises(RoutineError, match="Product 4 not found or inactive."):
        commands.create_order(db, 1, 4, 3, AS_OF)


@pytest.mark.proves("TC-RF-01..04", "TC-RF-07", "R-10")
def test_process_refund(db):
    after, got = commands.process_refund(db, 7, "late", "me", AS_OF)
    assert rows(got) == [(1, D("5000.0000"), "Completed")]
    assert after["inventory"].where("product_id = 1 and warehouse_id = 1").first().quantity_on_hand == 9  # the line of the smaller id
    assert after["orders"].where("order_id = 7").first().status == "Refunded" and after["inventory"].count() == 7
    with pytest.raises(RoutineError, match="Order 7 is not eligible for refund."):
        commands.process_refund(after, 7, "again", "me", AS_OF)
    with pytest.raises(RoutineError):
        commands.process_refund(db, 8, "pending", "me", AS_OF)


@pytest.mark.proves("TC-PPO-01..02", "TC-PPO-04", "R-17")
def test_process_pending_orders(db):
    after, got = commands.process_pending_orders(db, AS_OF)
    assert [(r.order_id, r.status, r.requires_approval, r.processed_at) for r in got.collect()] == [(8, "Processed", True, AS_OF), (9, "Processed", True, AS_OF)]
    assert after["orders"].count() == 10 and commands.process_pending_orders(after, AS_OF)[1].count() == 0
    one = commands.process_pending_orders(db, AS_OF, 1, datetime(2025, 1, 1))[0]["orders"].where("status = 'Processed'").collect()
    assert [r.order_id for r in one] == [8]


@pytest.mark.proves("TC-UC-01..03", "TC-UC-05", "R-18")
def test_upsert_customer(db):
    after, got = commands.upsert_customer(db, "u-1", "Anna", "Lee", "anna@example.com", AS_OF)
    assert rows(got) == [("UPDATE", 1, "anna@example.com")]
    one = after["customers"].where("customer_id = 1").first()
    assert (one.first_name, one.phone, one.birth_date) == ("Anna", None, date(1990, 12, 31))
    after, got = commands.upsert_customer(db, None, "X", "Y", "x@y", AS_OF, birth_date=date(2001, 1, 1))
    assert rows(got) == [("INSERT", 9, "x@y")] and after["customers"].count() == 9


@pytest.mark.proves("TC-SY-01..07", "TC-SY-09..11", "R-13")
def test_sync_product_catalog(db):
    after, got = commands.sync_product_catalog(db, AS_OF)
    assert rows(got) == [("INSERT", 1, 1, 0, 0), ("UPDATE", 4, 0, 4, 0)]
    by = {r.sku: r for r in after["products"].collect()}
    assert by["W-1"].price == D("21.0000") and by["W-2"].updated_at is None
    assert by["G-1"].is_active is False and by["G-1"].product_name == "Gear_100%"
    assert (by["Z-1"].product_id, by["Z-1"].category) == (6, None) and "Z-2" not in by and "Z-3" not in by
    assert not by["N-1"].is_active and not by["G-2"].is_active
    again = commands.sync_product_catalog(after, AS_OF)[1]
    assert rows(again) == [("UPDATE", 3, 0, 3, 0)]  # what the stage lacks or turns off, each time


def test_merge_takes_the_first_clause_and_never_matches_null(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    source = spark.createDataFrame([(1, "x"), (3, "y"), (None, "z")], "k int, v string")
    got = merged(target, source, "k", [Clause("matched", "DELETE"), Clause("matched", "UPDATE"), Clause("not_matched", "INSERT", {"k": commands.F.col("s_k"), "v": commands.F.col("s_v")})])
    assert sorted(map(str, rows(got))) == sorted(map(str, [(1, "a", "DELETE"), (2, "b", None), (None, "n", None), (3, "y", "INSERT"), (None, "z", "INSERT")]))


def test_merge_latest_is_idempotent(spark):
    target = spark.createDataFrame([(1, 5, "a"), (2, 5, "b")], "k int, ver int, v string")
    changes = spark.createDataFrame([(1, 6, "old"), (1, 7, "new"), (2, 4, "stale"), (3, 1, "add"), (None, 9, "lost")], "k int, ver int, v string")
    once, audit = commands.merge_latest(target, changes, "k", "ver")
    assert sorted(rows(once)) == [(1, 7, "new"), (2, 5, "b"), (3, 1, "add")] and {r.action: r["count"] for r in audit.collect()} == {"INSERT": 1, "UPDATE": 1}
    assert sorted(rows(commands.merge_latest(once, changes, "k", "ver")[0])) == sorted(rows(once))


def test_validation(db, spark):
    assert {r.violations for r in validation.integrity(db).collect()} == {0}
    broken = db.replaced(orders=db["orders"].unionByName(db["orders"].limit(1)), inventory=db["inventory"].withColumn("product_id", commands.F.col("product_id") + 1))
    bad = {r.table_name: r.violations for r in validation.integrity(broken).where("violations > 0").collect()}
    assert bad["orders(order_id)"] == 1 and bad["inventory(product_id)"] == 1
    a = spark.createDataFrame([("t", "same", "int"), ("t", "gone", "int"), ("t", "money", "double"), ("t", "odd", "int"), ("t", "unknown", None)], "table_name string, column_name string, data_type string")
    b = spark.createDataFrame([("t", "same", "int"), ("t", "new", "int"), ("t", "money", "decimal(19,4)"), ("t", "odd", "string"), ("t", "unknown", "int")], a.schema)
    ok = spark.createDataFrame([("double", "decimal(19,4)")], "source_type string, target_type string")
    got = {r.column_name: r.verdict for r in validation.compare_schemas(a, b, ok).collect()}
    assert got == {"same": "EXACT", "gone": "MISSING_TARGET", "new": "MISSING_SOURCE", "money": "APPROVED_TRANSFORM", "odd": "CONFLICT", "unknown": "UNVERIFIED"}
    assert validation.snapshot(a, ["column_name"]).first() == validation.snapshot(a.orderBy("column_name"), ["column_name"]).first()
    assert validation.differing_rows(a, b).count() == 8


def test_the_model(spark, db, tmp_path):
    assert len(DDL) == 17 and sum(len(d.split(", ")) for d in DDL.values()) == 112 and set(PRIMARY_KEYS) == set(DDL)
    db.save(str(tmp_path / "db"))
    back = Database.from_folder(spark, str(tmp_path / "db"), names=tuple(db.tables))
    assert validation.differing_rows(back["products"], db["products"]).count() == 0
    db["categories"].write.json(str(tmp_path / "j" / "categories"))
    assert Database.from_folder(spark, str(tmp_path / "j"), "json", ("categories",))["categories"].count() == 3
    db.views("t_")
    assert spark.sql("SELECT count(*) FROM t_orders").first()[0] == 10


def test_latest_per_key(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "k int, v int")
    assert sorted(rows(latest_per_key(df, ["k"], [commands.F.desc("v")]))) == [(1, 3), (2, 2)]
