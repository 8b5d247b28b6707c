"""Behaviours of the routines that the other tests leave out."""

from datetime import date, datetime
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from larkspur.plans import commands, reports

from .fixtures import AS_OF, database, order, t


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


@pytest.mark.proves("TC-RO-03..04")
def test_drafts_bear_the_name_of_who_asked(db):
    made = commands.process_reorders(db, "night run", AS_OF)[0]["purchase_orders"].where("purchase_order_id > 8").collect()
    assert {(r.status, r.created_by, r.created_at) for r in made} == {("Draft", "night run", AS_OF)} and len(made) == 3


@pytest.mark.proves("TC-RF-04..06", "TC-RF-08")
def test_each_product_of_a_refund_goes_back(db):
    """Two products go back to their default warehouses; a rejected call leaves no refund."""
    after, _ = commands.process_refund(db, 1, "broken", "me", AS_OF)
    stock = {(r.product_id, r.warehouse_id): r.quantity_on_hand for r in after["inventory"].collect()}
    assert (stock[1, 1], stock[2, 2], stock[2, 1]) == (5 + 2, 50 + 6, 10)
    assert [(r.order_id, r.status, r.processed_by) for r in after["refunds"].collect()] == [(1, "Completed", "me")]
    with pytest.raises(reports.RoutineError):
        commands.process_refund(after, 1, "again", "me", AS_OF)
    assert after["refunds"].count() == 1


@pytest.mark.proves("TC-PPO-03", "TC-PPO-05")
def test_small_orders_need_no_approval_and_good_ones_log_nothing(db, spark):
    small = db.replaced(orders=db["orders"].unionByName(spark.createDataFrame([order(20, 1, t(2025, 7, 1), "5.0000", "Pending")], db["orders"].schema)))
    after, got = commands.process_pending_orders(small, AS_OF)
    assert {r.order_id: r.requires_approval for r in got.collect()}[20] is False and after["processing_errors"].count() == 0
    assert after["orders"].where("status = 'Pending'").count() == 0


@pytest.mark.proves("TC-UC-03..04")
def test_an_update_keeps_the_key_and_takes_the_name(db):
    after, _ = commands.upsert_customer(db, "u-1", "Ann", "Kay", "ann@example.com", AS_OF)
    one = after["customers"].where("external_id = 'u-1'").collect()
    assert [(r.customer_id, r.last_name) for r in one] == [(1, "Kay")]


@pytest.mark.proves("TC-SY-08")
def test_new_products_bring_their_category_key(db):
    after, _ = commands.sync_product_catalog(db, AS_OF)
    new = after["products"].where("sku = 'Z-1'").first()
    assert (new.category_id, new.reorder_quantity, new.is_active, new.created_at) == (1, 50, True, AS_OF)


@pytest.mark.proves("TC-LTV-01")
def test_a_value_bears_the_name(db):
    assert reports.customer_lifetime_value(db, 1, AS_OF).first().customer_name == "Ann Lee"


@pytest.mark.proves("TC-PP-01", "TC-PP-06..08")
def test_performance_leaves_out_cancelled_orders_and_the_rest_of_the_last_day(db):
    got = reports.product_performance(db, date(2025, 6, 1), date(2025, 6, 30)).collect()
    assert [(r.product_id, r.units_sold) for r in got] == [(1, 5), (3, 1), (2, 8)]  # by falling revenue
    assert [r.revenue for r in got] == sorted((r.revenue for r in got), reverse=True) and got[0].order_count == 2


@pytest.mark.proves("TC-LO-03")
def test_stocks_above_their_point_are_no_alert(db):
    assert not {(r.product_id, r.warehouse_id) for r in reports.low_stock_alerts(db, AS_OF).collect()} & {(2, 2), (3, 1), (4, 1)}


@pytest.mark.proves("TC-CS-03..05", "TC-CS-07")
def test_a_summary_has_dates_alone_and_no_age_without_a_birth_date(db):
    one = reports.customer_summary(db, 1, AS_OF).first()
    assert (one.order_count, one.tier, one.last_order_date, one.first_order_date) == (4, "Silver", "2025-07-14", "2025-06-01")
    assert reports.customer_summary(db, 2, AS_OF).first().age is None


@pytest.mark.proves("TC-SP-04", "TC-SP-09", "TC-SP-11")
def test_search_knows_old_sort_names_pages_and_ages(db):
    got = reports.search_products(db, AS_OF, sort_column="ProductName", sort_dir="desc").collect()
    assert [r.product_id for r in got] == [3, 1, 2] and {r.product_id: r.age_days for r in got} == {1: 14, 2: 44, 3: 75}
    assert [r.product_id for r in reports.search_products(db, AS_OF, page_size=1, page_number=3).collect()] == [3]


@pytest.mark.proves("TC-SH-03..04")
def test_a_quote_without_a_reference_gets_one(db):
    a, b = (reports.calculate_shipping(db, 10, "20000", AS_OF).first() for _ in range(2))
    assert len(a.tracking_number) == 32 and set(a.tracking_number) <= set("0123456789abcdef") and a.tracking_number != b.tracking_number
    assert a.estimated_delivery == date(2025, 7, 20) and a.is_expedited is False


@pytest.mark.proves("TC-SO-01", "TC-SO-04")
def test_order_search_by_status(db):
    got = reports.search_orders(db, AS_OF, status="Pending").collect()
    assert [(r.order_id, r.order_date) for r in got] == [(9, "2025-05-31"), (8, "2025-05-31")]


@pytest.mark.proves("TC-OH-09..11")
def test_history_by_status_and_text(db):
    assert {r.order_id for r in reports.order_history(db, datetime(2025, 7, 15), status="Pending").collect()} == {8, 9}
    assert {r.customer_name for r in reports.order_history(db, AS_OF, search_text="LEE").collect()} == {"Ann Lee"}


@pytest.mark.proves("TC-MS-07", "RQ-19")
def test_means_are_money(db):
    assert reports.monthly_sales_summary(db, 2025, 6).first().avg_selling_price == D("22.5000")


@pytest.mark.proves("RQ-08")
def test_frames_are_rows_not_ranges(db):
    from larkspur.plans import patterns

    got = [(r.revenue, r.running_total) for r in patterns.running_revenue(db, date(2025, 3, 1), date(2025, 8, 1)).collect()]
    assert [b for _, b in got] == [sum((a for a, _ in got[: k + 1]), D(0)) for k in range(len(got))]


@pytest.mark.proves("RQ-01..02", "RQ-04", "RQ-22")
def test_one_measure_in_all_reports(db):
    """Revenue by month and by category agree, whatever the spelling of a category, and joins don't multiply it."""
    from larkspur.plans import patterns

    spelled = db.replaced(products=db["products"].withColumn("category", F.when(F.col("product_id") == 2, " WIDGETS ").otherwise(F.col("category"))))
    by_category = {r.category: r.revenue for r in patterns.category_revenue(spelled, date(2025, 1, 1), date(2026, 1, 1)).collect()}
    assert "widgets" in by_category and len(by_category) == 3
    lines = patterns.revenue_lines(spelled, date(2025, 1, 1), date(2026, 1, 1)).agg(F.sum("revenue")).first()[0]
    assert sum(by_category.values()) == lines
