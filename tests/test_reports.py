from datetime import date, datetime, timedelta
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur import functions as X
from larkspur.plans import reports
from larkspur.plans.reports import RoutineError

from .fixtures import AS_OF, database


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.proves("TC-MS-01..10", "R-01")
def test_month_ends_at_midnight_and_names_may_repeat(db):
    got = rows(reports.monthly_sales_summary(db, 2025, 6))
    assert got == [
        ("Widgets", "Bolt", 5, D("115.0000"), D("22.5000"), 2, D("195.0000"), 1),
        ("Widgets", "Bolt", 8, D("80.0000"), D("10.0000"), 2, D("195.0000"), 2),
        ("Gadgets", "Gear_100%", 1, D("99.9900"), D("99.9900"), 1, D("99.9900"), 1),
    ]
    assert reports.monthly_sales_summary(db, as_of=datetime(2024, 2, 1)).collect() == []
    assert reports.monthly_sales_summary(db, 2025, 6).schema["revenue"].dataType.simpleString() == "decimal(19,4)"


@pytest.mark.proves("TC-LTV-02..09", "R-02")
def test_lifetime_value(db):
    got = reports.customer_lifetime_value(db, 1, AS_OF).first()
    assert (got.lifetime_revenue, got.total_orders, got.avg_order_value, got.tenure_months, got.first_order_date, got.tier) == (D("1199.9900"), 4, D("299.9975"), 1, "2025-06-01", "Silver")
    none = reports.customer_lifetime_value(db, 8, AS_OF).first()
    assert (none.lifetime_revenue, none.total_orders, none.avg_order_value, none.tenure_months, none.tier) == (None, 0, D("0.0000"), None, "Bronze")
    assert reports.customer_lifetime_value(db, 99, AS_OF).count() == 0


@pytest.mark.proves("TC-REF-01..05", "TC-CSR-01..03", "R-03", "R-12")
def test_referrals_stop_at_level_five_and_show_zero(db):
    got = rows(reports.customer_referrals(db, 1))
    assert got == [(2, "Bob Ray", 1, D("999.9900")), (3, "Cy Fox", 2, D("20.0000")), (4, "Di Moe", 3, D("0.0000")), (5, "Ed Poe", 4, D("5000.0000")), (6, "Flo Kay", 5, D("2000.0100"))]
    assert reports.customer_lifetime_value_referrals(db, 8).count() == 0
    assert reports.customer_lifetime_value_referrals(db, 1).columns == ["customer_id", "customer_name", "referral_level", "referral_revenue"]


def test_a_cycle_of_referrals_repeats_and_ends(db, spark):
    loop = db["customers"].withColumn("referred_by", F.when(F.col("customer_id") == 1, 2).otherwise(F.col("referred_by")))
    got = reports.customer_referrals(db.replaced(customers=loop), 1)
    assert max(r.level for r in got.collect()) == 5


@pytest.mark.proves("TC-PP-02..05", "R-04")
def test_a_sunday_is_in_the_next_week(db):
    got = {(r.product_id, r.period_start) for r in reports.product_performance(db, date(2025, 6, 1), date(2025, 6, 30), "week").collect()}
    assert (3, date(2025, 6, 9)) in got and (1, date(2025, 6, 2)) in got
    month = reports.product_performance(db, date(2025, 6, 1), date(2025, 6, 30), "nonsense").first()
    assert month.period_start == date(2025, 6, 1)
    quarter = {r.period_start for r in reports.product_performance(db, date(2025, 3, 1), date(2025, 6, 30), "quarter").collect()}
    assert quarter == {date(2025, 1, 1), date(2025, 4, 1)}


@pytest.mark.proves("TC-LO-01..02", "TC-LO-04..08", "R-06")
def test_low_stock(db):
    got = [(r.product_id, r.warehouse_id, r.current_stock, r.reorder_point, r.shortfall_qty, r.last_restocked_formatted, r.days_since_restock) for r in reports.low_stock_alerts(db, AS_OF).collect()]
    assert got == [(1, 2, 4, 5, 1, None, None), (2, 1, 10, 10, 0, "06/15/2025", 30), (1, 1, 5, 5, 0, "07/05/2025", 10), (5, 1, 3, 3, 0, None, None)]
    assert {r.warehouse_id for r in reports.low_stock_alerts(db, AS_OF, 60, 2).collect()} == {2}


@pytest.mark.proves("TC-OH-01..08", "TC-OH-09..11", "R-09")
def test_order_history(db):
    page = reports.order_history(db, AS_OF, page_size=3)
    assert [(r.order_id, r.row_num, r.total_count) for r in page.collect()] == [(10, 1, 10), (3, 2, 10), (2, 3, 10)]
    second = reports.order_history(db, AS_OF, page_number=2, page_size=3).collect()
    assert [(r.order_id, r.row_num) for r in second] == [(5, 4), (4, 5), (1, 6)]
    one = reports.order_history(db, AS_OF, customer_id=1, status="Completed", date_from=datetime(2025, 6, 30), date_to=datetime(2025, 6, 30)).first()
    assert (one.days_ago, one.order_date_display, one.month_end, one.value_tier, one.star_rating) == (15, "Jun 30, 2025", "06/30/2025", "High Value", "★★★")
    assert reports.order_history(db, AS_OF, status="completed").count() == 0  # equality minds the case
    assert {r.customer_id for r in reports.order_history(db, AS_OF, search_text="ED_").collect()} == {5}


@pytest.mark.proves("TC-SO-02..03", "TC-SO-05", "R-19")
def test_search_orders_looks_back_three_months(db):
    assert {r.order_id for r in reports.search_orders(db, AS_OF).collect()} == {1, 2, 3, 4, 5, 8, 9, 10}
    assert [r.order_id for r in reports.search_orders(db, AS_OF, search_text="%o%", page_size=2).collect()] == [10, 3]


@pytest.mark.proves("TC-CS-01..02", "TC-CS-06", "R-11")
def test_customer_summary(db):
    one = reports.customer_summary(db, 1, AS_OF).first()
    assert (one.masked_email, one.age, one.estimated_next_order) == ("a**@example.com", 35, "2025-08-13")
    assert reports.customer_summary(db, 2, AS_OF).first().masked_email is None
    assert reports.customer_summary(db, 3, AS_OF).first().masked_email == "a@b.c"
    assert reports.customer_summary(db, 4, AS_OF).first().masked_email is None


@pytest.mark.proves("TC-SP-01..03", "TC-SP-05..08", "TC-SP-10", "R-14")
def test_search_products(db):
    got = reports.search_products(db, AS_OF)
    assert [r.product_id for r in got.collect()] == [2, 1, 3]  # inactive and without category are left out
    assert [r.product_id for r in reports.search_products(db, AS_OF, sort_column="price; DROP TABLE x", sort_dir="desc").collect()] == [3, 1, 2]
    assert [(r.product_id, r.match_position) for r in reports.search_products(db, AS_OF, search_text="EAR").collect()] == [(3, 2)]
    assert reports.search_products(db, AS_OF, search_text="").first().match_position == 0
    assert [r.product_id for r in reports.search_products(db, AS_OF, category="Widgets", min_price=15).collect()] == [1]


@pytest.mark.proves("TC-SH-08")
@pytest.mark.parametrize("zip_code,rate", [("10012", "0.85"), ("19999", "0.85"), ("20000", "1.10"), ("30000", "1.05"), ("39999", "1.05"), ("60601", "1.20"), ("69900", "1.20"), ("90001", "1.45"), ("99999", "1.45"), ("X", "1.10")])
def test_shipping_zones(db, zip_code, rate):
    got = reports.calculate_shipping(db, 10, zip_code, AS_OF).first()
    assert got.shipping_cost == round(D("4.350") * D(rate) + D("0.00000001"), 2)


@pytest.mark.proves("TC-SH-01..02", "TC-SH-05..07", "TC-SH-09..10", "R-15")
def test_shipping(db):
    got = reports.calculate_shipping(db, 10, "20000", AS_OF, True, "AB-CD").first()
    assert (got.tracking_number, got.total_weight_lbs, got.shipping_cost, got.estimated_delivery, got.calculated_at) == ("abcd", D("4.350"), D("7.1850"), date(2025, 7, 16), "2025-07-15T09:30:00")
    assert reports.calculate_shipping(db, 3, "20000", AS_OF).first().shipping_cost == D("0.0000")  # exactly 50
    for missing in (8, 12345):
        with pytest.raises(RoutineError, match=f"Order {missing} not found."):
            reports.calculate_shipping(db, missing, "20000", AS_OF)


@pytest.mark.proves("R-20")
def test_active_customers(db):
    assert rows(reports.active_customers(db, 2)) == [(1, "Ann Lee", 4), (3, "Cy Fox", 2), (6, "Flo Kay", 2)]


@settings(max_examples=15, deadline=None)
@given(a=st.dates(date(2000, 1, 1), date(2030, 1, 1)), b=st.dates(date(2000, 1, 1), date(2030, 1, 1)))
def test_boundaries_count_crossings(spark, a, b):
    got = spark.range(1).select(X.month_boundaries(F.lit(a), F.lit(b)), X.year_boundaries(F.lit(a), F.lit(b)), X.week_after_sunday(F.lit(a).cast("timestamp_ntz"))).first()
    assert got[0] == (b.year * 12 + b.month) - (a.year * 12 + a.month) and got[1] == b.year - a.year
    assert got[2].weekday() == 0 and -1 <= (a - got[2]).days <= 5


def test_replicate_and_charindex(spark):
    got = spark.range(1).select(X.replicate("*", F.lit(-1)), X.replicate("*", F.lit(0)), X.charindex("", F.lit("abc")), X.charindex("B", F.lit("abc")), X.charindex("z", F.lit("abc"))).first()
    assert tuple(got) == (None, "", 0, 2, 0)


@pytest.mark.proves("RQ-20")
def test_plans_push_filters_and_use_no_python(spark):
    from larkspur.plans.registry import QUERIES

    plan = QUERIES["r01_monthly_sales_summary"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "PushedFilters: [" in plan and "Python" not in plan and "CartesianProduct" not in plan


def test_search_text_with_a_backslash(spark):
    from larkspur.functions import contains_text

    rows = spark.createDataFrame([("xA\\Bx",), ("ab",), ("a_b",)], "t string")
    assert [r.t for r in rows.where(contains_text(F.col("t"), "a\\b")).collect()] == ["xA\\Bx"]
    assert [r.t for r in rows.where(contains_text(F.col("t"), "a_b")).collect()] == ["xA\\Bx", "a_b"]


@pytest.mark.proves("RQ-07")
def test_weeks_begin_on_any_day(spark):
    from larkspur.functions import DAYS, week_begin
    from larkspur.operators.relational import spine

    days = [date(2024, 2, 25) + timedelta(k) for k in range(9)]
    rows = spark.createDataFrame([(d,) for d in days], "d date").withColumn("ts", F.col("d").cast("timestamp_ntz"))
    for k, name in enumerate(DAYS):
        got = {r.d: r.w for r in rows.select("d", week_begin(F.col("ts"), name).alias("w")).collect()}
        assert all(w.weekday() == k and 0 <= (d - w).days < 7 for d, w in got.items())
    assert [r.period_start for r in spine(spark, date(2024, 2, 28), date(2024, 3, 4), "week", "sunday").collect()] == [date(2024, 2, 25), date(2024, 3, 3)]


def test_no_alerts_are_a_notice(spark, caplog):
    from larkspur.sources.catalog import Database

    with caplog.at_level("INFO", logger="larkspur.plans.reports"):
        assert reports.low_stock_alerts(Database(spark), datetime(2024, 1, 1)).count() == 0
    assert "No low-stock alerts found." in caplog.messages


def test_outer_apply_and_regular_expressions(spark):
    from larkspur.operators.relational import matching, outer_apply_first

    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, 5), (1, 9), (3, 1)], "k int, v int")
    assert sorted((r.k or 0, r.v or 0) for r in outer_apply_first(left, right, ["k"], [F.desc("v")]).collect()) == [(0, 0), (1, 9), (2, 0)]
    assert [r.t for r in matching(spark.createDataFrame([("0f8f",), ("0G",), (None,)], "t string"), "t", "^[0-9a-f]+$").collect()] == ["0f8f"]
