from datetime import date, datetime
from decimal import Decimal as D

import pytest

from larkspur.plans import patterns

from .fixtures import database, t

FROM, TO = date(2025, 3, 1), date(2025, 8, 1)


@pytest.fixture(scope="module")
def db(spark):
    return database(spark)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.proves("RP-01", "RQ-05", "RQ-14")
def test_rp01_fills_gaps_and_drops_refunds(db):
    got = rows(patterns.revenue_by_month(db, FROM, TO))
    assert got == [(date(2025, 3, 1), 1, D("5000.0000")), (date(2025, 4, 1), 0, D("0.0000")), (date(2025, 5, 1), 2, D("2000.0100")), (date(2025, 6, 1), 4, D("2149.9900")), (date(2025, 7, 1), 1, D("49.9900"))]
    assert patterns.revenue_by_month(db, TO, FROM).count() == 0


@pytest.mark.proves("RQ-06")
def test_rp01_in_the_reports_time_zone(db):
    got = dict((r.period_start, r.order_count) for r in patterns.revenue_by_month(db, FROM, TO, zone="Pacific/Auckland").collect())
    assert got[date(2025, 7, 1)] == 2  # 30 June 15:00 UTC is July there


@pytest.mark.proves("RP-02")
def test_rp02_share(db):
    got = rows(patterns.category_revenue(db, FROM, TO))
    assert [r[0] for r in got] == ["widgets", "gadgets", "unknown"] and sum(r[3] for r in got) == D("100.0000")


@pytest.mark.proves("RP-03..04", "RQ-03", "RQ-11")
def test_rp03_rp04(db):
    run = patterns.running_revenue(db, FROM, TO).collect()
    assert run[-1].running_total == D("9199.9900") and run[1].moving_avg == D("2500.0000") and run[4].moving_avg == D("1399.9967")
    growth = patterns.revenue_growth(db, FROM, TO).collect()
    assert [r.mom_pct for r in growth] == [None, D("-100.0000"), None, D("7.5000"), D("-97.6700")] and growth[0].yoy_pct is None


@pytest.mark.proves("RP-05", "RQ-09")
def test_rp05_keeps_ties(db, spark):
    got = rows(patterns.top_products_per_category(db, FROM, TO, 1))
    assert ("Widgets", "W-2", 108, 1) in got and (None, "N-1", 1, 1) in got


@pytest.mark.proves("RP-06")
def test_rp06(db):
    got = rows(patterns.customer_pareto(db, FROM, TO))
    assert got[0] == (5, D("5000.0000"), D("54.3500"), "A") and got[-1][2:] == (D("100.0000"), "C")


@pytest.mark.proves("RP-07", "RQ-10", "RQ-23")
def test_rp07(db, spark):
    one = patterns.order_value_stats(db, FROM, TO).first()
    assert (one.orders, one.median, one.median_actual) == (8, 999.995, 999.99)
    empty = patterns.order_value_stats(db, date(2000, 1, 1), date(2000, 2, 1)).first()
    assert (empty.orders, empty.average, empty.median) == (0, None, None)


@pytest.mark.proves("RP-08", "RQ-12", "RQ-24")
def test_rp08_counts_other(db):
    got = {r.period_start: r for r in patterns.orders_by_month_status(db, FROM, TO).collect()}
    assert (got[date(2025, 4, 1)].other, got[date(2025, 4, 1)].total, got[date(2025, 5, 1)].pending) == (1, 1, 2)


@pytest.mark.proves("RP-09", "RQ-17")
def test_rp09(db):
    got = rows(patterns.cohort_retention(db, FROM, TO))
    assert (date(2025, 6, 1), 0, 2, 2, D("100.0000")) in got and (date(2025, 6, 1), 1, 1, 2, D("50.0000")) in got


@pytest.mark.proves("RP-10", "RQ-13")
def test_rp10_takes_the_last_value(db, spark):
    audit = [(1, 1, 1, 0, 5, 5, None, "x", t(2025, 6, 29)), (2, 1, 1, 5, 2, 7, None, "x", t(2025, 6, 30, 23)), (3, 1, 1, 7, 1, 8, None, "x", t(2025, 7, 1, 0)), (4, 2, 1, 0, 3, 3, None, "x", t(2025, 6, 1))]
    from larkspur.schemas import schema

    db = db.replaced(inventory_audit=spark.createDataFrame(audit, schema("inventory_audit")))
    assert rows(patterns.stock_as_of(db, date(2025, 6, 30))) == [(1, 1, 7, 2), (2, 1, 3, 4)]


@pytest.mark.proves("RP-11", "RQ-18")
def test_rp11_counts_people_in_order(spark):
    e = [(1, "view", 1), (1, "view", 2), (1, "click", 3), (2, "click", 1), (2, "view", 2), (3, "view", 1), (3, "click", 2), (3, "purchase", 5)]
    events = spark.createDataFrame([(u, k, datetime(2025, 1, 1, h)) for u, k, h in e], "user_id long, event_type string, ts timestamp_ntz")
    got = rows(patterns.funnel(events, ("view", "click", "purchase", "return")))
    assert got == [(1, "view", 3, D("100.0000")), (2, "click", 2, D("66.6700")), (3, "purchase", 1, D("33.3300")), (4, "return", 0, D("0.0000"))]
    assert rows(patterns.funnel(events.limit(0), ("view", "click")))[0] == (1, "view", 0, None)


@pytest.mark.proves("RP-12", "RP-14")
def test_rp12_rp14(db):
    got = {r.customer_id: r for r in patterns.customer_activity_streaks(db, FROM, TO).collect()}
    assert (got[1].streak_months, got[1].streak_start, got[1].streak_end) == (2, date(2025, 6, 1), date(2025, 7, 1))
    ends = {r.customer_id: r for r in patterns.customer_first_last_order(db, FROM, TO).collect()}
    assert (ends[1].first_order_id, ends[1].last_order_id, ends[6].first_order_id, ends[6].last_order_id, ends[1].orders) == (1, 10, 8, 9, 4)


@pytest.mark.proves("RP-13", "RQ-15")
def test_rp13_marks_subtotals(db):
    got = rows(patterns.revenue_rollup(db, FROM, TO))
    assert got[-1][0] == "total" and ("product", None, "N-1", 1, D("29.9900")) in got and ("category", None, None, 1, D("29.9900")) in got


@pytest.mark.proves("RP-15")
def test_rp15(db):
    got = rows(patterns.order_value_histogram(db, FROM, TO, 1000))
    assert got == [(0, 1000, 4), (1000, 2000, 3), (2000, 3000, 0), (3000, 4000, 0), (4000, 5000, 0), (5000, 6000, 1)]
    assert patterns.order_value_histogram(db, date(2000, 1, 1), date(2000, 2, 1)).count() == 0


def test_json(db):
    assert patterns.as_json(patterns.revenue_by_month(db, date(2025, 7, 1), TO)).first()[0] == '[{"period_start":"2025-07-01","order_count":1,"revenue":49.9900}]'
