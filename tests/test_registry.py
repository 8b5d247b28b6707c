"""The registered queries against their SQL on the smallest tables, and the coverage of the catalogue."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

from larkspur.plans import commands, patterns, registry, reports

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 9))
    if isinstance(v, decimal.Decimal):
        return format(v.normalize() if v else decimal.Decimal(0), "f")
    return v.isoformat() if isinstance(v, datetime.datetime) else repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(registry.ORACLES[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


def test_every_routine_and_pattern_is_registered():
    names = {q[:3] for q in registry.QUERIES if q[0] == "r" and q[1].isdigit()}
    assert names == {f"r{i:02}" for i in range(1, 21)}
    assert {q[:4] for q in registry.QUERIES if q.startswith("rp")} == {f"rp{i:02}" for i in range(1, 16)}


@pytest.mark.proves("TC-CAT-01", "RQ-21")
def test_the_api_surface():
    for name in ("monthly_sales_summary", "customer_lifetime_value", "customer_lifetime_value_referrals", "product_performance", "low_stock_alerts", "order_history", "customer_summary", "customer_referrals", "search_products", "calculate_shipping", "search_orders"):
        assert callable(getattr(reports, name))
    for name in ("adjust_stock", "process_reorders", "create_customer_order", "process_refund", "sync_product_catalog", "create_order", "process_pending_orders", "upsert_customer"):
        assert callable(getattr(commands, name))
    assert patterns.EXCLUDED == ("Cancelled", "Refunded")


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[0] == "category" and set(registry.QUERIES) <= set(entry.queries()) and set(registry.ORACLES) <= set(entry.oracle_sql())
