"""The gate: every rule of catalogue.csv is proved by a query with SQL or by a marked test; and rules of all reports' plans."""

import ast
import csv
import pathlib
import re

import pytest

from larkspur.operators import lineage
from larkspur.plans import registry

HERE = pathlib.Path(__file__).parent
DATA = "/root/testdata/sf0.001"
has_data = pytest.mark.skipif(not pathlib.Path(DATA).is_dir(), reason="no driver tables")


def catalogued(path=HERE / "catalogue.csv"):
    """All rule ids of a catalogue."""
    with open(path) as f:
        return {f"{r['rule']}-{k:02}" for r in csv.DictReader(f) for k in range(int(r["first"]), int(r["last"]) + 1)}


def ids(text):
    """The ids of a mark: one, or a range."""
    name, first, last = re.fullmatch(r"(.+)-(\d+)(?:\.\.(\d+))?", text).groups()
    return {f"{name}-{k:02}" for k in range(int(first), int(last or first) + 1)}


def proved(folder=HERE):
    """Rules by what proves them: tests with the mark, and queries that have SQL (r05_... proves R-05, rp05_... RP-05)."""
    out = {}
    for path in sorted(folder.glob("test_*.py")):
        for f in ast.parse(path.read_text()).body:
            for d in getattr(f, "decorator_list", []):
                if isinstance(d, ast.Call) and ast.unparse(d.func) == "pytest.mark.proves":
                    for rule in set().union(*[ids(a.value) for a in d.args]):
                        out.setdefault(rule, set()).add(f"{path.name}::{f.name}")
    for q in set(registry.QUERIES) & set(registry.ORACLES):
        if m := re.match(r"(rp|r)(\d\d)_", q):
            out.setdefault(f"{m[1].upper()}-{m[2]}", set()).add(q)
    return out


def test_every_rule_is_proved_by_a_test():
    """Routines and patterns are proved by queries, all other rules by marked tests; no mark names a rule that isn't there."""
    rules, proofs = catalogued(), proved()
    assert not rules - set(proofs) and not set(proofs) - rules
    assert len(rules) == 24 + 15 + 20 + 142
    assert all(any("::" in p for p in proofs[r]) for r in rules if r.startswith(("TC-", "RQ-")))


def test_the_gate_fails_for_a_rule_without_a_test(tmp_path):
    """A new rule in the catalogue, and a mark that goes, are both noticed."""
    more = tmp_path / "catalogue.csv"
    more.write_text((HERE / "catalogue.csv").read_text() + "TC-NEW,1,2,a rule of tomorrow\n")
    assert catalogued(more) - set(proved()) == {"TC-NEW-01", "TC-NEW-02"}
    for path in HERE.glob("test_*.py"):
        (tmp_path / path.name).write_text(path.read_text().replace('"TC-SY-08"', '"TC-SY-01"'))
    assert catalogued() - set(proved(tmp_path)) == {"TC-SY-08"}


@has_data
@pytest.mark.proves("RQ-19")
@pytest.mark.parametrize("name", ["rp01_revenue_by_month", "rp02_category_revenue", "rp06_customer_pareto", "rp13_revenue_rollup", "rp14_customer_first_last_order", "rp15_order_value_histogram"])
def test_money_is_decimal(spark, name):
    kinds = {f.name: f.dataType.simpleString() for f in registry.QUERIES[name](spark, DATA).schema if f.name in ("revenue", "first_amount", "last_amount")}
    assert set(kinds.values()) <= {"decimal(19,4)"} and "double" not in {f.dataType.simpleString() for f in registry.QUERIES[name](spark, DATA).schema}


@has_data
@pytest.mark.proves("RQ-16")
@pytest.mark.parametrize("name, key", [("rp02_category_revenue", ["category"]), ("rp05_top_products_per_category", ["category", "rnk", "sku"]), ("rp06_customer_pareto", ["customer_id"]), ("rp12_customer_activity_streaks", ["customer_id"]), ("rp14_customer_first_last_order", ["customer_id"])])
def test_orders_end_with_a_unique_key(spark, name, key):
    df = registry.QUERIES[name](spark, DATA)
    first = [tuple(r) for r in df.collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        again = [tuple(r) for r in registry.QUERIES[name](spark, DATA).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    at = [df.columns.index(k) for k in key]
    assert first == again and len({tuple(r[i] for i in at) for r in first}) == len(first)


#: Reports by the filter that must reach their scan.
PUSHED = {
    "r01_monthly_sales_summary": "o_orderdate", "r02_customer_lifetime_value": "o_custkey", "r04_product_performance_month": "o_orderdate", "r09_order_history": "o_orderdate", "r19_search_orders": "o_orderdate",
    **{q: "o_orderdate" for q in registry.QUERIES if re.match(r"rp(01|02|03|04|05|08|09|12|13|14)_", q)}, "rp11_funnel": "event_type", "rp10_stock_as_of": "ts",
}
#: Reports whose only unpartitioned window runs over a page or over the periods of a report.
BOUNDED_WINDOWS = re.compile("r09|r14|r19|rp03|rp04")


@has_data
@pytest.mark.proves("RQ-20")
@pytest.mark.parametrize("name", sorted(q for q in registry.QUERIES if re.match(r"r(01|02|03|04|06|09|11|12|14|15|19|20)_|rp\d\d_", q)))
def test_plans_are_fit_for_size(spark, name):
    """No cartesian product; nested loops only beside one aggregated row; no window of all rows in one task; no Python; columns pruned; filters at the scan."""
    df = registry.QUERIES[name](spark, DATA)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "Python" not in plan and "Arrow" not in plan
    loops = plan.count("BroadcastNestedLoopJoin")
    lone_rows = len(re.findall(r"HashAggregate\(keys=\[\], functions=\[(?!partial_)", plan)) + plan.count("TakeOrderedAndProject") + plan.count("Range (0, 1,")
    assert loops <= lone_rows
    whole = [w for w in re.findall(r"Window \[.*?windowspecdefinition\((.*?), specifiedwindowframe", plan) if re.match(r"\S+ (ASC|DESC)", w)]
    assert not whole or BOUNDED_WINDOWS.match(name)
    for table, columns in lineage.scans(df):
        assert len(columns) < 8, (table, columns)
    if column := PUSHED.get(name):
        assert re.search(rf"PushedFilters: \[[^\]]*{column}", plan), plan
