"""Plans of schema changes, column lineage and snapshot differences."""

import itertools
import re
from datetime import datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from larkspur.operators import changes, lineage, snapshots, validation
from larkspur.operators.changes import Change
from larkspur.plans import data_jobs
from larkspur.sources.star import STAR, read

DATA = "/root/testdata/sf0.001"

SAFETY = {
    ("int", "bigint"): "SAFE", ("bigint", "int"): "HIGH_RISK", ("int", "decimal(9,0)"): "HIGH_RISK", ("int", "decimal(10,0)"): "SAFE", ("decimal(9,0)", "int"): "SAFE", ("decimal(10,0)", "int"): "HIGH_RISK", ("decimal(9,2)", "int"): "LOSSY",
    ("decimal(10,4)", "decimal(12,4)"): "SAFE", ("decimal(10,4)", "decimal(10,2)"): "LOSSY", ("decimal(10,2)", "decimal(10,4)"): "HIGH_RISK", ("int", "double"): "SAFE", ("bigint", "double"): "LOSSY", ("int", "float"): "LOSSY", ("smallint", "float"): "SAFE",
    ("double", "float"): "LOSSY", ("float", "double"): "SAFE", ("double", "decimal(38,10)"): "HIGH_RISK", ("double", "bigint"): "HIGH_RISK", ("decimal(9,2)", "double"): "LOSSY", ("string", "int"): "HIGH_RISK", ("int", "string"): "SAFE", ("binary", "string"): "HIGH_RISK",
    ("boolean", "int"): "SAFE", ("int", "boolean"): "LOSSY", ("boolean", "date"): "UNSUPPORTED", ("date", "timestamp"): "SAFE", ("timestamp_ntz", "date"): "LOSSY", ("timestamp", "timestamp_ntz"): "LOSSY", ("date", "int"): "UNSUPPORTED", ("array<int>", "array<bigint>"): "SAFE",
    ("array<bigint>", "array<int>"): "HIGH_RISK", ("array<int>", "int"): "UNSUPPORTED", ("struct<a:int,b:string>", "struct<a:bigint,b:int>"): "HIGH_RISK", ("struct<a:int>", "struct<a:int,b:int>"): "UNSUPPORTED", ("map<string,int>", "map<string,string>"): "SAFE",
}


@pytest.mark.parametrize("old, new", SAFETY)
def test_cast_safety(spark, old, new):
    assert changes.cast_safety(changes._type(old), changes._type(new)) == SAFETY[old, new]


def test_safe_casts_form_an_order(spark):
    """What is safe step by step is safe at once, and no cast there and back is safe both ways but between equal value sets."""
    kinds = [changes._type(t) for t in ("tinyint", "smallint", "int", "bigint", "decimal(5,0)", "decimal(10,0)", "decimal(20,5)", "float", "double", "string", "date", "timestamp_ntz", "boolean")]
    safe = {(a, b) for a in range(len(kinds)) for b in range(len(kinds)) if changes.cast_safety(kinds[a], kinds[b]) == "SAFE"}
    assert all((a, c) in safe for (a, b), (b2, c) in itertools.product(safe, safe) if b == b2)
    assert not [(a, b) for a, b in safe if a != b and (b, a) in safe]


def test_verdicts_hold_on_data(spark):
    """No value of a SAFE cast changes or fails, whatever the values; of a LOSSY one none fails."""
    top = {"tinyint": 127, "smallint": 32_767, "int": 2**31 - 1, "bigint": 2**63 - 1}
    for old, n in top.items():
        df = spark.createDataFrame([(v,) for v in (0, 1, -1, n, -n - 1, n // 2, None)], f"c {old}")
        for new in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal(3,0)", "decimal(5,0)", "decimal(10,0)", "decimal(19,0)", "decimal(21,2)", "string", "boolean"):
            step = changes.planned_steps({"t": df}, [Change("t", "c", new)])[0]
            if step.verdict == "SAFE":
                assert step.checks == {"rows_checked": 7, "rows_changed": 0, "rows_failed": 0}, (old, new)
            if step.verdict == "LOSSY":
                assert step.checks["rows_failed"] == 0, (old, new)


@pytest.fixture(scope="module")
def tables(spark):
    return {
        "a": spark.createDataFrame([(1, 2.5, "x", 4), (2, None, None, 5)], "id bigint, price double, name string, other int"),
        "b": spark.createDataFrame([(1, 1, datetime(2020, 1, 1, 5)), (2, 7, datetime(2020, 1, 2))], "key bigint, a_id bigint, at timestamp_ntz"),
    }


def test_casts_come_before_renames_and_keys_before_references(tables):
    wanted = [Change("b", "a_id", "int", "a_key"), Change("a", "id", "int", "key"), Change("a", "name", None, "label"), Change("b", "at", "date", "day")]
    steps = changes.planned_steps(tables, wanted, foreign_keys=[("b", "a_id", "a", "id")], readers={"q2": {("a", "id"), ("a", "other")}, "q1": {("b", "at")}, "q3": {("a", "other")}})
    assert [(s.table, s.column, s.action) for s in steps] == [("a", "id", "CAST"), ("b", "a_id", "CAST"), ("b", "at", "CAST"), ("b", "a_id", "RENAME"), ("b", "at", "RENAME"), ("a", "id", "RENAME"), ("a", "name", "RENAME"), ("", "q1", "ADAPT"), ("", "q2", "ADAPT")]
    assert [s.verdict for s in steps if s.action == "ADAPT"] == ["LOSSY", "HIGH_RISK"]
    assert steps[2].checks == {"rows_checked": 2, "rows_changed": 1, "rows_failed": 0}


def test_the_plan_runs_both_ways(spark, tables):
    wanted = [Change("a", "id", "decimal(20,0)", "key"), Change("a", "price", None, "name"), Change("a", "name", None, "price"), Change("a", "other", "string"), Change("b", "key", None, "a_id"), Change("b", "a_id", "string", "key")]
    steps = changes.planned_steps(tables, wanted)
    after = changes.applied(tables, steps)
    assert [(f.name, f.dataType.simpleString()) for f in after["a"].schema] == [("key", "decimal(20,0)"), ("name", "double"), ("price", "string"), ("other", "string")]
    assert [(f.name, f.dataType.simpleString()) for f in after["b"].schema] == [("a_id", "bigint"), ("key", "string"), ("at", "timestamp_ntz")]
    back = changes.rolled_back(after, steps)
    for name, df in tables.items():
        assert back[name].dtypes == df.dtypes and sorted(map(tuple, back[name].collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr)
    rows = {r.step: r for r in changes.plan_rows(spark, steps).collect()}
    assert sorted(r.rollback_step for r in rows.values()) == sorted(rows) and all(r.step + r.rollback_step == len(rows) + 1 for r in rows.values())
    names = {t: list(df.columns) for t, df in after.items()}  # undone by the statements themselves, in their order
    for r in sorted(rows.values(), key=lambda r: r.rollback_step):
        words = r.rollback.split()
        if words[3] == "RENAME":
            names[words[2]][names[words[2]].index(words[5])] = words[7]
        else:
            assert words[5] in names[words[2]]
    assert names == {t: df.columns for t, df in tables.items()}


def test_what_must_not_be_done_is_blocked(spark, tables):
    wanted = [Change("a", "id", "int"), Change("b", "nothing", "int", "x"), Change("c", "id", None, "x"), Change("b", "key", None, "at"), Change("b", "at", "int", "when"), Change("b", "a_id", None, "when")]
    steps = changes.planned_steps(tables, wanted, protected=frozenset({"a"}))
    verdicts = {(s.table, s.column, s.action): (s.verdict, s.disposition) for s in steps}
    assert verdicts["a", "id", "CAST"] == ("PROTECTED", "BLOCKED") and verdicts["b", "nothing", "RENAME"] == ("METADATA_NOT_FOUND", "BLOCKED") == verdicts["c", "id", "RENAME"]
    assert verdicts["b", "at", "CAST"] == ("UNSUPPORTED", "BLOCKED") and verdicts["b", "a_id", "RENAME"] == ("RENAME_COLLISION", "BLOCKED")
    assert verdicts["b", "key", "RENAME"] == ("SAFE", "APPLY") == verdicts["b", "at", "RENAME"]
    assert changes.applied(tables, steps)["b"].columns == ["at", "a_id", "when"] and changes.applied(tables, steps)["a"] is tables["a"]
    assert all(r.statement is None and r.rollback is None for r in changes.plan_rows(spark, steps).where("disposition = 'BLOCKED'").collect())


@settings(max_examples=200, deadline=None)
@given(data=st.data())
def test_renames_never_take_a_name_that_is_held(data):
    columns = data.draw(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=8, unique=True))
    targets = data.draw(st.permutations([*columns, "x", "y", "z"]))
    wanted = {c: t for c, t in zip(columns, targets) if t != c and data.draw(st.booleans())}
    wanted = {c: t for c, t in wanted.items() if t not in set(columns) - set(wanted)}
    while any(t in set(columns) - set(wanted) for t in wanted.values()):
        wanted = {c: t for c, t in wanted.items() if t not in set(columns) - set(wanted)}
    now = {c: c for c in columns}
    for old, new, origin in changes._renames_in_order("t", columns, wanted):
        assert now[origin] == old and new not in now.values()
        now[origin] = new
    assert now == {c: wanted.get(c, c) for c in columns}


# lineage


@pytest.mark.parametrize("name", ["active_customers", "low_stock", "revenue_by_month", "referrals", "shipping", "stock_as_of"])
def test_columns_that_are_not_read_do_not_matter(spark, tmp_path, name):
    """Against brute force: with every other column gone to null the report gives the same; without one of its columns it can't be made, or reads another file."""
    df = data_jobs.all_reports(spark, DATA)[name]
    used = lineage.columns_read(df)
    assert {t for t, _ in used} <= set(STAR)
    for t in STAR:
        kept = [F.col(c) if (t, c) in used else F.lit(None).cast(k).alias(c) for c, k in read(spark, DATA, t).dtypes]
        read(spark, DATA, t).select(*kept).write.parquet(str(tmp_path / f"{t}.parquet"))
    again = data_jobs.all_reports(spark, str(tmp_path))[name]
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, df.collect()), key=repr) and lineage.columns_read(again) == used


def test_a_missing_column_is_named_before_the_run(spark, tmp_path):
    refs = lineage.references(spark, {"q": read(spark, DATA, "orders").where("o_totalprice > 5").select("o_custkey"), "n": read(spark, DATA, "nation").groupBy().count()})
    assert {tuple(r) for r in refs.collect()} == {("q", "orders", "o_custkey"), ("q", "orders", "o_totalprice"), ("n", "nation", "*")}
    schema = spark.createDataFrame([("orders", "o_custkey", "int")], "table_name string, column_name string, data_type string")
    expected = spark.createDataFrame([("orders", "o_custkey", "bigint"), ("orders", "o_totalprice", "double")], schema.schema)
    got = {(r.query, r.column_name): r.status for r in lineage.checked_references(refs, schema, expected).collect()}
    assert got == {("q", "o_custkey"): "TYPE_CHANGED", ("q", "o_totalprice"): "MISSING_COLUMN", ("n", "*"): "MISSING_TABLE"}
    assert {r.status for r in lineage.checked_references(refs, expected).where("column_name <> '*'").collect()} == {"RESOLVED"}
    read(spark, DATA, "orders").drop("o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    with pytest.raises(AnalysisException):
        spark.read.parquet(str(tmp_path / "orders.parquet")).where("o_totalprice > 5")


def test_subqueries_are_read_too(spark):
    read(spark, DATA, "orders").createOrReplaceTempView("lineage_orders")
    read(spark, DATA, "customer").createOrReplaceTempView("lineage_customer")
    df = spark.sql("SELECT c_name FROM lineage_customer WHERE c_acctbal > (SELECT avg(o_totalprice) FROM lineage_orders)")
    assert lineage.columns_read(df) == {("customer", "c_name"), ("customer", "c_acctbal"), ("orders", "o_totalprice")}


def test_recursions_are_read_too(spark):
    used = lineage.columns_read(data_jobs.all_reports(spark, DATA)["referrals"])
    assert {("customer", "c_custkey"), ("customer", "c_name"), ("customer", "c_mktsegment"), ("orders", "o_custkey")} <= used and ("customer", "c_acctbal") not in used


def test_conforming_statements_make_the_schemas_agree(spark):
    kind = "table_name string, column_name string, data_type string"
    source = spark.createDataFrame([("t", "a", "int"), ("t", "b", "string"), ("t", "d", "decimal(19,4)")], kind)
    target = spark.createDataFrame([("t", "a", "bigint"), ("t", "c", "int"), ("t", "d", "decimal(19,4)")], kind)
    compared = validation.compare_schemas(source, target, spark.createDataFrame([], "source_type string, target_type string"))
    got = {(r.column_name, r.action): r.statement for r in lineage.conforming(compared).collect()}
    assert got == {("a", "CHANGE"): "ALTER TABLE t ALTER COLUMN a TYPE int", ("b", "ADD"): "ALTER TABLE t ADD COLUMN b string", ("c", "REVIEW"): None}


# snapshots

ROWS = [(i, f"n{i % 7}" if i % 5 else None, i * 2) for i in range(400)] + [(None, "null key", 1)]
KIND = "id int, name string, v int"


def _taken(spark, tmp_path, name, rows, depth=snapshots.DEPTH):
    path = str(tmp_path / name)
    snapshots.take_snapshot(spark.createDataFrame(rows, KIND), ["id"], path, depth)
    return path


def test_equal_tables_have_equal_snapshots(spark, tmp_path):
    a, b = _taken(spark, tmp_path, "a", ROWS), _taken(spark, tmp_path, "b", ROWS[::-1])
    assert snapshots.differing_buckets(spark, a, b) == [] and snapshots.snapshot_differences(spark, a, b, ["id"]).count() == 0


def test_differences_are_found_and_other_buckets_are_not_read(spark, tmp_path):
    changed = [r for r in ROWS if r[0] not in (3, 4)] + [(500, "new", 1), (500, "new", 2), (501, None, None)]
    changed = [(i, "other" if i == 10 else n, None if i in (10, 20) else v) for i, n, v in changed]
    changed = [(i, n, 7 if i is None else v) for i, n, v in changed]
    a, b = _taken(spark, tmp_path, "a", ROWS), _taken(spark, tmp_path, "b", changed)
    diffs = snapshots.snapshot_differences(spark, a, b, ["id"])
    want = {(3, "REMOVED", None, None, None), (4, "REMOVED", None, None, None), (500, "REPEATED_KEY", None, None, None), (501, "ADDED", None, None, None), (10, "CHANGED", "name", None, "other"), (10, "CHANGED", "v", "20", None), (20, "CHANGED", "v", "40", None), (None, "CHANGED", "v", "1", "7")}
    assert {tuple(r) for r in diffs.collect()} == want and diffs.count() == len(want)
    buckets = snapshots.differing_buckets(spark, a, b)
    assert 1 <= len(buckets) <= 7
    files = snapshots.bucket_rows(spark, a, buckets)
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_top#\d+ IN", plan) and "PushedFilters: [In(_bucket" in plan
    assert 5 <= files.count() <= 12  # of those of the old rows, and what shares a bucket
    report = {(r.kind, r.column_name): (r.n, r.sample) for r in snapshots.difference_report(diffs, ["id"], samples=1).collect()}
    assert report["REMOVED", None] == (2, '[{"id":3}]') and report["CHANGED", "v"][0] == 3


def test_empty_tables_have_snapshots(spark, tmp_path):
    a, b = _taken(spark, tmp_path, "a", []), _taken(spark, tmp_path, "b", ROWS[:2])
    assert snapshots.differing_buckets(spark, a, a) == [] and snapshots.snapshot_differences(spark, a, a, ["id"]).count() == 0
    assert {(r.id, r.kind) for r in snapshots.snapshot_differences(spark, a, b, ["id"]).collect()} == {(0, "ADDED"), (1, "ADDED")}


def test_nulls_change_places_only_if_rows_differ(spark, tmp_path):
    kind = "id int, x int, y int"
    for name, row in (("a", (1, None, 5)), ("b", (1, 5, None))):
        snapshots.take_snapshot(spark.createDataFrame([row], kind), ["id"], str(tmp_path / name))
    got = snapshots.snapshot_differences(spark, str(tmp_path / "a"), str(tmp_path / "b"), ["id"])
    assert {(r.column_name, r.before, r.after) for r in got.collect()} == {("x", None, "5"), ("y", "5", None)}
    a, b = (validation.snapshot(spark.createDataFrame([row], kind), ["id"]).first() for row in ((1, None, 5), (1, 5, None)))
    assert a.checksum != b.checksum


def test_deeper_levels_look_at_children_of_differing_nodes_only(spark, tmp_path):
    more = [(i, None, i) for i in range(3000)]
    a, b = _taken(spark, tmp_path, "a", more, 3), _taken(spark, tmp_path, "b", [(i, n, v + (i == 77)) for i, n, v in more], 3)
    assert len(snapshots.differing_buckets(spark, a, b, 3)) == 1
    assert [snapshots._level(spark, a, level).count() for level in range(3)] == [1, 16, 256]
