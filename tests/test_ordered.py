"""Orders without a global window, exact percentiles, and the latest rows before a time, all against plain Python."""

import math
import random
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from larkspur.operators import ordered, relational


def _no_single_task(df):
    """The plan; no window of it is without a partition."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"Window \[.*windowspecdefinition\((?!\w+#\d+L?, )", plan.replace("ASC NULLS", "")) or "SinglePartition" not in plan
    return plan


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    return [(i, rng.choice([None, 3, 3, 3, rng.randint(-50, 50)]), D(rng.randint(-999, 9999)).scaleb(-2)) for i in range(1200)]


def test_keys_are_gapless_and_in_order(spark, values):
    df = spark.createDataFrame(values, "id int, k int, amount decimal(19,2)").repartition(7)
    got = ordered.numbered_in_order(df, [F.col("k").desc_nulls_last(), F.asc("id")])
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    rows = sorted(got.collect(), key=lambda r: r._n)
    assert [(r._n, r.id) for r in rows] == [(i + 1, w[0]) for i, w in enumerate(want)]
    assert "Window" not in _no_single_task(got)


def test_hot_ties_are_dealt_over_parts(spark):
    df = spark.range(0, 20_000, 1, 8).select(F.lit(1).alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join these few rows again
    try:
        placed = ordered.in_order(df, [F.asc("k")])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in placed.groupBy("_part").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 15_000
    assert {r._n for r in ordered.numbered_in_order(df, [F.asc("k")]).select("_n").collect()} == set(range(1, 20_001))


def test_allocated_continues_the_keys(spark):
    old = spark.createDataFrame([(7, "x"), (3, "y")], "key int, v string")
    fresh = spark.createDataFrame([("b",), ("a",), ("c",)], "v string")
    got = relational.allocated(old, "key", fresh, [F.asc("v")])
    assert {(r.key, r.v) for r in got.collect()} == {(8, "a"), (9, "b"), (10, "c")} and got.schema["key"].dataType == old.schema["key"].dataType
    assert [r.key for r in relational.allocated(old.limit(0), "key", fresh.where("v = 'a'"), [F.asc("v")]).collect()] == [1]
    assert relational.allocated(old, "key", fresh.limit(0), [F.asc("v")]).count() == 0


def test_running_sums(spark, values):
    df = spark.createDataFrame(values, "id int, k int, amount decimal(19,2)").repartition(5)
    got = {r.id: r.running for r in ordered.running_sums(df, [F.asc("k"), F.asc("id")], "amount").collect()}
    total, want = D(0), {}
    for i, _, a in sorted(values, key=lambda r: (r[1] is not None, r[1] or 0, r[0])):
        total += a
        want[i] = total
    assert got == want
    _no_single_task(ordered.running_sums(df, [F.asc("k"), F.asc("id")], "amount"))


def _percentiles(df, column, shares):
    n, low, high = df.agg(F.count(column), F.min(column), F.max(column)).first()
    return ordered.exact_percentiles(df, column, shares, shares, n, None if low is None else D(low), None if high is None else D(high))


@pytest.mark.parametrize("kind, make", [("decimal(19,4)", lambda r: D(r.randint(-10**6, 10**6)).scaleb(-4)), ("bigint", lambda r: r.choice([5, 5, 5, r.randint(-(10**15), 10**15)])), ("decimal(28,8)", lambda r: D(r.randint(-(10**27), 10**27)).scaleb(-8)), ("int", lambda r: 7)])
def test_percentiles_are_exact(spark, monkeypatch, kind, make):
    """Ties, negative values, wide ranges and one single value; also when histograms must be refined to the last value."""
    rng = random.Random(3)
    rows = [make(rng) for _ in range(700)]
    df = spark.createDataFrame([(v,) for v in [*rows, None, None]], f"v {kind}").repartition(3)
    shares, order = [0.0, 0.1, 0.5, 0.9, 0.999, 1.0], sorted(rows)
    for bins, few in ((4096, 4096), (16, 3)):
        monkeypatch.setattr(ordered, "BINS", bins)
        monkeypatch.setattr(ordered, "SLICE", few)
        cont, disc = _percentiles(df, "v", shares)
        assert disc == [order[max(0, math.ceil(p * 700) - 1)] for p in shares]
        for p, c in zip(shares, cont):
            a, b = math.floor(p * 699), math.ceil(p * 699)
            want = float(order[a]) if a == b else (b - p * 699) * float(order[a]) + (p * 699 - a) * float(order[b])
            assert c == pytest.approx(want, rel=1e-12)


def test_percentiles_of_nothing_and_of_floats(spark):
    empty = spark.createDataFrame([(None,)], "v decimal(19,4)")
    assert _percentiles(empty, "v", [0.5]) == ([None], [None])
    for kind, v in (("double", 1.5), ("decimal(38,10)", D(1))):
        with pytest.raises(TypeError):
            ordered.order_statistics(spark.createDataFrame([(v,)], f"v {kind}"), "v", [0], D(1), D(2))


@pytest.fixture(scope="module")
def meetings(spark):
    """Audits and orders with a hot product, equal times, null keys and times."""
    rng = random.Random(9)
    product = lambda: rng.choice([1, 1, 1, 2, 3, 4, None])
    audits = [(i, product(), rng.choice([None, *range(40)])) for i in range(150)]
    orders = [(1000 + i, product(), rng.choice([None, *range(40)])) for i in range(200)]
    want = []
    for i, p, at in audits:
        best = sorted(((t, o) for o, q, t in orders if q == p and None not in (p, at, t) and t < at), reverse=True)[:3]
        want += [(i, p, k + 1, o, t) for k, (t, o) in enumerate(best)] or [(i, p, None, None, None)]
    a = spark.createDataFrame(audits, "audit int, product int, at int").repartition(4)
    return a, spark.createDataFrame(orders, "order int, product int, made int").repartition(3), sorted(want, key=repr)


def test_latest_before(meetings):
    audits, orders, want = meetings
    got = relational.latest_before(audits, orders, ["product"], "at", "made", 3, "order")
    assert sorted(((r.audit, r.product, r.place, r.order, r.made) for r in got.collect()), key=repr) == want
    plan = _no_single_task(got)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_outer_apply(meetings):
    audits, orders, want = meetings
    other = orders.withColumnRenamed("product", "sold")
    got = relational.outer_apply(audits, other, {"product": "sold"}, lambda outer: F.col("made") < outer("at"), [F.desc("made"), F.desc("order")], 3)
    assert sorted(((r.audit, r.product, r.order, r.made) for r in got.collect()), key=repr) == sorted(((a, p, o, m) for a, p, _, o, m in want), key=repr)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    every = relational.outer_apply(audits, other, {"product": "sold"}, None, [F.asc("order")], 1)
    assert every.count() == audits.count()


def test_tasks_stay_of_one_size_as_tables_grow(spark, monkeypatch, tmp_path):
    """Ordered parts, and the lines and orders of a batch, follow the bytes of the files, not the cores; results are the same."""
    from larkspur.plans import data_jobs
    from larkspur.sources import scratch

    path = lambda t: str(tmp_path / f"{t}.parquet")
    for t in ("nation", "part", "customer", "supplier", "orders", "lineitem", "events"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(path(t))
    orders = spark.read.parquet(path("orders")).select("o_orderkey", F.col("o_totalprice").cast("decimal(19,4)").alias("amount"))
    keys = [F.asc("amount"), F.asc("o_orderkey")]
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    jobs = [lambda: ordered.running_sums(orders, keys, "amount"), lambda: data_jobs._lateral_top(spark, str(tmp_path)), lambda: data_jobs._latest_before(spark, str(tmp_path))]
    want, few = [rows(job()) for job in jobs], ordered.in_order(orders, keys).select("_part").distinct().count()
    monkeypatch.setattr(scratch, "TASK_BYTES", 1 << 10)
    assert [rows(job()) for job in jobs] == want and all(want)
    parts = scratch.parts_for(orders)
    assert parts > spark.sparkContext.defaultParallelism >= few
    assert 0.8 * parts <= ordered.in_order(orders, keys).select("_part").distinct().count() <= parts
    plan = data_jobs._sales(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    # no broadcast, and nothing is dealt anew for the groups
    assert plan.count("REPARTITION_BY_NUM") == 2 and "ENSURE_REQUIREMENTS" not in plan and "Broadcast" not in plan
