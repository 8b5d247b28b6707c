"""Hard negatives against all pairs."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from larkspur.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, q string, block int, v string"


def plain(rows, step):
    """(vec_id, vector, label) rows; anchors are those whose id is divisible by step."""
    ok = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v), l) for i, v, l in rows if v is not None and l is not None and i is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, av, al in ok:
        if a % step:
            continue
        score = lambda v: sum(x * y for x, y in zip(av, v))
        mine = sorted((-score(v), i) for i, v, l in ok if l == al and i != a)[:5]
        for s, p in mine:
            fits = sorted((-score(v), i) for i, v, l in ok if l != al and -30 * s <= 100 * score(v) <= -90 * s)[:10]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(fits)]
    return sorted(out)


def random_rows(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 9))
    rows = []
    for i in range(n):
        v = (centres[rng.integers(6)] + 0.4 * rng.normal(size=9)).astype(np.float32).tolist()
        rows.append((i, v, int(rng.integers(4))))
    for i in range(n // 3):  # a very common vector, with ties of all kinds
        rows[3 * i] = (3 * i, rows[0][1], rows[3 * i][2] if i % 2 else 1)
    return rows


@pytest.mark.parametrize("cell_rows", [4096, 20])
def test_equals_all_pairs(spark, monkeypatch, cell_rows):
    """One cell and many; null, infinite, short and empty vectors, null labels, repeated rows, clashing names."""
    monkeypatch.setattr(hn, "CELL_ROWS", cell_rows)
    rows = random_rows(2, 400)
    rows += [(1001, None, 1), (1002, [1.0, None], 1), (1003, [float("nan")] * 9, 1), (1004, [float("inf")] + [0.0] * 8, 1), (1005, [0.5] * 9, None), (None, [0.5] * 9, 1), (1006, [2.0, -1.0], 2), (1010, [], 3), (1015, [0.0] * 9, 3), rows[5], rows[5], rows[10]]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = hn.hard_negatives(hn.valid_rows(table), F.col("vec_id") % 5 == 0)
    assert sorted(map(tuple, got.collect())) == plain(rows, 5)


def test_large_components_and_empty_tables(spark):
    big = [(0, [300_000.0, -1.5], 1), (1, [299_999.0, 2.0], 1), (2, [200_000.0, 1.0], 2), (3, [100_000.0, 7.0], 2)]
    table = spark.createDataFrame([(*r, "x", 1, "y") for r in big], SCHEMA)
    got = hn.hard_negatives(hn.valid_rows(table), F.col("vec_id") == 0).collect()
    assert sorted(map(tuple, got)) == [r for r in plain(big, 10) if r[0] == 0] and len(got) == 2
    empty = hn.valid_rows(spark.createDataFrame([], SCHEMA))
    assert hn.hard_negatives(empty, F.col("vec_id") == 0).count() == 0
    lone = hn.valid_rows(spark.createDataFrame([(0, [1.0], 1, "x", 1, "y")], SCHEMA))
    assert hn.hard_negatives(lone, F.col("vec_id") == 0).count() == 0


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 9999))
def test_balls_hold_all_products(seed):
    rng = np.random.default_rng(seed)
    a, b = (rng.integers(-300, 300, (rng.integers(1, 40), 5)) for _ in range(2))
    ta, tb = hn.grow(a, rng.integers(0, 2, len(a)), 4), hn.grow(b, np.zeros(len(b), np.int64), 4)
    assert sorted(ta.order.tolist()) == list(range(len(a)))
    for i in range(len(ta.begin)):
        for j in range(len(tb.begin)):
            low, high = hn.reach(float(ta.centre[i] @ tb.centre[j]), ta.norm[i], ta.radius[i], tb.norm[j], tb.radius[j])
            exact = hn.products(a[ta.order[ta.begin[i] : ta.end[i]]], b[tb.order[tb.begin[j] : tb.end[j]]])
            assert low <= exact.min() and exact.max() <= high


def test_groups_of_anchors_are_pruned(spark, monkeypatch):
    """Of far clusters only the own cells and those in reach are asked."""
    monkeypatch.setattr(hn, "CELL_ROWS", 50)
    rng = np.random.default_rng(4)
    rows = [(i, (np.eye(8)[i % 8] * 20 + rng.normal(size=8) * 0.1).astype(np.float32).tolist(), i % 8, "x", 1, "y") for i in range(800)]
    valid = hn.valid_rows(spark.createDataFrame(rows, SCHEMA))
    at = hn.index(valid, 10)
    queries = valid.where("vec_id % 10 = 0").select(F.col("vec_id").alias("q"), "label", "v", F.lit(10_000_000).cast("long").alias("least"), F.lit(hn.HIGH).alias("most"))
    placed = hn._with_cells(queries, at.cells, at.dims)
    assert len(at.cells.blocks) >= 8 and hn._asked(placed, at, own=False).count() < 2 * queries.count()
    assert np.array_equal(at.cells.blocks, np.ones(len(at.cells.blocks)))
