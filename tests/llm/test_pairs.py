"""Jaccard join and suffix-array deduplication against plain versions."""

import hashlib
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm.components import components
from larkspur.llm.jaccard_join import branches, jaccard_components, least_overlap, one_of_each, overlaps_in_tree, size_classes
from larkspur.llm.suffix_dedup import longest_previous_factors, remove_repeats

from . import brute


@pytest.mark.parametrize("share,shingle,seed", [(70, 2, 2)])
def test_components_equal_brute_force(spark, share, shingle, seed):
    rows = brute.corpus(seed, 150)
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    sets = {r[0]: brute.shingles(r[1], shingle) for r in rows}
    want = brute.components(sets, share)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_components(docs, shingle, share).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}
    assert len(set(want.values())) < len({s for s in sets.values() if s})  # there are links between different texts


def test_links_only_through_others_and_at_the_limit(spark):
    """A chain a-b-c of links whose ends aren't linked, and pairs just at and just under the limit."""
    w = [f"w{i}" for i in range(400)]
    text = lambda a, b: " ".join(w[a:b])
    # one-word shingles: sets of 100, moved on by 8: 92 / 108 = 0.852; by 16: 84 / 116
    docs = spark.createDataFrame([(5, text(0, 100)), (4, text(8, 108)), (3, text(16, 116)), (20, text(200, 300)), (21, text(200, 285)), (30, text(300, 400)), (31, text(300, 384))], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in jaccard_components(docs, 1, 85).collect()}
    assert got == {5: 3, 4: 3, 3: 3, 20: 20, 21: 20, 30: 30, 31: 31}


def test_one_of_each_keeps_columns_and_one_row(spark):
    rows = brute.corpus(3, 100)
    rows += [r for r in rows[:30]]  # repeated rows
    docs = spark.createDataFrame(rows, brute.SCHEMA)
    sets = {r[0]: brute.shingles(r[1], 5) for r in rows}
    want = brute.components(sets, 80)
    kept = one_of_each(docs, 5, 80)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect() if sets[r.doc_id]]
    assert sorted(ids) == sorted({want[i] for i in sets if sets[i]})


def test_one_of_each_goes_by_rows_and_not_by_ids(spark):
    text = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    rows = [(None, text(1), 1), (None, text(2), 2), (7, text(3), 3), (7, text(4), 4), (7, text(4), 5), (7, "", 6), (8, text(3), 7), (None, None, 8)]
    kept = sorted(r.row for r in one_of_each(spark.createDataFrame(rows, "doc_id long, text string, row long")).collect())
    assert kept in ([1, 2, 3, 4, 6, 8], [1, 2, 3, 5, 6, 8])


def test_edge_cases(spark):
    empty = spark.createDataFrame([], brute.SCHEMA)
    assert remove_repeats(empty).count() == 0 and one_of_each(empty).count() == 0
    text = "x" * 30 + " alpha beta gamma delta " + "y" * 30
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, None), (3, ""), (4, "a")], "doc_id long, text string")
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_components(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, 3, None), (1, 3, None), (1, 3, None), (2, 0, 2), (3, 0, 3), (4, 1, 4)], key=str)
    lost = [(r.doc_id, r.n_bytes, r.begin, r.end) for r in remove_repeats(docs).collect()]
    n = len(text)
    assert sorted(lost, key=str) == sorted([(None, n, [], []), (1, n, [0], [n]), (1, n, [0], [n]), (2, 0, [], []), (3, 0, [], []), (4, 1, [], [])], key=str)


@pytest.mark.parametrize("width,gram,seed,hot_rows", [(50, 24, 4, 1 << 14), (12, 5, 5, 1 << 14), (50, 24, 4, 3), (12, 5, 5, 1)])
def test_repeats_equal_brute_force(spark, width, gram, seed, hot_rows):
    """With anchors that are split, too."""
    rows = brute.corpus(seed, 120)
    docs = spark.createDataFrame(rows, brute.SCHEMA).repartition(5)
    want = brute.removed([(r[0], r[1]) for r in rows], width)
    got = {}
    for r in remove_repeats(docs, width, gram, hot_rows).collect():
        digest = r.text_sha256 if r.kept is None else hashlib.sha256(r.kept).hexdigest()
        got[r.doc_id] = (r.n_bytes, sum(b - a for a, b in zip(r.begin, r.end)), len(r.begin), digest)
    assert got == want and sum(v[1] for v in want.values())


def test_hot_anchors_are_counted_over_all_tasks(spark):
    from larkspur.llm import suffix_dedup as sd

    passage = "the passage that every document of this table holds, once and in the same words. "
    docs = spark.createDataFrame([(i, f"{i * 7919} begins " + passage + f"and ends with {i * 104729}") for i in range(60)], "doc_id long, text string").repartition(6)
    rows = sd.numbered(docs, "doc_id", "text").select("row", "text")
    shared = rows.mapInArrow(sd._emit_anchors(4, 50, 24), sd.PAIRS).repartition(3, "bucket").mapInArrow(sd._emit_shared(4, 50), sd.PAIRS)
    hot = sd.hot_anchors(shared)
    assert len(hot) and not len(sd.hot_anchors(shared.where("kind = 0")))
    data = np.frombuffer(("0 begins " + passage).encode(), np.uint8)
    low, _ = sd.anchors(data, np.array([0, len(data)]), 50, 24)
    changed = sd.split_hot(low, data, hot, 50) != low
    assert changed.any() and (changed == np.isin(low, hot)).all()


def test_periodic_texts(spark):
    docs = spark.createDataFrame([(1, "ab" * 200), (2, "ba" * 100), (3, "c" * 49 + "ab" * 30), (4, "ab" * 24), (5, "a" * 120), (6, "a" * 500)], "doc_id long, text string")
    want = brute.removed([tuple(r) for r in docs.collect()], 50)
    got = {r.doc_id: (r.n_bytes, sum(b - a for a, b in zip(r.begin, r.end)), len(r.begin)) for r in remove_repeats(docs).collect()}
    assert got == {k: v[:3] for k, v in want.items()}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (139, 140)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 141)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


sets_ = st.lists(st.sets(st.integers(0, 60), min_size=1, max_size=50), min_size=1, max_size=12)


@settings(max_examples=60, deadline=None)
@given(one=st.sets(st.integers(0, 60), min_size=1, max_size=50), others=sets_, share=st.sampled_from([50, 80, 85, 100]))
def test_tree_overlaps(one, others, share):
    path = lambda s: np.array(sorted(s), np.uint64)
    want = [100 * len(one & s) >= share * len(one | s) for s in others]
    assert overlaps_in_tree(path(one), [path(s) for s in others], share) == want


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10**6), size=st.integers(1, 300), share=st.sampled_from([60, 80, 85]))
def test_linked_sets_share_a_branch(seed, size, share):
    rng = np.random.default_rng(seed)
    x = np.unique(rng.integers(0, 2**64, size, dtype=np.uint64))
    lost, new = rng.integers(0, len(x) // 4 + 1), rng.integers(0, len(x) // 4 + 1)
    y = np.unique(np.concatenate([rng.permutation(x)[lost:], rng.integers(0, 2**64, new, dtype=np.uint64)]))
    both = len(np.intersect1d(x, y))
    if len(x) == len(y) == both or 100 * both < share * (len(x) + len(y) - both) or not len(y):
        return
    assert both >= least_overlap(np.int64(len(x) + len(y)), share)
    for often in (None, lambda s: s % np.uint64(10) < seed % 11):
        a, b = (set(branches(s, np.array([0, len(s)]), share, often and often(s))[0].tolist()) for s in (x, y))
        assert a & b


def test_unrelated_sets_share_no_branch():
    """Sets with empty ranges don't meet all others that have the same one."""
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**64, 30, dtype=np.uint64)) for _ in range(3000)]
    key, doc = branches(np.concatenate(sets), np.concatenate([[0], np.cumsum([len(s) for s in sets])]), 85)
    pair = np.unique(np.stack([key, doc.astype(np.uint64)], 1), axis=0)
    assert np.unique(pair[:, 0], return_counts=True)[1].max() == 1


def test_size_classes_hold_partners():
    for share in (60, 80, 85):
        last = size_classes(5000, share)
        for n in range(1, 4000):
            own, partner = np.searchsorted(last, [n, n * 100 // share])
            assert partner - own <= 1


def common_prefix(x, y):
    return next((k for k in range(len(x)) if x[k] != y[k]), len(x))


@settings(max_examples=80, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.text("ab", min_size=6, max_size=6)), max_size=60))
def test_longest_previous_factors(rows):
    windows = np.frombuffer("".join(w for _, w in rows).encode(), np.uint8).reshape(-1, 6)
    docs = np.array([d for d, _ in rows], np.int64)
    want = [max((common_prefix(w, v) for e, v in rows if e < d), default=0) for d, w in rows]
    assert longest_previous_factors(windows, docs).tolist() == want


def pieces(docs, width, gram, hot=np.zeros(0, np.uint64), find=True):
    """What _emit_pieces() sends of (doc_id, text) rows, all anchors being wanted, and the spans that _factors() finds in it."""
    from larkspur.llm import suffix_dedup as sd

    n = len(docs)
    texts = pa.RecordBatch.from_pydict({"bucket": [0] * n, "row": list(range(n)), "doc_id": [d for d, _ in docs], "text": [t for _, t in docs], "key": pa.nulls(n, pa.binary()), "rows": pa.nulls(n, pa.binary())})
    data, starts = sd.text_bytes(texts.column("text"))
    low, inside = sd.anchors(data, starts, width, gram)
    begin, _ = sd._stretches(low, inside)
    row = np.searchsorted(starts, begin, "right") - 1
    keys = pa.RecordBatch.from_pydict({"bucket": [0], "row": pa.nulls(1, pa.int64()), "doc_id": pa.nulls(1, pa.int64()), "text": pa.nulls(1, pa.string()), "key": [low[begin].tobytes()], "rows": [row.astype(np.int64).tobytes()]})
    sent = list(sd._emit_pieces(1, width, gram, SimpleNamespace(value=hot))(iter([texts, keys])))
    gone = [np.zeros(len(t.encode()), bool) for _, t in docs]
    for batch in sd._factors(1, width)(iter(sent)) if find else ():
        for r, x, y in zip(*(sd.unpacked(batch.column(c), np.int64).tolist() for c in ("row", "begin", "end"))):
            assert 0 <= x < y <= len(gone[r])
            gone[r][x:y] = True
    return sent, {d: int(g.sum()) for (d, _), g in zip(docs, gone)}


@settings(max_examples=60, deadline=None)
@given(docs=st.lists(st.tuples(st.text("abc", max_size=9), st.text("ab", min_size=1, max_size=7), st.integers(0, 40), st.text("abc", max_size=9), st.integers(0, 6)), min_size=2, max_size=8))
def test_rounds_of_repeated_strings(docs):
    """Texts that repeat themselves between other text, of any lengths and phases, also where earlier documents hold only some strings of a round."""
    docs = [(d, a + b * k + c) for a, b, k, c, d in docs]
    docs = list(dict(docs).items())
    _, got = pieces(docs, 12, 5)
    assert got == {d: v[1] for d, v in brute.removed(docs, 12).items()}


def test_what_repeats_itself_is_sent_once():
    docs = [(i, f"{'abcdefg'[i % 7:]} " + "Is onhe. " * (1500 + i) + f"end {i}") for i in range(40)]
    sent, got = pieces(docs, 50, 24)
    assert sum(len(x) for b in sent for x in b.column("bytes").to_pylist() if x) < 40 * 500  # of 40 texts of 13,500 bytes
    first = got.pop(0)
    assert first == 0 and all(got[i] >= 9 * 1500 for i in got)


def test_an_anchor_of_many_places_is_ordered_in_bounded_memory():
    """Half a million places of one anchor: stretches that don't repeat themselves, each in two documents."""
    from larkspur.llm import suffix_dedup as sd

    rng, width, n = np.random.default_rng(3), 50, 260
    bodies = rng.integers(0, 256, (n // 2, 2048), dtype=np.uint8)
    data = np.concatenate([bodies, bodies])
    ones = np.ones(n, np.int64)
    columns = [ones.astype(np.uint64), np.arange(n), np.arange(n), 0 * ones, data.shape[1] * ones]
    part = sd.packed(1, 0 * ones, columns, ["anchor", "row", "doc_id", "at", "size"])
    batch = pa.RecordBatch.from_arrays([*part.columns, pa.array([data.tobytes()])], [*part.schema.names, "bytes"])
    tracemalloc.start()
    try:
        spans = list(sd._factors(1, width)(iter([batch])))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    row, begin, end = (np.concatenate([sd.unpacked(b.column(c), np.int64) for b in spans]) for c in ("row", "begin", "end"))
    assert sorted(row.tolist()) == list(range(n // 2, n)) and (begin == 0).all() and (end == data.shape[1]).all()
    assert most < 100 * data.size


def test_pieces_of_split_anchors_are_made_in_bounded_memory():
    """300 KB of text whose anchors are all split: each of its places is sent with 50 bytes."""
    from larkspur.llm import suffix_dedup as sd

    rng = np.random.default_rng(4)
    docs = [(i, rng.integers(32, 127, 30_000, dtype=np.uint8).tobytes().decode()) for i in range(10)]
    data = np.frombuffer("".join(t for _, t in docs).encode(), np.uint8)
    hot = np.unique(sd.anchors(data, np.arange(0, len(data) + 1, 30_000), 50, 24)[0])
    tracemalloc.start()
    try:
        sent, _ = pieces(docs, 50, 24, hot, find=False)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    got = [(x, int.from_bytes(p[8 * k : 8 * k + 8], "little"), bytes(b[50 * k : 50 * k + 50])) for batch in sent for kind, r, p, b in zip(*(batch.column(c).to_pylist() for c in ("kind", "row", "at", "bytes"))) if kind == 1 for k in range(len(p) // 8) for x in [int.from_bytes(r[8 * k : 8 * k + 8], "little")]]
    assert len(got) == 10 * (30_000 - 49) and all(docs[r][1][at : at + 50].encode() == b for r, at, b in got)
    assert most < 800 * len(data)


@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.tuples(st.integers(0, 5), st.text("ab", min_size=20, max_size=20)), max_size=40), most=st.integers(1, 30), long=st.booleans())
def test_ranges_of_the_suffix_order(rows, most, long):
    """Many places in few at once, also many of one string."""
    from larkspur.llm import suffix_dedup as sd

    rows = [(d, "a" * 18 + w[:2] if long else w) for d, w in rows]
    data = np.frombuffer("".join(w for _, w in rows).encode(), np.uint8)
    docs = np.array([d for d, _ in rows], np.int64)
    want, sizes = [any(e < d and v == w for e, v in rows) for d, w in rows], []
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(sd, "ORDER_AT_ONCE", most)
        patch.setattr(sd, "longest_previous_factors", lambda w, d: sizes.append(len(d)) or longest_previous_factors(w, d))
        assert (sd.copied(data, 20 * np.arange(len(rows)), docs, 20).tolist() if rows else []) == want
    assert max(sizes, default=0) <= most


def test_rows_keep_their_numbers_however_the_scan_is_split(spark, tmp_path):
    from larkspur.llm.common import numbered

    docs = spark.createDataFrame(brute.corpus(9, 300), brute.SCHEMA)
    docs.repartition(5).write.option("parquet.block.size", 4096).parquet(str(tmp_path / "a b%" / "docs.parquet"))
    read = spark.read.parquet(str(tmp_path / "a b%" / "docs.parquet"))
    found = []
    try:
        for parts in ("1", "3", "16"):
            spark.conf.set("spark.sql.files.minPartitionNum", parts)
            found.append({(r.row, r.doc_id) for r in numbered(read.where("doc_id >= 0"), "doc_id").collect()})
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert found[0] == found[1] == found[2] and len({row for row, _ in found[0]}) == 300
    made = numbered(docs, "doc_id")
    assert {tuple(r) for r in made.collect()} == {tuple(r) for r in made.repartition(7).collect()}


@pytest.mark.parametrize("name", ["op9", "op10"])
def test_results_hold_when_the_splits_change_between_jobs(spark, tmp_path, monkeypatch, name):
    """Every job reads the table with another number of partitions, as when executors come and go."""
    from larkspur.llm import common, jaccard_join, suffix_dedup

    rows = brute.corpus(12, 90)
    spark.createDataFrame(rows, brute.SCHEMA).repartition(3).write.parquet(str(tmp_path / "docs.parquet"))
    docs, count = spark.read.parquet(str(tmp_path / "docs.parquet")), [0]

    def moved(df, tag, *options, **more):
        count[0] += 1
        spark.conf.set("spark.sql.files.minPartitionNum", str([1, 3, 9][count[0] % 3]))
        return common.written(df, tag, *options, **more)

    monkeypatch.setattr(jaccard_join, "written", moved)
    monkeypatch.setattr(suffix_dedup, "written", moved)
    try:
        if name == "op9":
            sets = {r[0]: brute.shingles(r[1]) for r in rows}
            assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == brute.components(sets, 85)
        else:
            want = brute.removed([(r[0], r[1]) for r in rows], 50)
            assert {r.doc_id: sum(b - a for a, b in zip(r.begin, r.end)) for r in remove_repeats(docs).collect()} == {i: v[1] for i, v in want.items()}
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert count[0] > 2
