"""Operators on single texts: quality, decontamination, language model, toxicity, chat, URL rules."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import chat, common, decontaminate, lm_score, quality, toxicity, url_rules

from . import brute


@pytest.fixture(scope="module")
def rows():
    return brute.corpus(11, 120)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, brute.SCHEMA).repartition(4)


def test_quality_measures(spark, rows, docs):
    labels = spark.createDataFrame([(r[0], int(i % 4 > 0), 0) for i, r in enumerate(rows)], "doc_id long, quality int, text int")
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    for r in rows:
        g, want = got[r[0]], brute.quality(r[1])
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want
        assert g.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (g.kept and g.base_failed)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 8)))
    prose = lambda: "\n".join(" ".join(word() for _ in range(20)).capitalize() + "." for _ in range(6))
    junk = lambda: "\n".join(" ".join(f"{word()}{rng.choice(['%%%', '&&&', '$$$'])}" for _ in range(20)) for _ in range(6))
    rows = [(i, prose() if i % 3 else junk(), int(i % 3 > 0)) for i in range(240)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in rows[:120]], "doc_id long, quality int")
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs, labels).collect()}
    assert sum(got[i] == bool(q) for i, _, q in rows[120:]) >= 114
    undecided = quality.judge_quality(docs, labels.limit(0))
    assert undecided.where("kept").count() == 0


def test_verdicts_equal_plain_decoding(spark, rows, docs):
    """kept by plain features and a plain Viterbi over the fitted chain."""
    labels = spark.createDataFrame([(r[0], int(i % 3 > 0)) for i, r in enumerate(rows)], "doc_id long, quality int")
    chain = quality.fit_chain(docs, labels, max_lines=3)
    got = {r.doc_id: r.kept for r in quality.judge_quality(docs, labels, max_lines=3).collect()}
    for r in rows:
        n, _, _, _, repeats = brute.quality(r[1])
        features = brute.line_features(r[1])
        marks = brute.viterbi([f @ chain.weights for f in map(np.array, features)], chain.moves)
        chars = [len(line) for line in (r[1] or "").split("\n")]
        share = sum(c * m for c, m in zip(chars, marks)) / max(sum(chars), 1)
        assert got[r[0]] == (n >= 50 and 100 * repeats <= 50 * n and share >= 0.5), r


@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 9999))
def test_viterbi_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    chain = quality.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    sizes = rng.integers(0, 6, 4)
    x = rng.normal(size=(sizes.sum(), 3))
    got, at = chain.decode(x, sizes), 0
    value = lambda f, y: sum(f[i] @ chain.weights * y[i] + (chain.moves[y[i - 1], y[i]] if i else 0) for i in range(len(y)))
    for n in sizes:
        f, mine = x[at : at + n], got[at : at + n]
        best = max((value(f, [k >> i & 1 for i in range(n)]) for k in range(2**n)), default=0)
        assert abs(value(f, mine.tolist()) - best) < 1e-9
        at += n
    chance, moves = chain._expected(x, sizes)
    assert abs(moves.sum() - np.maximum(sizes - 1, 0).sum()) < 1e-6 and ((chance >= 0) & (chance <= 1)).all()


@settings(max_examples=25, deadline=None)
@given(seed=st.integers(0, 9999), share=st.sampled_from([0.6, 0.75, 0.9]))
def test_expectations_equal_those_over_all_labellings(seed, share):
    """Against brute force: the chances and moves of the tilted chain are those of all 2^n labellings, the tilt is the least that meets the known share, and documents that meet it have none."""
    rng = np.random.default_rng(seed)
    chain = quality.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    sizes = rng.integers(1, 6, 5)
    x, chars, good = rng.normal(size=(sizes.sum(), 3)), rng.integers(0, 90, sizes.sum()), rng.random(5) < 0.5
    chance, moves = chain.known_shares(x, sizes, good, chars, share)
    at, total = 0, np.zeros((2, 2))

    def plainly(f, tilt):
        score, label = [], [[k >> i & 1 for i in range(len(f))] for k in range(2 ** len(f))]
        for y in label:
            score.append(math.exp(sum((f[i] @ chain.weights + tilt) * y[i] + (chain.moves[y[i - 1], y[i]] if i else 0) for i in range(len(f)))))
        p = np.array(score) / sum(score)
        pairs = np.zeros((2, 2))
        for q, y in zip(p, label):
            for i in range(1, len(f)):
                pairs[y[i - 1], y[i]] += q
        return p @ np.array(label), pairs

    for n, g in zip(sizes, good):
        f, w, got = x[at : at + n], np.maximum(chars[at : at + n], 1), chance[at : at + n]
        at += n
        part = lambda c, w=w, g=g: (w @ c / w.sum()) if g else 1 - w @ c / w.sum()
        own, pairs = plainly(f, 0.0)
        if part(own) >= share:
            assert np.allclose(got, own)
        else:
            tilts = [sign * k * 16 / 256 for k in range(1, 257) for sign in [1 if g else -1]]
            tilt = next(t for t in tilts if part(plainly(f, t)[0]) >= share)
            own, pairs = plainly(f, tilt)
            assert np.allclose(got, own) and part(got) >= share
        total += pairs
    assert np.allclose(moves, total)


def test_mixed_texts_get_mixed_labels(spark):
    """Learnt from whole good and whole bad documents, the chain parts texts of both kinds of lines where they change, and the larger part decides."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("aeioulrnst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: [" ".join(word() for _ in range(14)).capitalize() + "." for _ in range(n)]
    junk = lambda n: [" | ".join(f"{word().upper()}!" for _ in range(9)) for _ in range(n)]
    train = [(i, "\n".join([*prose(8), *junk(i % 3)] if i % 2 else [*junk(8), *prose(i % 3)]), i % 2) for i in range(160)]
    mixed = [(1000 + k, "\n".join([*prose(k), *junk(10 - k)]), k) for k in range(1, 10)] + [(2000 + k, "\n".join([*junk(5 - k), *prose(2 * k), *junk(5 - k)]), 2 * k) for k in range(1, 5)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in train + mixed], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i, _, q in train], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality.judge_quality(docs, labels).collect()}
    for i, text, n in mixed:
        lines = text.split("\n")
        want = sum(len(line) for line in lines if line.endswith(".")) / sum(map(len, lines))
        assert 0 < got[i].content_share < 1 and abs(got[i].content_share - want) < 0.01, (i, n)
        assert got[i].kept == (not got[i].base_failed and want >= 0.5)
    assert all(got[i].kept == bool(q) for i, _, q in train)


def test_contamination(spark, rows, docs):
    rng = random.Random(2)
    items = [(i, t) for i, t in enumerate(["", None, "a", "one two", "TA re.", " ".join(brute.tokens(rows[40][1] or "x")[:9])])]
    for k in range(30):
        w = (rng.choice(rows)[1] or "").split(" ")
        a = rng.randrange(max(1, len(w)))
        items.append((100 + k, " ".join(w[a : a + rng.randint(3, 30)])))
    items.append((100, "repeated id of another item text"))
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id long")
    want = brute.contamination([(r[0], r[1]) for r in rows], items)
    for blocks in (2_000_000, 40):
        got = {r.doc_id: r for r in decontaminate.verdicts(decontaminate.find_benchmark(docs, bench, block_words=blocks)).collect()}
        for i, (n, hit, found) in want.items():
            digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
            assert (got[i].n_words, got[i].n_hit, got[i].n_items, got[i].items_sha256, got[i].contaminated) == (n, hit, len(found), digest, hit > 0 and 20 * hit >= n), i
        kept = {r.doc_id for r in decontaminate.without_contaminated(docs, bench, block_words=blocks).collect()}
        assert kept == {i for i, (n, hit, _) in want.items() if not (hit > 0 and 20 * hit >= n)}
    none = decontaminate.verdicts(decontaminate.find_benchmark(docs, bench.limit(0)))
    assert none.where("n_hit > 0").count() == 0 and none.count() == len(rows)


def test_contaminated_rows_go_and_others_of_their_id_stay(spark):
    words = [f"w{i}" for i in range(40)]
    bench = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(words[20:]))], "item_id long, text string")
    bad, clean = " ".join(words[3:18]), " ".join(f"x{i}" for i in range(30))
    both = " ".join([*words[:13], *[f"y{i}" for i in range(480)], *words[20:33]])  # a twentieth of its words only with the hits of both items
    docs = spark.createDataFrame([(1, bad, 1), (1, clean, 2), (None, clean, 3), (None, bad, 4), (3, None, 5), (3, "", 6), (4, both, 7)], "doc_id long, text string, row int")
    for blocks in (500_000, 10):
        assert sorted(r.row for r in decontaminate.without_contaminated(docs, bench, block_words=blocks).collect()) == [2, 3, 5, 6]
    assert decontaminate.without_contaminated(docs, bench.limit(0)).count() == 7 and decontaminate.without_contaminated(docs.limit(0), bench).count() == 0


def test_matches_with_a_very_long_item(spark):
    """An item of 100,000 words takes no more memory a word than others; matches are as long as the common text."""
    rng = random.Random(3)
    item = [f"v{rng.randrange(5000)}" for _ in range(100_000)]
    docs = spark.createDataFrame([(1, " ".join(["a", *item[500:900], "b", *item[7:20]])), (2, " ".join(item)), (3, " ".join(item[3:15])), (None, " ".join(item[:13]))], "doc_id long, text string")
    bench = spark.createDataFrame([(5, " ".join(item)), (6, "b " + item[7])], "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.find_benchmark(docs, bench).collect()}
    assert [tuple(m) for m in got[1].matches] == [(5, 500, 1, 400), (6, 0, 401, 2), (5, 7, 402, 13)]
    assert (got[1].begin, got[1].end) == ([1], [415]) and got[1]["items"] == [5, 6]
    assert (5, 0, 0, 100_000) in [tuple(m) for m in got[2].matches] and got[2].end == [100_000]
    assert got[3].matches == [] and [tuple(m) for m in got[None].matches] == [(5, 0, 0, 13)]
    longest = {r["at"]: (r["words"], r["doc_id"], r["doc_at"]) for r in decontaminate.longest_matches(docs.where("doc_id = 1"), bench.where("item_id = 5")).where("at in (500, 899, 7)").collect()}
    assert longest[500] == (400, 1, 1) and longest[7] == (13, 1, 402) and longest[899][0] >= 1


def test_longest_matches(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "x b c d q"), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, "z b c d e y"), (8, "nothing here")], "item_id long, text string")
    got = {(r["item_id"], r["at"]): (r["words"], r["doc_id"], r["doc_at"]) for r in decontaminate.longest_matches(docs, bench).collect()}
    assert got == {(9, 1): (4, 1, 1), (9, 2): (3, 1, 2), (9, 3): (2, 1, 3), (9, 4): (1, 1, 4)}


def test_language_model(spark, rows, docs):
    want = brute.unigrams([(r[0], r[1]) for r in rows])
    for options in ({}, {"filter_bits": 1 << 19, "max_frequent": 20}):
        got = {r.doc_id: r for r in lm_score.score_texts(docs, **options).collect()}
        for i, (n, known, total, base) in want.items():
            g = got[i]
            assert (g.n_tokens, g.n_known, g.train_tokens) == (n, known, total) and abs(g.base_score - base) < 1e-6 * abs(base)
            assert g.score < 0
    everything = sum(g.score for g in got.values()), sum(g.base_score for g in got.values())
    assert everything[0] > everything[1]
    assert lm_score.score_texts(docs.limit(0)).count() == 0


def test_all_bigrams_count_whatever_the_corpus_size(spark):
    """A bigram seen once raises its text's score, with the smallest filter and many other n-grams too; the same texts beside more others keep their weights."""
    rng = random.Random(5)
    few = [(i, " ".join(f"p{i}x{j}" for j in range(20))) for i in range(40)]
    more = few + [(i, " ".join(f"v{rng.randrange(3000)}" for _ in range(1500))) for i in range(40, 120)]
    learnt = {i for i, _ in few if zlib.crc32(str(i).encode()) % 10}
    for rows in (few, more):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r for r in lm_score.score_texts(docs, filter_bits=1 << 19).collect()}
        # each word is seen once and always follows the one before, so the bigram's share is at least MOST
        assert all(got[i].score >= got[i].n_tokens * math.log10(lm_score.MOST) - 5 for i in learnt)
        same = {r.doc_id: r.score for r in lm_score.score_texts(docs).collect()}
        assert all(abs(got[i].score - same[i]) < 1e-6 for i in got)


def test_scores_equal_the_plain_model(spark, rows, docs):
    """The score of each text by plain counts; the filter reads a count too high now and then, so a text may differ a little."""
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    texts = {r[0]: [*brute.tokens(r[1]), 0] for r in rows}
    pairs = {i: list(zip([1, *t], t)) for i, t in texts.items()}
    ones = collections.Counter(w for i, t in texts.items() if not held(i) for w in t)
    twos = collections.Counter(p for i, ps in pairs.items() if not held(i) for p in ps)
    n, kinds = sum(ones.values()), len(ones)
    size = lambda c: 0.0 if not c else 2.0 ** (q := math.floor(math.log2(c))) * (1.5 if q else 1.0)
    got, off = {r.doc_id: r.score for r in lm_score.score_texts(docs).collect()}, []
    for i, ps in pairs.items():
        want = 0.0
        for h, w in ps:
            whole, p = size(ones[0] if h == 1 else ones[h]), (ones[w] + 0.1) / (n + 0.1 * (kinds + 1))
            both = size(twos[h, w]) if whole else 0.0
            share = lm_score.MOST if whole else 0.0
            want += math.log10(share * both / max(whole, both, 1.0) + (1 - share) * p)
        off.append(abs(got[i] - want) / len(ps))
    assert sorted(off)[len(off) // 2] < 0.02 and max(off) < 0.5


def test_asked_keys_are_small_and_their_shuffle_goes(spark, monkeypatch):
    """Packed keys come back as they were and take 7 compressed bytes at most; once they are counted, the shuffle that brought them leaves the disk."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate([rng.integers(0, 2**64, 200_000, dtype=np.uint64), np.array([0, 1, 2**63, 2**64 - 1], np.uint64)]))
    bucket, size = np.unique(lm_score._bucket(keys, 400), return_counts=True)
    column = lm_score._blobs(lm_score.to_planes(lm_score._differences(keys, size), size), 8 * size)
    for part in (slice(0, len(size)), slice(7, 90), slice(3, 3)):
        got, sizes = lm_score.from_planes(column[part], np.uint64)
        assert (sizes == size[part]).all() and (lm_score._summed(got, sizes) == keys[np.isin(lm_score._bucket(keys, 400), bucket[part])]).all()
    assert len(pa.compress(b"".join(column.to_pylist()), "lz4_raw", asbytes=True)) < 7 * len(keys) < len(pa.compress(keys.tobytes(), "lz4_raw", asbytes=True))
    left = lambda: [f.getName() for f in (lambda seq: [seq.apply(k) for k in range(seq.size())])(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()) if f.getName().endswith("_0.data")]
    seen, before, plain = {}, left(), lm_score.written

    def written(df, tag, *args, **options):
        out = plain(df, tag, *args, **options)
        seen[tag] = [f for f in left() if f not in before]
        return out

    monkeypatch.setattr(lm_score, "written", written)
    docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in row)) for i, row in enumerate(rng.integers(0, 5000, (60, 200)).tolist())], "doc_id long, text string")
    assert lm_score.score_texts(docs).count() == 60 and seen["lm-answers"] == []
    assert spark.conf.get(common.RELEASE) == "false"


def test_filter_gives_back_levels():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(0, 2**64, 4000, dtype=np.uint64))
    counts = rng.integers(1, 3000, len(keys))
    bits = np.zeros(2 * lm_score.SEGMENT_BITS // 8, np.uint8)
    import pyarrow as pa

    from larkspur.llm.blobs import packed

    batch = packed(2, (keys % np.uint64(2)).astype(np.int64), [keys, counts], ["keys", "counts"])
    for out in lm_score._filled(iter([batch])):
        for segment, data in zip(out.column("segment").to_pylist(), out.column("bits").to_pylist()):
            bits[segment * len(data) : (segment + 1) * len(data)] = np.frombuffer(data, np.uint8)
    model = lm_score.Model(1, 1, keys[:0], counts[:0], bits, 2)
    level, got = lm_score.level_of(counts), model.level(keys)
    assert (got >= level).all() and (got == level).mean() > 0.97
    assert (model.level(rng.integers(0, 2**64, 4000, dtype=np.uint64)) == 0).mean() > 0.97 and isinstance(batch, pa.RecordBatch)


def test_toxicity(spark):
    rng = random.Random(8)
    filler = [f"w{i}" for i in range(400)]
    bad = ["blarg", "fnord", "zork"]
    rows = []
    for i in range(600):
        words = [rng.choice(filler) for _ in range(rng.randint(5, 80))]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + ".")
        rows.append((i, " ".join(words), int(toxic)))
    docs = spark.createDataFrame([(i, t, x) for i, t, x in rows] + [(None, None, 0), (1000, "", 0), (1000, "", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, x) for i, _, x in rows] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == 603 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    held = [(r.predicted, rows[r.doc_id][2]) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 600]
    assert len(held) > 60 and sum(p == x for p, x in held) >= len(held) - 1
    assert all(r.evidence and all(rows[e][2] for e in r.evidence) for r in got if r.doc_id is not None and r.doc_id < 600 and r.predicted)
    assert {r.predicted for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0}
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


@settings(max_examples=30, deadline=None)
@given(seed=st.integers(0, 9999), k=st.integers(1, 12))
def test_votes_equal_brute_force_without_ones_own(seed, k):
    rng = np.random.default_rng(seed)
    examples = []
    for i in range(rng.integers(1, 60)):
        terms = np.sort(rng.choice(6, rng.integers(0, 4), replace=False))
        examples.append({"doc_id": i, "toxic": int(rng.integers(0, 2)), "terms": terms.tolist(), "counts": rng.integers(1, 3, len(terms)).tolist()})
    weight = {0: 3.0, 1: 1.0}
    model = toxicity.Model(np.arange(6, dtype=np.uint64), 500, np.array([400, 9, 9, 50, 200, 3]), examples, weight, k)

    def vector(e):
        v = np.zeros(6)
        v[e["terms"]] = (1 + np.log(e["counts"])) * model.idf[e["terms"]]
        return v / (np.sqrt((v * v).sum()) or 1.0)

    for e in examples[:15]:
        others = [o for o in examples if o["doc_id"] != e["doc_id"]]
        share, n, nearest, evidence = model.voted(np.array(e["terms"], np.int64), np.array(e["counts"], np.int64), e["doc_id"])
        cosine = sorted(((round(float(vector(e) @ vector(o)), 10), o["toxic"]) for o in others if o["terms"] and vector(e) @ vector(o) > 0), reverse=True)
        if not cosine:
            votes = [(1.0, o["toxic"]) for o in others if not o["terms"]] if not e["terms"] else [(1.0, o["toxic"]) for o in others if not o["terms"]]
        else:
            least = cosine[min(k, len(cosine)) - 1][0]
            votes = [c for c in cosine if c[0] >= least]
            if n < len(votes):  # of those tied at the end whole entries come in until there are enough
                continue
            assert n == len(votes) and abs(nearest - cosine[0][0]) < 1e-8
        toxic, total = sum(c * weight[1] for c, t in votes if t), sum(c * weight[t] for c, t in votes)
        assert abs(share - (toxic + model.prior) / (total + 1.0)) < 1e-8 and e["doc_id"] not in evidence


def test_the_curve_is_calibrated():
    rng = np.random.default_rng(2)
    share = rng.random(4000)
    toxic = (rng.random(4000) < share**2 / (share**2 + (1 - share) ** 2)).astype(int)
    curve = toxicity.fit_curve(share, toxic, np.ones(4000))
    assert abs(curve[0] - 2) < 0.2 and abs(curve[1]) < 0.2
    after = toxicity.calibrated(curve, share)
    for low in (0.0, 0.2, 0.4, 0.6, 0.8):
        mine = (after >= low) & (after < low + 0.2)
        assert abs(toxic[mine].mean() - after[mine].mean()) < 0.06
    assert toxicity.fit_curve(share, np.zeros(4000, int), np.ones(4000)) == (1.0, 0.0)


@settings(max_examples=40, deadline=None)
@given(seed=st.integers(0, 9999), k=st.integers(1, 30))
def test_block_max_neighbours_are_exact(seed, k):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(rng.integers(1, 400)):
        terms = np.sort(rng.choice(30, rng.integers(1, 5), replace=False))
        w = rng.random(len(terms)) + 0.1
        vectors.append((tuple(terms.tolist()), tuple((w / np.sqrt((w * w).sum())).tolist())))
    vectors.sort()
    index = toxicity.BlockMaxIndex(vectors, 30)
    terms = np.sort(rng.choice(30, 3, replace=False))
    w = np.array([0.5, 0.6, 0.7]) / np.sqrt(1.1)
    dense = np.zeros(30)
    dense[terms] = w
    cosine = np.array([sum(dense[t] * x for t, x in zip(*v)) for v in vectors])
    got, near = index.nearest(terms, w, lambda e: k if len(e) >= k else 0)
    order = np.lexsort((np.arange(len(vectors)), -np.round(cosine, 12)))
    want = [i for i in order if cosine[i] > 0][:k]
    assert got.tolist() == want and np.allclose(near, cosine[want])


def test_chat_round_trip(spark):
    hard = ["", None, "\\", "<|end|>\n", "<|turn|>user\nhi", "a\\|b<\\|c", "<", "é<|", "\n\\n", chat.HOSTILE, "x" * 300]
    rng = random.Random(4)
    rows = [(c if c else None, k if k % 5 else None, rng.choice(["user", "assistant", "sys\ntem", None, "\\n"]), rng.choice(hard), 1) for c in range(40) for k in range(rng.randint(1, 7))]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part int")
    formatted = chat.format_chats(df)
    parts = formatted.collect()
    assert sum(p.n_turns for p in parts) == len(rows)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, (r[3] or "").encode()))
        whole = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learnt = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(mine), hashlib.sha256(whole.encode()).hexdigest())
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
        assert got[c].formatted_chars == sum(len(p.formatted) for p in parts if p.conv_id == c)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_conversations_come_in_parts(spark, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chat, "PART_BYTES", 1000)
    n = 60
    batch = pa.RecordBatch.from_pydict({"conv_id": [1] * n, "turn": list(range(n)), "role": ["user", "assistant"] * (n // 2), "text": [f"{k} " * 40 for k in range(n)]})
    parts = list(chat._format(iter([batch])))
    assert len(parts) > 3 and [p.column("part").to_pylist() for p in parts] == [[k] for k in range(len(parts))]
    whole = next(chat._read_back(iter(parts)))
    assert whole.num_rows == 1 and whole.column("n_turns").to_pylist() == [n]


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "example.com", "/en/x"), ("allow", "Example.com", "/en/"), ("block", "a-b.com", ""), ("block", None, "/"), ("block", "", "/")]
URLS = [None, "", "nope", "http://", "https://EXAMPLE.com/en/1?x#y", "http://www.example.com/en/x1", "http://b.www.example.com/en/", "http://xexample.com/en/", "http://exa.mple.net/es/", "http://net/es/", "http://net/es", "ftp://user@example.com:80/en/", "http://example.com?q=/en/", "http://example.com#/en/", "a://b://c/d", "http://c.a-b.com", "http://.com/", "http://com./", "http://ex!.com/en/", "http://example.com/en/x"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i % 17, u, 1) for i, u in enumerate(URLS * 3)], "page_id long, url string, salt int")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in url_rules.filter_urls(pages, url_rules.rule_frame(spark, RULES)).collect())
    want = []
    for i, u in enumerate(URLS * 3):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = rest
        for c in "/?#":
            host = host.split(c, 1)[0]
        path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
        host = host.translate(brute.LOWER)
        fits = [(len(h + p), len(h), [-ord(c) for c in h + p], a == "block", h + p, a) for a, h, p in ((a, (h or "").lower(), p) for a, h, p in RULES) if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        want.append((i % 17, host, path, best[4] if best else "", best[5] if best else "allow"))
    assert got == sorted(want)
    assert {r.verdict for r in url_rules.filter_urls(pages, url_rules.rule_frame(spark, RULES).limit(0), default="block").collect()} == {"block"}
    assert url_rules.filter_urls(pages.limit(0), url_rules.rule_frame(spark, RULES)).count() == 0
