"""Fingerprints against a plain walk, and what they tell of edits."""

import base64
import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from larkspur.llm import fingerprint as fp

from . import brute

M = (1 << 64) - 1


def mix(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & M
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & M
    return x ^ x >> 31


def plain(text):
    """One character after another, one walk after another."""
    level, walks = fp.level_of(len(text)), []
    for walk in range(fp.WALKS):
        out = []
        for a in range(0, len(text), fp.BLOCK):
            end = min(a + fp.BLOCK, len(text))
            at, full = a, end - a == fp.BLOCK
            for step in range(fp.STEPS):
                if step % (1 << level) == fp.PHASE % (1 << level) and (at < end or full):
                    seen = text[at : min(at + fp.GRAM, end + fp.GRAM - 1)].ljust(fp.GRAM, "\0")
                    s = step
                    for c in seen:
                        s = mix((s * 0x9E3779B97F4A7C15 + ord(c)) & M)
                    out.append(s >> 56)
                if at < end:
                    kind = (mix(ord(text[at])) >> 20) % 255 + 1
                    at += mix((walk * fp.STEPS + step) * 256 + kind + 0x5EED) & 1
        walks.append(base64.b64encode(bytes(out)).decode())
    return ".".join([f"{level:02x}", *walks])


def prose(rng, n):
    return " ".join("".join(rng.choice("aeioulrnstké") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_walks_equal_a_plain_walk():
    rng = random.Random(3)
    texts = ["", "a", "ab\n", "é€😀" * 9, "\0" * 70, prose(rng, 30), prose(rng, 900), prose(rng, 2000), "x" * 8000]
    assert fp.fingerprints_of(texts) == [plain(t) for t in texts]


@settings(max_examples=30, deadline=None)
@given(texts=st.lists(st.text(max_size=300), max_size=12))
def test_a_text_has_one_fingerprint(texts):
    alone = [fp.fingerprints_of([t])[0] for t in texts]
    assert fp.fingerprints_of(texts) == alone and fp.fingerprints_of(texts[::-1])[::-1] == alone
    assert all(0 <= fp.likeness(a, b) <= 1 and fp.likeness(a, b) == fp.likeness(b, a) and (fp.likeness(a, b) == 1.0) >= (s == t) for a, s in zip(alone, texts) for b, t in zip(alone, texts))


def test_likeness_follows_edits():
    rng = random.Random(8)
    for n in (40, 400, 3000):
        a, b = prose(rng, n), prose(rng, n)
        few = a[: len(a) // 3] + "zz" + a[len(a) // 3 + 1 :]
        half = fp.edited_text(a, b)
        x = fp.fingerprints_of([a, few, half, b])
        near, mid, far = (fp.likeness(x[0], y) for y in x[1:])
        assert near > 0.85 and 0.35 < mid < 0.65 and far < 0.1
        assert len(set(fp.bands(x[0])) & set(fp.bands(x[1]))) >= 8 and not set(fp.bands(x[0])) & set(fp.bands(x[3]))


def test_levels_can_be_compared():
    rng = random.Random(2)
    text = prose(rng, 3000)
    for size in (64, 65, 2 * fp.BLOCK, len(text)):
        own = fp.fingerprints_of([text[:size]])[0]
        finer = fp.own_level(own)
        for level in range(finer, fp.COARSEST + 1):
            per_block = [s for s in range(fp.STEPS) if s % (1 << finer) == fp.PHASE % (1 << finer)]
            held = [k for k in range(99_999) if per_block[k % len(per_block)] % (1 << level) == fp.PHASE % (1 << level)]
            for got, all_of in zip(fp.samples_at(own, level), fp.samples_at(own, finer), strict=True):
                assert got.tolist() == [all_of[k] for k in held if k < len(all_of)]


def test_fingerprints_of_documents(spark):
    """Null and repeated ids, null, empty and very long texts, repeated rows, clashing names; the last is followed by the first."""
    base = [(r[0], r[1]) for r in brute.corpus(5, 90)]
    rows = [*base, (None, "first of all"), (base[4][0], base[4][1]), (5000, "\n" * 300_000), (5001, None), (5002, "")]
    docs = spark.createDataFrame([(*r, 1, "x", 2) for r in rows], "doc_id long, text string, row long, fingerprint string, part int").repartition(6)
    got = fp.fingerprints(docs).collect()
    assert len(got) == len(rows)
    ordered = sorted(((i is not None, i or 0, t or "") for i, t in rows))
    own = dict(zip((t for _, _, t in ordered), fp.fingerprints_of([t for _, _, t in ordered])))
    follow = {}
    for k, (there, i, t) in enumerate(ordered):
        follow.setdefault((i if there else None, t), ordered[(k + 1) % len(ordered)][2])
    ties = {i for i, _ in rows if sum(j == i for j, _ in rows) > 1}
    for r in got:
        text = next(t for (i, t) in follow if i == r.doc_id and own[t] == r.fingerprint)
        assert r.n_chars == len(text)
        if r.doc_id not in ties:
            after = follow[r.doc_id, text]
            edit = fp.edited_text(text, after)
            assert r.edited_sha256 == hashlib.sha256(edit.encode()).hexdigest() and r.edited_fingerprint == fp.fingerprints_of([edit])[0]
            assert r.near_next == fp.likeness(own[text], own[after]) and r.near_edited == fp.likeness(r.fingerprint, r.edited_fingerprint)
    assert fp.fingerprints(docs.limit(0)).count() == 0
    (lone,) = fp.fingerprints(docs.where("doc_id is null")).collect()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"first first ").hexdigest()


def test_near_documents_are_linked(spark):
    rng = random.Random(6)
    texts = [prose(rng, 200) for _ in range(20)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(100 + i, texts[i]) for i in range(5)] + [(200 + i, texts[i].replace(" ", "  ", 1)) for i in range(5, 10)]
    prints = fp.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    links = {(r.doc_id, r.near_id): r.likeness for r in fp.near_documents(prints).collect()}
    assert set(links) == {(100 + i, i) for i in range(5)} | {(200 + i, i) for i in range(5, 10)} and min(links.values()) >= 0.8
    assert np.mean(list(links.values())) > 0.9
