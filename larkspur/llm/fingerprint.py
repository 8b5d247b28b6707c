"""Document fingerprints by a randomised edit embedding.

A shared random walk runs over the characters of a text: at each step it looks at the character under its pointer, and a coin that depends on the step and the character alone decides whether
the pointer moves on. Walks over two texts run together where the texts agree, and mostly fall in step again after an edit, so the edit distance of the texts becomes a Hamming distance of what
the pointers see. Now and then they don't for long, so there are WALKS walks with coins of their own, and of each block the best one counts. Texts are walked in blocks of BLOCK characters,
each from step 0, so that walks over thousands of blocks advance together as numpy arrays.

The fingerprint samples the walks: at every 2^level-th step it keeps 8 bits of the hash of the GRAM characters from the pointer on. The level grows with the length, so that a walk has
32 to 64 samples, and at least two of each block. Fingerprints are compared sample by sample, at the coarser of their levels. Bands of some samples each make candidates, and likeness() verifies them.

Neighbours by doc_id are found in one shuffle of the texts: range partitions in order of doc_id, of which only the last text of each meets the first one of the next.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, numbered, partitions_for, slices, table, written
from .kernels import U, mix

BLOCK, STEPS, GRAM, WALKS = 3584, 7680, 8, 3
#: Samples are taken at the steps that leave this remainder by a power of two, and at most so many powers are used.
PHASE, COARSEST = 2730, 12
SAMPLES = 64
#: Characters whose walks advance together.
TOGETHER = 1 << 22
#: Text bytes that are fingerprinted at a time.
SLICE = 1 << 22
#: Bands of a walk.
BANDS, BAND_SAMPLES = 6, 4
#: How often the samples of unrelated texts agree.
CHANCE = 1 / 256


@lru_cache(WALKS)
def _coins(walk: int) -> np.ndarray:
    """Moves by step and class of character; class 0 stands still."""
    n = np.arange(STEPS * 256, dtype=U) + U(walk * STEPS * 256)
    coins = (mix(n + U(0x5EED)) & U(1)).astype(np.uint8).reshape(STEPS, 256)
    coins[:, 0] = 0
    return coins


def level_of(n_chars: int) -> int:
    """The power of two of steps between samples for a text of that length."""
    blocks, rest = divmod(n_chars, BLOCK)
    steps, level = blocks * STEPS + min(2 * rest, STEPS), 0
    while level < COARSEST and steps > SAMPLES << level:
        level += 1
    return level


def _walk(codes: np.ndarray, kinds: np.ndarray, begin: np.ndarray, sizes: np.ndarray, levels: np.ndarray, walk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of blocks, which are ordered by level: block, step and symbol. Each block is followed by the GRAM - 1 characters after it, whose kind is 0."""
    coins, at, who = _coins(walk), begin.copy(), np.arange(len(sizes))
    end, full = begin + sizes, sizes == BLOCK
    found = []
    counts = np.searchsorted(levels, np.arange(COARSEST + 1), "right")
    for step in range(STEPS):
        if step % 64 == 0 and step:
            live = full[who] | (at < end[who])
            if not live.all():
                who, at = who[live], at[live]
                counts = np.searchsorted(levels[who], np.arange(COARSEST + 1), "right")
            if not len(who):
                break
        off = step - PHASE
        n = counts[min((off & -off).bit_length() - 1, COARSEST) if off else COARSEST]
        if n:
            found.append((who[:n], np.full(n, step, np.int32), at[:n].copy()))
        at += coins[step][kinds[at]]
    none = np.zeros(0, np.int64)
    block, step, at = (np.concatenate(x) for x in zip(*found, (none, none.astype(np.int32), none)))
    held = full[block] | (at < end[block])
    block, step, at = block[held], step[held], at[held]
    symbol = step.astype(U)
    for k in range(GRAM):
        symbol = mix(symbol * U(0x9E3779B97F4A7C15) + codes[at + k])
    return block, step, (symbol >> U(56)).astype(np.uint8)


def fingerprints_of(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its level, and the samples of each walk in base 64. Equal texts have equal ones; an empty text has no samples."""
    made: list[list[list[tuple[int, bytes]]]] = [[[] for _ in range(WALKS)] for _ in texts]
    levels = [level_of(len(t)) for t in texts]
    blocks = [(levels[d], d, s) for d, t in enumerate(texts) for s in range(-(-len(t) // BLOCK))]
    size, cut, groups = 0, 0, []
    for k, (_, d, s) in enumerate(blocks):
        size += min(BLOCK, len(texts[d]) - s * BLOCK)
        if size >= TOGETHER:
            groups.append(blocks[cut : k + 1])
            size, cut = 0, k + 1
    for group in [*groups, blocks[cut:]]:
        if not group:
            continue
        group.sort()
        sizes = np.array([min(BLOCK, len(texts[d]) - s * BLOCK) for _, d, s in group])
        pieces = [texts[d][s * BLOCK : (s + 1) * BLOCK + GRAM - 1].ljust(n + GRAM, "\0") for (_, d, s), n in zip(group, sizes.tolist())]
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        begin = np.concatenate([[0], np.cumsum(sizes + GRAM)[:-1]])
        kinds = ((mix(codes.astype(U)) >> U(20)) % U(255) + U(1)).astype(np.uint8)
        for k in range(GRAM):
            kinds[begin + sizes + k] = 0
        for walk in range(WALKS):
            block, step, symbol = _walk(codes, kinds, begin, sizes, np.array([g[0] for g in group]), walk)
            order = np.lexsort((step, block))
            symbol = symbol[order]
            bounds = np.searchsorted(block[order], np.arange(len(group) + 1))
            for k, (_, d, s) in enumerate(group):
                made[d][walk].append((s, symbol[bounds[k] : bounds[k + 1]].tobytes()))
    coded = lambda parts: base64.b64encode(b"".join(x for _, x in sorted(parts))).decode()
    return [".".join([f"{level:02x}", *map(coded, walks)]) for level, walks in zip(levels, made)]


def own_level(fingerprint: str) -> int:
    return int(fingerprint[:2], 16)


def samples_at(fingerprint: str, level: int) -> list[np.ndarray]:
    """Of each walk the samples of a fingerprint that a coarser (or the same) level has too."""
    own = own_level(fingerprint)
    walks = [np.frombuffer(base64.b64decode(w), np.uint8) for w in fingerprint[3:].split(".")]
    if own == level:
        return walks
    first = PHASE % (1 << own)
    each = samples_of_block(own)
    return [w[np.arange(len(w)) % each % (1 << level - own) == ((PHASE % (1 << level)) - first) >> own] for w in walks]


def samples_of_block(level: int) -> int:
    """Samples of one walk in a whole block."""
    return -(-(STEPS - PHASE % (1 << level)) >> level)


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of samples that agree, less what chance would give, in each block by the walk that agrees most; 1 for equal fingerprints. Samples that only the longer text has don't agree."""
    if a == b:
        return 1.0
    level = max(own_level(a), own_level(b))
    xs, ys = samples_at(a, level), samples_at(b, level)
    each = samples_of_block(level)
    lengths = np.array([max(len(x), len(y)) for x, y in zip(xs, ys)])
    n_blocks = -(-int(lengths.max()) // each)
    if not n_blocks:
        return 0.0
    starts = np.arange(n_blocks) * each
    agree = np.zeros((WALKS, n_blocks))
    for w, (x, y) in enumerate(zip(xs, ys)):
        n = min(len(x), len(y))
        agree[w] = np.bincount(np.arange(n) // each, x[:n] == y[:n], n_blocks)
    most = np.clip(lengths[:, None] - starts, 0, each)
    share = (agree / np.maximum(most, 1)).max(0)
    weight = most.max(0)
    return max(0.0, float((share * weight).sum() / weight.sum() - CHANCE) / (1 - CHANCE))


@lru_cache(4096)
def _places(n: int) -> np.ndarray:
    """For each band of a walk the samples it looks at: those of the smallest hashes, so that they are mostly the same for texts of nearly equal length."""
    rank = mix((np.arange(BANDS, dtype=U)[:, None] << U(32)) + np.arange(n, dtype=U)[None, :])
    return np.sort(np.argsort(rank, axis=1)[:, :BAND_SAMPLES], axis=1)


def bands(fingerprint: str, level: int | None = None) -> list[int]:
    """Keys of the fingerprint's bands at a level; texts that share one are candidates. A text without samples has none."""
    level = own_level(fingerprint) if level is None else level
    keys: list[int] = []
    for walk, held in enumerate(samples_at(fingerprint, level)):
        if len(held):
            seen = held[_places(len(held))].astype(U)
            key = (np.arange(BANDS, dtype=U) + U(walk * BANDS)) * U(64) + U(level)
            for k in range(seen.shape[1]):
                key = mix(key * U(0x9E3779B97F4A7C15) + seen[:, k])
            keys += key.view(np.int64).tolist()
    return keys


def edited_text(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


OUT = [("kind", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shared_bands", pa.int32()), ("text", pa.string())]
DDL = "kind int, part int, doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, shared_bands int, text string"
WHOLE, OPEN, FIRST = 0, 1, 2


def _compared(rows: list[tuple[int | None, str, str]], following: list[tuple[str, str]], part: int) -> list[tuple]:
    """Result rows of (doc_id, text, fingerprint), each with the text and fingerprint of the next document."""
    edits = [edited_text(text, after) for (_, text, _), (after, _) in zip(rows, following)]
    out = []
    for (doc, text, own), edit, other, (_, after) in zip(rows, edits, fingerprints_of(edits), following):
        level = max(own_level(own), own_level(other))
        shared = len(set(bands(own, level)) & set(bands(other, level)))
        out.append((WHOLE, part, doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), own, other, likeness(own, other), likeness(own, after), shared, None))
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), OUT)], [n for n, _ in OUT])


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition in order of doc_id: results of all documents but the last, which stays open, and the first as what the partition before needs."""
    part, held = TaskContext.get().partitionId(), None
    for batch in slices(batches, "text", SLICE):
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows = list(zip(batch.column("doc_id").to_pylist(), texts, fingerprints_of(texts)))
        if held is None:
            doc, text, own = rows[0]
            yield _batch([(FIRST, part, doc, None, None, own, None, None, None, None, text)])
        else:
            rows.insert(0, held)
        held = rows.pop()
        if rows:
            yield _batch(_compared(rows, [(text, own) for _, text, own in [*rows[1:], held]], part))
    if held is not None:
        doc, text, own = held
        yield _batch([(OPEN, part, doc, None, None, own, None, None, None, None, text)])


def _closed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of the open documents, each beside the first of the next partition."""
    for batch in slices(batches, "text", SLICE):
        doc, own, text, after, after_text = (batch.column(c).to_pylist() for c in ("doc_id", "fingerprint", "text", "after", "after_text"))
        yield _batch(_compared(list(zip(doc, text, own)), list(zip(after_text, after)), -1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and shared_bands, the bands that text and edited text have in common.

    Documents follow each other by doc_id, null first; those of one doc_id (repeated rows too) as they stand in the table's files. The last is followed by the first, a lone one by itself.
    A null text is empty; empty texts are 1 alike, and 0 like all others. Other columns are left alone, whatever their names. An empty table gives no rows.
    A task holds 4 MB of text, or one longer text with its edited form (about 10 bytes a character); walks need the same memory at any length.
    """
    rows = numbered(docs, "doc_id", "text")
    n = partitions_for(rows, 32 << 20)
    ordered = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "row", "text").repartitionByRange(n, "doc_id", "row").sortWithinPartitions("doc_id", "row")
    made = written(ordered.mapInArrow(lean(_in_order), DDL), "fingerprints")
    parts = sorted(r[0] for r in made.where(F.col("kind") == OPEN).select("part").collect())  # a number for each partition
    before = made.sparkSession.createDataFrame([(parts[k - 1], p) for k, p in enumerate(parts)], "part int, next int")
    firsts = made.where(F.col("kind") == FIRST).select(F.col("part").alias("next"), F.col("fingerprint").alias("after"), F.col("text").alias("after_text"))
    open_ends = made.where(F.col("kind") == OPEN).select("doc_id", "fingerprint", "text", "part").join(before, "part").join(firsts, "next")
    both = made.where(F.col("kind") == WHOLE).unionByName(open_ends.select("doc_id", "fingerprint", "text", "after", "after_text").mapInArrow(lean(_closed), DDL))
    return both.drop("kind", "part", "text")


def near_documents(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """Links (doc_id, near_id, likeness) between documents of fingerprints() whose likeness is at least so much: those of one fingerprint to the smallest of them, and these, band by band,
    to the smallest that shares the band. A band's members aren't paired among each other, so a band that very many share costs no more than its rows. A null doc_id is smaller than all others."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc, own = b.column("doc_id").to_pylist(), b.column("fingerprint").to_pylist()
            rows = [(d, p, k) for d, p in zip(doc, own) for up in (0, 1) if own_level(p) + up <= COARSEST for k in bands(p, own_level(p) + up)]
            if rows:
                d, p, k = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(p, pa.string()), pa.array(k, pa.int64())], ["doc_id", "fingerprint", "band"])

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            like = [likeness(x, y) for x, y in zip(b.column("fingerprint").to_pylist(), b.column("other").to_pylist())]
            out = pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("near_id"), pa.array(like, pa.float64())], ["doc_id", "near_id", "likeness"])
            yield out.filter(pa.array([x >= least for x in like], pa.bool_()))

    own = prints.select("doc_id", "fingerprint")
    one = written(own.groupBy("fingerprint").agg(F.min_by("doc_id", F.struct(F.col("doc_id").isNotNull(), F.col("doc_id"))).alias("near_id")), "prints")
    copies = own.join(one, "fingerprint").where(~F.col("doc_id").eqNullSafe(F.col("near_id"))).select("doc_id", "near_id", F.lit(1.0).alias("likeness"))
    by_band = written(one.select(F.col("near_id").alias("doc_id"), "fingerprint").mapInArrow(lean(keyed), "doc_id long, fingerprint string, band long"), "bands")
    lead = by_band.groupBy("band").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("set"), "doc_id", "fingerprint")).alias("lead"))
    pairs = by_band.join(lead, "band").select("doc_id", "fingerprint", F.col("lead.doc_id").alias("near_id"), F.col("lead.fingerprint").alias("other")).where("fingerprint <> other").distinct()
    return copies.unionByName(pairs.mapInArrow(lean(checked), "doc_id long, near_id long, likeness double"))


def op13_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all whole documents and of their edited texts. Nulls, ties, repeats and empty tables as in fingerprints()."""
    return fingerprints(table(spark, sf_dir, "documents"))
