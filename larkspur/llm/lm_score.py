"""Language-model scores from a log-frequency Bloom filter.

Documents are stored in slices. Each slice sends its words and bigrams, once each and with their counts in the training documents, to the task of their bucket. There they are
counted exactly. A count c is quantised as q = 1 + floor(log2 c) and held in a Bloom filter as the q keys (n-gram, 1) .. (n-gram, q): probing one after
another until a miss reads it back, never too low, and too high with a chance that falls geometrically. The filter is sized by the counted keys of the task,
in segments of a fixed size, so every n-gram is in it however large the corpus is; nothing is broadcast. The slice gets back the filter's count of
each of its words and bigrams, and the exact one of its words.

    P(w | h) = a(h) * f(h, w) / f(h) + (1 - a(h)) * (c(w) + 0.1) / (N + 0.1 (V + 1)),   a(h) = MOST if h is known, else 0

f is the filter's count and c the exact one. a doesn't depend on how large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import buckets_for, packed, unpacked
from .common import ids, lean, only, partitions_for, slices, table, text_bytes, written
from .kernels import BASE, NOT_SPACE, fold_case, mix, prefix_hash, run_starts, span_hash, words
from .toxicity import fold

U = np.uint64
#: Hashes of what stands after the last word and before the first.
END, START = U(0x51ED270B5F1D3C9B), U(0x2545F4914F6CDD1D)
SEGMENT_BITS = 1 << 19
PROBES = 6
LEVELS = 48
#: Text bytes that ask for their counts together, and stored (compressed) bytes of slices for each task that counts and that scores.
ASK_BYTES = 1 << 22
COUNT_STORED, SCORE_STORED = 1 << 20, 3 << 20
MOST = 0.5
ASKED = "kind int, bucket int, keys binary, counts binary, slice long"
#: Kind 0: the documents of a slice; 1 and 2: what is known of its words and bigrams; 3: sums of a partition.
ANSWERS = "kind int, bucket int, slice long, counts binary, levels binary, tokens long, types long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words and ends, of what stands before each, and document numbers, in order."""
    data, starts = text_bytes(batch.column("text"))
    data = fold_case(data)
    a, b, doc = words(data, starts, NOT_SPACE)
    n = batch.num_rows
    at = np.arange(len(a)) + doc
    token, of = np.empty(len(a) + n, U), np.empty(len(a) + n, np.int64)
    token[at], of[at] = span_hash(prefix_hash(data), a, b), doc
    last = np.cumsum(np.bincount(doc, minlength=n) + 1) - 1
    token[last], of[last] = END, np.arange(n)
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[np.concatenate([[0], last[:-1] + 1])] = START
    return token, before, of


def _pair(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * U(BASE) + token)


def _bucket(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit key, by its place among all: sorted keys are in the order of their buckets."""
    return (((keys >> U(32)) * U(n)) >> U(32)).astype(np.int64)


def _plane_places(size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of such sizes laid one after another: where each record is in the first byte plane of its run, less the planes of the runs before, and the size of its run."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) - np.repeat(before, size), np.repeat(size, size)


def to_planes(values: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of each run of values (size: how many in each), all lowest bytes first, then the next ones: bytes that are 0 everywhere stand together, so that a shuffle's compression takes them out."""
    width = values.dtype.itemsize
    at, step = _plane_places(size)
    at += np.repeat((np.cumsum(size) - size) * width, size)
    out, raw = np.empty(len(values) * width, np.uint8), np.ascontiguousarray(values).view(np.uint8).reshape(-1, width)
    for k in range(width):
        out[at + k * step] = raw[:, k]
    return out


def from_planes(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows of a column of byte planes, one after another, and how many each row has."""
    width = np.dtype(kind).itemsize
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // width
    data = unpacked(column, np.uint8)
    at, step = _plane_places(size)
    at += np.repeat((np.cumsum(size) - size) * width, size)
    raw = np.empty((len(at), width), np.uint8)
    for k in range(width):
        raw[:, k] = data[at + k * step]
    return raw.reshape(-1).view(kind), size


def _differences(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Of sorted keys in runs: the first of each run, and how far each of the others is from the one before."""
    out = np.diff(keys, prepend=U(0))
    first = np.cumsum(size) - size
    out[first] = keys[first]
    return out


def _summed(differences: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The keys again; sums wrap around at 64 bits, and so does what is taken off."""
    sums = np.cumsum(differences, dtype=U)
    first = np.cumsum(size) - size
    there = first[size > 0]
    return sums - np.repeat(sums[there] - differences[there], size[size > 0])


def _blobs(data: np.ndarray, size: np.ndarray) -> pa.Array:
    """The bytes cut in values of such sizes."""
    ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _ask(n_buckets: int):
    """Of each slice, its words (kind 1) and bigrams (kind 2) once each, with their counts in rows to learn from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for of, batch in _unfolded(batches):
            token, before, doc = _tokens(batch)
            learnt = ~np.asarray(batch.column("held_out")).astype(bool)[doc]
            for kind, keys in ((1, token), (2, _pair(before, token))):
                key, at = np.unique(keys, return_inverse=True)
                bucket, size = np.unique(_bucket(key, n_buckets), return_counts=True)
                counts = np.bincount(at, learnt, len(key)).astype(np.uint32)
                columns = [np.full(len(bucket), kind, np.int32), bucket.astype(np.int32), _blobs(to_planes(_differences(key, size), size), 8 * size), _blobs(to_planes(counts, size), 4 * size), np.full(len(bucket), of)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], [c.split()[0] for c in ASKED.split(", ")])

    return run


def level_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 c) for c of 1 or more."""
    return np.frexp(counts.astype(np.float64))[1]


def _places(keys: np.ndarray, level: np.ndarray | int, k: int) -> np.ndarray:
    """The bit, within its segment, of probe k for (n-gram, level)."""
    h = mix(keys + np.asarray(level).astype(U) * U(0xD6E8FEB86659FD93))
    return (((h & U(0xFFFFFFFF)) + U(k) * ((h >> U(32)) | U(1))) & U(SEGMENT_BITS - 1)).astype(np.int64)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of each segment that comes to this task."""
    bits: dict[int, np.ndarray] = {}
    for batch in batches:
        for i, segment in enumerate(batch.column("bucket").to_pylist()):
            keys, counts = unpacked(batch.column("keys").slice(i, 1), U), unpacked(batch.column("counts").slice(i, 1), np.int64)
            mine = bits.setdefault(segment, np.zeros(SEGMENT_BITS, bool))
            level = level_of(counts)
            for j in range(1, int(level.max(initial=0)) + 1):
                keys, level = keys[level >= j], level[level >= j]
                for k in range(PROBES):
                    mine[_places(keys, j, k)] = True
    for segment, mine in bits.items():
        yield pa.RecordBatch.from_arrays([pa.array([segment], pa.int32()), pa.array([np.packbits(mine, bitorder="little").tobytes()], pa.binary())], ["segment", "bits"])


def _probed(bits: np.ndarray, base: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The quantised count of each n-gram, 0 for none: probes of one level after another until a miss. Its segment begins at the byte base."""
    out, left = np.zeros(len(keys), np.int64), np.arange(len(keys))
    for j in range(1, LEVELS):
        for k in range(PROBES):
            place = _places(keys[left], j, k)
            left = left[(bits[base[left] + (place >> 3)] >> (place & 7).astype(np.uint8)) & 1 > 0]
        if not len(left):
            break
        out[left] = j
    return out


def filter_levels(keys: np.ndarray, counts: np.ndarray, filter_bits: int) -> np.ndarray:
    """What a filter of all keys with a count of 1 or more gives back for each key. It is sized by the counts; filter_bits are held at a time."""
    level = level_of(counts)
    segments = max(1, int(np.ceil(level.sum() * PROBES / np.log(2) / SEGMENT_BITS)))
    segment = (keys % U(segments)).astype(np.int64)
    out, most, size = np.zeros(len(keys), np.uint8), max(1, filter_bits // SEGMENT_BITS), SEGMENT_BITS // 8
    for low in range(0, segments, most):
        mine = np.flatnonzero((segment >= low) & (segment < low + most))
        there = mine[counts[mine] > 0]
        bits = np.zeros(min(most, segments - low) * size, np.uint8)
        for filled in _filled(iter([packed(0, segment[there] - low, [keys[there], counts[there].astype(np.int64)], ["keys", "counts"])])):
            for at, data in zip(filled.column("segment").to_pylist(), filled.column("bits").to_pylist()):
                bits[at * size : (at + 1) * size] = np.frombuffer(data, np.uint8)
        out[mine] = _probed(bits, (segment[mine] - low) * size, keys[mine])
    return out


class Model:
    def __init__(self, tokens: int, types: int, keys: np.ndarray, counts: np.ndarray, bits: np.ndarray, segments: int) -> None:
        self.tokens, self.types, self.keys, self.counts, self.bits, self.segments = tokens, types, keys, counts, bits, segments

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return (counts + 0.1) / (self.tokens + 0.1 * (self.types + 1))

    def level(self, keys: np.ndarray) -> np.ndarray:
        return _probed(self.bits, (keys % U(self.segments)).astype(np.int64) * (SEGMENT_BITS // 8), keys)


def _answer(filter_bits: int):
    """Counts the n-grams of a partition and answers each slice, in the order in which it asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[int, list] = {1: [], 2: []}
        for batch in batches:
            for kind in (1, 2):
                part = batch.filter(pa.array(batch.column("kind").to_numpy() == kind))
                if part.num_rows:
                    differences, size = from_planes(part.column("keys"), U)
                    got[kind].append((ids(part.column("slice")).copy(), part.column("bucket").to_numpy().copy(), size, _summed(differences, size), from_planes(part.column("counts"), np.uint32)[0]))
        for kind, parts in got.items():
            if not parts:
                continue
            of, bucket, size, keys, counts = (np.concatenate(c) for c in zip(*parts))
            key, at = np.unique(keys, return_inverse=True)
            total = np.bincount(at, counts, len(key)).astype(np.int64)
            level = filter_levels(key, total, filter_bits)[at]
            exact = to_planes(total[at], size) if kind == 1 else np.zeros(0, np.uint8)
            yield _answers(np.full(len(size), kind), bucket, of, _blobs(exact, 8 * size * (kind == 1)), _blobs(level, size))
            if kind == 1:
                yield _answers(np.array([3]), np.zeros(1), np.zeros(1), *[pa.array([b""], pa.binary())] * 2, [int(total.sum())], [int((total > 0).sum())])

    return run


def _answers(kind, bucket, of, counts: pa.Array, levels: pa.Array, tokens: list | None = None, types: list | None = None) -> pa.RecordBatch:
    none = [None] * len(counts)
    columns = [pa.array(kind.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(of.astype(np.int64)), counts, levels, pa.array(tokens or none, pa.int64()), pa.array(types or none, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in ANSWERS.split(", ")])


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of each slice as one compressed record, which is stored and shuffled as it is."""
    for batch in slices(batches, "text", ASK_BYTES):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            stream.write_batch(batch)
        yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["documents"])


def _unfolded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
    for batch in batches:
        for of, documents in zip(batch.column("slice").to_pylist(), batch.column("documents")):
            yield of, pa.ipc.open_stream(documents.as_buffer()).read_next_batch()


def _scored(model: Model, docs: pa.RecordBatch, exact: np.ndarray, words_: np.ndarray, pairs: np.ndarray) -> pa.RecordBatch:
    """The answers are in the order of the slice's distinct words and bigrams."""
    token, before, doc = _tokens(docs)
    size = np.array([0.0] + [2.0 ** (q - 1) * (1.5 if q > 1 else 1.0) for q in range(1, LEVELS + 1)])
    at = np.unique(token, return_inverse=True)[1]
    count, known = exact[at], size[words_[at]]
    end = int(exact[at[np.flatnonzero(token == END)[0]]])  # as often as there are beginnings
    whole = np.concatenate([[0.0], known[:-1]])
    whole[before == START] = size[level_of(np.array([end]))[0]]
    both = np.where(whole > 0, size[pairs[np.unique(_pair(before, token), return_inverse=True)[1]]], 0.0)
    share, estimate, p = np.where(whole > 0, MOST, 0.0), both / np.maximum(np.maximum(whole, both), 1.0), model.unigram(count)
    n = docs.num_rows
    sums = [np.bincount(doc, minlength=n), np.bincount(doc[count > 0], minlength=n), np.bincount(doc, np.log10(p), n), np.bincount(doc, np.log10(share * estimate + (1 - share) * p), n)]
    return pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), *[pa.array(x) for x in sums]], [c.split()[0] for c in SCORES.split(", ")])


def _score(model: Model):
    """Rows by (slice, kind, bucket): the documents of a slice, and what is known of its words and bigrams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, held = None, []

        def scored() -> pa.RecordBatch:
            docs = pa.ipc.open_stream(held[0].column("counts")[0].as_buffer()).read_next_batch()
            of = lambda kind, name, to: np.concatenate([np.zeros(0, to), *[from_planes(b.column(name), to)[0] for b in (x.filter(pa.array(x.column("kind").to_numpy() == kind)) for x in held)]])
            return _scored(model, docs, of(1, "counts", np.int64), of(1, "levels", np.uint8), of(2, "levels", np.uint8))

        for batch in batches:
            own = ids(batch.column("slice"))
            at = run_starts(own) if len(own) else []
            for a, b in zip(at, [*at[1:], len(own)]):
                if where != own[a]:
                    if held:
                        yield scored()
                    where, held = own[a], []
                held.append(batch.slice(a, b - a))
        if held:
            yield scored()

    return run


def score_texts(docs: DataFrame, folds: int = 10, filter_bits: int = 1 << 27, max_frequent: int = 1 << 18) -> DataFrame:
    """The log10 probability of every text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (the model).

    docs: doc_id, text; other columns are ignored. The model learns from rows of which the fold (crc32 of the id as text) is not 0. A null or empty
    text has its end token alone. Repeated rows are learnt from and scored each. filter_bits bounds the part of the filter that a task holds at a time;
    all n-grams are in the filter. max_frequent is accepted and has no effect, as no table of words is broadcast. Words are told apart by 64-bit
    hashes. An empty table gives an empty result.
    """
    docs = only(docs, "doc_id", "text").select("doc_id", "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out"))
    # a slice is one stored record, so it is the same in both passes
    folded = written(docs.mapInArrow(lean(_folded), "documents binary").select(F.monotonically_increasing_id().alias("slice"), "documents"), "lm-slices", rows_per_file=8)
    parts, n_buckets = buckets_for(folded, COUNT_STORED)
    asked = folded.mapInArrow(lean(_ask(n_buckets)), ASKED).repartition(parts, "bucket")
    answers = written(asked.mapInArrow(lean(_answer(filter_bits)), ANSWERS), "lm-answers", release=True)
    sums = answers.where("kind = 3").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types")).first()
    tokens, types = sums["tokens"] or 0, sums["types"] or 0
    empty = np.zeros(0, U)
    model = Model(tokens, types, empty, empty, empty, 1)
    none = [F.lit(None).cast(t).alias(n) for n, t in (("levels", "binary"), ("tokens", "long"), ("types", "long"))]
    documents = folded.select(F.lit(0).alias("kind"), F.lit(0).alias("bucket"), "slice", F.col("documents").alias("counts"), *none)
    dealt = answers.where("kind < 3").unionByName(documents).repartition(partitions_for(folded, SCORE_STORED), "slice").sortWithinPartitions("slice", "kind", "bucket")
    scores = dealt.mapInArrow(lean(_score(model)), SCORES)
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every document under unigrams and under the model. Nulls, ties, repeats and empty tables as in score_texts()."""
    return score_texts(table(spark, sf_dir, "documents"))
