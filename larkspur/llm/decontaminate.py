"""Benchmark decontamination with suffix arrays over the training text.

The words of each shard of documents (the rows of one pass of a task) are numbered by the benchmark's vocabulary; a word that the benchmark lacks ends a match.
A suffix array of the shard orders the word positions by the words that follow them, to just beyond a window; how much further two suffixes
agree is bisected over running hashes, so memory doesn't grow with the length of an item. The array is
sparse: a position enters only if its first words (up to SEED of them) begin some suffix of the benchmark, as no other position can
hold a match. Every suffix of every item is then searched in it by bisection: the range of its first `window` words gives all places where that window
occurs, and each of them its longest verbatim match. Of a document, those that begin no later than any other (their words before differ) are its
matches; the words that they cover are hit.

The benchmark is broadcast in blocks of at most block_words words (or one longer item), one after another; the hits of all blocks are merged by row.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids, lean, numbered, only, slices, table, text_bytes, written
from .kernels import ALNUM, covered, fold_case, ngrams, prefix_hash, running_hash, span_hash, spans_of, words

#: Words that decide whether a position enters the suffix array.
SEED = 3
#: Text bytes of a shard; one longer document is a shard of its own.
SHARD_BYTES = 1 << 20
#: Words by which suffixes are ordered, at least.
DEPTH = 13
#: Places of windows that are looked at together.
AT_ONCE = 1_000_000
FOUND = "struct<item_id: long, item_at: long, begin: long, words: long>"
HITS = f"row long, doc_id long, n_words long, begin array<long>, end array<long>, items array<long>, matches array<{FOUND}>"
HIT_NAMES = ["row", "doc_id", "n_words", "begin", "end", "items", "matches"]
MATCHES = "item_id long, at long, words long, doc_id long, doc_at long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of each word, A-Z lower-cased."""
    data, starts = text_bytes(column)
    data = fold_case(data)
    a, b, doc = words(data, starts, ALNUM)
    return span_hash(prefix_hash(data), a, b), doc


class Benchmark:
    """The suffixes of some items, as rows of the first word numbers from 1; 0 stands after an item's end."""

    def __init__(self, item_ids: np.ndarray, word: np.ndarray, item: np.ndarray, window: int) -> None:
        self.item_ids, self.window = item_ids, window
        sizes = np.bincount(item, minlength=len(item_ids))
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.vocabulary = np.unique(word)
        #: one more than a window, so that each leaves a place where anything may stand
        self.depth = max(window, DEPTH) + 1
        self.number = number = (np.searchsorted(self.vocabulary, word) + 1).astype(np.int32)
        self.item = item
        self.hashes = running_hash(number)
        self.place = np.arange(len(word)) - self.first[item]
        self.left = sizes[item] - self.place
        self.suffixes = rows_of(number, self.left, self.depth)
        #: window length of each item: the whole of an item that is shorter
        self.span = np.minimum(sizes, window)
        self.starts = np.flatnonzero(self.left >= self.span[item])
        seeds = [ngrams(number.astype(np.uint64), k) for k in range(1, SEED + 1)]
        self.seeds = []
        for k in range(1, SEED + 1):
            # a suffix whose window is shorter than SEED words is known by all of them
            want = np.flatnonzero((np.minimum(self.left, self.span[item]) == k) if k < SEED else (self.left >= SEED))
            self.seeds.append(np.unique(seeds[k - 1][want]))


def rows_of(number: np.ndarray, left: np.ndarray, depth: int, at: np.ndarray | None = None) -> np.ndarray:
    """Row i: the depth numbers from place at[i] on (all places by default), 0 after left[i] of them."""
    at = np.arange(len(number)) if at is None else at
    padded = np.concatenate([number, np.zeros(depth, number.dtype)])
    out = padded[at[:, None] + np.arange(depth)]
    out[np.arange(depth) >= left[:, None]] = 0
    return out


def order_of(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows as big-endian byte strings, which compare as their numbers do, and their order."""
    keys = np.ascontiguousarray(rows.astype(">u4")).view(np.dtype((np.void, 4 * rows.shape[1]))).ravel()
    return keys, np.argsort(keys, kind="stable")


class Shard:
    """The sparse suffix array of some documents."""

    def __init__(self, word: np.ndarray, doc: np.ndarray, bench: Benchmark) -> None:
        at = np.minimum(np.searchsorted(bench.vocabulary, word), len(bench.vocabulary) - 1)
        number = np.where(bench.vocabulary[at] == word, at + 1, 0).astype(np.int32)
        n = len(number)
        # words from each place up to the next unknown word or the document's end
        stop = np.flatnonzero((number == 0) | np.append(doc[1:] != doc[:-1], True))
        end = stop + (number[stop] != 0)
        self.number, self.hashes = number, running_hash(number)
        self.left = left = end[np.searchsorted(stop, np.arange(n))] - np.arange(n)
        enter = np.zeros(n, bool)
        for k in range(1, SEED + 1):
            if len(bench.seeds[k - 1]) and n >= k:
                grams = ngrams(number.astype(np.uint64), k)
                place = np.flatnonzero(left[: len(grams)] >= k)
                found = np.minimum(np.searchsorted(bench.seeds[k - 1], grams[place]), len(bench.seeds[k - 1]) - 1)
                enter[place[bench.seeds[k - 1][found] == grams[place]]] = True
        self.at = np.flatnonzero(enter)
        rows = rows_of(number, left[self.at], bench.depth, self.at)
        keys, order = order_of(rows)
        self.at, self.rows, self.keys = self.at[order], rows[order], keys[order]
        self.doc = doc

    def ranges(self, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For rows of numbers with 0 where anything may stand: the range of suffixes that begin with each."""
        low = np.ascontiguousarray(prefix.astype(">u4")).view(self.keys.dtype).ravel()
        high = np.ascontiguousarray(np.where(prefix == 0, 0xFFFFFFFF, prefix).astype(">u4")).view(self.keys.dtype).ravel()
        return bisect(self.keys, low), bisect(self.keys, high)

    def agreed(self, bench: Benchmark, suffix: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many words each suffix of the benchmark has in common with the text from a place on."""
        low, high = np.zeros(len(suffix), np.int64), np.minimum(bench.left[suffix], self.left[at])
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = span_hash(bench.hashes, suffix, suffix + mid) == span_hash(self.hashes, at, at + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def places(self, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The number of each range that isn't empty with each of its places, in parts of about AT_ONCE."""
        found = np.flatnonzero(high > low)
        sizes = (high - low)[found]
        part = (np.cumsum(sizes) - 1) // AT_ONCE if len(found) else sizes
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(found)]
        for a, b in zip(cuts, cuts[1:]):
            n = sizes[a:b]
            yield np.repeat(found[a:b], n), self.at[np.repeat(low[found[a:b]] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]

    def longest(self, bench: Benchmark) -> tuple[np.ndarray, np.ndarray]:
        """For every suffix of the benchmark: the words of its longest verbatim match here, and the first place of it (-1: none)."""
        n = len(bench.suffixes)
        best, where = np.zeros(n, np.int64), np.full(n, -1)
        if not len(self.at):
            return best, where
        low = self.ranges(bench.suffixes)[0]
        # the neighbours in suffix order tell how deep the match is, up to the depth of the order; all that agree so far are then compared
        depth = np.zeros(n, np.int64)
        for near in (low - 1, low):
            same = (self.rows[np.clip(near, 0, len(self.at) - 1)] == bench.suffixes) & (bench.suffixes != 0)
            depth = np.maximum(depth, np.where((near >= 0) & (near < len(self.at)), np.cumprod(same, axis=1).sum(1), 0))
        wanted = np.where(np.arange(bench.depth) < np.minimum(depth, bench.depth - 1)[:, None], bench.suffixes, 0)
        first, last = self.ranges(wanted)
        last[depth == 0] = first[depth == 0]
        for suffix, at in self.places(first, last):
            size = self.agreed(bench, suffix, at)
            order = np.lexsort((at, -size, suffix))
            order = order[np.concatenate([[True], np.diff(suffix[order]) > 0])] if len(order) else order
            better = size[order] > best[suffix[order]]
            best[suffix[order][better]], where[suffix[order][better]] = size[order][better], at[order][better]
        return best, where


def bisect(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The left place of each wanted key, all at once; byte strings compare as bytes."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys))
    width = keys.dtype.itemsize // 4
    rows = keys.view(">u4").reshape(-1, width) if len(keys) else np.zeros((0, width), ">u4")
    want = wanted.view(">u4").reshape(-1, width)
    lanes = np.arange(len(wanted))
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high) // 2
        row = rows[np.minimum(mid, len(keys) - 1)]
        differ = row != want
        k = differ.argmax(1)
        less = open_ & (row[lanes, k] < want[lanes, k])
        low = np.where(less, mid + 1, low)
        high = np.where(open_ & ~less, mid, high)


def _occurrences(shard: Shard, bench: Benchmark, prefix: np.ndarray) -> np.ndarray:
    """Rows (suffix, place, words): the verbatim matches of a window or more whose words before differ or are none."""
    out = [np.zeros((3, 0), np.int64)]
    for which, at in shard.places(*shard.ranges(prefix)):
        suffix = bench.starts[which]
        inside = (bench.place[suffix] > 0) & (at > 0)
        inside[inside] = shard.doc[at[inside] - 1] == shard.doc[at[inside]]
        inside[inside] = shard.number[at[inside] - 1] == bench.number[suffix[inside] - 1]
        suffix, at = suffix[~inside], at[~inside]
        out.append(np.stack([suffix, at, shard.agreed(bench, suffix, at)]))
    found = np.concatenate(out, 1)
    return found[:, np.lexsort((found[0], found[1]))]


def _lists(cuts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(cuts.astype(np.int32), values)


def _find(bench: Benchmark, block: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    prefix = bench.suffixes[bench.starts].copy()
    span = bench.span[bench.item[bench.starts]]
    prefix[np.arange(bench.depth) >= span[:, None]] = 0
    for batch in slices(batches, "text", SHARD_BYTES):
        word, doc = tokens(batch.column("text"))
        n = batch.num_rows
        n_words = np.bincount(doc, minlength=n)
        first = np.concatenate([[0], np.cumsum(n_words)])
        found = _occurrences(Shard(word, doc, bench), bench, prefix) if len(word) and len(bench.starts) else np.zeros((3, 0), np.int64)
        suffix, at, size = found
        flags = covered(len(word), at, at + size)
        spans = [np.zeros((3, 0), np.int64)]
        for i in np.unique(doc[at]):  # documents with a hit
            a, b = spans_of(flags[first[i] : first[i + 1]])
            spans.append(np.stack([np.full(len(a), i), a, b]))
        spans = np.concatenate(spans, 1)
        cuts, match_cuts = np.searchsorted(spans[0], np.arange(n + 1)), np.searchsorted(doc[at], np.arange(n + 1))
        pairs = np.unique(doc[at] * len(bench.item_ids) + bench.item[suffix])
        items, item_cuts = bench.item_ids[pairs % max(1, len(bench.item_ids))], np.searchsorted(pairs // max(1, len(bench.item_ids)), np.arange(n + 1))
        matches = pa.StructArray.from_arrays([pa.array(np.asarray(x, np.int64)) for x in (bench.item_ids[bench.item[suffix]], bench.place[suffix], at - first[doc[at]], size)], ["item_id", "item_at", "begin", "words"])
        lists = [_lists(cuts, pa.array(spans[1])), _lists(cuts, pa.array(spans[2])), _lists(item_cuts, pa.array(np.asarray(items, np.int64))), _lists(match_cuts, matches)]
        out = pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(n_words.astype(np.int64)), *lists], HIT_NAMES)
        yield out if not block else out.filter(pa.array(item_cuts[1:] > item_cuts[:-1]))


def _matches(bench: Benchmark, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SHARD_BYTES):
        word, doc = tokens(batch.column("text"))
        if not len(word):
            continue
        size, at = Shard(word, doc, bench).longest(bench)
        hit = np.flatnonzero(size > 0)
        first = np.searchsorted(doc, np.arange(batch.num_rows))
        of = doc[at[hit]]
        yield pa.RecordBatch.from_arrays([pa.array(bench.item_ids[bench.item[hit]]), pa.array(bench.place[hit]), pa.array(size[hit]), pa.array(ids(batch.column("doc_id"))[of]), pa.array(at[hit] - first[of])], [c.split()[0] for c in MATCHES.split(", ")])


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[Benchmark]:
    """The benchmark in blocks of whole items, at most block_words words each (one item at least)."""
    pending, size = [], 0

    def made() -> Benchmark:
        word, item = tokens(pa.array([r["text"] for r in pending], pa.string()))
        return Benchmark(np.array([r["item_id"] for r in pending], np.int64), word, item, window)

    for row in only(benchmark, "item_id", "text").dropna().orderBy("item_id").toLocalIterator():
        n = len(row["text"]) // 2 + 1  # words at most
        if pending and size + n > block_words:
            yield made()
            pending, size = [], 0
        pending.append(row)
        size += n
    if pending:
        yield made()


def _found(rows: DataFrame, blocks: Iterator[Benchmark], window: int) -> DataFrame:
    """HITS of numbered rows: one job over the rows for each block, merged by row."""
    context, parts = rows.sparkSession.sparkContext, []
    for k, bench in enumerate(blocks):
        shared = context.broadcast(bench)
        parts.append(rows.mapInArrow(lean(lambda batches, k=k, shared=shared: _find(shared.value, k, batches)), HITS))
    if not parts:
        nothing = context.broadcast(Benchmark(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), window))
        parts.append(rows.mapInArrow(lean(lambda batches: _find(nothing.value, 0, batches)), HITS))
    if len(parts) == 1:
        return parts[0]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    spans = F.array_sort(F.flatten(F.collect_list(F.arrays_zip("begin", "end"))))  # of one document
    merged = every.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), spans.alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("matches"))).alias("matches"),
    )
    joined = F.aggregate("spans", F.array().cast("array<struct<begin: long, end: long>>"), lambda out, s: F.when((F.size(out) > 0) & (s["begin"] <= F.element_at(out, -1)["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["begin"].alias("begin"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s))))
    return merged.withColumn("spans", joined).select("row", "doc_id", "n_words", F.col("spans.begin").alias("begin"), F.col("spans.end").alias("end"), "items", "matches")


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 500_000) -> DataFrame:
    """What of each document stands in the benchmark: doc_id, n_words, begin and end (spans of hit words), items (ids that occur), matches, for every row.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. A window is `window` consecutive words of an item, or the whole of an item with
    fewer; a word inside an occurrence of a window is hit. matches are the longest verbatim ones of a window or more: item_id, item_at (its word), begin (the document's word) and words. Null and
    empty texts have no words; items without words, text or id find nothing. Of repeated documents each is found, whatever their ids; repeated items
    count once in items. An empty table of documents gives an empty result, an empty benchmark rows without hits.
    """
    return _found(numbered(docs, "doc_id", "text"), _blocks(benchmark, window, block_words), window).drop("row")


def longest_matches(docs: DataFrame, benchmark: DataFrame, block_words: int = 500_000) -> DataFrame:
    """The longest verbatim match of every suffix of every item over all shards: item_id, at (its word), words, doc_id, doc_at (word of the document).

    Of equally long matches one of the smallest doc_id among the shards' first ones is given; suffixes without any common word are left out, so
    null and empty texts and tables give nothing. Repeated items give their rows once.
    """
    spark, out = docs.sparkSession, None
    for bench in _blocks(benchmark, 1, block_words):  # every word may begin a match
        shared = spark.sparkContext.broadcast(bench)
        found = only(docs, "doc_id", "text").mapInArrow(lean(lambda batches, shared=shared: _matches(shared.value, batches)), MATCHES)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], MATCHES)
    best = F.max_by(F.struct("words", "doc_id", "doc_at"), F.struct("words", -F.col("doc_id"), -F.col("doc_at"))).alias("best")
    return out.groupBy("item_id", "at").agg(best).select("item_id", "at", "best.words", "best.doc_id", "best.doc_at")


def verdicts(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for the rows of find_benchmark(). Without words nothing is contaminated.

    Null ids stay null; each of repeated rows has its verdict; an item that several windows or repeated rows name counts once. Without rows there are no verdicts.
    """
    n_hit = F.aggregate(F.zip_with("begin", "end", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    digest = F.sha2(F.concat_ws(",", F.array_sort(F.transform(F.array_distinct("items"), lambda i: i.cast("string")))).cast("binary"), 256)
    out = found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size(F.array_distinct("items")).cast("long").alias("n_items"), digest.alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _clean(bench: Benchmark, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", SHARD_BYTES):
        rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["row", "doc_id", "text"])
        found = pa.Table.from_batches(list(_find(bench, 0, iter([rows]))))
        hit = np.array([sum(e) - sum(b) for b, e in zip(found.column("begin").to_pylist(), found.column("end").to_pylist())], np.int64)
        left = batch.filter(pa.array((hit == 0) | (20 * hit < found.column("n_words").to_numpy())))
        if left.num_rows:
            yield left


def without_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13, block_words: int = 500_000) -> DataFrame:
    """The rows of docs that aren't contaminated (see verdicts()), with all columns, whatever their names but doc_id and text.

    Each row is judged by itself, so repeated, shared and null ids do no harm; null and empty texts stay. With a benchmark of one block texts aren't
    shuffled; with more, contaminated rows are taken out by their number. An empty table gives an empty result, an empty benchmark all rows.
    """
    blocks = _blocks(benchmark, window, block_words)
    head = list(itertools.islice(blocks, 2))
    if not head:
        return docs
    if len(head) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(head[0])
        return docs.mapInArrow(lean(lambda batches: _clean(shared.value, batches)), docs.schema)
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = numbered(docs.toDF(*names), *names)
    of = rows.select("row", F.lit(None).cast("long").alias("doc_id"), F.col(names[docs.columns.index("text")]).alias("text"))
    n_hit = F.aggregate(F.zip_with("begin", "end", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    found = _found(of, itertools.chain(head, blocks), window).select("row", "n_words", n_hit.alias("n_hit"))
    bad = written(found.where("n_hit > 0 and 20 * n_hit >= n_words").select("row"), "contaminated")
    return rows.join(bad, "row", "left_anti").select(*names).toDF(*docs.columns)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every document by windows of 13 words of the benchmark. Nulls, ties, repeats and empty tables as in find_benchmark() and verdicts()."""
    return verdicts(find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS k FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (SELECT doc_id, k, n, item_id FROM dw JOIN iw USING (n, g)
), words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM (SELECT DISTINCT doc_id, k, n FROM hit)) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM hit) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
