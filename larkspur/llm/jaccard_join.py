"""N-gram Jaccard join by prefix trees: an exact self join of word-shingle sets, and its connected components.

Each set is put in one global order, the order of its shingles' hashes, and stands for a path of a prefix tree.

Partners meet by whole branches. The order is cut into twice as many ranges as two partners of these sizes can differ in shingles, and two more: then
their paths run alike through half of them at least. A set's path through each range is one record, dealt by its hash; sets alike there are
joined to the first of them, and a lone record is dropped. Ranges are fixed for a class of sizes, and a set whose partners can be in the next class is
in that one too. The first cut leaves out shingles that many texts hold, so that those with just a passage in common don't meet. Two partners can be alike in empty
ranges only; then both have more of these than are allowed for, and both send paths of all their shingles too, and if need be through the ranges of other hashes.

Candidates are checked exactly. The sets to be compared with one set come to a task in blocks and are stored as a prefix tree: sorted, each shares the beginning with
the one before. The tree is traversed once with the counted overlap carried along shared beginnings; a subtree is left as soon as what remains of
both sets can't reach the wanted overlap.

A bound from parity bitmaps comes before (the bits in which two bitmaps differ are no more than the shingles in which the sets do). Sets that were joined to the
same first one but aren't connected through it are compared with each other after the same bound, so no link is lost: those outside the largest
component of such a group meet all of it in blocks, which are dealt over the cluster; first each takes its nearest ones, then, if still apart, all.

Equal sets are one class, which its smallest document stands for. Records of one task are merged before the shuffle, so a group of
near copies, however large, sends each task's share as one record.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import bucket_of, buckets_for, by_file, packed, unpacked
from .common import bit_sketch, has, ids, lean, numbered, only, planned_bytes, slices, table, text_bytes, written
from .components import components
from .kernels import NOT_SPACE, first_of, fold_case, mix, ngrams, prefix_hash, run_starts, span_hash, words
from .suffix_dedup import _shared_here

U = np.uint64
SHINGLE = 4
#: Links are pairs with HUNDRED * intersection >= SHARE * union.
SHARE, HUNDRED = 85, 100
FLUSH = 400_000
BLOCK_ROWS = 256
#: Sets of one side that meet in a task, and the nearest that each takes first.
CELL_ROWS, NEAREST = 1024, 2
#: Ways to cut the order into ranges, for sets with too many empty ones.
CUTS = 6
#: Counters for shingles, how often is often, and bytes of a scan for each counter: beyond them documents are sampled.
COUNTERS, OFTEN, SAMPLE_BYTES = 1 << 24, 3, 2
#: Elements of a path that are looked up at once.
STEP = 128
EDGES = "kind int, bucket int, key binary, row binary, leader binary"


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of all documents in global order, one document after another, and where each document begins."""
    data, starts = text_bytes(column)
    data = fold_case(data)
    a, b, doc = words(data, starts, NOT_SPACE)
    word, docs = span_hash(prefix_hash(data), a, b), len(column)
    grams, of = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    whole = ngrams(word, n)
    if len(whole):
        at = np.flatnonzero(doc[: len(whole)] == doc[n - 1 :])
        grams.append(whole[at])
        of.append(doc[at])
    sizes = np.bincount(doc, minlength=docs)
    first = np.concatenate([[0], np.cumsum(sizes)])
    for k in range(1, n):  # shorter documents are one shingle
        short = np.flatnonzero(sizes == k)
        if len(short):
            grams.append(mix(ngrams(word, k)[first[short]] + U(k)))
            of.append(short)
    gram, of = np.concatenate(grams), np.concatenate(of)
    order = np.lexsort((gram, of))
    gram, of = gram[order], of[order]
    fresh = np.concatenate([[True], (gram[1:] != gram[:-1]) | (of[1:] != of[:-1])]) if len(gram) else np.zeros(0, bool)
    return gram[fresh], first_of(of[fresh], docs)


def most_different(total: np.ndarray, share: int) -> np.ndarray:
    """How many shingles two linked sets with so many together can differ in."""
    return total * (HUNDRED - share) // (HUNDRED + share)


def least_overlap(total: np.ndarray, share: int) -> np.ndarray:
    """The least intersection of two linked sets with so many shingles together."""
    return -(-total * share // (HUNDRED + share))


def size_classes(largest: int, share: int) -> np.ndarray:
    """The last size of each class: classes are wide enough that partners are in the same or the next one."""
    last = [0]
    while last[-1] < largest * HUNDRED // share + 1:
        low = last[-1] + 1
        last.append(max(low, low * HUNDRED * HUNDRED // (share * share)))
    return np.array(last, np.int64)


def branches(gram: np.ndarray, first: np.ndarray, share: int, often: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each set's path through each range, and its document number. often: which shingles many documents hold; the first cut leaves them out."""
    sizes = np.diff(first)
    last = size_classes(int(sizes.max(initial=1)), share)
    own = np.searchsorted(last, sizes)
    hashes, docs = [], []
    mixed = mix(gram)
    for shift in (0, 1):
        number = np.minimum(own + shift, len(last) - 1)
        differ = most_different(2 * last[number], share)
        ranges = 2 * (differ + 1)
        there = (sizes > 0) & (differ > 0) & ((shift == 0) | (sizes * HUNDRED // share > last[own]))
        for cut in range(0 if often is not None else 1, CUTS):
            if not there.any():
                break
            doc = np.repeat(np.arange(len(sizes)), sizes)
            keep = there[doc] if cut else there[doc] & ~often
            doc, g, m = doc[keep], gram[keep], mixed[keep]
            place = g if cut < 2 else mix(g ^ U(cut * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            part = (((place >> U(32)) * ranges[doc].astype(U)) >> U(32)).astype(np.int64)
            if cut > 1:
                order = np.lexsort((part, doc))
                doc, part, m = doc[order], part[order], m[order]
            at = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (part[1:] != part[:-1])])) if len(doc) else np.zeros(0, np.int64)
            if len(at):
                salt = mix(number[doc[at]].astype(U) * U(0x9E3779B97F4A7C15) + part[at].astype(U) + (U(cut) << U(48)))
                hashes.append(mix(np.add.reduceat(m, at) + salt))
                docs.append(doc[at])
            # alike in empty ranges only: then both have so few others
            there = there & (np.bincount(doc[at], minlength=len(sizes)) < differ + 1)
        for d in np.flatnonzero(there):  # too many empty ranges whatever the cut: those of the last
            blank = np.setdiff1d(np.arange(ranges[d]), part[at][doc[at] == d])
            hashes.append(mix(mix(np.full(len(blank), int(number[d])).astype(U) * U(0x9E3779B97F4A7C15) + blank.astype(U))))
            docs.append(np.full(len(blank), d))
    return np.concatenate([np.zeros(0, U), *hashes]), np.concatenate([np.zeros(0, np.int64), *docs]).astype(np.int64)


def _counter(gram: np.ndarray) -> np.ndarray:
    return (mix(gram ^ U(0x2545F4914F6CDD1D)) & U(COUNTERS - 1)).astype(np.int64)


def often_held(standing: DataFrame, shingle: int) -> np.ndarray:
    """A bitmap of COUNTERS bits: the shingles that OFTEN or more of a sample of the texts hold, and a few others.

    It only moves shingles out of the first cut, which spares pairs that have just a common passage; links are found whatever it says. The sample is as
    large as the counters can tell apart. standing: text.
    """
    segment = 1 << 16
    every = max(1, planned_bytes(standing) // (COUNTERS * SAMPLE_BYTES))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(COUNTERS, np.uint8)
        for batch in slices(batches, "text"):
            place, n = np.unique(_counter(shingle_sets(batch.column("text"), shingle)[0]), return_counts=True)
            held[place] = np.minimum(held[place].astype(np.int64) + n, 255)
        at = np.flatnonzero(held)
        yield packed(0, at // segment, [at % segment, held[at]], ["place", "n"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, bucket in enumerate(batch.column("bucket").to_pylist()):
                place, n = unpacked(batch.column("place").slice(k, 1), np.int64), unpacked(batch.column("n").slice(k, 1), np.uint8)
                held.setdefault(bucket, np.zeros(segment, np.int64))[place] += n
        bits = [np.packbits(n >= OFTEN).tobytes() for n in held.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array(bits, pa.binary())], ["bucket", "bits"])

    sample = standing.where(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("text")
    counted = sample.mapInArrow(lean(count), "kind int, bucket int, place binary, n binary").repartition(16, "bucket").mapInArrow(judge, "bucket int, bits binary")
    out = np.zeros(COUNTERS // 8, np.uint8)
    for r in counted.toArrow().to_pylist():  # COUNTERS bits at most
        out[r["bucket"] * segment // 8 : (r["bucket"] + 1) * segment // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def is_often(often: np.ndarray, gram: np.ndarray) -> np.ndarray:
    place = _counter(gram)
    return (often[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 > 0


def _describe(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            gram, first = shingle_sets(batch.column("text"), shingle)
            sums = [np.concatenate([np.zeros(1, U), np.cumsum(mix(gram ^ U(salt)))]) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F)]
            keys = [pa.array((s[first[1:]] - s[first[:-1]]).view(np.int64)) for s in sums]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(np.diff(first).astype(np.int64)), *keys], ["row", "doc_id", "n_shingles", "key1", "key2"])

    return run


def _stars(key: np.ndarray, row: np.ndarray, n_buckets: int) -> tuple[pa.RecordBatch, np.ndarray, np.ndarray]:
    """Of (key, row) records: edges from the rows of each shared key to its first row, and one record for each key."""
    many, of, one, first = _shared_here(key, row)
    at = run_starts(many)
    leader = np.repeat(of[at], np.diff(np.append(at, len(many))))
    keep = of != leader
    return packed(0, bucket_of(many[keep], n_buckets), [many[keep], of[keep], leader[keep]], ["key", "row", "leader"]), one, first


def _emit_branches(sketch: np.ndarray, often: np.ndarray, n_buckets: int, shingle: int, share: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            edges, one, first = _stars(np.concatenate(keys), np.concatenate(rows), n_buckets)
            yield edges
            for of_file, base in by_file(first):  # small offsets from the first row of a file
                yield packed(1, bucket_of(one[of_file], n_buckets), [one[of_file], (first[of_file] - base).astype(np.uint32), np.full(len(of_file), base)], ["key", "row", "leader"])

        for batch in slices(batches, "text"):
            row = ids(batch.column("row"))
            keep = has(sketch, row)
            batch, row = batch.filter(pa.array(keep)), row[keep]
            if not len(row):
                continue
            gram, at = shingle_sets(batch.column("text"), shingle)
            key, doc = branches(gram, at, share, is_often(often, gram))
            keys.append(key)
            rows.append(row[doc])
            size += len(key)
            if size > FLUSH:
                yield from flush()
                keys, rows, size = [], [], 0
        if keys:
            yield from flush()

    return run


def _join_branches(n_buckets: int):
    """The edges of all tasks' keys, each key's to its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, edge_keys, edge_rows = [np.zeros(0, U)], [np.zeros(0, np.int64)], [np.zeros(0, U)], [np.zeros(0, np.int64)]
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            through = batch.filter(pa.array(kind == 0))
            edge_keys.append(unpacked(through.column("key"), U).copy())
            edge_rows.append(unpacked(through.column("row"), np.int64).copy())
            part = batch.filter(pa.array(kind == 1))
            keys.append(unpacked(part.column("key"), U).copy())
            rows.append(unpacked(part.column("row"), np.uint32).astype(np.int64) + unpacked(part.column("leader"), np.int64))
        key, row = np.concatenate(keys), np.concatenate(rows)
        yield _stars(key, row, n_buckets)[0]
        # rows that a task joined to its own first row are joined to the first of all
        order = np.lexsort((row, key))
        first = order[run_starts(key[order])]
        key, row, of, other = key[first], row[first], np.concatenate(edge_keys), np.concatenate(edge_rows)
        leader = row[np.searchsorted(key, of)]
        yield packed(0, bucket_of(of, n_buckets), [of, other, leader], ["key", "row", "leader"])

    return run


def _pairs_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pair = np.unique(np.stack([unpacked(batch.column("row"), np.int64), unpacked(batch.column("leader"), np.int64)], 1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])


def overlaps_in_tree(one: np.ndarray, others: list[np.ndarray], share: int) -> list[bool]:
    """Which of the other sets are linked with the one. All are in global order; the others are traversed as a prefix tree.

    In the order of their paths, each set shares a branch with the one before; the overlaps counted along it are carried on. Where the shingles that remain of both
    sets can't reach the wanted overlap the subtree is left: what it still holds is passed over without a look at its shingles.
    """
    out = [False] * len(others)
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    before, done, counted, passed = np.zeros(0, U), 0, np.zeros(1, np.int64), 0
    for i in order:
        path = others[i]
        wanted = int(least_overlap(np.int64(len(one) + len(path)), share))
        reach = min(done, len(path), len(before))
        differ = np.flatnonzero(before[:reach] != path[:reach])
        k = int(differ[0]) if len(differ) else reach
        hits = [counted[: k + 1]]
        overlap, at = int(hits[0][-1]), passed if k == done else int(np.searchsorted(one, path[k - 1], "right")) if k else 0
        while k < len(path) and overlap + min(len(path) - k, len(one) - at) >= wanted:
            part = path[k : k + STEP]
            places = np.minimum(np.searchsorted(one, part), len(one) - 1)
            hits.append(overlap + np.cumsum(one[places] == part))
            overlap, k = int(hits[-1][-1]), k + len(part)
            at = int(np.searchsorted(one, part[-1], "right"))
        out[i] = overlap >= wanted and k >= len(path)
        before, done, counted, passed = path, k, np.concatenate(hits), at
    return out


def _compare(shingle: int, share: int):
    """Rows by (leader, block, is_member): the first is the leader's text. Gives each member's verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, one, rows, sets = None, None, [], []

        def verdicts() -> pa.RecordBatch:
            linked = overlaps_in_tree(one, sets, share)
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array([where[0]] * len(rows), pa.int64()), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

        for batch in slices(batches, "text"):
            gram, first = shingle_sets(batch.column("text"), shingle)
            for i, (leader, block, member, row) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("leader", "block", "is_member", "row")))):
                if where != (leader, block):
                    if rows:
                        yield verdicts()
                    where, one, rows, sets = (leader, block), None, [], []
                mine = gram[first[i] : first[i + 1]].copy()
                if not member:
                    one = mine
                else:
                    rows.append(row)
                    sets.append(mine)
                    if len(rows) >= 4 * BLOCK_ROWS:
                        yield verdicts()
                        rows, sets = [], []
        if rows:
            yield verdicts()

    return run


def _filtered(sketch: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = has(sketch, ids(batch.column("row")))
        if keep.any():
            yield batch.filter(pa.array(keep))


def _texts_of(source: DataFrame, rows: DataFrame) -> DataFrame:
    """The texts of the rows, and perhaps a few others."""
    sketch = source.sparkSession.sparkContext.broadcast(bit_sketch(rows, "row"))
    return source.select("row", "text").mapInArrow(lambda batches: _filtered(sketch.value, batches), "row long, text string")


def compared(source: DataFrame, pairs: DataFrame, parts: int, shingle: int, share: int) -> DataFrame:
    """The exact verdict on each pair of rows (a, b): a, b, linked. b's set meets the sets of all its a, in blocks."""
    blocks = pairs.groupBy("b").agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("blocks"))
    members = pairs.join(blocks, "b").select(F.col("a").alias("row"), F.col("b").alias("leader"), F.pmod(F.xxhash64("a"), F.col("blocks")).alias("block"), F.lit(1).alias("is_member"))
    leaders = members.select("leader", "block").distinct().select(F.col("leader").alias("row"), "leader", "block", F.lit(0).alias("is_member"))
    wanted = written(members.unionByName(leaders), "join-wanted")
    with_text = wanted.join(_texts_of(source, wanted), "row")
    dealt = with_text.repartition(parts, "leader", "block").sortWithinPartitions("leader", "block", "is_member")
    return written(dealt.select("leader", "block", "is_member", "row", "text").mapInArrow(lean(_compare(shingle, share)), "a long, b long, linked boolean"), "join-verdicts")


def _bitmaps(shingle: int):
    """The parity bitmap of each set: the bit of a hash is set if an odd number of shingles has it. About two bits for each shingle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            gram, first = shingle_sets(batch.column("text"), shingle)
            out = []
            for i in range(batch.num_rows):
                mine = gram[first[i] : first[i + 1]]
                bits = max(256, 1 << int(2 * len(mine)).bit_length())
                flags = np.bincount((mix(mine) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
                out.append(np.packbits(flags.astype(np.uint8), bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(np.diff(first).astype(np.int64)), pa.array(out, pa.binary())], ["row", "n", "bitmap"])

    return run


def _folded(bitmap: np.ndarray, size: int) -> np.ndarray:
    """A parity bitmap of fewer bits: halves are laid over each other."""
    while len(bitmap) > size:
        half = len(bitmap) // 2
        bitmap = bitmap[:half] ^ bitmap[half:]
    return bitmap


def _bound(share: int):
    """Which pairs the sizes and bitmaps don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = ids(batch.column("n_a")), ids(batch.column("n_b"))
            differ = np.zeros(batch.num_rows, np.int64)
            for i, (x, y) in enumerate(zip(batch.column("bitmap_a"), batch.column("bitmap_b"))):
                x, y = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
                size = min(len(x), len(y))
                differ[i] = np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum(dtype=np.int64)
            maybe = (np.minimum(n, m) >= least_overlap(n + m, share)) & (differ <= most_different(n + m, share))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(maybe)], ["a", "b", "maybe"])

    return run


def _cross_pairs(share: int, nearest: int):
    """Rows by (key, i, j): pairs of different components that the sizes and bitmaps don't rule out, of each probe the nearest ones or (0) all."""

    def pairs(group: list[tuple]) -> Iterator[pa.RecordBatch]:
        row, comp, n, side = (np.array([g[k] for g in group], np.int64) for k in (0, 1, 2, 4))
        size = min(len(g[3]) for g in group)
        bits = np.stack([_folded(np.frombuffer(g[3], np.uint8), size) for g in group])
        rest, found = np.flatnonzero(side != 0), []
        for i in np.flatnonzero(side != 1):
            total = n[i] + n[rest]
            at = rest[(comp[rest] != comp[i]) & (np.minimum(n[i], n[rest]) >= least_overlap(total, share))]
            differ = np.bitwise_count(bits[at] ^ bits[i]).sum(1, dtype=np.int64)
            fits = differ <= most_different(n[i] + n[at], share)
            at, differ = at[fits], differ[fits]
            at = at[np.argsort(differ, kind="stable")[:nearest]] if nearest else at
            found.append(np.stack([np.maximum(row[at], row[i]), np.minimum(row[at], row[i])], 1))
        if found:
            pair = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, group = None, []
        for batch in batches:
            for k, i, j, *member in zip(*(batch.column(c).to_pylist() for c in ("key", "i", "j", "row", "component", "n", "bitmap", "side"))):
                if where != (k, i, j):
                    yield from pairs(group) if len(group) > 1 else ()
                    where, group = (k, i, j), []
                group.append(member)
        yield from pairs(group) if len(group) > 1 else ()

    return run


def _cells(members: DataFrame) -> DataFrame:
    """Where the members of a group meet: key (its first set), i, j, row, component, side (0: a probe, 1: one to be met, 2: both).

    Probes are the members outside the largest component of a key. They are cut in blocks i and all members in blocks j, by hash; each i meets each j.
    """
    by_component = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    sizes = by_component.groupBy("key").agg(F.sum("n").alias("n"), F.count("*").alias("kinds"), F.max(F.struct("n", "component")).alias("most")).where("n > 2 and kinds > 1")
    blocks = lambda n: F.ceil(n / CELL_ROWS).cast("int")
    dealt = members.join(sizes.select("key", blocks(F.col("n") - F.col("most.n")).alias("is"), blocks(F.col("n")).alias("js"), F.col("most.component").alias("largest")), "key")
    dealt = dealt.withColumns({"one": F.expr("is = 1 and js = 1"), "probe": F.col("component") != F.col("largest")})
    up_to = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda c: F.pmod(F.xxhash64("row", F.lit(c)), F.col(c)).cast("int")
    met = dealt.select("key", "row", "component", up_to("is").alias("i"), block("js").alias("j"), F.when(F.col("one") & F.col("probe"), 2).otherwise(1).alias("side"))
    probes = dealt.where("probe and not one").select("key", "row", "component", block("is").alias("i"), up_to("js").alias("j"), F.lit(0).alias("side"))
    return met.unionByName(probes)


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, share: int = SHARE) -> DataFrame:
    """Every row's set size, class and component: doc_id, n_shingles, class_id, n_links, component_id.

    docs: doc_id, text; other columns are ignored. A-Z are lower-cased; a set holds the distinct shingles of so many words, or the whole sequence of a shorter
    text. Rows without words are linked with nothing. Two sets are linked when 100 * intersection >= share * union. class_id is the smallest doc_id with the same
    set, component_id the smallest reachable by links; n_links counts the checked links of the class with other classes that were needed to connect it. A null id is smaller than
    all others and shown as null; repeated rows are one class. An empty table gives an empty result.
    """
    return _placed(numbered(docs, "doc_id", "text"), shingle, share)


def _placed(rows: DataFrame, shingle: int, share: int) -> DataFrame:
    """jaccard_components() of numbered rows; component_row is the same for the rows of a component, whatever their ids, and theirs alone."""
    spark = rows.sparkSession
    parts, n_buckets = buckets_for(rows)
    source = rows.select("row", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "text")
    described = written(source.mapInArrow(lean(_describe(shingle)), "row long, doc_id long, n_shingles long, key1 long, key2 long"), "join-sets")
    same = ["n_shingles", "key1", "key2"]
    classes = described.where("n_shingles > 0").groupBy(*same).agg(F.min(F.struct("doc_id", "row")).alias("first"))
    # a document without words is a class of its own
    described = described.join(classes, same, "left").select("row", "doc_id", "n_shingles", F.coalesce("first.row", "row").alias("class_row"), F.coalesce("first.doc_id", "doc_id").alias("class_id"))
    described = written(described, "join-classes")
    standing = described.where("n_shingles > 0 and row = class_row").select("row", F.col("class_id"))
    sketch = spark.sparkContext.broadcast(bit_sketch(standing, "row"))
    often = spark.sparkContext.broadcast(often_held(source.select("row", "text"), shingle))
    joined = source.select("row", "text").mapInArrow(lean(lambda batches: _emit_branches(sketch.value, often.value, n_buckets, shingle, share)(batches)), EDGES)
    edges = written(joined.repartition(parts, "bucket").mapInArrow(lean(_join_branches(n_buckets)), EDGES), "join-edges")
    class_of = described.select("row", "class_row")

    def by_class(pairs: DataFrame) -> DataFrame:
        return pairs.join(class_of.select(F.col("row").alias("a"), F.col("class_row").alias("class_a")), "a").join(class_of.select(F.col("row").alias("b"), F.col("class_row").alias("class_b")), "b")

    pairs = written(edges.select("row", "leader").mapInArrow(_pairs_in, "a long, b long").distinct(), "join-pairs")
    in_pairs = pairs.select(F.col("a").alias("row")).unionByName(pairs.select(F.col("b").alias("row")))
    bitmaps = written(_texts_of(source, in_pairs).mapInArrow(lean(_bitmaps(shingle)), "row long, n long, bitmap binary"), "join-bitmaps")
    of = lambda c: bitmaps.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("bitmap").alias(f"bitmap_{c}"))
    bounds = written(pairs.join(of("a"), "a").join(of("b"), "b").mapInArrow(_bound(share), "a long, b long, maybe boolean"), "join-bounds")
    verdicts = compared(source, bounds.where("maybe").select("a", "b"), parts, shingle, share).unionByName(bounds.where("not maybe").select("a", "b", F.lit(False).alias("linked")))
    linked = by_class(verdicts.where("linked")).select(F.col("class_a").alias("a"), F.col("class_b").alias("b")).where("a <> b").distinct()
    stars = written(components(linked), "join-stars")

    def with_component(rows: DataFrame, name: str, to: str) -> DataFrame:
        return rows.join(stars.select(F.col("node").alias(name), F.col("component").alias("_c")), name, "left").withColumn(to, F.coalesce("_c", name)).drop("_c")

    # sets that are alike in a range with the same first one, but not connected through it
    apart = with_component(with_component(by_class(verdicts.where("not linked")), "class_a", "ca"), "class_b", "cb").where("ca <> cb").select(F.col("b").alias("key")).distinct()
    joined = pairs.select(F.col("b").alias("key"), F.col("a").alias("row")).join(written(apart, "join-open"), "key")
    members = joined.unionByName(apart.withColumn("row", F.col("key"))).join(class_of, "row").select("key", F.col("class_row").alias("row")).distinct()
    members = written(members, "join-members")
    done = verdicts.select("a", "b")
    for nearest in (NEAREST, 0):
        cells = _cells(written(with_component(members, "row", "component"), "join-placed")).join(bitmaps, "row")
        grouped = cells.select("key", "i", "j", "row", "component", "n", "bitmap", "side").repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", "row")
        more = grouped.mapInArrow(lean(_cross_pairs(share, nearest)), "a long, b long").distinct()
        more = written(more.join(done, ["a", "b"], "left_anti"), "join-more")
        judged = compared(source, more, parts, shingle, share)
        done = done.unionByName(judged.select("a", "b"))
        linked = written(linked.unionByName(judged.where("linked").select("a", "b")).distinct(), "join-links")
        stars = written(components(linked), "join-stars")
    counts = linked.select("a").unionByName(linked.select(F.col("b").alias("a"))).groupBy("a").agg(F.count("*").alias("n_links")).withColumnRenamed("a", "class_row")
    placed = standing.join(stars, standing["row"] == stars["node"]).select(F.col("row").alias("class_row"), "component", "class_id")
    smallest = placed.groupBy("component").agg(F.min("class_id").alias("component_id"))
    placed = placed.join(smallest, "component").select("class_row", "component", "component_id").join(counts, "class_row", "left")
    shown = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c)).alias(c)
    full = described.join(placed, "class_row", "left").withColumn("component_id", F.coalesce("component_id", "class_id"))
    return full.select("row", shown("doc_id"), "n_shingles", shown("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), shown("component_id"), F.coalesce("component", "class_row").alias("component_row"), (F.col("row") == F.col("class_row")).alias("stands"))


def one_of_each(docs: DataFrame, shingle: int = 5, share: int = 80) -> DataFrame:
    """The rows of docs with all columns, one of each component: its smallest doc_id, and of repeated rows one.

    Rows without words are all kept. Ids don't decide what is a group: unrelated rows of one id, or without an id, all stay. Only rows that go, and
    perhaps a few others, are shuffled.
    """
    spark = docs.sparkSession
    names = [f"c{k}" for k in range(len(docs.columns))]
    rows = numbered(docs.toDF(*names), *names)
    of = rows.select("row", *[F.col(names[docs.columns.index(c)]).alias(c) for c in ("doc_id", "text")])
    found = written(_placed(of, shingle, share).where("n_shingles > 0").select("row", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), "component_row"), "join-result")
    won = found.groupBy("component_row").agg(F.min(F.struct("doc_id", "row")).alias("first")).select("first.row")
    lost = written(found.select("row").join(won, "row", "left_anti"), "join-lost")
    sketch = spark.sparkContext.broadcast(bit_sketch(lost, "row"))

    def part(inside: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = has(sketch.value, ids(batch.column("row"))) == inside
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return run

    alone, maybe = (rows.mapInArrow(part(inside), rows.schema) for inside in (False, True))
    return alone.unionByName(maybe.join(lost, "row", "left_anti")).select(*names).toDF(*docs.columns)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of four-word shingles with a similarity of 0.85 or more. Nulls, ties, repeats and empty tables as in jaccard_components()."""
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (SELECT DISTINCT doc_id, array_to_string(w[k : k + 3], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS k FROM d WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(doc_id, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.doc_id WHERE r.low < e.b)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(low) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""
