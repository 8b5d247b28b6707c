"""Suffix-array deduplication: longest-previous-factor arrays find what stands in an earlier document.

A byte goes if a WIDTH-byte string that covers it also starts in a document with a smaller id. In suffix order, the nearest suffix before and
the nearest after of a smaller document share the longest prefix that any smaller document does: the longest previous factor. The byte string at a place
has an earlier copy if its factor is WIDTH bytes or more; as no longer one is asked for, suffixes are ordered and factors measured by the first WIDTH bytes.

Only text that can have a copy is ordered, and the order is made piece by piece:

1. Each place belongs to the smallest hash of the GRAM-byte strings in the WIDTH bytes from it, its anchor. Equal strings have equal anchors, and neighbours
   mostly share theirs. Anchors of whole texts are dealt by hash; those in one document alone have no copy.
2. The texts with shared anchors are cut into the stretches of places of one anchor, and these are dealt by anchor. Each task has all places that could be
   equal, orders them and takes the earlier factors. Stretches that a task holds several times are sent once, with the smallest document; of what repeats itself
   in a stretch, one round is. However many places an anchor has, a bounded number is ordered at once.
3. The places found go back to their documents, whose kept bytes are put together.

Equal texts are found beforehand: all but those of the smallest id are copies as a whole. No string meets all its copies in one task: equal
anchors of a task's documents are merged before each shuffle, and an anchor of very many documents is split into one for each string that it stands for, so that
the different surroundings of a passage aren't ordered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import bucket_of, buckets_for, by_file, packed, unpacked
from .common import bit_sketch, has, ids, lean, numbered, only, possible, slices, table, text_bytes, written
from .kernels import mix, prefix_hash, run_starts, span_hash, window_hash

U = np.uint64
WIDTH, GRAM = 50, 24
SLICE = 1 << 19
FLUSH = 400_000
#: Windows that are ordered at once.
ORDER_AT_ONCE = 100_000
#: Bytes of stretches that are put together at once.
GATHER_AT_ONCE = 1 << 20
#: The size of a piece holds its bytes, and from this bit on how many places follow that repeat those of the bytes from the first on.
AGAIN = 32
#: An anchor of more records than HOT_ROWS, and than one in HOT_SHARE of those of all such anchors, is split by the strings that it stands for.
HOT_ROWS, HOT_SHARE = 1 << 14, 1 << 20
PAIRS = "kind int, bucket int, key binary, row binary"
TEXTS = "bucket int, row long, doc_id long, text string, key binary, rows binary"
PIECES = "kind int, bucket int, anchor binary, row binary, doc_id binary, at binary, size binary, bytes binary"
SPANS = "bucket int, row binary, begin binary, end binary"
CUT = "row long, begin array<long>, end array<long>, kept binary"


def anchors(data: np.ndarray, starts: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the smallest hash of the grams in its window, and whether the window ends within its document."""
    n = len(data) - width + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, bool)
    low, span, wanted = window_hash(prefix_hash(np.append(data, np.uint8(0))), gram), 1, width - gram + 1
    while span < wanted:
        step = min(span, wanted - span)
        low = np.minimum(low[:-step], low[step:])
        span += step
    inside = np.zeros(n, bool)
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        inside[a : max(a, b - width + 1)] = True
    return low[:n], inside


def _stretches(low: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the runs of places inside documents that share an anchor; a run never spans two documents, as the last places of one are outside."""
    new = inside.copy()
    new[1:] &= (low[1:] != low[:-1]) | ~inside[:-1]
    last = inside.copy()
    last[:-1] &= (low[1:] != low[:-1]) | ~inside[1:]
    return np.flatnonzero(new), np.flatnonzero(last) + 1


def _shared_here(key: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of (key, row) records: all of keys with several rows (keys, rows), then one for each key."""
    order = np.lexsort((row, key))
    key, row = key[order], row[order]
    fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (row[1:] != row[:-1])]) if len(key) else np.zeros(0, bool)
    key, row = key[fresh], row[fresh]
    at = run_starts(key)
    many = np.repeat(np.diff(np.append(at, len(key))) > 1, np.diff(np.append(at, len(key))))
    return key[many], row[many], key[at], row[at]


def _emit_anchors(n_buckets: int, width: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows, size = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            many, of, one, first = _shared_here(np.concatenate(keys), np.concatenate(rows))
            yield packed(0, bucket_of(mix(of.astype(U)), n_buckets), [many, of], ["key", "row"])
            cut = run_starts(many)
            beyond = np.diff(np.append(cut, len(many))) - 1
            yield packed(3, bucket_of(many[cut], n_buckets), [many[cut], beyond.astype(np.uint32)], ["key", "row"])
            for of_file, base in by_file(first):
                yield offsets(one[of_file], first[of_file], base)

        def offsets(one: np.ndarray, first: np.ndarray, base: int) -> pa.RecordBatch:
            """Rows of a file as small offsets from a base, which stands first."""
            at = bucket_of(one, n_buckets)
            order = np.argsort(at, kind="stable")
            cut = run_starts(at[order])
            low = np.insert((first - base)[order].astype(np.uint32), np.repeat(cut, 2), 0)
            where = cut + 2 * np.arange(len(cut))
            low[where], low[where + 1] = base & 0xFFFFFFFF, base >> 32
            bounds = np.append(where, len(low)) * 4
            key_bounds = np.append(cut, len(one)) * 8
            blob = lambda b, x: pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(b.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(cut), 1, np.int32)), pa.array(at[order][cut].astype(np.int32)), blob(key_bounds, one[order]), blob(bounds, low)], ["kind", "bucket", "key", "row"])

        for batch in slices(batches, "text", SLICE):
            data, starts = text_bytes(batch.column("text"))
            low, inside = anchors(data, starts, width, gram)
            begin, _ = _stretches(low, inside)
            keys.append(low[begin])
            rows.append(ids(batch.column("row"))[np.searchsorted(starts, begin, "right") - 1])
            size += len(begin)
            if size > FLUSH:
                yield from flush()
                keys, rows, size = [], [], 0
        if keys:
            yield from flush()

    return run


def _counts(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts by key."""
    key, at = np.unique(np.concatenate([np.zeros(0, U), *keys]), return_inverse=True)
    return key, np.bincount(at, np.concatenate([np.zeros(0), *counts]), len(key)).astype(np.int64)


def _emit_shared(n_buckets: int, hot_rows: int):
    """Anchors of several rows, by row. The rows of one task's records came together already; those that it found shared pass through.

    One record of each anchor and batch comes here by anchor (kind 1), and how many more rows the batch has (kind 3). So anchors are counted here too: kind 2 of the
    result holds those of more than hot_rows records, with how many there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = [np.zeros(0, U)], [np.zeros(0, np.int64)]
        beyond = [(np.zeros(0, U), np.zeros(0, np.int64))]
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            through = batch.filter(pa.array(kind == 0))
            if through.num_rows:
                yield through
            more = batch.filter(pa.array(kind == 3))
            if more.num_rows:
                beyond.append(_counts([unpacked(more.column("key"), U)], [unpacked(more.column("row"), np.uint32)]))
                if len(beyond) > 16:
                    beyond = [_counts(*map(list, zip(*beyond)))]
            for key, row in zip(batch.filter(pa.array(kind == 1)).column("key"), batch.filter(pa.array(kind == 1)).column("row")):
                keys.append(np.frombuffer(key.as_buffer(), U).copy())
                at = np.frombuffer(row.as_buffer(), np.uint32)
                rows.append(at[2:].astype(np.int64) + int(at[0]) + (int(at[1]) << 32))
        many, of, _, _ = _shared_here(np.concatenate(keys), np.concatenate(rows))
        yield packed(0, bucket_of(mix(of.astype(U)), n_buckets), [many, of], ["key", "row"])
        key, n = _counts([*keys, *(b[0] for b in beyond)], [*(np.ones(len(k)) for k in keys), *(b[1] for b in beyond)])
        hot = n > hot_rows
        yield packed(2, np.zeros(int(hot.sum()), np.int64), [key[hot], n[hot]], ["key", "row"])

    return run


def hot_anchors(shared: DataFrame) -> np.ndarray:
    """The anchors to be split: those of kind 2 that hold more than a millionth of all of its records, so that there are at most a million of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(unpacked(batch.column(c), np.int64)) for c in ("key", "row")], ["key", "n"])

    found = shared.where("kind = 2").mapInArrow(run, "key long, n long")
    total = found.agg(F.sum("n")).first()[0]
    if not total:
        return np.zeros(0, U)
    hot = found.where(F.col("n") > total // HOT_SHARE).select("key").toArrow()  # HOT_SHARE of them at most
    return np.sort(hot.column("key").to_numpy().view(U))


def split_hot(low: np.ndarray, data: np.ndarray, hot: np.ndarray, width: int) -> np.ndarray:
    """The anchors, where those that are hot become one anchor for each string of width bytes: equal strings still share one."""
    if not len(hot):
        return low
    at = np.flatnonzero(hot[np.minimum(np.searchsorted(hot, low), len(hot) - 1)] == low)
    out = low.copy()
    out[at] = mix(low[at] + window_hash(prefix_hash(data), width)[at])
    return out


def _wanted(sketch: np.ndarray, n_buckets: int):
    """The texts of rows that may be in the sketch, with their bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = ids(batch.column("row"))
            keep = has(sketch, row)
            if keep.any():
                bucket = pa.array(bucket_of(mix(row[keep].astype(U)), n_buckets).astype(np.int32))
                part = batch.filter(pa.array(keep))
                none = pa.nulls(part.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([bucket, part.column("row"), part.column("doc_id"), part.column("text"), none, none], [c.split()[0] for c in TEXTS.split(", ")])

    return run


def _split(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.RecordBatch], list[pa.RecordBatch]]:
    """The texts and the packed records of a partition."""
    texts, records = [], []
    for batch in batches:
        is_text = np.asarray(batch.column("row").is_valid())
        for flags, to in ((is_text, texts), (~is_text, records)):
            if flags.any():
                to.append(batch.filter(pa.array(flags)))
    return texts, records


def _pair_key(key: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(key + mix(row.astype(U)))


def rounds(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of places (begin, end) with what repeats itself in them set apart: which stretch, begin, end, and how many of the first places have each string once.

    In a long one it is looked for around the middle, then before and after what was found. Short ones, and what doesn't repeat itself, have all their places once.
    """
    long = np.flatnonzero(end - begin > width)
    left, done = list(zip(long.tolist(), begin[long].tolist(), end[long].tolist())), []
    while left:
        k, a, b = left.pop()
        raw, mid, once = data[a : b + width - 1], (b - a) // 2, b - a
        if once > width:
            text = raw.tobytes()
            step = text.find(text[mid : mid + width], mid + 1) - mid
            if step > 0:
                differ = np.flatnonzero(raw[step:] != raw[:-step])
                i = int(np.searchsorted(differ, mid))
                x, y = int(differ[i - 1]) + 1 if i else 0, (int(differ[i]) if i < len(differ) else len(raw) - step) + step - width + 1
                if y - x >= 2 * step:
                    left += [(k, c, d) for c, d in ((a, a + x), (a + y, b)) if c < d]
                    a, b, once = a + x, a + y, step
        done.append((k, a, b, once))
    short = np.flatnonzero(end - begin <= width)
    found = np.array(done, np.int64).reshape(-1, 4)
    return tuple(np.concatenate(c) for c in zip((short, begin[short], end[short], (end - begin)[short]), found.T))


def _portions(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Groups in a row (by where they end) in portions of at most that many elements, whole groups each; a larger group is a portion of its own."""
    a = 0
    while a < len(ends):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, "right")))
        yield a, b
        a = b


def _gathered(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the stretches one after another, about GATHER_AT_ONCE at once, as the index of a byte is far larger than the byte."""
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(total[-1], np.uint8)
    for a, b in _portions(total[1:], GATHER_AT_ONCE):
        out[total[a] : total[b]] = data[np.repeat(begin[a:b] - total[a:b], size[a:b]) + np.arange(total[a], total[b])]
    return out


def _emit_pieces(n_buckets: int, width: int, gram: int, hot: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, records = _split(batches)
        shared = np.unique(np.concatenate([np.zeros(0, U), *(_pair_key(unpacked(r.column("key"), U), unpacked(r.column("rows"), np.int64)) for r in records)]))
        if not len(shared):
            return
        for batch in slices(iter(texts), "text", 2 << 20):
            data, starts = text_bytes(batch.column("text"))
            whole, inside = anchors(data, starts, width, gram)
            low = split_hot(whole, data, hot.value, width)
            begin, end = _stretches(low, inside)
            of = np.searchsorted(starts, begin, "right") - 1
            row, doc_id = ids(batch.column("row"))[of], ids(batch.column("doc_id"))[of]
            pair = _pair_key(whole[begin], row)
            found = np.minimum(np.searchsorted(shared, pair), len(shared) - 1)
            keep = shared[found] == pair
            begin, end, of, row, doc_id = begin[keep], end[keep], of[keep], row[keep], doc_id[keep]
            if not len(begin):
                continue
            of_stretch, begin, end, once = rounds(data, begin, end, width)
            of, row, doc_id = of[of_stretch], row[of_stretch], doc_id[of_stretch]
            size, again = once + width - 1, end - begin - once
            # stretches of equal bytes: the smallest document's goes on, in the others all places have an earlier copy
            text = span_hash(prefix_hash(data), begin, begin + size) + mix(size.astype(U))
            order = np.lexsort((doc_id, text))
            first = run_starts(text[order])
            leader = np.repeat(order[first], np.diff(np.append(first, len(order))))
            copy = doc_id[order] > doc_id[leader]
            lost = order[copy]
            at = begin - starts[:-1][of]
            names = ["anchor", "row", "doc_id", "at", "size", "bytes"]
            yield packed(0, bucket_of(mix(row[lost].astype(U)), n_buckets), [np.zeros(len(lost), U), row[lost], doc_id[lost], at[lost], (end - begin)[lost]], names)
            sent = np.sort(order[~copy])
            bucket = bucket_of(low[begin[sent]], n_buckets)
            sent, bucket = sent[np.argsort(bucket, kind="stable")], np.sort(bucket, kind="stable")
            out = packed(1, bucket, [low[begin[sent]], row[sent], doc_id[sent], at[sent], size[sent] | again[sent] << AGAIN], names)
            total = np.concatenate([[0], np.cumsum(size[sent])])
            raw = _gathered(data, begin[sent], size[sent])
            cut = np.append(run_starts(bucket), len(bucket))
            column = pa.BinaryArray.from_buffers(pa.binary(), len(cut) - 1, [None, pa.py_buffer(total[cut].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])
            yield pa.RecordBatch.from_arrays([*out.columns[:-1], column], out.schema.names)

    return run


def previous_smaller(x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest one before with a smaller value (-1: none), and the least of h from the place after that one to the place itself.

    Places jump together: what lies between a place and where it looks is not smaller, so it may go on to where that one looks.
    """
    at, low = np.arange(len(x)) - 1, h.copy()
    left = np.flatnonzero(at >= 0)
    while True:
        left = left[x[at[left]] >= x[left]]
        if not len(left):
            return at, low
        low[left] = np.minimum(low[left], low[at[left]])
        at[left] = at[at[left]]
        left = left[at[left] >= 0]


def longest_previous_factors(windows: np.ndarray, doc_id: np.ndarray) -> np.ndarray:
    """How long a prefix of each suffix also begins a suffix of a smaller document, up to the width that is looked at.

    The suffixes (rows of their first bytes) are put in suffix order, with the documents of equal ones rising. Of all suffixes of smaller documents, the nearest before
    and the nearest after (the previous and next smaller values of the array of documents) share the longest prefixes with it; these are the least
    common prefixes of neighbours in between.
    """
    n, width = windows.shape
    if not n:
        return np.zeros(0, np.int64)
    keys = np.ascontiguousarray(windows).view(np.dtype((np.void, width))).ravel()
    by_doc = np.argsort(doc_id, kind="stable")
    order = by_doc[np.argsort(keys[by_doc], kind="stable")]
    differ = windows[order[1:]] != windows[order[:-1]]
    common = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), width)])  # with the suffix before
    before, low = previous_smaller(doc_id[order], common)
    after, high = previous_smaller(doc_id[order][::-1], np.append(common[1:], 0)[::-1])
    out = np.empty(n, np.int64)
    out[order] = np.maximum(np.where(before >= 0, low, 0), np.where(after >= 0, high, 0)[::-1])
    return out


def copied(data: np.ndarray, start: np.ndarray, doc_id: np.ndarray, width: int, known: int = 0) -> np.ndarray:
    """Which of the places have a longest previous factor of the whole width.

    ORDER_AT_ONCE suffixes are ordered at once. More than these are dealt by their next 8 bytes into ranges of the suffix order first: suffixes of two ranges
    differ in these bytes, so no factor of the width leads from one to another. A range that is still too large goes on with the bytes after them, and one that is a single string
    (all its bytes are known to be equal) needs no order.
    """
    if len(start) <= ORDER_AT_ONCE:
        return longest_previous_factors(np.lib.stride_tricks.sliding_window_view(data, width)[start], doc_id) >= width
    if known >= width:
        return doc_id > doc_id.min()
    upto = min(known + 8, width)
    key = np.zeros(len(start), U)
    for k in range(known, upto):
        key <<= U(8)
        key |= data[start + k]
    order = np.argsort(key, kind="stable")
    key = key[order]
    cut = np.append(run_starts(key), len(key))
    out = np.empty(len(start), bool)
    for a, b in _portions(cut[1:], ORDER_AT_ONCE):
        mine = order[cut[a] : cut[b]]
        out[mine] = copied(data, start[mine], doc_id[mine], width, upto if b == a + 1 else known)
    return out


def _factors(n_buckets: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, got = ["row", "begin", "end"], []

        def spans(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.RecordBatch:
            out = packed(0, bucket_of(mix(row.astype(U)), n_buckets), [row, begin, end], names)
            return pa.RecordBatch.from_arrays(out.columns[1:], out.schema.names[1:])

        for batch in batches:
            kind = batch.column("kind").to_numpy()
            for k in (0, 1):
                part = batch.filter(pa.array(kind == k))
                if not part.num_rows:
                    continue
                x = [unpacked(part.column(c), t).copy() for c, t in (("anchor", U), ("row", np.int64), ("doc_id", np.int64), ("at", np.int64), ("size", np.int64))]
                if k:
                    got.append((*x, unpacked(part.column("bytes"), np.uint8).copy()))
                else:
                    yield spans(x[1], x[3], x[3] + x[4] + width - 1)
        if not got:
            return
        anchor, row, doc_id, at, size, data = (np.concatenate(c) for c in zip(*got))
        again, size = size >> AGAIN, size & ((1 << AGAIN) - 1)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        order = np.argsort(anchor, kind="stable")
        places = size - width + 1
        group = run_starts(anchor[order])
        lone = np.diff(np.append(group, len(order))) == 1
        order = order[np.repeat(~lone, np.diff(np.append(group, len(order))))]
        bounds = np.append(run_starts(anchor[order]), len(order))
        for a, b in _portions(np.cumsum(places[order])[bounds[1:] - 1], ORDER_AT_ONCE):  # whole anchors
            mine = order[bounds[a] : bounds[b]]
            n = places[mine]
            start = np.repeat(first[mine] - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
            gone = copied(data, start, np.repeat(doc_id[mine], n), width)
            piece = np.repeat(np.arange(len(mine)), n)
            # runs of places that go, within each piece
            on = gone.copy()
            on[1:] &= ~gone[:-1] | (piece[1:] != piece[:-1])
            off = gone.copy()
            off[:-1] &= ~gone[1:] | (piece[1:] != piece[:-1])
            x, y = np.flatnonzero(on), np.flatnonzero(off)
            where = mine[piece[x]]
            begin = at[where] + start[x] - first[where]
            whole = y - x + 1 == places[where]
            yield spans(row[where], begin, begin + (y - x) + width + np.where(whole, again[where], 0))
            # runs that are a part of a round come again in each round after it
            times = np.where(whole, 0, -(-again[where] // places[where]))
            each = np.repeat(np.arange(len(x)), times)
            where = where[each]
            ahead = (np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times) + 1) * places[where]
            last = at[where] + places[where] + again[where]
            inside = begin[each] + ahead < last
            each, where, ahead, last = each[inside], where[inside], ahead[inside], last[inside]
            yield spans(row[where], begin[each] + ahead, np.minimum(begin[each] + ahead + (y - x)[each] + 1, last) + width - 1)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    texts, records = _split(batches)
    if not records:
        return
    row, begin, end = (np.concatenate([unpacked(r.column(c), np.int64) for r in records]) for c in ("rows", "begin", "end"))
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order], end[order]
    for batch in texts:
        out = []
        for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
            a, b = np.searchsorted(row, [r, r + 1])
            if a == b:
                continue
            reach = np.maximum.accumulate(end[a:b])
            new = np.flatnonzero(np.concatenate([[True], begin[a + 1 : b] > reach[:-1]]))
            x, y = begin[a:b][new], reach[np.append(new[1:], b - a) - 1]
            raw = text.encode()
            kept = b"".join(raw[p:q] for p, q in zip([0, *y.tolist()], [*x.tolist(), len(raw)]))
            out.append({"row": r, "begin": x.tolist(), "end": y.tolist(), "kept": kept})
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("row", pa.int64()), ("begin", pa.list_(pa.int64())), ("end", pa.list_(pa.int64())), ("kept", pa.binary())]))


def remove_repeats(docs: DataFrame, width: int = WIDTH, gram: int = GRAM, hot_rows: int = HOT_ROWS) -> DataFrame:
    """What each row loses: doc_id, n_bytes, text_sha256 (of the whole text), begin and end (byte spans that go), kept (the bytes that stay; null: all).

    docs: doc_id, text; other columns are ignored. Each byte goes that a width-byte string covers which also starts in a document with a smaller doc_id;
    all are judged on the input. A null text is empty; a null id is smaller than all others. Rows of equal id don't take from each other. Texts
    shorter than width lose nothing. An empty table gives an empty result. Anchors that stand in more than hot_rows rows (and a millionth of all such rows) are split; the
    result is the same.
    """
    rows = numbered(docs, "doc_id", "text")
    parts, n_buckets = buckets_for(rows)
    source = rows.select("row", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    raw = F.col("text").cast("binary")
    keyed = written(source.select("row", "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("text_sha256")), "dedup-keys")
    smallest = keyed.groupBy("text_sha256").agg(F.min("doc_id").alias("first_id"))
    keyed = written(keyed.join(smallest, "text_sha256"), "dedup-classes")
    shared = source.select("row", "text").mapInArrow(lean(_emit_anchors(n_buckets, width, gram)), PAIRS).repartition(parts, "bucket").mapInArrow(lean(_emit_shared(n_buckets, hot_rows)), PAIRS)
    shared = written(shared, "dedup-anchors")
    hot = docs.sparkSession.sparkContext.broadcast(hot_anchors(shared))
    shared = shared.where("kind = 0")
    owners = possible(keyed.where("doc_id = first_id"), "row", bit_sketch(shared, "row"))
    first = docs.sparkSession.sparkContext.broadcast(bit_sketch(owners, "row"))
    texts = source.mapInArrow(lambda batches: _wanted(first.value, n_buckets)(batches), TEXTS)
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("row", "long"), ("doc_id", "long"), ("text", "string"))]
    pieces = texts.unionByName(shared.select("bucket", *empty, "key", F.col("row").alias("rows"))).repartition(parts, "bucket").mapInArrow(lean(_emit_pieces(n_buckets, width, gram, hot)), PIECES)
    spans = written(pieces.repartition(parts, "bucket").mapInArrow(lean(_factors(n_buckets, width)), SPANS), "dedup-spans")
    second = docs.sparkSession.sparkContext.broadcast(bit_sketch(spans, "row"))
    texts = source.mapInArrow(lambda batches: _wanted(second.value, n_buckets)(batches), TEXTS).select("bucket", "row", "text", F.lit(None).cast("binary").alias("rows"), F.lit(None).cast("binary").alias("begin"), F.lit(None).cast("binary").alias("end"))
    packed_spans = spans.select("bucket", F.lit(None).cast("long").alias("row"), F.lit(None).cast("string").alias("text"), F.col("row").alias("rows"), "begin", "end")
    cut = texts.unionByName(packed_spans).repartition(parts, "bucket").mapInArrow(lean(_cut), CUT)
    copy = (F.col("doc_id") > F.col("first_id")) & (F.col("n_bytes") >= width)
    none = F.array().cast("array<long>")
    real_id = F.when(F.col("doc_id") != -(1 << 63), F.col("doc_id"))
    return keyed.join(cut, "row", "left").select(
        real_id.alias("doc_id"), "n_bytes", "text_sha256",
        F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("begin", none)).alias("begin"),
        F.when(copy, F.array("n_bytes")).otherwise(F.coalesce("end", none)).alias("end"),
        F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept"),
    )


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document loses to 50-byte strings of documents with smaller ids. Nulls, ties, repeats and empty tables as in remove_repeats()."""
    found = remove_repeats(table(spark, sf_dir, "documents"))
    n_removed = F.aggregate(F.zip_with("begin", "end", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    return found.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("begin").cast("long").alias("n_spans"), F.when(F.col("kept").isNull(), F.col("text_sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents
), w AS (SELECT doc_id, k, array_slice(b, k, k + 49) AS s FROM (SELECT doc_id, b, unnest(range(1, n - 48)) AS k FROM d WHERE n >= 50)
), g AS (SELECT doc_id, k FROM w JOIN (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s) USING (s) WHERE doc_id > first_id
), i AS (SELECT doc_id, k, sum(fresh) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM (SELECT doc_id, k, CASE WHEN k > lag(k) OVER (PARTITION BY doc_id ORDER BY k) + 50 THEN 1 ELSE 0 END AS fresh FROM g)
), r AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS e FROM i GROUP BY doc_id, island
), edges AS (SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a AS y FROM r UNION ALL SELECT doc_id, max(e), max(n) + 1 FROM r JOIN d USING (doc_id) GROUP BY doc_id
), kept AS (SELECT doc_id, sha256(unhex(string_agg(CASE WHEN y > x THEN hex(array_slice(b, x, y - 1)) ELSE '' END, '' ORDER BY x))) AS digest FROM edges JOIN d USING (doc_id) GROUP BY doc_id
), sums AS (SELECT doc_id, sum(e - a)::BIGINT AS n_removed, count(*) AS n_spans FROM r GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, coalesce(digest, sha256(b)) AS kept_sha256 FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
