"""Sharding by best-fit-decreasing bin packing.

Rows of equal text are one indivisible group. Packing runs in two levels, so that nothing whole passes one task:

1. Each task sorts its groups by size, largest first, and packs them into bundles of a fixed capacity: each enters the open bundle with
   the tightest room that still fits, found in a balanced tree. All bundles but one of a task are half full at least, so there
   are at most 2 * bundles_per_shard * n_shards + tasks of them, however many groups there are.
2. The bundles, that bounded number, are packed the same way into the shards.

With a capacity given, the fewest shards of that capacity are made. With a number of shards given, the smallest capacity that
needs no more of them is found by bisection, which makes the shards near equal. A group that is larger than an even share gets a shard
of its own, and the rest is spread evenly over the others.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import only, table, written


class Rooms:
    """Open bins by their room: a balanced tree of two levels, whose leaves hold up to 2 * FAN entries and split when full."""

    FAN = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.least: list[tuple[int, int]] = [(-1, -1)]

    def add(self, room: int, label: int) -> None:
        k = max(bisect_left(self.least, (room, label)) - 1, 0)
        leaf = self.leaves[k]
        insort(leaf, (room, label))
        if len(leaf) > 2 * self.FAN:
            self.leaves[k : k + 1] = [leaf[: self.FAN], leaf[self.FAN :]]
            self.least.insert(k + 1, leaf[self.FAN])

    def take_tightest(self, size: int) -> tuple[int, int] | None:
        """Removes and returns the least room of size or more."""
        k = max(bisect_left(self.least, (size, -1)) - 1, 0)
        while k < len(self.leaves):
            leaf = self.leaves[k]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and k:
                    del self.leaves[k], self.least[k]
                return found
            k += 1
        return None


def best_fit(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes must fall. An item over the capacity gets a bin of its own."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take_tightest(size)
        if found is None:
            found, bins = (capacity, bins), bins + 1
        out.append(found[1])
        if found[0] > size:
            rooms.add(found[0] - size, found[1])
    return out


def even_bins(sizes: list[int], n: int) -> list[int]:
    """Packs into n bins of near equal load: the smallest capacity for which best_fit() needs at most n. sizes must fall."""
    out, first, left = [], 0, sum(sizes)
    while first < min(len(sizes), n - 1) and sizes[first] * (n - first) > left:
        out.append(first)
        left -= sizes[first]
        first += 1
    rest, bins = sizes[first:], n - first
    if not rest:
        return out
    low, high = max(rest[0], -(-left // bins)), max(rest[0], 2 * left // bins + 1)
    while low < high:
        mid = (low + high) // 2
        if max(best_fit(rest, mid)) < bins:
            high = mid
        else:
            low = mid + 1
    return out + [first + b for b in best_fit(rest, low)]


def _bundles(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, rooms, bins = TaskContext.get().partitionId() << 40, Rooms(), 0
        for batch in batches:
            labels = []
            for size in batch.column("size").to_pylist():
                found = rooms.take_tightest(size)
                if found is None:
                    found, bins = (capacity, bins), bins + 1
                labels.append(base + found[1])
                if found[0] > size:
                    rooms.add(found[0] - size, found[1])
            yield pa.RecordBatch.from_arrays([batch.column("text_key"), batch.column("size"), pa.array(labels, pa.int64())], ["text_key", "size", "bundle"])

    return run


def shard_documents(docs: DataFrame, n_shards: int | None = 16, capacity: int | None = None, bundles_per_shard: int = 64, slot_rows: int = 50_000) -> DataFrame:
    """Puts every row into a shard: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null under this law).

    docs: doc_id, text; other columns are ignored. size is the UTF-8 bytes of the text plus 1. A null text is an empty one; equal texts
    stay together. slot counts the rows of a shard from 0 without a gap, by a spread of doc_id and then doc_id. Repeated rows each get a slot. An empty
    table gives an empty result. Give n_shards for near equal shards, or capacity for the fewest shards of that many bytes.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = written(only(docs, "doc_id", "text").select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.substring(F.sha2(text.cast("binary"), 256), 1, 32)).alias("text_key")), "shard-keys")
    groups = keyed.groupBy("text_key").agg(F.sum("size").alias("size"))
    rows, total = keyed.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    cell = max(1, -(-capacity // bundles_per_shard) if capacity else -(-total // (n_shards * bundles_per_shard)))
    ordered = groups.sortWithinPartitions(F.desc("size"), "text_key")
    bundled = written(ordered.mapInArrow(_bundles(cell), "text_key binary, size long, bundle long"), "shard-bundles")
    loads = bundled.groupBy("bundle").agg(F.sum("size").alias("size")).orderBy(F.desc("size"), "bundle").collect()  # a bounded number, see above
    sizes = [r["size"] for r in loads]
    shards = best_fit(sizes, capacity) if capacity else even_bins(sizes, n_shards)
    placed_bundles = spark.createDataFrame([(r["bundle"], s) for r, s in zip(loads, shards)], "bundle long, shard int")
    placed_groups = bundled.join(F.broadcast(placed_bundles), "bundle").select("text_key", "shard")
    cells = max(64, rows // (slot_rows * (max(shards, default=0) + 1)) + 1)
    placed = keyed.join(placed_groups, "text_key").select("doc_id", "size", "text_crc32", "shard", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(cells)).cast("int").alias("cell"))
    placed = written(placed, "shard-rows")
    counts = placed.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("shard", "cell").orderBy("doc_id", "text_crc32", "size")
    numbered = placed.withColumn("k", F.row_number().over(within) - 1).join(offsets, ["shard", "cell"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("k")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of near equal bytes. Nulls, ties, repeats and empty tables as in shard_documents()."""
    return shard_documents(table(spark, sf_dir, "documents"))
