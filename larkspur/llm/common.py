"""What the operators of this subpackage share: tables, scratch storage and Arrow batch helpers."""

from __future__ import annotations

import ctypes
import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one numpy pass handles; a longer document makes a pass of its own.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads one of the input tables, a Parquet file or folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. If that is unset, a local master gets one made here; on a cluster it must be set."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="larkspur-")
        spark.conf.set("spark.checkpoint.dir", shared)
        spark.sparkContext.setCheckpointDir(shared)
    return shared


#: Spark's setting that shuffle files go as soon as the query that wrote them has ended, not when the driver happens to collect garbage.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _released(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(RELEASE, None)
    spark.conf.set(RELEASE, "true")
    try:
        yield
    finally:
        spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)


def written(df: DataFrame, tag: str, rows_per_file: int = 0, release: bool = False) -> DataFrame:
    """Cuts the lineage: writes the rows as Parquet to the shared folder and reads them back. rows_per_file keeps files of very large rows small.
    release gives the disk of the shuffles behind this point back once the rows are written.

    A lost executor costs nothing that is behind this point. Zero partitions or rows give an empty table of the same schema.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    with _released(spark) if release else nullcontext():
        df.write.option("maxRecordsPerFile", rows_per_file).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def planned_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan; for a file scan, the bytes of its files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def partitions_for(df: DataFrame, each_bytes: int) -> int:
    """Shuffle partitions that keep about each_bytes of the estimated input in a task, spark.sql.shuffle.partitions at least."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(100_000, planned_bytes(df) // each_bytes + 1))


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that the text column of each holds about limit bytes; one row at least."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.maximum(np.cumsum(size) - 1, 0) // limit
        cuts = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), n]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins (one more at the end). A null text is empty."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind, count=len(column) + 1, offset=column.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def ids(column: pa.Array, null: int = -(1 << 63)) -> np.ndarray:
    """A long column as numpy; a null id becomes the given value."""
    return pc.fill_null(column.cast(pa.int64()), null).to_numpy(zero_copy_only=False)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and nothing else, so that other columns with clashing names do no harm."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def bit_sketch(rows: DataFrame, column: str, bits: int = 1 << 24) -> np.ndarray:
    """A bitmap of the hashed ids of a column (long, or packed as bytes), of a fixed size: has() is true for each of them, and for few others while it is sparse.

    It only spares shuffling what is surely not wanted; whoever uses it must not rely on it beyond that.
    """
    from .blobs import packed, unpacked
    from .kernels import mix

    segment = 4096  # words of the bitmap that go together

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            values = unpacked(batch.column(0), np.int64) if pa.types.is_binary(batch.column(0).type) else ids(batch.column(0))
            place = np.unique(mix(values.astype(np.uint64)) & np.uint64(bits - 1))
            np.bitwise_or.at(held, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(held)
        yield packed(0, at // segment, [at, held[at]], ["place", "mask"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            np.bitwise_or.at(held, unpacked(batch.column("place"), np.int64), unpacked(batch.column("mask"), np.uint64))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(held[at].view(np.int64))], ["place", "mask"])

    parts = only(rows, column).mapInArrow(run, "kind int, bucket int, place binary, mask binary")
    masks = parts.repartition(max(1, bits // 64 // segment), "bucket").mapInArrow(join, "place long, mask long").toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[masks.column("place").to_numpy()] = masks.column("mask").to_numpy().view(np.uint64)
    return out


def has(sketch: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which ids may be in the sketch."""
    from .kernels import mix

    place = mix(values.astype(np.uint64)) & np.uint64(len(sketch) * 64 - 1)
    return (sketch[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) > 0


def file_number(path: str) -> int:
    """The number of a scanned file, as _file_number() gives it in a plan."""
    return int(hashlib.md5(path.encode()).hexdigest()[:8], 16) >> 1


def _file_number(path: Column) -> Column:
    return F.shiftright(F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long"), 1)


def numbered(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns and row, a number that each row keeps in every later job, however many executors there are and however the scan is split.

    Over a plain scan of Parquet files it is the file (31 bits of a hash of its path, which are checked here to tell the files apart) and the row's place in the file
    (32 bits). Anything else is written first, its numbers too, as its rows could come in another order next time. So the size of the result is always known
    from files.
    """
    plan = docs._jdf.queryExecution().optimizedPlan()
    lines = [line.strip(" :+-") for line in plan.toString().splitlines() if line.strip()]
    plain = plan.deterministic() and all(line.startswith(("Project", "Filter")) or line.startswith("Relation") and line.endswith("parquet") for line in lines)
    if plain:
        # the scan and the listing write schemes with a different number of slashes
        files = [re.sub("^([a-z]+):/+", r"\1:/", f) for f in docs.inputFiles()]
        plain = len({file_number(f) for f in files}) == len(files)
    if plain:
        at = docs.metadataColumn("_metadata")
        row = F.shiftleft(_file_number(F.regexp_replace(at["file_path"], "^([a-z]+):/+", "$1:/")), 32) + at["row_index"]
        return docs.select(row.alias("row"), *[F.col(f"`{n}`") for n in names])
    return written(only(docs, *names).select(F.monotonically_increasing_id().alias("row"), *[F.col(f"`{n}`") for n in names]), "numbered")


def possible(rows: DataFrame, column: str, sketch: np.ndarray) -> DataFrame:
    """The ids of a column that may be in the sketch."""
    shared = rows.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(has(shared.value, ids(batch.column(0)))))

    return only(rows, column).mapInArrow(run, f"{column} long")


#: Batches after which a worker gives memory back while its task goes on.
GIVE_BACK = 16


def lean(run):
    """A batch function that gives memory back as a task goes on and when it ends: workers stay for other tasks, and several share an executor."""

    def give_back() -> None:
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim is not None:
            trim(0)

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for k, batch in enumerate(run(batches), 1):
                yield batch
                del batch
                if k % GIVE_BACK == 0:
                    give_back()
        finally:
            give_back()

    return wrapped
