"""Shuffles of many small integer records as packed columns.

A task sorts its records by bucket and sends one row for each bucket, with each column as bytes; Spark deals the rows out by bucket. So the JVM
moves a few thousand rows instead of many millions, and the receiving task gets numpy arrays back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import partitions_for

#: Buckets for each partition, so that hashing them to partitions stays even.
PER_PARTITION = 4


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each 64-bit key."""
    return ((keys >> np.uint64(33)) % np.uint64(n)).astype(np.int64)


def packed(kind: int, bucket: np.ndarray, columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    """One row for each bucket that has records: kind, bucket, and the columns as bytes (empty for names without a column)."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    bounds = np.append(cut, len(bucket))
    out = [pa.array(np.full(len(cut), kind, np.int32)), pa.array(bucket[cut].astype(np.int32))]
    for k in range(len(names)):
        data = columns[k][order] if k < len(columns) else np.zeros(0, np.uint8)
        at = (bounds * data.itemsize if k < len(columns) else np.zeros(len(bounds))).astype(np.int32)
        out.append(pa.BinaryArray.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(data))]))
    return pa.RecordBatch.from_arrays(out, ["kind", "bucket", *names])


def unpacked(column: pa.Array, kind: type) -> np.ndarray:
    """The records of all rows of a packed column, one after another."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, count=len(column) + 1, offset=4 * column.offset)
    if data is None or at[0] == at[-1]:
        return np.zeros(0, kind)
    return np.frombuffer(data.to_pybytes() if at[0] % np.dtype(kind).itemsize else data, kind, count=(at[-1] - at[0]) // np.dtype(kind).itemsize, offset=int(at[0]))


def by_file(rows: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """For numbered() rows: which of them are of each file, and the smallest of these. Within a file rows differ by less than 2^32."""
    file = rows >> 32
    return [(mine, int(rows[mine].min())) for f in np.unique(file) for mine in [np.flatnonzero(file == f)]]


def buckets_for(rows: DataFrame, each_bytes: int = 3 << 19) -> tuple[int, int]:
    """Partitions and buckets for records whose volume follows the texts of numbered() rows. Of anything else Catalyst may not know the size."""
    n = partitions_for(rows, each_bytes)
    return n, n * PER_PARTITION
