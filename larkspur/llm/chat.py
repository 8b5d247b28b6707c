r"""Chat formatting by columnar byte assembly.

A turn is written as `<|turn|>` role `\n` text `<|end|>\n`. Inside roles and texts a backslash becomes two and `<|` becomes `<\|`, so no text can hold a
control string; in roles a line break becomes `\n` as two characters. Both are reversible.

The rows of a conversation come to one task in the order of their turns. For each Arrow batch the lengths of all segments give cumulative
offsets, these give scatter indices, and headers and contents are copied into one preallocated buffer, which becomes the Arrow string
column as it is. A conversation that is longer than a batch is returned in parts, so memory is bounded by the batch and not by the conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids, only, slices, table, text_bytes

HEAD, MIDDLE, TAIL = b"<|turn|>", b"\n", b"<|end|>\n"
PART_BYTES = 4 << 20
PARTS = "conv_id long, part int, n_turns long, formatted string, loss array<struct<begin: long, end: long>>"
TURN = re.compile(r"<\|turn\|>(.*?)\n(.*?)<\|end\|>\n", re.S)
ESCAPED = re.compile(r"\\(.)", re.S)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    column = pc.replace_substring(pc.replace_substring(pc.fill_null(column, ""), "\\", "\\\\"), "<|", "<\\|")
    return pc.replace_substring(column, "\n", "\\n") if role else column


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def _copy(out: np.ndarray, at: np.ndarray, data: np.ndarray, starts: np.ndarray) -> None:
    """Scatters the spans of data between starts to the places at."""
    sizes = np.diff(starts)
    out[np.repeat(at - starts[:-1], sizes) + np.arange(len(data))] = data


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all turns, where each turn begins (one more at the end), and where each escaped text begins and ends."""
    roles, role_at = text_bytes(escape(role, role=True))
    texts, text_at = text_bytes(escape(text))
    n = len(role)
    sizes = np.empty((n, 5), np.int64)
    sizes[:, 0], sizes[:, 1], sizes[:, 2], sizes[:, 3], sizes[:, 4] = len(HEAD), np.diff(role_at), len(MIDDLE), np.diff(text_at), len(TAIL)
    offsets = np.zeros(n * 5 + 1, np.int64)
    np.cumsum(sizes.ravel(), out=offsets[1:])
    out = np.empty(offsets[-1], np.uint8)
    begin = offsets[:-1].reshape(n, 5)
    for k, fixed in ((0, HEAD), (2, MIDDLE), (4, TAIL)):
        out[begin[:, k, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    _copy(out, begin[:, 1], roles, role_at)
    _copy(out, begin[:, 3], texts, text_at)
    return out, offsets[::5], np.stack([begin[:, 3], begin[:, 4]], 1)


def _strings(at: np.ndarray, data: np.ndarray) -> pa.Array:
    """Strings between the places; those of 2 GB and more together have wide offsets."""
    if at[-1] < 1 << 31:
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(data))
    return pa.LargeStringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())  # raises if one alone is too long


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last, part = None, 0
    for batch in slices(batches, "text", PART_BYTES):
        conv, null = ids(batch.column("conv_id")), np.asarray(pc.is_null(batch.column("conv_id")))
        out, turn_at, text_at = assemble(batch.column("role"), batch.column("text"))
        first = np.flatnonzero(np.concatenate([[True], (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])]))
        conv_at = turn_at[np.append(first, len(conv))]
        chars = np.concatenate([[0], np.cumsum((out & 0xC0) != 0x80)])
        trained = np.flatnonzero(np.asarray(pc.fill_null(pc.equal(batch.column("role"), "assistant"), False)))
        of = np.searchsorted(first, trained, "right") - 1
        spans = chars[text_at[trained]] - chars[conv_at[of]][:, None]
        loss = pa.ListArray.from_arrays(np.searchsorted(of, np.arange(len(first) + 1)).astype(np.int32), pa.StructArray.from_arrays([spans[:, 0], spans[:, 1]], ["begin", "end"]))
        parts = np.zeros(len(first), np.int32)
        same = last is not None and last == (conv[0], null[0])
        parts[0] = part + 1 if same else 0
        last, part = (conv[-1], null[-1]), int(parts[-1])
        text = _strings(conv_at, out)
        turns = np.diff(np.append(first, len(conv)))
        yield pa.RecordBatch.from_arrays([pa.array(conv[first], mask=null[first]), pa.array(parts), pa.array(turns), text, loss], ["conv_id", "part", "n_turns", "formatted", "loss"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, or more parts of it in order within a task: conv_id, part, n_turns, formatted, loss.

    conversations: conv_id, turn, role, text; other columns are ignored. Turns are ordered by turn (null first), then role and text, so repeated rows
    stand side by side. Null roles and texts are empty; rows of a null conv_id are one conversation. loss has the spans, in code points of formatted, of the
    escaped texts of assistant turns. An empty table gives an empty result.
    """
    rows = only(conversations, "conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format, PARTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
    state, done = None, []

    def close() -> None:
        conv, turns, whole, chars, loss, size = state
        done.append({"conv_id": conv, "n_turns": turns, "turns_sha256": whole.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": size})

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "part", "formatted", "loss"))):
            conv, part, text, spans = row
            if not part:
                if state:
                    close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, body in TURN.findall(text):
                state[1] += 1
                state[2].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
            for span in spans:
                learned = unescape(text[span["begin"] : span["end"]])
                state[3] += len(learned)
                state[4].update(learned.encode())
            state[5] += len(text)
        if done:
            yield pa.RecordBatch.from_pylist(done, schema)
            done.clear()
    if state:
        close()
        yield pa.RecordBatch.from_pylist(done, schema)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from the output of format_chats() alone. It must follow it without a shuffle.

    A null conv_id is a conversation like others; without rows there are none. Rows of a conversation that repeat are turns of their own, as in format_chats().
    """
    return formatted.mapInArrow(_read_back, DIGESTS)


#: The text of both turns of conversation -7.
HOSTILE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of one with hostile texts, read back from their formatted text. Nulls, ties, repeats and empty tables as in format_chats()."""
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(HOSTILE).alias("text"))
    return read_back(format_chats(only(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 17 AS n FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
