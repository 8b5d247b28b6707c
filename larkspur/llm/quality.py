"""Quality rules: line labelling by a linear-chain conditional random field.

Each line of a text has features of its bytes and words. A chain with the two labels content and boilerplate is fitted on a bounded sample of
documents of known quality. The labels of their lines are hidden: a good document is only known to be content for the most part, a bad one to be
boilerplate for the most part, so lines of junk in good documents, and of prose in bad ones, are found by what they look like. Viterbi decoding labels the lines of every document; the
share of its characters in content lines decides whether it is kept. Counts of words, symbols and repetition are the base rules beside.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, only, slices, table, text_bytes
from .kernels import NOT_SPACE, mix, ngrams, prefix_hash, repeated, seen_before, span_hash, words

U = np.uint64
SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
FEATURES = ("bias", "symbols", "bars", "bangs", "capitals", "closed", "digits", "long_words", "stutter", "repeated_line", "short", "blank")
MEASURES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


class Lines:
    """Words, lines and their features for the texts of a batch."""

    def __init__(self, column: pa.Array) -> None:
        self.data, self.starts = data, starts = text_bytes(column)
        self.n = n = len(column)
        self.hashes = prefix_hash(data)
        self.a, self.b, self.doc = words(data, starts, NOT_SPACE)
        self.word = span_hash(self.hashes, self.a, self.b)
        breaks = np.flatnonzero(data == 10)
        of = np.searchsorted(starts, breaks, "right") - 1
        # a document has one line more than breaks, the first at its start
        self.begin = np.sort(np.concatenate([starts[:-1], breaks + 1]), kind="stable")
        self.line_doc = np.sort(np.concatenate([np.arange(n), of]))
        self.end = np.concatenate([self.begin[1:], [len(data)]]) - 1
        last = np.flatnonzero(np.append(self.line_doc[1:] != self.line_doc[:-1], True))
        self.end[last] = starts[1:]
        self.first_word = np.searchsorted(self.a, self.begin)
        self.n_line_words = np.searchsorted(self.a, self.end) - self.first_word
        self.chars = self._count((data & 0xC0) != 0x80)

    def _count(self, flags: np.ndarray) -> np.ndarray:
        """Flags in each line."""
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return sums[self.end] - sums[self.begin]

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return np.diff(sums[self.starts])

    def duplicates(self) -> np.ndarray:
        """Lines with a word that equal an earlier line of their document."""
        key = span_hash(self.hashes, self.begin, self.end) + mix(self.line_doc.astype(U) + U(1))
        return seen_before(key) & (self.n_line_words > 0)

    def repeat_words(self) -> np.ndarray:
        """Words in each document that lie in a 3-word window found twice or more in it."""
        flags = np.zeros(len(self.word), bool)
        if len(self.word) >= 3:
            at = np.flatnonzero(self.doc[2:] == self.doc[:-2])
            key = ngrams(self.word, 3)[at] + mix(self.doc[at].astype(U) + U(1))
            hit = at[repeated(key)]
            for k in range(3):
                flags[hit + k] = True
        return np.bincount(self.doc[flags], minlength=self.n)

    def features(self) -> np.ndarray:
        """A row of FEATURES for each line, between 0 and 1."""
        data, n = self.data, np.maximum(self.n_line_words, 1)
        letters = np.maximum(self._count(((data | 32) >= 97) & ((data | 32) <= 122)), 1)
        same = np.zeros(len(self.word) + 1, np.int64)
        if len(self.word):
            equal = np.concatenate([[False], (self.word[1:] == self.word[:-1]) & (self.doc[1:] == self.doc[:-1])])
            same[1:] = np.cumsum(equal)
        last = np.where(self.end > self.begin, self.end - 1, 0)
        final = data[last] if len(data) else np.zeros(len(last), np.uint8)
        out = np.empty((len(self.begin), len(FEATURES)))
        out[:, 0] = 1.0
        out[:, 1] = np.minimum(self._count(SYMBOLS[data]) / n, 1.0)
        out[:, 2] = np.minimum(self._count(data == 124) / n * 2, 1.0)
        out[:, 3] = np.minimum(self._count(data == 33) / n, 1.0)
        out[:, 4] = self._count((data >= 65) & (data <= 90)) / letters
        out[:, 5] = np.isin(final, np.frombuffer(b".!?", np.uint8)) & (self.end > self.begin)
        out[:, 6] = np.minimum(self._count((data >= 48) & (data <= 57)) / np.maximum(self.chars, 1) * 4, 1.0)
        out[:, 7] = np.minimum(self.chars / n / 20, 1.0)
        out[:, 8] = (same[self.first_word + self.n_line_words] - same[self.first_word]) / n
        out[:, 9] = self.duplicates()
        out[:, 10] = self.n_line_words < 4
        out[:, 11] = self.n_line_words == 0
        return out


class Chain:
    """A linear chain of two labels: 1 is content. The unary score of content is features @ weights; moves[i, j] scores j after i."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray) -> None:
        self.weights, self.moves = weights, moves

    @staticmethod
    def _grid(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Documents by falling size, how many are still there at each step, and where each document's lines begin."""
        order = np.argsort(-sizes, kind="stable")
        active = np.searchsorted(-sizes[order], -np.arange(sizes.max(initial=0)), "left") if len(sizes) else np.zeros(0, np.int64)
        return order, active, np.concatenate([[0], np.cumsum(sizes)])[:-1]

    def decode(self, features: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Viterbi: the most likely labels of the lines of all documents, which stand one after another."""
        score, m = features @ self.weights, self.moves
        order, active, first = self._grid(sizes)
        back = np.zeros((len(score), 2), np.int8)
        best = np.zeros((len(sizes), 2))
        for t, k in enumerate(active):
            at = first[order[:k]] + t
            if t:
                from0, from1 = best[:k, :1] + m[0], best[:k, 1:] + m[1]
                back[at] = from1 > from0
                best[:k] = np.maximum(from0, from1)
            best[:k, 1] += score[at]
        labels = np.zeros(len(score), np.int8)
        state = np.zeros(len(sizes), np.int8)
        for t in range(len(active) - 1, -1, -1):
            k = active[t]
            done = active[t + 1] if t + 1 < len(active) else 0
            state[done:k] = best[done:k, 1] > best[done:k, 0]
            at = first[order[:k]] + t
            labels[at] = state[:k]
            state[:k] = back[at, state[:k]]
        return labels

    def _expected(self, features: np.ndarray, sizes: np.ndarray, tilt: np.ndarray | float = 0.0) -> tuple[np.ndarray, np.ndarray]:
        """Forward-backward: the chance of content of each line, and the expected count of each move. tilt is added to each line's score of content."""
        score, m = features @ self.weights + tilt, self.moves
        order, active, first = self._grid(sizes)
        forward, backward = np.zeros((len(score), 2)), np.zeros((len(score), 2))
        for t, k in enumerate(active):
            at = first[order[:k]] + t
            if t:
                forward[at] = np.logaddexp(forward[at - 1][:, :1] + m[0], forward[at - 1][:, 1:] + m[1])
            forward[at, 1] += score[at]
        moves = np.zeros((2, 2))
        for t in range(len(active) - 2, -1, -1):
            at = first[order[: active[t + 1]]] + t
            after = backward[at + 1] + np.stack([np.zeros(len(at)), score[at + 1]], 1)
            backward[at] = np.logaddexp(after[:, :1] + m[:, 0], after[:, 1:] + m[:, 1])
            total = np.logaddexp(*(forward[at] + backward[at]).T)
            pair = forward[at][:, :, None] + m[None] + after[:, None, :] - total[:, None, None]
            moves += np.exp(pair).sum(0)
        both = forward + backward
        return 1 / (1 + np.exp(np.clip(both[:, 0] - both[:, 1], -60, 60))), moves

    def known_shares(self, features: np.ndarray, sizes: np.ndarray, good: np.ndarray, chars: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
        """The expectation step: what _expected() gives when each good document is content for at least `share` of its characters, and each bad one is boilerplate for as much.

        Of all distributions over line labels that keep to this the one nearest to the chain's: each document that doesn't keep to it gets one tilt for all its lines, the least that does, by bisection.
        """
        doc, weight = np.repeat(np.arange(len(sizes)), sizes), np.maximum(chars, 1).astype(float)
        whole = np.maximum(np.bincount(doc, weight, len(sizes)), 1)

        def expected(tilt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            chance, moves = self._expected(features, sizes, tilt[doc])
            content = np.bincount(doc, weight * chance, len(sizes)) / whole
            return chance, moves, np.where(good, content, 1 - content) >= share

        low, sign = np.zeros(len(sizes)), np.where(good, 1.0, -1.0)
        chance, moves, kept = expected(low)
        if kept.all():
            return chance, moves
        high = np.where(kept, 0.0, 16.0)
        for _ in range(8):
            middle = (low + high) / 2
            met = expected(sign * middle)[2]
            low, high = np.where(met, low, middle), np.where(met, middle, high)
        return expected(sign * high)[:2]

    @classmethod
    def fit(cls, features: np.ndarray, sizes: np.ndarray, good: np.ndarray, chars: np.ndarray, share: float = 0.75, rounds: int = 6, steps: int = 40, rate: float = 0.15, ridge: float = 1.0) -> Chain:
        """Fits to documents whose quality is known and whose line labels are not: expectation over the labels under known_shares(), then Adam steps up the ridged likelihood of these expectations, in turn.

        The first round takes lines as they are in such documents on the whole, without moves. The same input gives the same chain.
        """
        flat, n, width = np.zeros(features.shape[1] + 4), max(len(features), 1), features.shape[1]
        chance, moves = np.where(np.repeat(good, sizes), 0.85, 0.15), None
        for _ in range(rounds):
            m, v = np.zeros_like(flat), np.zeros_like(flat)
            for t in range(1, steps + 1):
                if moves is None:
                    now, gap = 1 / (1 + np.exp(-np.clip(features @ flat[:width], -60, 60))), np.zeros(4)
                else:
                    now, seen = cls(flat[:width], flat[width:].reshape(2, 2))._expected(features, sizes)
                    gap = (moves - seen).ravel()
                slope = np.concatenate([features.T @ (chance - now), gap]) / n - ridge * flat / n
                m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
                flat = flat + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            chain = cls(flat[:width], flat[width:].reshape(2, 2))
            chance, moves = chain.known_shares(features, sizes, good, chars, share)
        return chain


def _sample(max_lines: int):
    """The features and characters of the lines of each text; of a longer one, of so many lines about its middle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            lines = Lines(batch.column("text"))
            x = lines.features()
            at = np.searchsorted(lines.line_doc, np.arange(batch.num_rows + 1))
            size = np.minimum(np.diff(at), max_lines)
            first = at[:-1] + (np.diff(at) - size) // 2
            rows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size * x.shape[1])]).astype(np.int32), pa.array(np.concatenate([x[a : a + n].ravel() for a, n in zip(first, size)])))
            chars = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), pa.array(np.concatenate([lines.chars[a : a + n] for a, n in zip(first, size)])))
            yield pa.RecordBatch.from_arrays([batch.column("quality"), pa.array(size), rows, chars], ["quality", "n", "features", "chars"])

    return run


def fit_chain(docs: DataFrame, labels: DataFrame, max_docs: int = 2000, max_lines: int = 200) -> Chain:
    """Fits on up to max_docs labelled documents, chosen by a hash of the id, of up to max_lines lines each. Of an id's several texts the least is taken."""
    spark = docs.sparkSession
    known = only(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"))
    picked: list = []
    for quality in (0, 1):
        picked += known.where((F.col("quality") > 0) == (quality > 0)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs // 2).collect()
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, quality int"))  # max_docs rows
    text = only(docs, "doc_id", "text").join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality")).dropna()
    rows = text.select("quality", "text").mapInArrow(lean(_sample(max_lines)), "quality int, n long, features array<double>, chars array<long>").collect()
    width = len(FEATURES)
    if not rows:
        return Chain(np.zeros(width), np.zeros((2, 2)))
    rows.sort(key=lambda r: (r["quality"], r["n"], r["features"], r["chars"]))
    sizes = np.array([r["n"] for r in rows], np.int64)
    features = np.concatenate([np.array(r["features"]).reshape(-1, width) for r in rows])
    return Chain.fit(features, sizes, np.array([r["quality"] > 0 for r in rows]), np.concatenate([np.array(r["chars"], np.int64) for r in rows]))


def _judge(chain: Chain, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        lines = Lines(batch.column("text"))
        n_words = np.bincount(lines.doc, minlength=lines.n)
        inside = NOT_SPACE[lines.data]
        repeats = lines.repeat_words()
        failed = (n_words < 50) | (100 * repeats > 50 * n_words)
        sizes = np.bincount(lines.line_doc, minlength=lines.n)
        content = chain.decode(lines.features(), sizes)
        chars = np.bincount(lines.line_doc, lines.chars, lines.n)
        share = np.bincount(lines.line_doc, lines.chars * content, lines.n) / np.maximum(chars, 1)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array(np.asarray(x, np.int64)) for x in (n_words, lines.per_doc(inside & ((lines.data & 0xC0) != 0x80)), lines.per_doc(SYMBOLS[lines.data]), np.bincount(lines.line_doc, lines.duplicates(), lines.n), repeats)), pa.array(failed), pa.array(~failed & (share >= least)), pa.array(share)],
            [c.split()[0] for c in MEASURES.split(", ")],
        )


def judge_quality(docs: DataFrame, labels: DataFrame, least_content: float = 0.5, **sample) -> DataFrame:
    """The base measures and the verdict for every row of docs: see MEASURES.

    docs: doc_id, text; labels: doc_id, quality (0 or 1); other columns are ignored. A null text has no words and fails the base rules, as does an
    empty one. Repeated rows are judged alike. Without labels the chain is undecided and every line is boilerplate. sample: options of fit_chain().
    """
    chain = fit_chain(docs, labels, **sample)
    return only(docs, "doc_id", "text").mapInArrow(lean(lambda batches: _judge(chain, least_content, batches)), MEASURES)


def _keep(chain: Chain, least: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text"):
        rows = pa.RecordBatch.from_arrays([pa.nulls(batch.num_rows, pa.int64()), batch.column("text")], ["doc_id", "text"])
        kept = np.concatenate([np.asarray(verdict.column("kept")) for verdict in _judge(chain, least, iter([rows]))])
        whole = batch.filter(pa.array(kept))
        if whole.num_rows:
            yield whole


def keep_good(docs: DataFrame, labels: DataFrame, least_content: float = 0.5, **sample) -> DataFrame:
    """The rows of docs that judge_quality() keeps, with all columns, whatever their names but doc_id and text; texts aren't shuffled.

    Null and empty texts go. Repeated rows stay or go together; an empty table gives an empty result.
    """
    chain = fit_chain(docs, labels, **sample)
    return docs.mapInArrow(lean(lambda batches: _keep(chain, least_content, batches)), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base measures and the verdict of the line labelling for every document. Nulls, ties, repeats and empty tables as in judge_quality()."""
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
