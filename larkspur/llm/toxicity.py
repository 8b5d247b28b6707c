"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of the labelled rows, toxic and clean ones in halves where there are enough; every vote carries the weight that
undoes this choice. The terms are the words that mark toxic examples by a chi-square test and by the share
of toxic rows among those that hold them; their document frequencies are counted
over all documents. Examples of equal vectors are one entry with its votes. The entries stand in an inverted index in blocks, with the
largest weight of each term in each block: a query bounds each block by the sum of its terms' maxima, reads blocks from the largest
bound down and stops when no other block can hold a nearer entry, so the neighbours are exact.

Votes count by cosine. An example never votes on its own document, so no label is an input of its own score. What share of the votes means is learnt: the examples are
scored by each other, and a logistic curve is fitted to their labels.

Size bounds: max_examples entries, max_terms terms; only these are broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ids, lean, only, slices, table, text_bytes, written
from .kernels import ALNUM, fold_case, prefix_hash, span_hash, words

BLOCK = 64
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_votes int, nearest double, evidence array<long>"


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def _terms(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Hash and document number of each word."""
    data, starts = text_bytes(batch.column("text"))
    data = fold_case(data)
    a, b, doc = words(data, starts, ALNUM)
    return span_hash(prefix_hash(data), a, b), doc


def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Examples that hold each word, toxic and clean."""
    for batch in slices(batches, "text"):
        term, doc = _terms(batch)
        order = np.lexsort((doc, term))
        term, doc = term[order], doc[order]
        keep = np.ones(len(term), bool)
        keep[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
        toxic = ids(batch.column("toxic"))[doc[keep]]
        term, at = np.unique(term[keep], return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(np.bincount(at, toxic, len(term)).astype(np.int64)), pa.array(np.bincount(at, 1 - toxic, len(term)).astype(np.int64))], ["term", "toxic", "clean"])


def _matches(batch: pa.RecordBatch, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document number, term number and count of each vocabulary word that a document holds, by document."""
    term, doc = _terms(batch)
    at = np.minimum(np.searchsorted(vocabulary, term), len(vocabulary) - 1)
    hit = vocabulary[at] == term
    key, count = np.unique(doc[hit] * len(vocabulary) + at[hit], return_counts=True)
    return key // len(vocabulary), key % len(vocabulary), count


def _frequencies(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for batch in slices(batches, "text"):
            total += np.bincount(_matches(batch, vocabulary)[1], minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(vocabulary))), pa.array(total)], ["term", "n"])

    return run


def _vectors(vocabulary: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, term, count = _matches(batch, vocabulary)
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(at, pa.array(x.astype(np.int32))) for x in (term, count)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])

    return run


class BlockMaxIndex:
    """Unit vectors in an inverted index of blocks; nearest() is exact.

    Entries are ordered by their terms, so that a block's entries are alike and its maxima are close. The maxima are kept term by term, and the
    postings block by block, so that a block that must be read is scored in one pass.
    """

    def __init__(self, vectors: list[tuple[tuple[int, ...], tuple[float, ...]]], n_terms: int) -> None:
        self.n, self.n_terms, blocks = len(vectors), n_terms, -(-max(len(vectors), 1) // BLOCK)
        self.term = np.fromiter((t for v in vectors for t in v[0]), np.int64)
        self.weight = np.fromiter((w for v in vectors for w in v[1]), np.float64)
        sizes = np.array([len(v[0]) for v in vectors], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.most = np.zeros((n_terms, blocks))
        np.maximum.at(self.most, (self.term, np.repeat(np.arange(self.n), sizes) // BLOCK), self.weight)

    def _read(self, block: int, query: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries of a block that share a term with the query, and their cosines."""
        a, b = block * BLOCK, min(block * BLOCK + BLOCK, self.n)
        at = slice(self.first[a], self.first[b])
        score = np.add.reduceat(self.weight[at] * query[self.term[at]], self.first[a:b] - self.first[a])
        hit = np.flatnonzero(score)
        return a + hit, score[hit]

    def nearest(self, terms: np.ndarray, weights: np.ndarray, enough) -> tuple[np.ndarray, np.ndarray]:
        """Entries and cosines, nearest first (ties by entry), at least those that enough(entries) needs: it returns how many, or 0 if more are wanted."""
        bound = weights @ self.most[terms]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        query = np.zeros(self.n_terms)
        query[terms] = weights
        got, found, k, step = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while k < len(order):
            read = [self._read(block, query) for block in order[k : k + step]]
            got, found = np.concatenate([got, *(r[0] for r in read)]), np.concatenate([found, *(r[1] for r in read)])
            by = np.lexsort((got, -np.round(found, 12)))
            got, found = got[by], found[by]
            k, step = k + step, step * 2
            need = enough(got)
            if need and (k >= len(order) or found[need - 1] > bound[order[k]] + 1e-12):
                return got[:need], found[:need]
        need = enough(got) or len(got)
        return got[:need], found[:need]


class Model:
    """The index, its votes, what a document without any term scores, and the curve from the share of votes to the score."""

    def __init__(self, vocabulary: np.ndarray, n_docs: int, frequency: np.ndarray, examples: list, weight: dict[int, float], neighbours: int) -> None:
        self.vocabulary, self.neighbours = vocabulary, neighbours
        self.idf = np.log((1.0 + n_docs) / (1.0 + frequency)) + 1.0
        votes: dict[tuple, list] = {}
        for e in examples:
            key = (tuple(e["terms"]), tuple(e["counts"]))
            v = votes.setdefault(key, [0, 0.0, 0.0, []])
            v[0] += 1
            v[1] += weight[e["toxic"]] * e["toxic"]
            v[2] += weight[e["toxic"]]
            v[3] = sorted([*v[3], e["doc_id"]])[:2]
        keys = sorted(k for k in votes if k[0])
        at = {k: i for i, k in enumerate(keys)} | {((), ()): -1}
        #: of each example its entry and what it adds there
        self.own = {e["doc_id"]: (at[tuple(e["terms"]), tuple(e["counts"])], weight[e["toxic"]] * e["toxic"], weight[e["toxic"]]) for e in examples}
        self.votes = np.array([votes[k][:3] for k in keys]).reshape(-1, 3)
        self.evidence = [votes[k][3] for k in keys]
        self.index = BlockMaxIndex([(k[0], tuple(self.unit(np.array(k[0]), np.array(k[1])))) for k in keys], max(len(vocabulary), 1))
        weights = sum(v[2] for v in votes.values())
        self.prior = sum(v[1] for v in votes.values()) / weights if weights else 0.0
        self.blank = votes.get(((), ()), [0, 0.0, 0.0, []])[1:3]
        self.curve = (1.0, 0.0)
        self.known: dict[bytes, tuple] = {}

    def unit(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1.0 + np.log(counts)) * self.idf[terms]
        return w / np.sqrt((w * w).sum())

    def _share(self, toxic: float, total: float) -> float:
        return float((max(toxic, 0.0) + self.prior) / (max(total, 0.0) + 1.0))

    def voted(self, terms: np.ndarray, counts: np.ndarray, doc_id: int | None) -> tuple[float, int, float, list[int]]:
        """The toxic share of the votes, how many there were, the nearest cosine and the nearest examples; that of doc_id, if it is one, is left out."""
        entry, own_toxic, own_total = self.own.get(doc_id, (None, 0.0, 0.0))
        got, near, wanted = np.zeros(0, np.int64), np.zeros(0), self.neighbours + (entry is not None)
        if len(terms) and self.index.n:
            have = lambda e: np.cumsum(self.votes[e, 0])
            got, near = self.index.nearest(terms, self.unit(terms, counts), lambda e: int(np.searchsorted(have(e), wanted)) + 1 if len(e) and have(e)[-1] >= wanted else 0)
        votes = self.votes[got]
        if entry is not None and entry >= 0:
            mine = got == entry
            votes = votes - mine[:, None] * np.array([1.0, own_toxic, own_total])
            left = votes[:, 0] > 0
            got, near, votes = got[left], near[left], votes[left]
        if not len(got):
            own = (own_toxic, own_total) if entry == -1 else (0.0, 0.0)
            return self._share(self.blank[0] - own[0], self.blank[1] - own[1]), 0, 0.0, []
        w = np.minimum(near, 1.0)
        evidence = [next(i for i in self.evidence[g] if i != doc_id) for g in got[:5].tolist()]
        return self._share((w * votes[:, 1]).sum(), (w * votes[:, 2]).sum()), int(votes[:, 0].sum()), float(w[0]), evidence

    def score(self, terms: np.ndarray, counts: np.ndarray, doc_id: int | None) -> tuple[float, int, float, list[int]]:
        key = terms.tobytes() + counts.tobytes()
        if doc_id in self.own:
            found = self.voted(terms, counts, doc_id)
        elif key in self.known:
            return self.known[key]
        else:
            found = self.voted(terms, counts, None)
        found = (float(calibrated(self.curve, np.array(found[0]))), *found[1:])
        if doc_id not in self.own:
            if len(self.known) > 100_000:
                self.known.clear()
            self.known[key] = found
        return found


def calibrated(curve: tuple[float, float], share: np.ndarray) -> np.ndarray:
    """The chance of toxic that a share of votes stands for."""
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return 1.0 / (1.0 + np.exp(-np.clip(curve[0] * np.log(share / (1 - share)) + curve[1], -40, 40)))


def fit_curve(share: np.ndarray, toxic: np.ndarray, weight: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[float, float]:
    """Slope and offset of the logistic curve over the log odds of the share, by Newton steps; a ridge holds it to the share itself. One label alone leaves it so."""
    if not len(share) or toxic.min() == toxic.max():
        return 1.0, 0.0
    share = np.clip(share, 1e-6, 1 - 1e-6)
    x = np.stack([np.log(share / (1 - share)), np.ones(len(share))], 1)
    weight = weight * (len(weight) / weight.sum())
    curve = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ curve, -40, 40)))
        slope = x.T @ (weight * (toxic - p)) - ridge * (curve - [1.0, 0.0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(bend, slope)
        curve = curve + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
    return (float(curve[0]), float(curve[1])) if curve[0] > 0 else (1.0, 0.0)


def _shares(model: Model):
    """The share of votes of each example, by all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "terms", "counts")))
            share = [model.voted(np.array(t, np.int64), np.array(c, np.int64), i)[0] for i, t, c in rows]
            yield pa.RecordBatch.from_arrays([pa.array(share, pa.float64()), batch.column("toxic")], ["share", "toxic"])

    return run


def _scores(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            doc, term, count = _matches(batch, model.vocabulary) if len(model.vocabulary) else (np.zeros(0, np.int64),) * 3
            at = np.searchsorted(doc, np.arange(batch.num_rows + 1))
            rows = [model.score(term[at[i] : at[i + 1]], count[at[i] : at[i + 1]], doc_id) for i, doc_id in enumerate(batch.column("doc_id").to_pylist())]
            score = np.array([r[0] for r in rows])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "held_out", "score", "predicted", "n_votes", "nearest", "evidence"],
            )

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, max_examples: int = 20_000, max_terms: int = 2048, min_chi2: float = 25.0, min_share: float = 0.4, neighbours: int = 25) -> DataFrame:
    """A toxicity score for every row of docs: doc_id, held_out, score, predicted, n_votes, nearest (cosine), evidence (ids of the nearest examples).

    docs: doc_id, text; labels: doc_id, toxic; other columns are ignored. Labels are learnt only from rows of which the fold is not 0; rows of a null
    id or label teach nothing, and of several labels of an id the largest holds, of several texts the least. max_examples bounds the examples, chosen by a hash of the id: this
    bounded sample is all that is fitted on. A null or empty text, or one without any term, scores what such examples score. Without
    examples of both labels every text scores the share of toxic ones. Repeated rows are scored alike. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = only(docs, "doc_id", "text")
    learnt = only(labels, "doc_id", "toxic").dropna().groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(fold(F.col("doc_id"), folds) != 0)
    learnt = learnt.withColumn("toxic", (F.col("toxic") > 0).cast("int"))
    there = {r["toxic"]: r["n"] for r in learnt.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked: list = []
    for toxic in (1, 0):
        most = max(max_examples // 2, max_examples - there.get(1 - toxic, 0))
        picked += learnt.where(F.col("toxic") == toxic).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # max_examples rows at most
    weight = {t: there.get(t, 0) / max(1, sum(r["toxic"] == t for r in picked)) for t in (0, 1)}
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, toxic int"))
    examples = written(docs.join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")), "toxic-examples")
    marks = examples.mapInArrow(lean(_marks), "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    n1, n0 = (sum(r["toxic"] == t for r in picked) for t in (1, 0))
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    chi2 = (n1 + n0) * F.pow(a * (n0 - b) - b * (n1 - a), 2) / ((a + b) * (n1 + n0 - a - b) * n1 * n0)
    toxic_share = a * weight[1] / (a * weight[1] + b * weight[0])
    marks = marks.where((a * n0 > b * n1) & (a + b < n1 + n0) & (toxic_share >= min_share)) if n1 and n0 else marks.where("false")
    terms = marks.select("term", (chi2 if n1 and n0 else F.lit(0.0)).alias("chi2")).where(F.col("chi2") >= min_chi2).orderBy(F.desc("chi2"), "term").limit(max_terms).collect()
    vocabulary = np.sort(np.array([r["term"] for r in terms], np.int64).view(np.uint64))
    n_docs, frequency = 0, np.zeros(len(vocabulary))
    if len(vocabulary):
        n_docs = docs.count()
        for r in docs.select("text").mapInArrow(lean(_frequencies(vocabulary)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
            frequency[r["term"]] = r["n"]
        vectors = written(examples.mapInArrow(lean(_vectors(vocabulary)), "doc_id long, toxic int, terms array<int>, counts array<int>"), "toxic-vectors")
    else:
        none = F.array().cast("array<int>")
        vectors = examples.select("doc_id", "toxic", none.alias("terms"), none.alias("counts"))
    model = Model(vocabulary, n_docs, frequency, vectors.collect(), weight, neighbours)  # max_examples rows
    first = spark.sparkContext.broadcast(model)
    shares = vectors.mapInArrow(lambda batches: _shares(first.value)(batches), "share double, toxic int").collect()  # max_examples rows
    toxic = np.array([r["toxic"] for r in shares])
    model.curve = fit_curve(np.array([r["share"] for r in shares]), toxic, np.array([weight[t] for t in toxic.tolist()]))
    fitted = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _scores(fitted.value)(batches)

    return docs.select("doc_id", "text", (fold(F.col("doc_id"), folds) == 0).alias("held_out")).mapInArrow(lean(run), SCHEMA)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document. Nulls, ties, repeats and empty tables as in score_toxicity()."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
