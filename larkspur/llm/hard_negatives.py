"""Hard negatives by dual-tree search: trees over anchors and candidates, intervals of the inner product of two nodes, and exact scores of leaf pairs.

1. Vectors become integers in the JVM. Of rows of equal label and vector only those of the smallest ids can be among the first k, so the others are left out as candidates, before the shuffle.
   Anchors of equal label and vector ask the same, so they ask once.
2. A tree of at most CELLS cells is fitted to SAMPLE vectors (a documented bound; it decides about speed alone). Every row gets a cell; a cell's centre and the
   largest distance from it are a ball that holds all its rows. Cells are cut into blocks of BLOCK_ROWS rows.
3. A search asks the blocks of a query's own cell first, which gives each query a least score; then, for whole groups of queries of one cell and label, all cells whose interval of inner
   products with the group's ball still reaches that score. Nothing else is left out, so the result is exact.
4. In a block both sides are grown into trees down to leaves of LEAF rows. A pair of nodes is dropped as a whole if no inner product of their balls lies in what any query of the node still wants,
   and leaf pairs are scored exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ids, lean, only, table, written

CELLS, SAMPLE, CELL_ROWS = 256, 16_384, 4096
#: Components of the sample, all in all.
SAMPLE_VALUES = 1 << 22
BLOCK_ROWS = 1 << 18
LEAF = 96
#: Queries that go through a block together.
TOGETHER = 2048
#: Components are cut at this absolute value, so that sums fit 64 bits up to 512 dimensions.
LARGEST = 1 << 27
LOW, HIGH = -(1 << 62), 1 << 62


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    at = column.offsets.to_numpy()
    flat = column.values.slice(at[0], at[-1] - at[0]).to_numpy(zero_copy_only=False)
    at = at - at[0]
    size = np.diff(at)
    if (size == dims).all():
        return flat.reshape(len(size), dims)
    out = np.zeros((len(size), dims), flat.dtype)
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(flat)) - at[row]] = flat
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; by floating point where no sum can leave its exact range."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1] < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


@dataclass
class Tree:
    """Nodes over rows that are put in order: node i holds rows begin[i] to end[i]; left is -1 for a leaf."""

    order: np.ndarray
    begin: list[int]
    end: list[int]
    left: list[int]
    right: list[int]
    centre: np.ndarray
    norm: np.ndarray
    radius: np.ndarray
    labels: list[tuple[int, int]]


def _parted(points: np.ndarray) -> tuple[np.ndarray, float]:
    """A direction and a threshold along it that part the points around two means, begun at two points that are far from each other."""
    far = lambda c: points[np.argmax(((points - c) ** 2).sum(1))]
    one = far(points.mean(0))
    two = far(one)
    for _ in range(8):
        way, cut = one - two, float((one - two) @ (one + two)) / 2
        high = points @ way > cut
        if high.all() or not high.any():
            break
        one, two = points[high].mean(0), points[~high].mean(0)
    return way, cut


def _halves(points: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the rows and where to cut it: around two means, or in the middle if that leaves less than an eighth on a side."""
    way, cut = _parted(points)
    along = points @ way
    n, order = int((along <= cut).sum()), np.argsort(along, kind="stable")
    return order, n if len(points) <= 8 * min(n, len(points) - n) else len(points) // 2


def grow(vectors: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
    """A tree of balls: rows of different labels are parted first, then around two means."""
    order = np.argsort(labels, kind="stable")
    points, tags = vectors.astype(np.float64), labels
    begin, end, left, right, centre, radius, spans = [], [], [], [], [], [], []

    def node(a: int, b: int) -> int:
        mine = points[order[a:b]]
        c = mine.mean(0)
        begin.append(a), end.append(b), left.append(-1), right.append(-1), centre.append(c)
        radius.append(float(np.sqrt(((mine - c) ** 2).sum(1).max())))
        spans.append((int(tags[order[a:b]].min()), int(tags[order[a:b]].max())))
        return len(begin) - 1

    todo = [node(0, len(order))]
    while todo:
        i = todo.pop()
        a, b = begin[i], end[i]
        if b - a <= leaf:
            continue
        if spans[i][0] != spans[i][1]:  # still sorted by label
            edge = np.flatnonzero(np.diff(tags[order[a:b]])) + 1
            cut = a + int(edge[np.argmin(np.abs(edge - (b - a) // 2))])
        else:
            halves, n = _halves(points[order[a:b]])
            order[a:b], cut = order[a:b][halves], a + n
        left[i], right[i] = node(a, cut), node(cut, b)
        todo += [left[i], right[i]]
    centres = np.array(centre)
    return Tree(order, begin, end, left, right, centres, np.sqrt((centres**2).sum(1)), np.array(radius), spans)


def reach(mid: np.ndarray, norm_a: np.ndarray, radius_a: np.ndarray, norm_b: np.ndarray, radius_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval that holds all inner products of points of two balls, given that of their centres; a little wider, for rounding."""
    width = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    width = width + 1 + 1e-9 * (np.abs(mid) + width)
    return mid - width, mid + width


class Best:
    """The first k hits of each query: by falling score, then by id."""

    def __init__(self, k: int, least: np.ndarray) -> None:
        self.k, self.least = k, least.copy()
        self.held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, row: np.ndarray, score: np.ndarray, found: np.ndarray) -> None:
        """Hits of queries, rows ascending."""
        cut = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1], [True]])) if len(row) else np.zeros(1, np.int64)
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            q, s, f = int(row[a]), score[a:b], found[a:b]
            if q in self.held:
                s, f = np.concatenate([self.held[q][0], s]), np.concatenate([self.held[q][1], f])
            keep = np.lexsort((f, -s))[: self.k]
            self.held[q] = s[keep], f[keep]
            if len(keep) == self.k:
                self.least[q] = max(self.least[q], s[keep[-1]])


def dual_search(queries: Tree, q_vectors: np.ndarray, q_labels: np.ndarray, least: np.ndarray, most: np.ndarray, tree: Tree, vectors: np.ndarray, labels: np.ndarray, found_ids: np.ndarray, k: int, same: bool) -> Best:
    """The first k rows of the same (or of another) label for each query, with scores from least to most. All arrays of queries and candidates are in the order of their trees."""
    best = Best(k, least)

    def interval(a: int, c: int) -> tuple[float, float]:
        return reach(float(queries.centre[a] @ tree.centre[c]), queries.norm[a], queries.radius[a], tree.norm[c], tree.radius[c])

    todo = [(0, 0, *interval(0, 0))]
    while todo:
        a, c, low, high = todo.pop()
        rows = slice(queries.begin[a], queries.end[a])
        (a0, a1), (c0, c1) = queries.labels[a], tree.labels[c]
        if same and (a1 < c0 or c1 < a0) or not same and a0 == a1 == c0 == c1 or high < best.least[rows].min() or low > most[rows].max():
            continue
        if queries.left[a] < 0 and tree.left[c] < 0:
            score = products(q_vectors[rows], vectors[tree.begin[c] : tree.end[c]])
            fits = (q_labels[rows, None] == labels[None, tree.begin[c] : tree.end[c]]) == same
            fits &= (score >= best.least[rows, None]) & (score <= most[rows, None])
            i, j = np.nonzero(fits)
            best.add(i + queries.begin[a], score[i, j], found_ids[tree.begin[c] + j])
        else:
            if tree.left[c] >= 0 and (queries.left[a] < 0 or tree.radius[c] >= queries.radius[a]):
                pairs = [(a, tree.left[c]), (a, tree.right[c])]
            else:
                pairs = [(queries.left[a], c), (queries.right[a], c)]
            todo += sorted(((*p, *interval(*p)) for p in pairs), key=lambda p: p[3])  # the highest first, as it raises the least scores
    return best


@dataclass
class Cells:
    """The fitted tree of the sample: inner nodes (direction, threshold, left, right; a leaf as -1 - cell), and each cell's centre, largest distance and first block and number of blocks."""

    nodes: list[tuple[np.ndarray, float, int, int]]
    centre: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    blocks: np.ndarray

    def cell_of(self, vectors: np.ndarray) -> np.ndarray:
        points, out = vectors.astype(np.float64), np.zeros(len(vectors), np.int64)
        todo = [(0 if self.nodes else -1, np.arange(len(vectors)))]
        while todo:
            node, rows = todo.pop()
            if node < 0:
                out[rows] = -1 - node
                continue
            way, cut, left, right = self.nodes[node]
            low = points[rows] @ way <= cut
            todo += [(left, rows[low]), (right, rows[~low])]
        return out

    def distance(self, vectors: np.ndarray, cell: np.ndarray) -> np.ndarray:
        return np.sqrt(((vectors - self.centre[cell]) ** 2).sum(1))


def fitted(sample: np.ndarray, cells: int) -> Cells:
    """Parts the sample around two means until there are so many parts; the largest part first. Fewer, if all points of the parts are equal."""
    points = sample.astype(np.float64)
    nodes: list[list] = []
    parts = [(-len(points), 0, np.arange(len(points)), None)]  # a heap; each part knows the node, and the side of it, that leads there
    done = []
    while parts and len(parts) + len(done) < cells:
        _, _, rows, parent = part = heappop(parts)
        way, cut = _parted(points[rows])
        high = points[rows] @ way > cut
        if high.all() or not high.any():
            done.append(part)
            continue
        if parent is not None:
            nodes[parent[0]][parent[1]] = len(nodes)
        nodes.append([way, cut, 0, 0])
        for side, mine in ((2, rows[~high]), (3, rows[high])):
            heappush(parts, (-len(mine), 2 * len(nodes) + side, mine, (len(nodes) - 1, side)))
    parts += done
    for k, (_, _, _, parent) in enumerate(parts):
        if parent is not None:
            nodes[parent[0]][parent[1]] = -1 - k
    n = len(parts)
    return Cells([tuple(x) for x in nodes], np.array([points[rows].mean(0) for _, _, rows, _ in parts]), np.zeros(n), np.zeros(n, np.int64), np.ones(n, np.int64))


def integers(vector: Column) -> Column:
    """floor(256 * x) of each component, cut at LARGEST; null if the vector or a component is null or not finite."""
    x = lambda v: v.cast("double")
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(x(v)) < float("inf")))
    return F.when(fine, F.transform(vector, lambda v: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(x(v) * 256))).cast("int")))


def _first_of_equals(rows: DataFrame, n: int) -> DataFrame:
    """Of each label and vector the rows of the n smallest ids, equal rows once. Spark cuts to n before the shuffle too."""
    ranked = rows.withColumn("_n", F.dense_rank().over(Window.partitionBy("label", "v").orderBy("vec_id")))
    return ranked.where(F.col("_n") <= n).drop("_n").distinct()


def _with_cells(rows: DataFrame, cells: Cells, dims: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = matrix(b.column("v"), dims)
            cell = shared.value.cell_of(v)
            yield b.append_column("cell", pa.array(cell.astype(np.int32))).append_column("away", pa.array(shared.value.distance(v, cell)))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(lean(run), f"{fields}, cell int, away double")


@dataclass
class Index:
    """All candidates by cell and block, and what a search has to know of them."""

    rows: DataFrame
    cells: Cells
    dims: int
    parts: int


def index(rows: DataFrame, keep: int) -> Index:
    """An index of rows (vec_id, label, v). Of equal labels and vectors only the `keep` smallest ids are in it, which is enough for searches of so many hits."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kept = written(_first_of_equals(rows, keep), "candidates")
    n, dims = kept.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    dims = max(dims, 1)
    sample = kept.orderBy(F.xxhash64("v"), "vec_id").select("v").limit(max(1, min(SAMPLE, SAMPLE_VALUES // dims))).toArrow().combine_chunks()
    points = matrix(sample.column("v").combine_chunks() if sample.num_rows else pa.array([[0] * dims], pa.list_(pa.int32())), dims)
    cells = fitted(points, min(CELLS, max(1, n // CELL_ROWS)))
    placed = written(_with_cells(kept, cells, dims), "placed")
    for cell, count, away in placed.groupBy("cell").agg(F.count("*"), F.max("away")).collect():  # a row for each cell
        cells.radius[cell] = away
        cells.blocks[cell] = -(-count // max(1024, min(BLOCK_ROWS, n // (2 * parts))))
    cells.first[1:] = np.cumsum(cells.blocks)[:-1]
    where = spark.createDataFrame([(c, int(cells.first[c]), int(cells.blocks[c])) for c in range(len(cells.blocks))], "cell int, first int, blocks int")
    block = (F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).cast("int")
    return Index(placed.join(F.broadcast(where), "cell").select(block.alias("block"), "vec_id", "label", "v"), cells, dims, parts)


def _asked(queries: DataFrame, at: Index, own: bool) -> DataFrame:
    """The queries once for each block they go to: those of their own cell, or those of all others that a whole group of queries of one cell and label can't rule out."""
    shared = queries.sparkSession.sparkContext.broadcast(at.cells)
    names = ["q", "label", "v", "least", "most"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = shared.value
        norm = np.sqrt((cells.centre**2).sum(1))
        for b in batches:
            home, label, least, most = (ids(b.column(c)) for c in ("cell", "label", "least", "most"))
            away = b.column("away").to_numpy(zero_copy_only=False)
            cut = np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (label[1:] != label[:-1]), [True]]))
            blocks = []
            for x, y in zip(cut[:-1].tolist(), cut[1:].tolist()):
                h = int(home[x])
                low, high = reach(cells.centre @ cells.centre[h], norm[h], away[x:y].max(), norm, cells.radius)
                fits = (high >= least[x:y].min()) & (low <= most[x:y].max())
                wanted = [h] if own else [c for c in np.flatnonzero(fits).tolist() if c != h]
                mine = [int(cells.first[c]) + s for c in wanted for s in range(int(cells.blocks[c]))]
                blocks += [mine] * (y - x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], pa.array(blocks, pa.list_(pa.int32()))], [*names, "blocks"])

    ordered = queries.repartitionByRange(at.parts, "cell", "label", "q").sortWithinPartitions("cell", "label", "q")
    return ordered.mapInArrow(lean(run), "q long, label long, v array<int>, least long, most long, blocks array<int>").select(F.explode("blocks").alias("block"), *names)


def _scored(asked: DataFrame, at: Index, k: int, same: bool) -> DataFrame:
    """q, vec_id, score: the first k of each block for each query that goes there."""
    dims = at.dims

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, gathered, tree = None, [], None
        for b in batches:
            block, kind = ids(b.column("block")), ids(b.column("kind"))
            cut = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (kind[1:] != kind[:-1]), [True]])) if len(block) else [0]
            for x, y in zip(cut[:-1], cut[1:]):
                part = b.slice(int(x), int(y - x))
                if block[x] != here:
                    here, gathered, tree = block[x], [], None
                if not kind[x]:
                    gathered.append((ids(part.column("id")), ids(part.column("label")), matrix(part.column("v"), dims)))
                    continue
                if not gathered:
                    continue
                if tree is None:
                    found, labels, vectors = (np.concatenate(c) for c in zip(*gathered))
                    tree = grow(vectors, labels)
                    found, labels, vectors = found[tree.order], labels[tree.order], vectors[tree.order]
                for z in range(0, part.num_rows, TOGETHER):
                    some = part.slice(z, TOGETHER)
                    q, tags, v = ids(some.column("id")), ids(some.column("label")), matrix(some.column("v"), dims)
                    asking = grow(v, tags)
                    o = asking.order
                    best = dual_search(asking, v[o], tags[o], ids(some.column("least"))[o], ids(some.column("most"))[o], tree, vectors, labels, found, k, same)
                    if best.held:
                        rows = np.repeat(np.fromiter(best.held, np.int64), [len(s) for s, _ in best.held.values()])
                        score, hit = (np.concatenate(c) for c in zip(*best.held.values()))
                        yield pa.RecordBatch.from_arrays([pa.array(q[o][rows]), pa.array(hit), pa.array(score)], ["q", "vec_id", "score"])

    none = F.lit(None).cast("long")
    candidates = at.rows.select("block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "label", "v", none.alias("least"), none.alias("most"))
    wanted = asked.select("block", F.lit(1).alias("kind"), F.col("q").alias("id"), "label", "v", "least", "most")
    return candidates.unionByName(wanted).repartitionById(at.parts, F.col("block")).sortWithinPartitions("block", "kind", "label", "id").mapInArrow(lean(run), "q long, vec_id long, score long")


def _first_hits(hits: DataFrame, k: int) -> DataFrame:
    """The first k of all hits, with place from 1."""
    ranked = hits.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("place") <= k)


def search(queries: DataFrame, at: Index, k: int, same: bool) -> DataFrame:
    """q, vec_id, score, place: for each query (q, label, v, least, most) the first k rows of the same (or of another) label whose score is from least to most. Exact."""
    placed = written(_with_cells(queries, at.cells, at.dims), "queries")
    near = written(_first_hits(_scored(_asked(placed, at, own=True), at, k, same), k), "near")
    kth = near.where(F.col("place") == k).select("q", F.col("score").alias("kth"))
    tighter = placed.join(kth, "q", "left").withColumn("least", F.greatest("least", "kth")).drop("kth")
    far = _scored(_asked(tighter, at, own=False), at, k, same)
    return written(_first_hits(near.drop("place").unionByName(far), k), "hits")


def valid_rows(vectors: DataFrame) -> DataFrame:
    """vec_id, label, v: the rows that take part, vectors as integers."""
    rows = only(vectors, "vec_id", "label", "embedding").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integers(F.col("embedding")).alias("v"))
    return rows.where("vec_id is not null and label is not null and v is not null")


def hard_negatives(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor (rows for which `anchors` holds) and each of its first positives the first rows of other labels
    whose score is low to high hundredths of the positive's.

    rows: vec_id, label, v (integers), none of them null, as of valid_rows(). Higher scores come first, ties by smaller vec_id. Rows that are repeated wholly count once; vec_id is taken for a key: a row of the anchor's
    id is no positive of it, and where other rows bear the anchor's id, there may be fewer positives. A negative positive score has no negatives. Shorter vectors count as if they ended in zeros. Empty tables give no rows.
    """
    at = index(rows, max(positives + 1, negatives))
    marked = rows.where(anchors)
    asking = written(marked.select("label", "v").distinct().withColumn("q", F.monotonically_increasing_id()), "asking")
    members = marked.join(asking, ["label", "v"]).select("q", F.col("vec_id").alias("anchor_id")).distinct()
    wide = asking.withColumns({"least": F.lit(LOW), "most": F.lit(HIGH)})
    hits = search(wide.select("q", "label", "v", "least", "most"), at, positives + 1, same=True)
    score = F.col("score")
    exact = {"least": F.expr(f"(score * {low} + 99) div 100"), "most": F.expr(f"(score * {high}) div 100")}
    bounds = hits.where(score >= 0).select("q", "score").distinct()
    bounds = written(bounds.withColumns(exact).withColumn("nq", F.monotonically_increasing_id()), "bounds")
    wanted = bounds.join(asking, "q").select(F.col("nq").alias("q"), "label", "v", "least", "most")
    below = search(wanted, at, negatives, same=False).join(bounds.select(F.col("nq").alias("q"), F.col("q").alias("anchors"), F.col("score").alias("positive_score")), "q")
    below = below.select(F.col("anchors").alias("q"), "positive_score", F.col("place").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    lists = hits.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("place", "vec_id", "score"))).alias("hits"))  # positives + 1 of each
    others = F.filter("hits", lambda h: h["vec_id"] != F.col("anchor_id"))
    pairs = members.join(lists, "q").select("q", "anchor_id", F.explode(F.slice(others, 1, positives)).alias("h"))
    pairs = pairs.select("q", "anchor_id", F.col("h.vec_id").alias("positive_id"), F.col("h.score").alias("positive_score"))
    return pairs.join(below, ["q", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of all vectors, anchors being the rows whose vec_id is divisible by 100, labels shifted where it is by 7. Ties, repeats and empty tables as in hard_negatives(); rows with a null label,
    vector, component or vec_id, or a component that isn't finite, take no part."""
    rows = valid_rows(table(spark, sf_dir, "embeddings"))
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


#: All anchors against all rows.
ORACLE = """
WITH rows AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: greatest(-134217728, least(134217728, CAST(floor(CAST(x AS DOUBLE) * 256) AS HUGEINT)))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(coalesce(list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])), 0) AS BIGINT) AS score
    FROM rows a, rows b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM scores WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10"""
