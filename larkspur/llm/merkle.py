"""A Merkle manifest of a table: a hash tree of fan-out 3 for each source, and one over the sources' roots.

1. Leaves are hashed in the JVM, dealt over range partitions of (source, doc_id) and numbered there; counts of each partition and source give every
   partition the place of its first leaf.
2. A task pushes its leaves on a mountain-range stack: three nodes of a level carry one to the next, as in counting to the base of 3. Runs that begin left of the partition stay
   as peaks, as do runs that it doesn't see the end of. A run at the end of a tree is hashed as it is, without padding.
3. Peaks meet under the node that stands LEVELS levels higher, at most 3^LEVELS of them in a group whatever the size of a source, and are merged by the same stack, round after round.
4. Each partition gets the few outer nodes that its leaves' paths touch, recomputes its own, and writes or folds the path of each leaf.

The tree over the sources is built by the same steps, with the sources' roots as leaves. Only the largest height comes to the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, only, table, written

FANOUT = 3
#: Levels that one round of merging climbs.
LEVELS = 8
#: Leaves of a partition, about.
PART_ROWS = 1 << 18
#: Rows of an Arrow batch of results.
BATCH = 4096


def digest_of(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def level_counts(leaves: int) -> list[int]:
    """Nodes of each level, from the leaves to the root."""
    counts = [leaves]
    while counts[-1] > 1:
        counts.append(-(-counts[-1] // FANOUT))
    return counts


class Mountains:
    """The stack: the open run of each level of one tree, fed with nodes from left to right."""

    def __init__(self, leaves: int) -> None:
        self.counts = level_counts(leaves)
        self.open: list[list[tuple[int, str]]] = [[] for _ in self.counts]
        self.peaks: list[tuple[int, int, str]] = []

    def push(self, level: int, index: int, digest: str) -> list[tuple[int, int, str]]:
        """Adds a node and gives the nodes (level, index, digest) that are complete by it."""
        made = []
        while True:
            run = self.open[level]
            run.append((index, digest))
            if level == len(self.counts) - 1 or index % FANOUT != FANOUT - 1 and index != self.counts[level] - 1:
                return made
            whole = run[0][0] % FANOUT == 0
            if not whole:  # the run begins left of what is seen here
                self.peaks += [(level, *node) for node in run]
            else:
                digest = digest_of("".join(d for _, d in run))
            run.clear()
            if not whole:
                return made
            level, index = level + 1, index // FANOUT
            made.append((level, index, digest))

    def rest(self) -> list[tuple[int, int, str]]:
        """The peaks: nodes that were given or made and are in no larger node yet; a root is one."""
        return self.peaks + [(level, *node) for level, run in enumerate(self.open) for node in run]


def _rows(columns: list[list], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


class _Out:
    """Rows that are yielded as Arrow batches."""

    def __init__(self, schema: list[tuple[str, pa.DataType]]) -> None:
        self.names, self.types = zip(*schema)
        self.rows: list[tuple] = []

    def full(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= BATCH):
            yield _rows(list(zip(*self.rows)), self.names, self.types)
            self.rows = []


NODE = [("grp", pa.string()), ("total", pa.int64()), ("level", pa.int32()), ("idx", pa.int64()), ("digest", pa.string()), ("peak", pa.bool_())]
NODE_DDL = "grp string, total long, level int, idx long, digest string, peak boolean"


def _indexed(leaves: DataFrame, order: list[str], n_parts: int) -> DataFrame:
    """leaves with part and at, their place in the part, in the order of grp and the columns. Rows that are equal in all of these may stand either way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for b in batches:
            b = b.drop_columns(["tie"]).append_column("part", pa.array([part] * b.num_rows, pa.int32()))
            yield b.append_column("at", pa.array(range(n, n + b.num_rows), pa.int64()))
            n += b.num_rows

    keys = ["grp", *order, "tie"]
    rows = leaves.withColumn("tie", F.monotonically_increasing_id())
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in leaves.schema)
    return written(rows.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, f"{fields}, part int, at long"), "leaves")


def _segments(leaves: DataFrame) -> DataFrame:
    """For each part and group: where it begins in the part (first) and in the group (start), how many leaves it has there (n) and in all (total)."""
    counted = leaves.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("grp").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each part at most
    return written(counted.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), F.sum("n").over(Window.partitionBy("grp")).alias("total")), "segments")


def _ranges(leaves: DataFrame, segments: DataFrame, n_parts: int, records: bool) -> DataFrame:
    """What the stacks of all parts give: peaks, and with records all nodes that were made."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, grp, total, shift = _Out(NODE), None, None, 0, 0

        def close() -> None:
            if stack is not None:
                out.rows += [(grp, total, *node, True) for node in stack.rest()]

        for b in batches:
            for g, kind, at, start, n, digest in zip(*[b.column(c).to_pylist() for c in ("grp", "kind", "at", "start", "total", "digest")]):
                if not kind:
                    close()
                    stack, grp, total, shift = Mountains(n), g, n, start - at
                    continue
                made = stack.push(0, at + shift, digest)
                if records:
                    out.rows += [(grp, total, *node, False) for node in made]
            yield from out.full()
        close()
        yield from out.full(last=True)

    none = F.lit(None)
    heads = segments.select("part", "grp", F.lit(0).alias("kind"), F.col("first").alias("at"), "start", "total", none.cast("string").alias("digest"))
    rows = leaves.select("part", "grp", F.lit(1).alias("kind"), "at", none.cast("long").alias("start"), none.cast("long").alias("total"), "digest")
    return heads.unionByName(rows).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "grp", "kind", "at").mapInArrow(lean(run), NODE_DDL)


def _power(exponent: Column) -> Column:
    return F.pow(F.lit(float(FANOUT)), exponent).cast("long")


def _merge_round(peaks: DataFrame, top: int) -> DataFrame:
    """Merges the peaks under each node of level top: the nodes made (not peak) and what is left (peak)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, stack, here = _Out(NODE), None, None

        def close() -> None:
            if stack is not None:
                out.rows += [(here[0], here[1], *node, True) for node in stack.rest()]

        for b in batches:
            for grp, total, level, idx, digest, under in zip(*[b.column(c).to_pylist() for c in ("grp", "total", "level", "idx", "digest", "under")]):
                if here is None or here != (grp, total, under):
                    close()
                    stack, here = Mountains(total), (grp, total, under)
                out.rows += [(grp, total, *node, False) for node in stack.push(level, idx, digest)]
            yield from out.full()
        close()
        yield from out.full(last=True)

    keyed = peaks.withColumn("under", F.expr("idx div " + f"cast(pow({FANOUT}.0D, {top} - level) as bigint)")).withColumn("at", F.col("idx") * _power(F.col("level")))
    return keyed.repartition("grp", "under").sortWithinPartitions("grp", "under", "at").mapInArrow(lean(run), NODE_DDL)


@dataclass
class Forest:
    """The trees of all groups. upper: nodes that others than one part know; roots: grp, digest; nodes: all nodes above the leaves, if they were asked for."""

    leaves: DataFrame
    segments: DataFrame
    n_parts: int
    upper: DataFrame
    roots: DataFrame
    nodes: DataFrame | None


def forest(leaves: DataFrame, order: list[str], records: bool = False, rows: int | None = None) -> Forest:
    """A tree for each grp over the digests of leaves (grp and digest not null), in the given order; rows is their number, if it is known."""
    n_parts = max(1, -(-(leaves.count() if rows is None else rows) // PART_ROWS))
    if rows is None:
        n_parts = max(n_parts, int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    leaves = _indexed(leaves, order, n_parts)
    segments = _segments(leaves)
    first = written(_ranges(leaves, segments, n_parts, records), "peaks")
    upper, made = first.where("peak"), [first.where("not peak")]
    is_root = _power(F.col("level")) >= F.col("total")
    roots = upper.where(is_root)
    pending, top = upper.where(~is_root), 0
    largest = segments.where("n < total").agg(F.max("total")).first()[0]
    height = len(level_counts(largest)) - 1 if largest else 0
    while top < height:
        top += LEVELS
        after = written(_merge_round(pending.where(F.col("level") <= top), top), "merged")
        made.append(after.where("not peak"))
        upper = upper.unionByName(made[-1])
        left = after.where("peak").unionByName(pending.where(F.col("level") > top))
        roots, pending = roots.unionByName(left.where(is_root)), left.where(~is_root)
    nodes = None
    if records:
        nodes = made[0]
        for m in made[1:]:
            nodes = nodes.unionByName(m)
        nodes = nodes.select("grp", "level", "idx", "digest")
    return Forest(leaves, segments, n_parts, upper.select("grp", "level", "idx", "digest"), roots.select("grp", "digest"), nodes)


def _outer(trees: Forest) -> DataFrame:
    """The nodes that paths of a part's leaves touch and that lie (at least in part) outside of it: part, grp, level, idx, digest. At most 6 of a level."""
    wide = trees.segments.where("n < total").select("part", "grp", "start", (F.col("start") + F.col("n") - 1).alias("stop"), "total")
    levels = wide.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(39)))).where(_power(F.col("level")) < F.col("total"))
    span = f"cast(pow({FANOUT}.0D, level) as bigint)"
    run = lambda c: f"sequence({c} div {span} - ({c} div {span}) % {FANOUT}, {c} div {span} - ({c} div {span}) % {FANOUT} + {FANOUT - 1})"
    asked = levels.select("part", "grp", "level", F.explode(F.expr(f"array_distinct(concat({run('start')}, {run('stop')}))")).alias("idx"))
    return asked.join(trees.upper, ["grp", "level", "idx"])


def _levels(start: int, n: int, counts: list[int], leaves: list[str], outer: dict[tuple[int, int], str]) -> list[tuple[int, list[str]]]:
    """Of each level below the root the nodes from the first to the last that paths of these leaves touch, with the index of the first."""
    out, span = [], 1
    for level, count in enumerate(counts[:-1]):
        low = start // span // FANOUT * FANOUT
        high = min(count, ((start + n - 1) // span // FANOUT + 1) * FANOUT)
        nodes = []
        for x in range(low, high):
            if x * span >= start and min((x + 1) * span, counts[0]) <= start + n:
                if not level:
                    nodes.append(leaves[x - start])
                else:
                    base, below = out[-1]
                    nodes.append(digest_of("".join(below[x * FANOUT - base : (x + 1) * FANOUT - base])))
            else:
                nodes.append(outer[level, x])
        out.append((low, nodes))
        span *= FANOUT
    return out


def paths(start: int, n: int, total: int, leaves: list[str], outer: dict[tuple[int, int], str], above: list[tuple[str, str]]) -> Iterator[tuple[list[tuple[str, str]], str]]:
    """For leaf after leaf the siblings left and right of its path's node, level by level up to the root and on through above, and all of them as one text. The list is the same object each time."""
    counts = level_counts(total)
    levels = _levels(start, n, counts, leaves, outer)
    height = len(levels)
    steps: list[tuple[str, str]] = [("", "")] * height + list(above)
    rests = [""] * height + ["".join(a + b for a, b in above)]
    seen = [-1] * height
    for x in range(start, start + n):
        level = 0
        while level < height and seen[level] != x:
            low, nodes = levels[level]
            base = x - x % FANOUT
            steps[level] = "".join(nodes[base - low : x - low]), "".join(nodes[x + 1 - low : base + FANOUT - low])
            seen[level] = x
            level, x = level + 1, x // FANOUT
        for k in range(level - 1, -1, -1):
            rests[k] = steps[k][0] + steps[k][1] + rests[k + 1]
        yield steps, rests[0]


def folded(digest: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and the siblings of its path give."""
    for left, right in steps:
        digest = digest_of(left + digest + right)
    return digest


def _walked(trees: Forest, heads: DataFrame, payload: list[tuple[str, str]], finish: Callable, out: list[tuple[str, pa.DataType]], ddl: str) -> DataFrame:
    """finish(head, leaf, steps, rest) for each leaf: head has what heads (grp, root, subroot, lefts, rights) holds for its group, leaf the payload's columns and digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, head, outer, mine = _Out(out), None, {}, []

        def close() -> Iterator[pa.RecordBatch]:
            if head is not None:
                above = list(zip(head["lefts"] or [], head["rights"] or []))
                for leaf, (steps, rest) in zip(mine, paths(head["start"], len(mine), head["total"], [m["digest"] for m in mine], outer, above)):
                    rows.rows.append(finish(head, leaf, steps, rest))
                    yield from rows.full()

        for b in batches:
            names = b.schema.names
            for values in zip(*[b.column(c).to_pylist() for c in names]):
                row = dict(zip(names, values))
                if row["kind"] == 0:
                    yield from close()
                    head, outer, mine = row, {}, []
                elif row["kind"] == 1:
                    outer[row["level"], row["at"]] = row["digest"]
                else:
                    mine.append({k: row[k] for k in keep})
        yield from close()
        yield from rows.full(last=True)

    keep = ["digest", *[n for n, _ in payload]]
    names = [("part", "int"), ("grp", "string"), ("kind", "int"), ("at", "long"), ("level", "int"), ("start", "long"), ("total", "long"), ("digest", "string"), ("root", "string"), ("subroot", "string"), ("lefts", "array<string>"), ("rights", "array<string>"), *payload]
    shaped = lambda df, kind: df.withColumn("kind", F.lit(kind)).select(*[(F.col(n) if n in df.columns or n == "kind" else F.lit(None)).cast(t).alias(n) for n, t in names])
    first = shaped(trees.segments.join(heads, "grp").withColumn("at", F.lit(0)), 0)
    rows = first.unionByName(shaped(_outer(trees).withColumnRenamed("idx", "at"), 1)).unionByName(shaped(trees.leaves, 2))
    return rows.repartitionById(trees.n_parts, F.col("part")).sortWithinPartitions("part", "grp", "kind", "at").mapInArrow(lean(run), ddl)


def field(c: Column | str) -> Column:
    """One field of a leaf: - for null, else its bytes, a colon and the value."""
    text = (F.col(c) if isinstance(c, str) else c).cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column | str) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]), 256)


def _group(source: Column) -> Column:
    """Sources as texts that sort as they do, null first."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def manifest(docs: DataFrame, changed: Column | None = None) -> DataFrame:
    """Per document: doc_id, leaf, subroot (of its source), root, proof_sha256, folded_root and verified, against the leaf of the changed text, if one is given.

    Leaves of a source ascend by doc_id (null first; of equal ids by digest), subroots by source (null first, bytewise). A null field is `-`, an empty one `0:`. Repeated rows are leaves of their own.
    Other columns are left alone, whatever their names. An empty table gives no rows. Texts are hashed in the JVM and never shuffled, so their length doesn't matter.
    """
    row = only(docs, "doc_id", "source", "lang", "n_chars", "text")
    rest = ["doc_id", "source", "lang", "n_chars"]
    found = F.lit(None).cast("string") if changed is None else leaf_digest(*rest, changed)
    leaves = row.select(_group(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest(*rest, "text").alias("digest"), found.alias("found"))
    leaves = leaves.withColumn("found", F.when(F.col("found") != F.col("digest"), F.col("found")))
    trees = forest(leaves, ["doc_id", "digest"])
    subroots = written(trees.roots, "subroots")
    tops = forest(subroots.select(F.lit("").alias("grp"), F.col("grp").alias("name"), "digest"), ["name"], rows=subroots.count())

    def step_lists(head: dict, leaf: dict, steps: list, rest: str) -> tuple:
        return leaf["name"], leaf["digest"], head["root"], [a for a, _ in steps], [b for _, b in steps]

    path_out = [("grp", pa.string()), ("subroot", pa.string()), ("root", pa.string()), ("lefts", pa.list_(pa.string())), ("rights", pa.list_(pa.string()))]
    heads = _walked(tops, tops.roots.withColumnRenamed("digest", "root"), [("name", "string")], step_lists, path_out, "grp string, subroot string, root string, lefts array<string>, rights array<string>")

    def verdict(head: dict, leaf: dict, steps: list, rest: str) -> tuple:
        root = folded(leaf["found"] or leaf["digest"], steps)
        return leaf["doc_id"], leaf["digest"], head["subroot"], head["root"], digest_of(rest), root, root == head["root"]

    out = [("doc_id", pa.int64()), *[(n, pa.string()) for n in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], ("verified", pa.bool_())]
    return _walked(trees, written(heads, "paths"), [("doc_id", "long"), ("found", "string")], verdict, out, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def node_records(docs: DataFrame) -> DataFrame:
    """The manifest itself: source, level (from 1), idx and digest of every node of the sources' trees above the leaves; a source of one document has none. Nulls, ties and repeats as in manifest()."""
    row = only(docs, "doc_id", "source", "lang", "n_chars", "text")
    leaves = row.select(_group(F.col("source")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_digest("doc_id", "source", "lang", "n_chars", "text").alias("digest"))
    nodes = forest(leaves, ["doc_id", "digest"], records=True).nodes
    return nodes.select(F.expr("case when grp <> '' then substr(grp, 2) end").alias("source"), "level", "idx", "digest")


def without_breaks() -> Column:
    """The text as tampering leaves it: no line breaks where the checksum of doc_id is even."""
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, checked against texts of which some have lost their line breaks. Nulls, ties, repeats and empty tables as in manifest(); a null doc_id isn't tampered with."""
    return manifest(table(spark, sf_dir, "documents"), without_breaks())


_FIELDS = "CASE WHEN {0} IS NULL THEN '-' ELSE strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR) END"
_LEAF = " || ".join(_FIELDS.format(c) for c in ("doc_id", "source", "lang", "n_chars"))

#: The same in SQL: trees and paths level by level, the checksum bit by bit.
ORACLE = f"""
WITH RECURSIVE crc AS (SELECT DISTINCT doc_id, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, strlen(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ord(substr(CAST(doc_id AS VARCHAR), CAST(k AS INTEGER), 1)) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295) AS c FROM documents WHERE doc_id IS NOT NULL),
hashed AS (SELECT d.doc_id, source, sha256({_LEAF.replace('doc_id', 'd.doc_id')} || {_FIELDS.format('text')}) AS leaf,
    sha256({_LEAF.replace('doc_id', 'd.doc_id')} || CASE WHEN text IS NULL THEN '-' WHEN c % 2 = 0 THEN strlen(replace(text, chr(10), '')) || ':' || replace(text, chr(10), '') ELSE strlen(text) || ':' || text END) AS found
    FROM documents d LEFT JOIN crc ON crc.doc_id = d.doc_id),
leaves AS (SELECT *, coalesce('=' || source, '') AS grp, row_number() OVER (PARTITION BY source ORDER BY d.doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM hashed d),
tree AS (SELECT 0 AS lvl, grp, i, leaf AS h, n FROM leaves
    UNION ALL SELECT lvl + 1, grp, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM tree WHERE n > 1 GROUP BY lvl, grp, i // 3, n),
subs AS (SELECT grp, h, row_number() OVER (ORDER BY encode(grp)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lvl, i, h, n FROM subs UNION ALL SELECT lvl + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY lvl, i // 3, n),
runs AS (SELECT lvl, grp, i // 3 AS r, list(h ORDER BY i) AS hs FROM tree WHERE n > 1 GROUP BY 1, 2, 3),
top_runs AS (SELECT lvl, i // 3 AS r, list(h ORDER BY i) AS hs FROM top WHERE n > 1 GROUP BY 1, 2),
walk AS (SELECT i AS id, 0 AS lvl, grp, i, n, found AS h, '' AS proof FROM leaves
    UNION ALL SELECT id, w.lvl + 1, w.grp, i // 3, (n + 2) // 3, sha256(array_to_string(list_transform(range(1, len(hs) + 1), lambda k: CASE WHEN k = i % 3 + 1 THEN h ELSE hs[k] END), '')),
      proof || array_to_string(list_filter(hs, lambda x, k: k <> i % 3 + 1), '') FROM walk w JOIN runs r ON r.lvl = w.lvl AND r.grp = w.grp AND r.r = w.i // 3 WHERE n > 1),
climb AS (SELECT id, 0 AS lvl, s.i, s.n, w.h, proof, w.grp FROM walk w JOIN subs s ON s.grp = w.grp WHERE w.n = 1
    UNION ALL SELECT id, c.lvl + 1, i // 3, (n + 2) // 3, sha256(array_to_string(list_transform(range(1, len(hs) + 1), lambda k: CASE WHEN k = i % 3 + 1 THEN h ELSE hs[k] END), '')),
      proof || array_to_string(list_filter(hs, lambda x, k: k <> i % 3 + 1), ''), grp FROM climb c JOIN top_runs r ON r.lvl = c.lvl AND r.r = c.i // 3 WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, c.h AS folded_root, c.h = t.h AS verified
FROM leaves l JOIN climb c ON c.grp = l.grp AND c.id = l.i AND c.n = 1 JOIN subs s ON s.grp = l.grp JOIN top t ON t.n = 1"""
