"""What queries read: the tables and columns of Spark's own plans, and a check of them against a schema.

A DataFrame's physical plan is made, not run: after column pruning each file scan names its folder and the columns that it must read.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _leaves(plan) -> list:
    """Leaf operators of a physical plan, those of its subqueries too."""
    out, nodes = [], [plan]
    while nodes:
        node = nodes.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            nodes.append(node.initialPlan())  # as planned, before it runs
            continue
        below = [seq.apply(i) for seq in (node.children(), node.subqueries()) for i in range(seq.size())]
        nodes += below
        if node.children().isEmpty():
            out.append(node)
    return out


def _tables(relation) -> set[str]:
    paths = relation.location().rootPaths()
    return {paths.apply(i).getName().split(".")[0] for i in range(paths.size())}


def _logical_scans(plan) -> list[tuple[str, tuple[str, ...]]]:
    """The same of a logical plan (what is run again and again by a recursion is kept as such): the columns that any step above a table mentions."""
    nodes, seen, used = [plan], [], set()
    each = lambda seq: [seq.apply(i) for i in range(seq.size())]
    used |= {a.exprId().id() for a in each(plan.output())}
    while nodes:
        node = nodes.pop()
        seen.append(node)
        nodes += each(node.children())
        used |= {a.exprId().id() for a in each(node.references().toSeq())}
    found = [n for n in seen if n.getClass().getSimpleName() == "LogicalRelation" and hasattr(n.relation(), "location")]
    return [(table, tuple(a.name() for a in each(n.output()) if a.exprId().id() in used)) for n in found for table in _tables(n.relation())]


def scans(df: DataFrame) -> list[tuple[str, tuple[str, ...]]]:
    """(table, columns) of each file scan of the plan, in no order; the table is the folder's or file's name without its ending."""
    out = []
    for leaf in _leaves(df._jdf.queryExecution().executedPlan()):
        kind = leaf.getClass().getSimpleName()
        if kind == "FileSourceScanExec":
            out += [(name, tuple(leaf.requiredSchema().fieldNames())) for name in _tables(leaf.relation())]
        elif kind == "UnionLoopExec":
            out += _logical_scans(leaf.anchor()) + _logical_scans(leaf.recursion())
    return out


def columns_read(df: DataFrame) -> set[tuple[str, str]]:
    """(table, column) pairs that the query reads after pruning. A table of which only the rows are counted has the column *."""
    return {(table, c) for table, columns in scans(df) for c in columns or ("*",)}


def references(spark: SparkSession, queries: Mapping[str, DataFrame]) -> DataFrame:
    """query, table_name, column_name: what each query reads."""
    rows = [(q, t, c) for q, df in queries.items() for t, c in sorted(columns_read(df))]
    return spark.createDataFrame(rows, "query string, table_name string, column_name string")


def checked_references(refs: DataFrame, schema: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """query, table_name, column_name, expected_type, data_type, status of each reference against a schema table (table_name, column_name, data_type), before anything is run.

    RESOLVED; MISSING_TABLE; MISSING_COLUMN; or, with the types that the queries were written for (expected, another schema table), TYPE_CHANGED. The column * asks for the table alone. Names count as they are written.
    """
    keys = ["table_name", "column_name"]
    known = schema.select(*keys, "data_type").distinct()
    there = known.select("table_name").distinct().withColumn("_table", F.lit(True))
    before = known.limit(0) if expected is None else expected.select(*keys, "data_type").distinct()
    rows = refs.join(known, keys, "left").join(before.withColumnRenamed("data_type", "expected_type"), keys, "left").join(there, "table_name", "left")
    status = (
        F.when(F.col("_table").isNull(), "MISSING_TABLE").when(F.col("column_name") == "*", "RESOLVED").when(F.col("data_type").isNull(), "MISSING_COLUMN")
        .when(F.col("expected_type") != F.col("data_type"), "TYPE_CHANGED").otherwise("RESOLVED")
    )
    return rows.select("query", *keys, "expected_type", "data_type", status.alias("status"))


def conforming(compared: DataFrame) -> DataFrame:
    """The statements that would bring a target schema to its source, as a proposal: step, table_name, column_name, action, statement. compared: rows of compare_schemas().

    Missing columns are added and conflicting types changed; columns that only the target has, and unknown types, are left for a reviewer, without a statement. Nothing is run.
    """
    action = F.when(F.col("verdict") == "MISSING_TARGET", "ADD").when(F.col("verdict") == "CONFLICT", "CHANGE").when(F.col("verdict").isin("MISSING_SOURCE", "UNVERIFIED"), "REVIEW")
    alter = F.concat(F.lit("ALTER TABLE "), F.col("table_name"))
    text = F.when(F.col("action") == "ADD", F.concat(alter, F.lit(" ADD COLUMN "), F.col("column_name"), F.lit(" "), F.col("source_type"))).when(
        F.col("action") == "CHANGE", F.concat(alter, F.lit(" ALTER COLUMN "), F.col("column_name"), F.lit(" TYPE "), F.col("source_type"))
    )
    return compared.withColumn("action", action).where("action is not null").select("table_name", "column_name", "action", text.alias("statement"))


def profiled_references(refs: DataFrame, tables: Mapping[str, DataFrame]) -> DataFrame:
    """table_name, column_name, n_queries, n_rows, n_nulls of every column that is referenced and there: one scan of each table, of these columns alone."""
    wanted = refs.groupBy("table_name", "column_name").agg(F.countDistinct("query").alias("n_queries"))
    names: dict[str, list[str]] = {}
    for t, c in sorted((r.table_name, r.column_name) for r in wanted.collect()):  # names of columns, however large the tables
        if t in tables and c in tables[t].columns:
            names.setdefault(t, []).append(c)
    parts = []
    for t, columns in names.items():
        counts = tables[t].agg(F.count("*").alias("n"), *[F.count(f"`{c}`").alias(f"c{k}") for k, c in enumerate(columns)])
        entry = [F.struct(F.lit(c).alias("column_name"), (F.col("n") - F.col(f"c{k}")).alias("n_nulls")) for k, c in enumerate(columns)]
        parts.append(counts.select(F.lit(t).alias("table_name"), F.col("n").alias("n_rows"), F.explode(F.array(*entry)).alias("e")).select("table_name", "e.column_name", "n_rows", "e.n_nulls"))
    if not parts:
        return wanted.select("table_name", "column_name", "n_queries", F.lit(0).cast("long").alias("n_rows"), F.lit(0).cast("long").alias("n_nulls")).limit(0)
    return wanted.join(F.broadcast(reduce(DataFrame.unionByName, parts)), ["table_name", "column_name"]).select("table_name", "column_name", "n_queries", "n_rows", "n_nulls")
