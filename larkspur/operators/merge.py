"""MERGE on immutable tables: an outer join on the key, and the first clause that holds decides each row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Clause:
    """when: matched, not_matched (by target) or not_matched_by_source. sets: columns to change (an insert gives all it has; the rest is null)."""

    when: str
    action: str
    sets: dict[str, Column] = field(default_factory=dict)
    condition: Column | None = None


def merged(target: DataFrame, source: DataFrame, on: str, clauses: list[Clause]) -> DataFrame:
    """All rows of the new target, with merge_action (INSERT, UPDATE, DELETE, or null for untouched). Columns of the source are s_<name> in conditions and sets.

    A null key never matches. Rows that a DELETE takes are still there, marked; drop them, and merge_action, to get the table. Of a target row that several source rows
    match, each match gives a row: deduplicate the source before.
    """
    s = source.select([F.col(c).alias(f"s_{c}") for c in source.columns]).withColumn("_s", F.lit(True))
    t = target.withColumn("_t", F.lit(True))
    both = t.join(s, t[on] == s[f"s_{on}"], "full_outer")
    kind = {"matched": F.col("_t") & F.col("_s"), "not_matched": F.col("_t").isNull(), "not_matched_by_source": F.col("_s").isNull()}
    chosen = None
    for i, clause in enumerate(clauses):
        holds = F.coalesce(kind[clause.when] if clause.condition is None else kind[clause.when] & clause.condition, F.lit(False))
        chosen = F.when(holds, i) if chosen is None else chosen.when(holds, i)
    both = both.withColumn("_clause", chosen if chosen is not None else F.lit(None).cast("int"))
    both = both.where(F.col("_t").isNotNull() | F.col("_clause").isNotNull())
    columns = []
    for c in target.columns:
        value = None
        for i, clause in enumerate(clauses):
            if c in clause.sets:
                value = F.when(F.col("_clause") == i, clause.sets[c]) if value is None else value.when(F.col("_clause") == i, clause.sets[c])
        columns.append((F.col(c) if value is None else value.otherwise(F.col(c))).cast(target.schema[c].dataType).alias(c))
    action = F.lit(None).cast("string")
    for i, clause in enumerate(clauses):
        action = F.when(F.col("_clause") == i, clause.action).otherwise(action)
    return both.select(*columns, action.alias("merge_action"))


def action_summary(rows: DataFrame) -> DataFrame:
    """action, count, inserted, updated, deleted of merged() rows; untouched rows don't count."""
    n = lambda a: F.count(F.when(F.col("action") == a, 1)).cast("int")
    rows = rows.where("merge_action is not null").select(F.col("merge_action").alias("action"))
    return rows.groupBy("action").agg(F.count("*").cast("int").alias("count"), n("INSERT").alias("inserted"), n("UPDATE").alias("updated"), n("DELETE").alias("deleted")).orderBy("action")
