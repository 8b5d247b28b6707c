"""Checks of keys, schemas and snapshots, as DataFrames."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import FOREIGN_KEYS, PRIMARY_KEYS, UNIQUE_KEYS
from ..sources.catalog import Database
from .snapshots import row_hash


def key_violations(df: DataFrame, keys: list[str], nulls_violate: bool = True) -> DataFrame:
    """Keys that stand more than once, or (if asked) hold a null: the keys and n."""
    some_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    counted = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counted.where(((F.col("n") > 1) & ~some_null) | (some_null & F.lit(nulls_violate)))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of child whose column is set but has no parent."""
    return child.where(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def integrity(db: Database) -> DataFrame:
    """One row for each rule of the model: rule, table_name, violations.

    A primary key is violated once by each value that stands more than once or holds a null, a unique column by each value (but null) that does, a foreign key by each row
    whose value has no parent; tables that aren't there are empty. Each table that is there is read once for all rules it takes part in, and all values meet in one shuffle, counted before it.
    """
    rules: list[tuple[str, str]] = []
    values: dict[str, list[Column]] = {}

    def seen(rule: int, table: str, columns: list[str], by: str, nulls_count: bool = False) -> None:
        unset = reduce(or_, [F.col(c).isNull() for c in columns])
        entry = F.struct(F.lit(rule).alias("rule"), F.to_json(F.array(*[F.col(c).cast("string") for c in columns])).alias("value"), unset.alias("unset"), *[F.lit(int(by == b)).alias(b) for b in ("own", "child", "parent")])
        values.setdefault(table, []).append(entry if nulls_count else F.when(~unset, entry))

    def rule(kind: str, name: str) -> int:
        rules.append((kind, name))
        return len(rules) - 1

    for table, keys in PRIMARY_KEYS.items():
        seen(rule("primary key", f"{table}({', '.join(keys)})"), table, keys, "own", nulls_count=True)
    for table, column in UNIQUE_KEYS:
        seen(rule("unique", f"{table}({column})"), table, [column], "own")
    for child, column, parent, key in FOREIGN_KEYS:
        k = rule("foreign key", f"{child}({column})")
        seen(k, child, [column], "child")
        seen(k, parent, [key], "parent")
    if not db.tables:
        return db.spark.createDataFrame([(*r, 0) for r in rules], "rule string, table_name string, violations long")
    found = reduce(DataFrame.unionByName, [db[t].select(F.explode(F.array_compact(F.array(*v))).alias("e")).select("e.*") for t, v in values.items() if t in db.tables])
    counted = found.groupBy("rule", "value", "unset").agg(*[F.sum(c).alias(c) for c in ("own", "child", "parent")])
    bad = F.when(F.col("own") > 0, ((F.col("own") > 1) | F.col("unset")).cast("long")).when(F.col("parent") == 0, F.col("child")).otherwise(0)
    violations = counted.groupBy("rule").agg(F.sum(bad).alias("violations"))
    names = db.spark.createDataFrame([(i, *r) for i, r in enumerate(rules)], "_rule int, rule string, table_name string")
    counts = F.broadcast(violations.withColumnRenamed("rule", "_rule"))  # a row for each rule
    return names.join(counts, "_rule", "left").select("rule", "table_name", F.coalesce("violations", F.lit(0)).cast("long").alias("violations"))


def schema_rows(spark: SparkSession, name: str, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(name, f.name, f.dataType.simpleString(), f.nullable) for f in df.schema], "table_name string, column_name string, data_type string, nullable boolean")


def compare_schemas(source: DataFrame, target: DataFrame, approved: DataFrame) -> DataFrame:
    """Each column of two snapshots (table_name, column_name, data_type): EXACT, APPROVED_TRANSFORM, MISSING_TARGET, MISSING_SOURCE, CONFLICT, UNVERIFIED.

    approved: source_type, target_type pairs. A column whose type is unknown (null) on either side is UNVERIFIED.
    """
    keys = ["table_name", "column_name"]
    both = source.select(*keys, F.col("data_type").alias("source_type"), F.lit(True).alias("_s")).join(target.select(*keys, F.col("data_type").alias("target_type"), F.lit(True).alias("_t")), keys, "full_outer")
    both = both.join(approved.select("source_type", "target_type").distinct().withColumn("_ok", F.lit(True)), ["source_type", "target_type"], "left")
    verdict = F.when(F.col("_t").isNull(), "MISSING_TARGET").when(F.col("_s").isNull(), "MISSING_SOURCE").when(F.col("source_type").isNull() | F.col("target_type").isNull(), "UNVERIFIED").when(F.col("source_type") == F.col("target_type"), "EXACT").when(F.col("_ok"), "APPROVED_TRANSFORM").otherwise("CONFLICT")
    return both.select(*keys, "source_type", "target_type", verdict.alias("verdict"))


def snapshot(df: DataFrame, keys: list[str]) -> DataFrame:
    """row_count, key_count and an order-free checksum of the rows: equal tables have equal snapshots."""
    row = row_hash(df.columns).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("row_count"), F.countDistinct(F.struct(*keys)).alias("key_count"), F.coalesce(F.sum(row), F.lit(0)).cast("string").alias("checksum"))


def differing_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, copies counted: side (a or b) and the columns."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))
