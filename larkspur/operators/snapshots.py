"""Snapshots of tables in buckets of their keys, with order-free checksums on several levels, and the differences between two of them.

Equal tables have equal checksums whatever the order and files of their rows. Two snapshots are compared from the top: only children of groups that differ are looked at, and of the rows only the buckets that
differ are read again, as the rows are stored by bucket.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Children of a node, and levels below the whole table. 4096 buckets; more levels for tables of which one bucket is too much to read again.
FAN_OUT, DEPTH = 16, 3


def row_hash(columns: list[str]) -> Column:
    """64 bits of a row that tell nulls from values, and one null from another."""
    return F.xxhash64(*[x for c in sorted(columns) for x in (F.col(f"`{c}`").isNull(), F.col(f"`{c}`"))])


def _sums(rows: DataFrame, by: list[Column]) -> DataFrame:
    """n_rows and two checksums of each group, from n_rows, total and mix of parts."""
    return rows.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.sum("total").cast("decimal(38,0)").alias("total"), F.bit_xor("mix").alias("mix"))


def take_snapshot(df: DataFrame, keys: list[str], path: str, depth: int = DEPTH) -> None:
    """Writes the rows (path/rows) and the checksums of all levels (path/sums): level 0 is the whole table, level `depth` has FAN_OUT ** depth buckets. Null keys are keys too; a table may be empty.

    Rows are in a folder for each node of level 1, in files that are in the order of buckets, so that a scan for a few buckets skips other folders, files and row groups.
    """
    bucket = F.pmod(F.xxhash64(*[x for k in keys for x in (F.col(f"`{k}`").isNull(), F.col(f"`{k}`"))]), F.lit(FAN_OUT**depth)).cast("int")
    placed = df.withColumn("_bucket", bucket).withColumn("_top", F.floor(F.col("_bucket") / FAN_OUT ** (depth - 1)).cast("int"))
    df.limit(0).coalesce(1).write.parquet(f"{path}/schema")  # for tables without rows
    placed.repartitionByRange("_bucket").sortWithinPartitions("_bucket").write.partitionBy("_top").parquet(f"{path}/rows")
    spark = df.sparkSession
    rows = spark.read.schema(placed.schema).parquet(f"{path}/rows")
    sums = rows.select(F.col("_bucket").alias("node"), row_hash(df.columns).alias("h")).groupBy("node").agg(F.count("*").alias("n_rows"), F.sum(F.col("h").cast("decimal(38,0)")).cast("decimal(38,0)").alias("total"), F.bit_xor("h").alias("mix"))
    above = F.expr(f"cast(node div cast(pow({FAN_OUT}, {depth} - level) as bigint) as int)")
    spread = sums.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("node", above)  # a row for each bucket and level
    _sums(spread, [F.col("level"), F.col("node")]).write.partitionBy("level").parquet(f"{path}/sums")


def _level(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("node int, n_rows long, total decimal(38,0), mix long, level int").parquet(f"{path}/sums").where(F.col("level") == level).drop("level")


def differing_buckets(spark: SparkSession, a: str, b: str, depth: int = DEPTH) -> list[int]:
    """The buckets in which two snapshots differ: level by level, children of differing nodes only. At most FAN_OUT ** depth numbers."""
    nodes: list[int] | None = None
    for level in range(depth + 1):
        sides = [_level(spark, p, level) for p in (a, b)]
        if nodes is not None:
            sides = [s.where(F.floor(F.col("node") / FAN_OUT).isin(nodes)) for s in sides]
        x, y = sides[0].alias("x"), sides[1].alias("y")
        same = reduce(and_, [F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}")) for c in ("n_rows", "total", "mix")])
        found = x.join(y, F.col("x.node") == F.col("y.node"), "full_outer").where(~same).select(F.coalesce("x.node", "y.node")).collect()
        nodes = sorted(r[0] for r in found)
        if not nodes:
            break
    return nodes or []


def bucket_rows(spark: SparkSession, path: str, buckets: list[int], depth: int = DEPTH) -> DataFrame:
    """The rows of some buckets; folders without one aren't read, nor are row groups."""
    tops = sorted({b // FAN_OUT ** (depth - 1) for b in buckets})
    kind = spark.read.parquet(f"{path}/schema").schema.add("_bucket", "integer").add("_top", "integer")
    return spark.read.schema(kind).parquet(f"{path}/rows").where(F.col("_top").isin(tops) & F.col("_bucket").isin(buckets)).drop("_bucket", "_top")


def snapshot_differences(spark: SparkSession, a: str, b: str, keys: list[str], depth: int = DEPTH) -> DataFrame:
    """The keys, kind, column_name, before and after (as texts) of all differences between two snapshots of equal columns.

    ADDED and REMOVED rows have no column_name; CHANGED has a row for each column that differs; REPEATED_KEY is a key of several rows that aren't the same rows on both sides. Null keys match each other.
    """
    buckets = differing_buckets(spark, a, b, depth)
    sides = [bucket_rows(spark, p, buckets, depth) for p in (a, b)]
    names = sides[0].columns
    if set(names) != set(sides[1].columns):
        raise ValueError("the snapshots have different columns: compare their schemas first")
    others = [c for c in names if c not in keys]

    def by_key(df: DataFrame, side: str) -> DataFrame:
        row = F.struct(*[F.col(f"`{c}`") for c in names])
        return df.groupBy(*[F.col(f"`{k}`").alias(f"{side}_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias(f"{side}_n"), F.min(row).alias(f"{side}_row"), F.sum(row_hash(names).cast("decimal(38,0)")).alias(f"{side}_h"))

    x, y = by_key(sides[0], "a"), by_key(sides[1], "b")
    both = x.join(y, reduce(and_, [F.col(f"a_{i}").eqNullSafe(F.col(f"b_{i}")) for i in range(len(keys))]), "full_outer")
    both = both.where(~(F.col("a_h").eqNullSafe(F.col("b_h")) & F.col("a_n").eqNullSafe(F.col("b_n"))))
    repeated = (F.coalesce("a_n", F.lit(0)) > 1) | (F.coalesce("b_n", F.lit(0)) > 1)
    kind = F.when(repeated, "REPEATED_KEY").when(F.col("a_n").isNull(), "ADDED").when(F.col("b_n").isNull(), "REMOVED").otherwise("CHANGED")
    text = lambda side, c: F.col(f"{side}_row")[c].cast("string")
    none = F.lit(None).cast("string")
    whole = F.array(F.struct(none.alias("column_name"), none.alias("before"), none.alias("after")))
    cells = [F.when(~F.col("a_row")[c].eqNullSafe(F.col("b_row")[c]), F.struct(F.lit(c).alias("column_name"), text("a", c).alias("before"), text("b", c).alias("after"))) for c in others]
    changed = F.array_compact(F.array(*cells)) if cells else whole
    out = both.withColumn("kind", kind).withColumn("d", F.explode(F.when(F.col("kind") == "CHANGED", changed).otherwise(whole)))
    key = [F.when(F.col("a_n").isNotNull(), F.col("a_row")[k]).otherwise(F.col("b_row")[k]).alias(k) for k in keys]
    return out.select(*key, "kind", "d.column_name", "d.before", "d.after")


def difference_report(differences: DataFrame, keys: list[str], samples: int = 3) -> DataFrame:
    """kind, column_name, n of all differences, and sample: the first differences by key, as many as asked for, as JSON."""
    group = ["kind", "column_name"]
    counted = differences.groupBy(*group).agg(F.count("*").alias("n"))
    ranked = differences.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(*keys, "before", "after"))).where(F.col("_k") <= samples)
    first = ranked.groupBy(*group).agg(F.to_json(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.struct(*keys, "before", "after").alias("d")))), lambda x: x["d"])).alias("sample"))
    a, b = counted.alias("c"), first.alias("f")
    return a.join(b, (F.col("c.kind") == F.col("f.kind")) & F.col("c.column_name").eqNullSafe(F.col("f.column_name"))).select("c.kind", "c.column_name", "n", "sample")
