"""Paging, predicates that are there only if asked for, spines and key allocation."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import contains_text, week_begin
from ..sources.scratch import stored
from .ordered import numbered_in_order, running_sums


def where_given(df: DataFrame, *predicates: Column | None) -> DataFrame:
    """Filters by the predicates that are given; a missing one costs nothing in the plan."""
    given = [p for p in predicates if p is not None]
    return df.where(reduce(and_, given)) if given else df


def any_contains(columns: list[str], text: str | None) -> Column | None:
    return reduce(or_, [contains_text(F.col(c), text) for c in columns]) if text is not None else None


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page in order, with row_num counted over all pages. Spark keeps offset + size rows of each task and never sorts the rest."""
    offset = (number - 1) * size
    rows = df.orderBy(*order).offset(offset).limit(size) if offset else df.orderBy(*order).limit(size)
    return rows.withColumn("row_num", (F.row_number().over(Window.orderBy(*order)) + offset).cast("bigint"))  # over one page


def with_total(df: DataFrame, paged: DataFrame) -> DataFrame:
    """total_count of all rows of df beside each row of its page."""
    return paged.crossJoin(F.broadcast(df.agg(F.count("*").alias("total_count"))))  # one row


def spine(spark: SparkSession, start: date, end: date, unit: str = "month", first_day: str = "monday") -> DataFrame:
    """period_start of every period that overlaps [start, end): no gaps. Weeks begin on first_day."""
    if start >= end:
        return spark.createDataFrame([], "period_start date")
    first, last = F.lit(start).cast("date"), F.date_sub(F.lit(end).cast("date"), 1)
    step = F.expr({"month": "interval 1 month", "quarter": "interval 3 months", "week": "interval 7 days", "day": "interval 1 day"}[unit])
    begin = first if unit == "day" else week_begin(first.cast("timestamp_ntz"), first_day) if unit == "week" else F.trunc(first, unit)
    return spark.range(1).select(F.explode(F.sequence(begin, last, step)).alias("period_start"))


def allocated(existing: DataFrame, key: str, fresh: DataFrame, order: list[Column]) -> DataFrame:
    """fresh with new keys: the largest existing key plus the place in order. Places are prefix sums over range partitions, so a batch may be of any size; it is run once, here."""
    top = existing.agg(F.coalesce(F.max(key), F.lit(0)).alias("_top"))
    kind = existing.schema[key].dataType
    return numbered_in_order(fresh, order).crossJoin(F.broadcast(top)).withColumn(key, (F.col("_top") + F.col("_n")).cast(kind)).drop("_n", "_top")  # one row


def latest_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order: deduplication in which the latest wins."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def outer_apply_first(rows: DataFrame, other: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Each row with the first row of other, in the order, that has its keys; nulls where there is none."""
    return rows.join(latest_per_key(other, keys, order), keys, "left")


def outer_apply(rows: DataFrame, other: DataFrame, keys: dict[str, str], matches: Callable[[Callable[[str], Column]], Column] | None, order: list[Column], n: int) -> DataFrame:
    """Each row with the first n rows of other, in the order, that agree with it in keys (column of rows: column of other) and for which matches(outer) holds, outer(name) being a column of the row. Nulls where there are none.

    matches may be any condition, inequalities too. Rows and other must not share column names, and there must be a key: Spark makes all pairs of a key that match before it takes the first n, so for the latest
    rows before a time latest_before() is the better way where keys are hot. Null keys match nothing.
    """
    # by an alias, as a bare name would be looked for in other's hidden columns first
    outer = lambda name: F.col(f"_rows.{name}").outer()
    # as structs the keys stay in one condition with the inequality; apart from it, Spark would pair every row with every value of the inequality's columns before it looks at keys
    agree = F.struct(*[F.col(c) for c in keys.values()]) == F.struct(*[outer(c) for c in keys])
    there = reduce(and_, [F.col(c).isNotNull() for c in keys.values()])
    found = other.where(there).where(agree if matches is None else agree & matches(outer)).orderBy(*order).limit(n)
    return rows.alias("_rows").lateralJoin(found, how="left")


def latest_before(rows: DataFrame, other: DataFrame, keys: list[str], at: str, other_at: str, n: int, tie: str) -> DataFrame:
    """Each row with the n latest rows of other that have its keys and are earlier: other's columns (nulls where there is none) and place, 1 for the latest. Of equal times the larger tie is the later.

    Both sides are put in one order of keys and time, and how many of other stand before a row is a prefix sum: a key with a third of all rows is spread over tasks, and no pairs are made but those of the result.
    A row with a null key or time has none.
    """
    k = [f"_k{i}" for i in range(len(keys))]
    names = [c for c in other.columns if c not in keys]
    left = rows.select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(at).alias("_time"), F.lit(0).alias("_is"), F.lit(None).cast(other.schema[tie].dataType).alias("_tie_by"), F.struct(*rows.columns).alias("_row"), F.lit(None).cast(other.select(F.struct(*names)).schema[0].dataType).alias("_other"))
    known = reduce(and_, [F.col(c).isNotNull() for c in [*keys, other_at]])
    right = other.where(known).select(*[F.col(c).alias(a) for c, a in zip(keys, k)], F.col(other_at).alias("_time"), F.lit(1).alias("_is"), F.col(tie).alias("_tie_by"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.struct(*names).alias("_other"))
    both = running_sums(left.unionByName(right), [*[F.asc(c) for c in k], F.asc("_time"), F.asc("_is"), F.asc("_tie_by")], "_is", "_seen").withColumn("_seen", F.col("_seen").cast("long"))
    asking = both.where("_is = 0").withColumn("_no", F.monotonically_increasing_id())
    asking = stored(asking.select("_no", *k, "_time", "_seen", "_row"), "asking")
    wanted = asking.where(F.col("_time").isNotNull() & (F.col("_seen") > 0)).select("_no", *k, F.posexplode(F.sequence(F.col("_seen"), F.greatest(F.col("_seen") - n + 1, F.lit(1)), F.lit(-1))).alias("place", "_seen"))
    found = wanted.join(both.where("_is = 1").select(*k, "_seen", "_other"), [*k, "_seen"]).select("_no", (F.col("place") + 1).alias("place"), "_other")
    return asking.join(found, "_no", "left").select("_row.*", "place", *[F.col("_other")[c].alias(c) for c in names])


def matching(df: DataFrame, column: str, pattern: str) -> DataFrame:
    """The rows of which a part of the column matches the regular expression."""
    return df.where(F.col(column).rlike(pattern))
