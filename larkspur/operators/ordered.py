"""Global orders without a global window: prefix sums over range partitions, keys by them, and exact order statistics by histograms."""

from __future__ import annotations

from decimal import Decimal
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import dealt, parts_for, stored

#: Rows before this bit of a row's number are its partition.
PART_BITS = 33
#: Bins of a histogram, and values that are few enough to be looked at one by one.
BINS, SLICE = 4096, 4096


def in_order(df: DataFrame, order: list[Column]) -> DataFrame:
    """df with _part and _at, written once: all rows of a part are before those of the next, and _at counts within it. A part is of a stated size (parts_for()). Rows that are equal in the order are dealt over parts too; which is first is left open."""
    rows, parts = df.withColumn("_tie", F.monotonically_increasing_id()), parts_for(df)
    placed = rows.repartitionByRange(*[parts] * (parts > 0), *order, F.col("_tie")).sortWithinPartitions(*order, F.col("_tie")).drop("_tie").withColumn("_id", F.monotonically_increasing_id())
    placed = stored(placed, "in-order")
    return placed.withColumns({"_part": F.shiftright("_id", PART_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << PART_BITS) - 1))}).drop("_id")


def _before(sums: DataFrame, zero) -> DataFrame:
    """_part and _before, the sum of all parts before it. sums: a row for each part, which pass the driver."""
    rows = sorted((r[0], r[1]) for r in sums.collect())
    before = [zero, *accumulate(s for _, s in rows)]
    kind = sums.schema[1].dataType.simpleString()
    return sums.sparkSession.createDataFrame([(p, b) for (p, _), b in zip(rows, before)], f"_part long, _before {kind}")


def numbered_in_order(df: DataFrame, order: list[Column], name: str = "_n") -> DataFrame:
    """df with the place of each row in the order, from 1, without gaps. A task holds a partition, however many rows there are."""
    placed = in_order(df, order)
    before = _before(placed.groupBy("_part").agg(F.count("*").alias("s")), 0)
    return placed.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def running_sums(df: DataFrame, order: list[Column], value: str, name: str = "running") -> DataFrame:
    """df with the sum of value over all rows up to each one in the order. Sums within a partition go beside the sums of the partitions before it. value is a decimal or an integer."""
    placed = in_order(df, order)
    placed = dealt(placed, parts_for(placed), "_part")
    total = F.sum(value)
    before = _before(placed.groupBy("_part").agg(F.coalesce(total, F.lit(0)).cast("decimal(38,4)").alias("s")), Decimal(0))
    within = total.over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    rows = placed.withColumn("_in", F.coalesce(within, F.lit(0)).cast("decimal(38,4)")).join(F.broadcast(before), "_part")
    return rows.withColumn(name, (F.col("_before") + F.col("_in")).cast("decimal(38,4)")).drop("_part", "_at", "_before", "_in")


def _whole(df: DataFrame, column: str) -> tuple[DataFrame, int]:
    """The column as whole numbers v, and the digits that were after the point. Nulls go."""
    kind = df.schema[column].dataType
    if not isinstance(kind, T.DecimalType | T.IntegralType) or isinstance(kind, T.DecimalType) and kind.precision + kind.scale > 36:
        raise TypeError(f"{column} is {kind.simpleString()}: exact order statistics are taken of integers, and of decimals of up to 36 digits, those after the point counted twice")
    scale = kind.scale if isinstance(kind, T.DecimalType) else 0
    v = F.col(f"`{column}`")
    if scale:
        v = v * F.lit(Decimal(10) ** scale).cast(f"decimal({scale + 1},0)")
    return df.select(v.cast("decimal(38,0)").alias("v")).where("v is not null"), scale


def order_statistics(df: DataFrame, column: str, ranks: list[int], low: Decimal, high: Decimal) -> dict[int, Decimal]:
    """The values of the given ranks (from 0) of a decimal or integer column without its nulls; low and high are its least and largest value.

    Each pass over the data counts BINS bins of the ranges in which ranks lie and keeps one bin of each, until SLICE values or one are left there: 2 or 3 passes, of which the driver sees
    a histogram for each rank. Ties are no matter, and no task or driver holds the distinct values.
    """
    values, scale = _whole(df, column)
    unit = Decimal(10) ** -scale
    found: dict[int, int] = {}
    spans = {r: (int(low / unit), int(high / unit), 0, None) for r in ranks}  # first and last value, values before it, values in it
    while todo := {r: s for r, s in spans.items() if r not in found}:
        for r, (a, b, _, _) in todo.items():
            if a == b:
                found[r] = a
        open_spans = sorted({s for r, s in todo.items() if r not in found})
        if not open_spans:
            break
        small = [s for s in open_spans if s[3] is not None and s[3] <= SLICE]
        width = {s: 1 if s in small else -(-(s[1] - s[0] + 1) // BINS) for s in open_spans}
        which, bin_of = F.lit(None).cast("int"), F.lit(None).cast("decimal(38,0)")
        for k, s in enumerate(open_spans):
            inside = (F.col("v") >= Decimal(s[0])) & (F.col("v") <= Decimal(s[1]))
            which = F.when(inside, k).otherwise(which)
            off = f"(v - cast({s[0]} as decimal(38,0)))"
            # of a small span the bins are its values, SLICE of them at most, however far apart
            bin_of = F.when(inside, F.expr(off if s in small else f"{off} div cast({width[s]} as decimal(38,0))").cast("decimal(38,0)")).otherwise(bin_of)
        counted = values.select(which.alias("k"), bin_of.alias("bin")).where("k is not null").groupBy("k", "bin").count().collect()
        for k, s in enumerate(open_spans):
            bins = sorted((int(row["bin"]), row["count"]) for row in counted if row["k"] == k)
            for r in [r for r, mine in todo.items() if mine == s and r not in found]:
                seen = s[2]
                for b, n in bins:
                    if r < seen + n:
                        first = s[0] + b * width[s]
                        spans[r] = (first, min(s[1], first + width[s] - 1), seen, n)
                        break
                    seen += n
    return {r: Decimal(v) * unit for r, v in found.items()}


def exact_percentiles(df: DataFrame, column: str, cont: list[float], disc: list[float], n: int, low: Decimal | None, high: Decimal | None) -> tuple[list[float | None], list[Decimal | None]]:
    """percentile_cont (interpolated, in floating point) and percentile_disc (a value that occurs) of a decimal or integer column of n values that are not null; nulls if there are none."""
    if not n:
        return [None] * len(cont), [None] * len(disc)
    at = [p * (n - 1) for p in cont]
    places = [max(0, ceil(p * n) - 1) for p in disc]
    value = order_statistics(df, column, sorted({r for x in at for r in (floor(x), ceil(x))} | set(places)), low, high)
    mean = lambda x: float(value[floor(x)]) if floor(x) == ceil(x) else (ceil(x) - x) * float(value[floor(x)]) + (x - floor(x)) * float(value[ceil(x)])
    return [mean(x) for x in at], [value[r] for r in places]
