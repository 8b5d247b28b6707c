"""The fifteen reporting patterns.

One definition of revenue holds in all of them: orders that are neither cancelled nor refunded, by their total, in [start, end). Money is decimal and
divided before it is rounded; empty periods are 0 and growth from 0 is null; every order of rows ends with a unique key.
RP-01 and RP-05 have given columns; the columns and edge cases of the others are specified in their docstrings.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import full_name, money, week_begin, zero_money
from ..operators.ordered import exact_percentiles, running_sums
from ..operators.relational import spine
from ..sources.catalog import Database
from .reports import line_revenue

EXCLUDED = ("Cancelled", "Refunded")


def _day(d: date) -> Column:
    return F.lit(str(d)).cast("timestamp_ntz")


def local_time(ts: Column, zone: str | None) -> Column:
    """UTC as the report's local time."""
    return ts if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), ts)


def revenue_orders(db: Database, start: date, end: date, zone: str | None = None) -> DataFrame:
    """The single definition of revenue: order_id, customer_id, created_at (local to the zone), total_amount."""
    at = local_time(F.col("created_at"), zone)
    return db["orders"].where((at >= _day(start)) & (at < _day(end)) & ~F.col("status").isin(*EXCLUDED)).select("order_id", "customer_id", at.alias("created_at"), "total_amount")


def revenue_lines(db: Database, start: date, end: date) -> DataFrame:
    """Lines of revenue_orders() with category, sku and revenue."""
    lines = db["order_lines"].select("order_id", "product_id", "quantity", line_revenue().alias("revenue"))
    return lines.join(revenue_orders(db, start, end), "order_id").join(db["products"].select("product_id", "category", "sku"), "product_id")


def _month(c: str = "created_at") -> Column:
    return F.trunc(c, "month")


def _ratio(part: Column, whole: Column, scale: int = 100, digits: int = 2) -> Column:
    """part * scale / whole, rounded last; null for a whole of 0."""
    return F.round(part * F.lit(scale).cast("decimal(5,0)") / F.nullif(whole, F.lit(0)), digits).cast("decimal(19,4)")


def revenue_by_month(db: Database, start: date, end: date, zone: str | None = None, unit: str = "month") -> DataFrame:
    """RP-01: period_start, order_count, revenue of every month (or week, quarter, day) in the range; empty ones are 0."""
    orders = revenue_orders(db, start, end, zone)
    period = F.trunc("created_at", unit) if unit != "day" else F.col("created_at").cast("date")
    sums = orders.groupBy(period.alias("period_start")).agg(F.count("total_amount").cast("int").alias("order_count"), F.sum("total_amount").alias("revenue"))
    rows = spine(db.spark, start, end, unit).join(sums, "period_start", "left")
    return rows.select("period_start", F.coalesce("order_count", F.lit(0)).alias("order_count"), money(F.coalesce("revenue", zero_money())).alias("revenue")).orderBy("period_start")


def revenue_by_week(db: Database, start: date, end: date, first_day: str = "monday") -> DataFrame:
    """RP-01 by week, the week begun on the named day: period_start, order_count, revenue; weeks without orders are 0."""
    weekly = revenue_orders(db, start, end).groupBy(week_begin(F.col("created_at"), first_day).alias("period_start")).agg(F.count("*").cast("int").alias("order_count"), money(F.sum("total_amount")).alias("revenue"))
    weeks = spine(db.spark, start, end, "week", first_day).join(weekly, "period_start", "left")
    return weeks.select("period_start", F.coalesce("order_count", F.lit(0)).alias("order_count"), F.coalesce("revenue", zero_money()).alias("revenue")).orderBy("period_start")


def category_revenue(db: Database, start: date, end: date) -> DataFrame:
    """RP-02: category (trimmed, lower case; null is unknown), units, revenue, share_pct of all revenue (null if there is none)."""
    name = F.coalesce(F.lower(F.trim("category")), F.lit("unknown"))
    rows = revenue_lines(db, start, end).groupBy(name.alias("category")).agg(F.sum("quantity").cast("bigint").alias("units"), money(F.sum("revenue")).alias("revenue"))
    total = rows.agg(F.sum("revenue").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("category", "units", "revenue", _ratio(F.col("revenue"), F.col("total")).alias("share_pct")).orderBy(F.desc("revenue"), "category")


def running_revenue(db: Database, start: date, end: date, months: int = 3) -> DataFrame:
    """RP-03: period_start, revenue, running_total from the start, moving_avg of the last months (fewer at the start)."""
    by_time = Window.orderBy("period_start")
    rows = revenue_by_month(db, start, end)
    return rows.select(
        "period_start", "revenue", money(F.sum("revenue").over(by_time.rowsBetween(Window.unboundedPreceding, 0))).alias("running_total"), money(F.avg("revenue").over(by_time.rowsBetween(1 - months, 0))).alias("moving_avg")
    ).orderBy("period_start")


def revenue_growth(db: Database, start: date, end: date) -> DataFrame:
    """RP-04: period_start, revenue, mom_pct and yoy_pct on the gap-free series; null without, or with a zero, base."""
    by_time = Window.orderBy("period_start")
    rows = revenue_by_month(db, start, end).withColumn("last_month", F.lag("revenue", 1).over(by_time)).withColumn("last_year", F.lag("revenue", 12).over(by_time))
    growth = lambda base: _ratio(F.col("revenue") - F.col(base), F.col(base))
    return rows.select("period_start", "revenue", growth("last_month").alias("mom_pct"), growth("last_year").alias("yoy_pct")).orderBy("period_start")


def top_products_per_category(db: Database, start: date, end: date, n: int = 3) -> DataFrame:
    """RP-05: category, sku, units, rnk: the n best ranks of each category, ties kept."""
    units = revenue_lines(db, start, end).groupBy("category", "sku").agg(F.sum("quantity").cast("bigint").alias("units"))
    ranked = units.withColumn("rnk", F.dense_rank().over(Window.partitionBy("category").orderBy(F.desc("units"))).cast("bigint"))
    return ranked.where(F.col("rnk") <= n).orderBy("category", "rnk", "sku")


def customer_pareto(db: Database, start: date, end: date) -> DataFrame:
    """RP-06: customer_id, revenue, running_pct (by falling revenue, then id) and abc: A up to 80, B up to 95, else C.

    The running sum is a prefix sum over range partitions, so no task holds all customers, nor all those of one revenue.
    """
    spent = revenue_orders(db, start, end).groupBy("customer_id").agg(money(F.sum("total_amount")).alias("revenue"))
    rows = running_sums(spent, [F.desc("revenue"), F.asc("customer_id")], "revenue")
    total = rows.agg(F.sum("revenue").alias("_total"))
    running = _ratio(F.col("running").cast("decimal(28,4)"), F.col("_total"))
    rows = rows.crossJoin(F.broadcast(total)).select(F.col("customer_id").cast("int").alias("customer_id"), "revenue", running.alias("running_pct"))  # one row
    return rows.withColumn("abc", F.when(F.col("running_pct") <= 80, "A").when(F.col("running_pct") <= 95, "B").otherwise("C")).orderBy(F.desc("revenue"), "customer_id")


def order_value_stats(db: Database, start: date, end: date) -> DataFrame:
    """RP-07: one row: orders, average, median (interpolated), median_actual (a value that occurs), p90 (interpolated). Without orders 0 and nulls.

    The percentiles are exact, by histograms that are refined in a few passes: no task holds the distinct values.
    """
    orders = revenue_orders(db, start, end)
    v = F.col("total_amount")
    all_of = orders.agg(F.count("*").alias("orders"), money(F.avg(v)).alias("average"), F.count(v).alias("n"), F.min(v).alias("low"), F.max(v).alias("high")).first()
    cont, disc = exact_percentiles(orders, "total_amount", [0.5, 0.9], [0.5], all_of["n"], all_of["low"], all_of["high"])
    row = (all_of["orders"], all_of["average"], cont[0], None if disc[0] is None else float(disc[0]), cont[1])
    one = db.spark.createDataFrame([row], "orders long, average decimal(19,4), median double, median_actual double, p90 double")
    return one.withColumns({c: F.round(c, 4) for c in ("median", "median_actual", "p90")})


def order_value_percentiles(db: Database, start: date, end: date, shares: tuple[float, ...] = (0.5, 0.9), accuracy: int = 100_000) -> DataFrame:
    """RP-07 for very many orders: share, value, off by a share of 1 / accuracy at most. Each task holds a sketch and not the distinct values, as the exact form does."""
    one = revenue_orders(db, start, end).agg(F.percentile_approx("total_amount", list(shares), accuracy).alias("v"))
    return one.select(F.explode(F.arrays_zip(F.array(*[F.lit(s) for s in shares]).alias("share"), F.col("v").alias("value"))).alias("r")).select("r.share", "r.value")


def orders_by_month_status(db: Database, start: date, end: date, statuses: tuple[str, ...] = ("Pending", "Processed", "Completed", "Cancelled")) -> DataFrame:
    """RP-08: period_start, a count for each status, other and total. All orders count here, whatever their status."""
    orders = db["orders"].where((F.col("created_at") >= _day(start)) & (F.col("created_at") < _day(end)))
    counts = [F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in statuses]
    other = F.count(F.when(~F.coalesce(F.col("status").isin(*statuses), F.lit(False)), 1)).alias("other")
    rows = spine(db.spark, start, end).join(orders.groupBy(_month().alias("period_start")).agg(*counts, other, F.count("*").alias("total")), "period_start", "left")
    return rows.na.fill(0).orderBy("period_start")


def cohort_retention(db: Database, start: date, end: date) -> DataFrame:
    """RP-09: cohort_month (first order in the range), month_offset, active_customers, cohort_size, retention_pct."""
    months = revenue_orders(db, start, end).select("customer_id", _month().alias("m")).distinct()
    first = months.groupBy("customer_id").agg(F.min("m").alias("cohort_month"))
    offset = ((F.year("m") - F.year("cohort_month")) * 12 + F.month("m") - F.month("cohort_month")).cast("int")
    active = months.join(first, "customer_id").groupBy("cohort_month", offset.alias("month_offset")).agg(F.count("*").alias("active_customers"))
    size = first.groupBy("cohort_month").agg(F.count("*").alias("cohort_size"))
    return active.join(size, "cohort_month").select("cohort_month", "month_offset", "active_customers", "cohort_size", _ratio(F.col("active_customers").cast("decimal(19,0)"), F.col("cohort_size").cast("decimal(19,0)")).alias("retention_pct")).orderBy("cohort_month", "month_offset")


def stock_as_of(db: Database, day: date) -> DataFrame:
    """RP-10: product_id, warehouse_id, quantity, as_of_audit: the last audited quantity of each place before the end of the day; never a sum over days."""
    audit = db["inventory_audit"].where(F.col("adjusted_at") < F.date_add(F.lit(str(day)).cast("date"), 1).cast("timestamp_ntz"))
    last = audit.groupBy("product_id", "warehouse_id").agg(F.max_by(F.struct("new_qty", "audit_id"), F.struct("adjusted_at", "audit_id")).alias("last"))
    return last.select("product_id", "warehouse_id", F.col("last.new_qty").alias("quantity"), F.col("last.audit_id").alias("as_of_audit")).orderBy("product_id", "warehouse_id")


def funnel(events: DataFrame, steps: tuple[str, ...], user: str = "user_id", kind: str = "event_type", at: str = "ts") -> DataFrame:
    """RP-11: step, name, users, pct_of_first: users who did all steps up to this one, each no earlier than the one before. Steps without users are 0; events without a user count nowhere."""
    did = lambda s: events.where((F.col(kind) == s) & F.col(user).isNotNull()).select(F.col(user).alias("_user"), F.col(at).alias("_at"))
    reached = did(steps[0]).groupBy("_user").agg(F.min("_at").alias("_since")).where("_since is not null")
    counts = reached.agg(F.count("*").alias("n0"))
    for i, s in enumerate(steps[1:], 1):  # of each user only the first time at each step is held
        reached = did(s).join(reached, "_user").where("_at >= _since").groupBy("_user").agg(F.min("_at").alias("_since"))
        counts = counts.crossJoin(F.broadcast(reached.agg(F.count("*").alias(f"n{i}"))))  # one row
    rows = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(s).alias("name"), F.col(f"n{i}").alias("users"), F.col("n0").alias("first")) for i, s in enumerate(steps)]))
    return counts.select(rows.alias("r")).select("r.step", "r.name", "r.users", _ratio(F.col("r.users").cast("decimal(19,0)"), F.col("r.first").cast("decimal(19,0)")).alias("pct_of_first")).orderBy("step")


def customer_activity_streaks(db: Database, start: date, end: date) -> DataFrame:
    """RP-12: customer_id, streak_months, streak_start, streak_end: the longest run of months with orders (the earliest of equal ones)."""
    months = revenue_orders(db, start, end).select("customer_id", _month().alias("m")).distinct()
    index = F.year("m") * 12 + F.month("m")
    island = months.withColumn("g", index - F.row_number().over(Window.partitionBy("customer_id").orderBy("m")))
    runs = island.groupBy("customer_id", "g").agg(F.count("*").cast("int").alias("n"), F.min("m").alias("a"), F.max("m").alias("b"))
    best = runs.groupBy("customer_id").agg(F.max_by(F.struct("n", "a", "b"), F.struct("n", -F.col("g"))).alias("r"))
    return best.select(F.col("customer_id").cast("int").alias("customer_id"), F.col("r.n").alias("streak_months"), F.col("r.a").alias("streak_start"), F.col("r.b").alias("streak_end")).orderBy(F.desc("streak_months"), "customer_id")


def revenue_rollup(db: Database, start: date, end: date) -> DataFrame:
    """RP-13: level (product, category, total by grouping()), category, sku, units, revenue. A null category at level product is a real one."""
    rows = revenue_lines(db, start, end).rollup("category", "sku").agg(F.grouping("category").alias("gc"), F.grouping("sku").alias("gs"), F.sum("quantity").cast("bigint").alias("units"), money(F.sum("revenue")).alias("revenue"))
    level = F.when(F.col("gc") == 1, "total").when(F.col("gs") == 1, "category").otherwise("product")
    return rows.select(level.alias("level"), "category", "sku", "units", "revenue").orderBy("gc", "category", "gs", "sku")


def customer_first_last_order(db: Database, start: date, end: date) -> DataFrame:
    """RP-14: customer_id, customer_name, first and last order (id, date, amount); ties of time go by order id."""
    first, last = (f(F.struct("order_id", "created_at", "total_amount"), F.struct("created_at", "order_id")) for f in (F.min_by, F.max_by))
    ends = revenue_orders(db, start, end).groupBy("customer_id").agg(first.alias("f"), last.alias("l"), F.count("*").alias("orders"))
    pick = lambda k: [F.col(f"{k}.order_id").cast("int").alias(f"{'first' if k == 'f' else 'last'}_order_id"), F.col(f"{k}.created_at").cast("date").alias(f"{'first' if k == 'f' else 'last'}_order_date"), F.col(f"{k}.total_amount").alias(f"{'first' if k == 'f' else 'last'}_amount")]
    return ends.join(db["customers"].select("customer_id", full_name().alias("customer_name")), "customer_id").select(F.col("customer_id").cast("int").alias("customer_id"), "customer_name", *pick("f"), *pick("l"), "orders").orderBy("customer_id")


def order_value_histogram(db: Database, start: date, end: date, width: int = 100) -> DataFrame:
    """RP-15: bucket_from, bucket_to (not included), orders, from the bucket of 0 to that of the largest order; empty ones are 0. The largest bucket is looked up first, and the buckets are a distributed range."""
    counts = revenue_orders(db, start, end).groupBy(F.floor(F.col("total_amount") / width).cast("bigint").alias("b")).agg(F.count("*").alias("orders"))
    top = counts.agg(F.max("b")).first()[0]
    every = db.spark.range(0 if top is None else max(top + 1, 0)).select(F.col("id").alias("b"))
    return every.join(counts, "b", "left").select((F.col("b") * width).alias("bucket_from"), ((F.col("b") + 1) * width).alias("bucket_to"), F.coalesce("orders", F.lit(0)).alias("orders")).orderBy("bucket_from")


def as_json(report: DataFrame) -> DataFrame:
    """A report of bounded size as one JSON array, in its rows' order of text."""
    return report.agg(F.to_json(F.sort_array(F.collect_list(F.struct(*report.columns)))).alias("report"))
