"""Versions of a database, the merge job over them, and routines called from SQL."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from larkspur.plans import commands, patterns, reports, sql_surface
from larkspur.sources.store import SaveConflict, Store
from larkspur.streaming import merge_job

from .fixtures import AS_OF, database


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def test_versions_come_whole(spark, store):
    empty = store.load()
    assert empty.version == 0 and not empty.database.tables and store.versions() == []
    db = database(spark)
    first = store.save(db, empty)
    after, _ = commands.adjust_stock(first.database, 1, 1, -5, "sold", "me", AS_OF)
    second = store.save(after, first)
    assert store.versions() == [1, 2] and second.version == 2
    assert rows(second.database["inventory"]) == rows(after["inventory"]) and second.database["inventory_audit"].count() == 1
    assert rows(store.load(1).database["inventory"]) == rows(db["inventory"]) and second.database["orders"].schema == first.database["orders"].schema
    assert second.paths["orders"] == first.paths["orders"] and second.paths["inventory"] != first.paths["inventory"]


def test_a_save_that_fails_midway_leaves_the_old_state(spark, store):
    first = store.save(database(spark), store.load())
    good = first.database["inventory"].withColumn("quantity_on_hand", F.lit(0))
    broken = first.database["orders"].withColumn("status", F.when(F.col("order_id") == 7, F.raise_error(F.lit("disk full"))).otherwise(F.col("status")))
    with pytest.raises(Exception, match="disk full"):
        store.save(first.database.replaced(inventory=good, orders=broken), first)
    now = store.load()
    assert now.version == 1 and rows(now.database["inventory"]) == rows(first.database["inventory"]) and rows(now.database["orders"]) == rows(first.database["orders"])
    assert store.save(first.database.replaced(inventory=good), first).version == 2


def test_a_rule_that_fails_saves_nothing(spark, store):
    first = store.save(database(spark), store.load())
    with pytest.raises(reports.RoutineError):
        store.save(commands.adjust_stock(first.database, 1, 1, -500, "sold", "me", AS_OF)[0], first)
    assert store.versions() == [1]


def test_of_two_saves_the_second_fails(spark, store):
    first = store.save(database(spark), store.load())
    one = commands.adjust_stock(first.database, 1, 1, 1, "a", "me", AS_OF)[0]
    other = commands.adjust_stock(first.database, 1, 1, 2, "b", "me", AS_OF)[0]
    store.save(one, first)
    with pytest.raises(SaveConflict):
        store.save(other, first)
    assert store.load().database["inventory"].where("product_id = 1 and warehouse_id = 1").first().quantity_on_hand == 6


def test_vacuum_keeps_what_versions_name(spark, store):
    saved = store.save(database(spark), store.load())
    for k in range(3):
        saved = store.save(saved.database.replaced(coupons=saved.database["coupons"].withColumn("use_count", F.lit(k))), saved)
    assert store.vacuum(keep=2) == [] and store.versions() == [3, 4]  # folders are too young to go
    gone = store.vacuum(keep=2, older_than=-60)
    assert len(gone) == 2 and all(g.startswith("coupons-") for g in gone)
    assert store.load(3).database["coupons"].first().use_count == 1 and store.load().database["orders"].count() == 10


# the merge job


@pytest.fixture
def source(spark, tmp_path):
    folder = tmp_path / "changes"

    def put(*changes):
        spark.createDataFrame(list(changes), "id int, version int, v string").coalesce(1).write.mode("append").parquet(str(folder))

    put((1, 1, "a"), (2, 1, "b"), (2, 3, "c"), (None, 9, "lost"))
    return folder, put, lambda: spark.readStream.schema("id int, version int, v string").option("maxFilesPerTrigger", 1).parquet(str(folder))


def _run(stream, store, tmp_path, checkpoint="c"):
    query = merge_job.merge_job(stream(), store, "things", "id", "version", str(tmp_path / checkpoint))
    query.awaitTermination()


def test_batches_are_merged_once(spark, store, source, tmp_path):
    _, put, stream = source
    _run(stream, store, tmp_path)
    put((1, 2, "d"), (2, 2, "stale"), (3, 1, "e"), (3, 1, "e"))
    _run(stream, store, tmp_path)
    things, audit = rows(store.load().database["things"]), [tuple(r) for r in merge_job.audited(store).orderBy("batch_id").collect()]
    assert things == [(1, 2, "d"), (2, 3, "c"), (3, 1, "e")]
    assert [a[2:] for a in audit] == [(4, 2, 0, 2), (4, 1, 1, 2)] and [a[1] for a in audit] == list(range(len(audit)))
    _run(stream, store, tmp_path)  # nothing new
    _run(stream, store, tmp_path, checkpoint="lost")  # the same batches again, with the same numbers
    assert rows(store.load().database["things"]) == things and [tuple(r) for r in merge_job.audited(store).orderBy("batch_id").collect()] == audit


def test_a_batch_that_breaks_is_done_by_the_restart(spark, store, source, tmp_path, monkeypatch):
    """The job stops after the tables are written and before the version is: a restart merges the batch, once."""
    _, put, stream = source
    whole = Store._publish

    def stops(self, version, text):
        raise RuntimeError("power cut")

    monkeypatch.setattr(Store, "_publish", stops)
    with pytest.raises(Exception, match="power cut"):
        _run(stream, store, tmp_path)
    assert store.versions() == [] and merge_job.audited(store).count() == 0
    monkeypatch.setattr(Store, "_publish", whole)
    _run(stream, store, tmp_path)
    assert rows(store.load().database["things"]) == [(1, 1, "a"), (2, 3, "c")] and merge_job.audited(store).count() == 1

    def published_then_stops(self, version, text):
        whole(self, version, text)
        raise RuntimeError("power cut")

    put((1, 5, "z"))
    monkeypatch.setattr(Store, "_publish", published_then_stops)  # now the version is there, but the checkpoint doesn't know
    with pytest.raises(Exception, match="power cut"):
        _run(stream, store, tmp_path)
    monkeypatch.setattr(Store, "_publish", whole)
    _run(stream, store, tmp_path)
    assert store.versions() == [1, 2] and merge_job.audited(store).count() == 2 and (1, 5, "z") in rows(store.load().database["things"])


# SQL


@pytest.fixture(scope="module")
def db(spark):
    db = database(spark)
    sql_surface.register(db)
    return db


def test_functions_equal_the_routines(spark, db):
    month = spark.sql("SELECT * FROM monthly_sales_summary(p_month => 6, p_year => 2025)")
    assert rows(month) == rows(reports.monthly_sales_summary(db, 2025, 6)) and month.dtypes == reports.monthly_sales_summary(db, 2025, 6).dtypes
    span = date(2025, 3, 1), date(2025, 8, 1)
    assert rows(spark.sql("SELECT * FROM revenue_by_month(DATE '2025-03-01', DATE '2025-08-01')")) == rows(patterns.revenue_by_month(db, *span))
    assert spark.sql("SELECT * FROM revenue_by_month(DATE '2025-03-01', DATE '2025-03-01')").count() == 0
    for n in (1, 3):
        assert rows(spark.sql(f"SELECT * FROM top_products_per_category(DATE '2025-03-01', DATE '2025-08-01', {n})")) == rows(patterns.top_products_per_category(db, *span, n))
    joined = spark.sql("SELECT c.last_name, count(*) AS n FROM retail_customers c, LATERAL customer_orders(c.customer_id) o GROUP BY 1")
    assert {r.last_name: r.n for r in joined.collect()} == {r.last_name: r.n for r in db["orders"].join(db["customers"], "customer_id").groupBy("last_name").agg(F.count("*").alias("n")).collect()}


@pytest.mark.parametrize("given", [{}, {"min_price": 10, "max_price": 30}, {"search_text": "bol"}, {"search_text": "100%"}, {"search_text": "b\\x"}, {"search_text": ""}, {"sort_column": "SKU", "sort_dir": "desc"}, {"sort_column": "price; DROP TABLE x --", "sort_dir": "'"}, {"page_size": 2, "page_number": 2, "sort_column": "created_at"}])
def test_the_search_script_equals_the_routine(db, given):
    got = sql_surface.call(db, "search_products", as_of=str(AS_OF), **given)
    want = reports.search_products(db, AS_OF, **given)
    assert [tuple(r) for r in got.collect()] == [tuple(r) for r in want.collect()] and got.columns == want.columns


def test_scripts_refuse(spark, db):
    with pytest.raises(Exception, match="begin at 1"):
        sql_surface.call(db, "search_products", as_of=str(AS_OF), page_number=0).collect()
    with pytest.raises(Exception, match="time is needed"):
        sql_surface.call(db, "process_pending_orders").collect()
    with pytest.raises(TypeError):
        sql_surface.call(db, "search_products", order_by="x")


def test_the_processing_script_equals_the_command(spark, db):
    for given, more in (({}, {}), ({"batch_size": 1}, {"processed_date": datetime(2025, 7, 1)})):
        got = sql_surface.call(db, "process_pending_orders", as_of=str(AS_OF), **given, **{k: str(v) for k, v in more.items()})
        assert rows(got) == rows(commands.process_pending_orders(db, AS_OF, **given, **more)[1])
