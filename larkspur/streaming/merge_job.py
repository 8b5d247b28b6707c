"""The merge job: batches of changes merged into a stored table, each batch once.

The table, the counts of the batch and the number of the batch become one version of the store together. A batch that comes again, after a restart or with a lost checkpoint, is known by its number and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.commands import merge_latest
from ..sources.store import Store

AUDIT = "merge_audit"
AUDIT_SCHEMA = "job string, batch_id long, changes long, inserted long, updated long, ignored long"


def merge_batch(store: Store, table: str, key: str, version: str, changes: DataFrame, job: str, batch_id: int) -> bool:
    """Merges one batch, the latest version of each key winning, and writes its counts to merge_audit; False, and nothing done, for a batch that is in the store already.

    Changes with a null key, older ones of a key, and those that aren't newer than the row they meet are counted as ignored. The first batch makes the table.
    """
    before = store.load()
    if before.batches.get(job, -1) >= batch_id:
        return False
    held = changes.persist()
    try:
        target = before.database.tables.get(table, held.limit(0))
        after, actions = merge_latest(target, held, key, version)
        done = {r["action"]: r["count"] for r in actions.collect()}  # two rows at most
        read = held.count()
        inserted, updated = done.get("INSERT", 0), done.get("UPDATE", 0)
        row = store.spark.createDataFrame([(job, batch_id, read, inserted, updated, read - inserted - updated)], AUDIT_SCHEMA)
        audit = before.database.tables[AUDIT].unionByName(row) if AUDIT in before.database.tables else row
        store.save(before.database.replaced(**{table: after, AUDIT: audit}), before, **{job: batch_id})
    finally:
        held.unpersist()
    return True


def merge_job(changes: DataFrame, store: Store, table: str, key: str, version: str, checkpoint: str, job: str = "merge") -> StreamingQuery:
    """Starts the job over a stream of changes: all that is there now, then it ends. Started again with the same checkpoint it goes on; its batches have the numbers that the checkpoint gives them."""
    run = lambda batch, number: merge_batch(store, table, key, version, batch, job, number)
    return changes.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def audited(store: Store) -> DataFrame:
    """job, batch_id, changes, inserted, updated, ignored of all batches so far."""
    tables = store.load().database.tables
    return tables[AUDIT] if AUDIT in tables else store.spark.createDataFrame([], AUDIT_SCHEMA).select(*[F.col(c.split()[0]) for c in AUDIT_SCHEMA.split(", ")])
