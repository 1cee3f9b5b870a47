"""Micro-batches merged into the stored table, and alerts about new rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.merge import expire_by_scans, merge_log
from ..operators.views import digest
from ..plans.snapshot import SnapshotTable


def merge_batches(
    table: SnapshotTable, hours: int, priority: Sequence[str], stream: str = "merge",
) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function: merge a batch of identified sightings, then expire and commit.

    A batch may hold any number of scans; batches have to come in time order. The batch is reduced
    by partial aggregation, so no key has to fit one task. The version carries the batch number, so
    a batch that comes again after a failure is passed over.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        token = f"{stream}:{batch_id}"
        if batch.isEmpty() or table.has(token):
            return
        rows = merge_log(table.read_open(), batch, hours, priority)
        scans = batch.select("source", F.col("fetched_at").alias("scan_ts"))
        rows = expire_by_scans(rows.drop("change"), scans, hours)
        clock = batch.agg(F.max("fetched_at").alias("t")).first()["t"]
        table.commit_scan(rows, clock, hours, token)
    return run


def alert_batches(path: str) -> Callable[[DataFrame, int], None]:
    """`foreachBatch` function: a digest of the `new` events of each batch, one folder per batch.

    The folder is named by the batch and overwritten, so a replayed batch gives no second alert.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        new = batch.filter(F.col("kind") == "new").select(
            F.col("key").alias("job_id"), F.col("key").alias("title"), "first_seen",
            F.col("cities").alias("locations"), F.lit(None).cast("double").alias("score"),
            *[F.lit(None).cast("string").alias(c)
              for c in ("company", "location", "currency", "source", "url", "eval_reason")],
            *[F.lit(None).cast("double").alias(c) for c in ("salary_min", "salary_max")])
        digest(new).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return run
