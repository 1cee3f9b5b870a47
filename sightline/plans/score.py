"""One scoring run: candidates to a scorer, scores back into the table, one ledger row."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.replies import PRICES
from ..operators import enrich, lifecycle, scoring, views
from ..schema import SCORE_RUN
from ..session import cut_lineage, shared_dir

# Rows that go to the scorer before the run looks whether to go on.
BATCH_ROWS = 500


@dataclass(frozen=True)
class ScoringResult:
    rows: DataFrame
    judged: DataFrame
    ledger: DataFrame
    skipped: DataFrame


def run_scoring(
    rows: DataFrame, scorer: scoring.Scorer, *, run_id: str, model: str, engine: str, started: datetime,
    job_ids: DataFrame | None = None, only_unscored: bool = True, max_jobs: int | None = None,
    batch_rows: int = BATCH_ROWS, should_stop: Callable[[], bool] | None = None, prices=PRICES,
) -> ScoringResult:
    """Score the newest candidates and write the scores; statuses stay as they are.

    A failed row is counted and passed over. The first auth or budget error ends the run: scores
    before it are kept, rows after it are left for the next run. Rows go to the scorer newest first,
    in batches of `batch_rows`, and no batch is sent once one has failed for good or `should_stop`
    says so, whether the run is capped by `max_jobs` or not.
    """
    pool = rows if job_ids is None else enrich.only_ids(rows, job_ids)
    picked = views.numbered(views.candidates(pool, only_unscored, max_jobs), views.newest_first())
    # Written by batch, so that a batch reads its own rows only.
    place = F.col("place") - 1
    path = shared_dir(rows.sparkSession, "candidates")
    picked = picked.withColumns({"seq": place, "batch": F.floor(place / batch_rows)}).drop("place")
    picked.write.partitionBy("batch").parquet(path)
    picked = rows.sparkSession.read.schema(picked.schema).parquet(path)

    halted, parts = False, []
    last = picked.agg(F.max("batch").alias("b")).first()["b"]
    for number in range(0 if last is None else last + 1):
        if should_stop and should_stop():
            halted = True
            break
        batch = picked.filter(F.col("batch") == number).drop("batch")
        part = cut_lineage(scoring.score_batch(batch, scorer, prices), "scored")
        parts.append(part)
        if not part.filter(F.col("outcome").isin("auth", "budget")).isEmpty():
            break
    picked = picked.drop("batch")
    if not parts:
        parts = [scoring.score_batch(picked.filter(F.lit(False)), scorer, prices)]
    judged = reduce(DataFrame.unionByName, parts).withColumn("run_id", F.lit(run_id))

    kept = scoring.cut_off(judged).filter(F.col("outcome") == "scored").select(
        "job_id", "score", F.col("reason").alias("eval_reason"), F.lit(f"{engine}:{model}").alias("engine"),
        F.lit(started).alias("evaluated_at"))
    return ScoringResult(
        lifecycle.apply_scores(rows, kept), judged,
        _ledger(picked, judged, run_id, model, engine, started, halted),
        views.skipped(pool, only_unscored, max_jobs))


def _ledger(picked, judged, run_id, model, engine, started, halted) -> DataFrame:
    """One row, also for a run that scored nothing."""
    summary = scoring.run_summary(judged, halted=F.lit(halted)).drop("jobs", "note")
    row = picked.agg(F.count("*").alias("jobs")).withColumn("run_id", F.lit(run_id)).join(summary, "run_id", "left")
    count = lambda c: F.coalesce(c, F.lit(0))
    note = (F.when(F.col("auth_failed"), "auth failed").when(F.col("budget_hit"), "rate/usage limit")
            .when(F.lit(halted), "halted").otherwise(""))
    values = {
        "stage": F.lit("triage"), "model": F.lit(model), "engine": F.lit(engine), "started_at": F.lit(started),
        "finished_at": F.current_timestamp(), "budget_hit": F.coalesce("budget_hit", F.lit(False)), "note": note,
        **{c: count(F.col(c)) for c in ("scored", "errors", "cost_usd", *scoring.TOKENS)},
    }
    return row.select(*[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in SCORE_RUN.fields])
