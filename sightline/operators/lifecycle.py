"""Status changes. Every function returns a new snapshot; none depends on row order."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import SETTABLE

# Fixed value: board stages and the moves each one offers.
MOVES = {
    "saved": ("applied", "rejected", "new"),
    "applied": ("rejected", "new"),
    "rejected": ("saved", "new"),
}
STAGES = tuple(MOVES)


def _update(snapshot: DataFrame, changes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Overwrite `cols` (nulls included) in the rows that `changes` names, one row per job_id."""
    hit = changes.select(F.col("job_id").alias("_id"), F.struct(*cols).alias("_to"))
    joined = snapshot.join(hit, F.col("job_id") == F.col("_id"), "left")
    found = F.col("_id").isNotNull()
    return joined.select(*[
        F.when(found, F.col(f"_to.{c}")).otherwise(F.col(c)).cast(snapshot.schema[c].dataType).alias(c)
        if c in cols else F.col(c) for c in snapshot.columns
    ])


def match_verdicts(snapshot: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Verdicts by target: the last one and how many there were; unknown targets go.

    A verdict names a job_id or else a url. A url shared by several generations means the latest.
    Verdicts are first reduced to one row per target, so a target named over and over costs one row
    per task; then the two lookups are plain equi-joins.
    """
    for name, dtype in (("job_id", "string"), ("url", "string")):
        if name not in verdicts.columns:
            verdicts = verdicts.withColumn(name, F.lit(None).cast(dtype))
    given = F.nullif(F.col("job_id"), F.lit(""))
    what = F.struct(
        F.coalesce(F.nullif(F.col("status"), F.lit("")), F.lit("evaluated")).alias("status"),
        "score", "report_num")
    last = (
        verdicts.withColumn("job_id", given)
        .withColumn("url", F.when(F.col("job_id").isNull(), F.col("url")))
        .groupBy("job_id", "url")
        .agg(F.max_by(what, "seq").alias("verdict"), F.max("seq").alias("seq"), F.count("*").alias("n"))
    )
    by_id = last.filter(F.col("job_id").isNotNull()).join(
        snapshot.select("job_id"), "job_id", "left_semi")
    by_url = last.filter(F.col("job_id").isNull() & (F.col("url") != "")).drop("job_id")
    target = (
        snapshot.join(by_url.select("url"), "url", "left_semi").groupBy("url")
        .agg(F.max_by("job_id", F.struct("first_seen", "job_id")).alias("job_id"))
    )
    cols = ["job_id", "url", "verdict", "seq", "n"]
    return by_id.select(*cols).unionByName(by_url.join(target, "url").select(*cols))


def apply_verdicts(snapshot: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(snapshot, count of verdicts that hit). A verdict without score clears the stored score."""
    matched = match_verdicts(snapshot, verdicts)
    last = matched.groupBy("job_id").agg(F.max_by("verdict", "seq").alias("v")).select(
        "job_id", "v.status", "v.score", "v.report_num")
    hits = matched.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("updated"))
    return _update(snapshot, last, ["status", "score", "report_num"]), hits


def split_settable(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) status events; only a few statuses may be set directly."""
    ok = F.coalesce(F.col("status").isin(*SETTABLE), F.lit(False))
    return events.filter(ok), events.filter(~ok)


def apply_status(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """Set statuses from (job_id, status, seq); the last accepted event per job counts."""
    accepted, _ = split_settable(events)
    last = accepted.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"))
    return _update(snapshot, last, ["status"])


def update_outcomes(snapshot: DataFrame, events: DataFrame, settable: bool = True) -> DataFrame:
    """`events` with `applied`: what a single update answers. False for an id the table does not hold, or (settable)
    for a status that may not be set; a null id is never applied. The table's ids are reduced to distinct ids before
    the join, so an id named by many events costs one row of the table side."""
    ids = snapshot.select(F.col("job_id").alias("_held")).distinct()
    hit = events.join(ids, events["job_id"] == ids["_held"], "left")
    applied = F.col("_held").isNotNull()
    if settable:
        applied = applied & F.coalesce(F.col("status").isin(*SETTABLE), F.lit(False))
    return hit.withColumn("applied", applied).drop("_held")


def apply_status_and_views(snapshot: DataFrame, events: DataFrame) -> DataFrame:
    """As `apply_status`, with openings among the events (`kind` = set | open).

    Opening a listing turns `new` into `viewed` and nothing else. A set status overrides all that
    went before, so per job only the last set event and the last opening matter.
    """
    accepted, _ = split_settable(
        events.withColumn("status", F.when(F.col("kind") == "open", "viewed").otherwise(F.col("status"))))
    is_set = F.col("kind") == "set"
    folded = accepted.groupBy("job_id").agg(
        F.max_by(F.when(is_set, F.col("status")), F.when(is_set, F.col("seq"))).alias("set_to"),
        F.max(F.when(is_set, F.col("seq"))).alias("set_at"),
        F.max(F.when(~is_set, F.col("seq"))).alias("opened_at"),
    ).withColumnRenamed("job_id", "_id")
    base = F.coalesce(F.col("set_to"), F.col("status"))
    opened = F.col("opened_at").isNotNull() & (
        F.col("set_at").isNull() | (F.col("opened_at") > F.col("set_at")))
    status = F.when((base == "new") & opened, "viewed").otherwise(base)
    return (
        snapshot.join(folded, F.col("job_id") == F.col("_id"), "left")
        .withColumn("status", status).select(*snapshot.columns)
    )


def apply_scores(snapshot: DataFrame, scores: DataFrame) -> DataFrame:
    """Write score, reason, engine and time; status and report number stay."""
    cols = ["score", "eval_reason", "engine", "evaluated_at"]
    last = scores.groupBy("job_id").agg(F.max_by(F.struct(*cols), "evaluated_at").alias("s"))
    return _update(snapshot, last.select("job_id", "s.*"), cols)


def expire_stale(
    snapshot: DataFrame, live_sources: Sequence[str] | DataFrame,
    scan_ts: datetime | Column, hours: int,
) -> DataFrame:
    """New rows of succeeded sources, not seen for more than `hours`, become `expired`.

    The row's first source counts, whoever refreshed it since. No shuffle of the table: the source
    names are a literal list, or a table of one row per source.
    """
    if hours <= 0:
        return snapshot
    ts = scan_ts if isinstance(scan_ts, Column) else F.lit(scan_ts)
    old = F.col("last_seen") < ts - F.make_dt_interval(hours=F.lit(hours))
    stale = (F.col("status") == "new") & old
    if isinstance(live_sources, DataFrame):
        live = live_sources.select(F.col("source").alias("_live")).distinct()
        joined = snapshot.join(live, F.col("source") == F.col("_live"), "left")
        stale = stale & F.col("_live").isNotNull()
    elif not live_sources:
        return snapshot
    else:
        joined, stale = snapshot, stale & F.col("source").isin(*live_sources)
    return joined.withColumn("status", F.when(stale, "expired").otherwise(F.col("status"))).select(
        *snapshot.columns)


def stage_moves(snapshot: DataFrame) -> DataFrame:
    """One row per board listing and move it may take."""
    moves = F.lit(None).cast("array<string>")
    for stage, targets in MOVES.items():
        moves = F.when(F.col("status") == stage, F.array(*[F.lit(t) for t in targets])).otherwise(moves)
    return snapshot.filter(F.col("status").isin(*STAGES)).withColumn("move", F.explode(moves))
