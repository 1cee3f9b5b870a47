"""Scoring batches. The scorer itself is a plug-in: iterator of pandas frames in, the same out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..functions.replies import PRICES, build_prompt, error_class, parse_reply, token_cost

Scorer = Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]

ATTEMPT = (
    "job_id string, seq bigint, model string, reply string, error_kind string, error_message string, "
    "input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_write_tokens bigint, "
    "cost_usd double"
)
_TEXTS = ("job_id", "model", "reply", "error_kind", "error_message")
TOKENS = ("input_tokens", "output_tokens", "cache_read_tokens", "cache_write_tokens")


def keyword_scorer(words: dict[str, int], model: str = "keywords") -> Scorer:
    """A scorer without a service: adds the weights of the words a prompt contains."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            low = pdf["prompt"].str.lower()
            total = pd.Series(0, index=pdf.index)
            for word, weight in words.items():
                total = total + low.str.contains(word.lower(), regex=False).astype(int) * weight
            reply = '{"score": ' + total.astype(str) + ', "reason": "keywords"}'
            yield pd.DataFrame({
                "job_id": pdf["job_id"], "seq": pdf["seq"], "model": model, "reply": reply,
                "error_kind": None, "error_message": None,
                "input_tokens": pdf["prompt"].str.len(), "output_tokens": reply.str.len(),
                "cache_read_tokens": 0, "cache_write_tokens": 0, "cost_usd": None,
            })
    return run


def attempts(candidates: DataFrame, scorer: Scorer, prompt_chars: int | None = None) -> DataFrame:
    """Send every candidate to the scorer; partitions run side by side. prompt_chars: see `build_prompt`."""
    prompts = candidates.select("job_id", "seq", build_prompt(F.col, prompt_chars).alias("prompt"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for out in scorer(frames):
            # Chunked Arrow strings, which pandas may hand back, do not convert; plain objects do.
            texts = [c for c in _TEXTS if c in out]
            plain = out[texts].astype(object)
            yield out.assign(**{c: plain[c].where(plain[c].notna(), None) for c in texts})
    return prompts.mapInPandas(run, ATTEMPT)


def judge(tried: DataFrame, prices=PRICES) -> DataFrame:
    """Attempts -> score, reason, outcome (scored | auth | budget | other) and cost.

    A reply that cannot be read is an error of that row, not of the batch.
    """
    failed = F.col("error_kind").isNotNull() | F.col("error_message").isNotNull()
    verdict = F.when(~failed, parse_reply(F.col("reply")))
    outcome = (
        F.when(failed, error_class(F.col("error_kind"), F.col("error_message")))
        .when(F.col("verdict").isNull(), "other").otherwise("scored")
    )
    cost = F.when(F.col("outcome") == "scored", F.coalesce(
        F.col("cost_usd"), token_cost(F.col("model"), F.col, prices))).otherwise(0.0)
    return (
        tried.withColumn("verdict", verdict).withColumn("outcome", outcome)
        .withColumn("cost", cost)
        .withColumn("score", F.col("verdict.score")).withColumn("reason", F.col("verdict.reason"))
        .drop("verdict")
    )


def score_batch(candidates: DataFrame, scorer: Scorer, prices=PRICES, prompt_chars: int | None = None) -> DataFrame:
    return judge(attempts(candidates, scorer, prompt_chars), prices)


def _with_ran(judged: DataFrame, run: str, seq: str) -> DataFrame:
    """Add `_ran`: the attempt comes no later than the first auth or budget error of its run.

    First the smallest fatal position per run (map-side combined), then a join back: a run of any
    length never has to be sorted in one task.
    """
    fatal = judged.filter(F.col("outcome").isin("auth", "budget")).groupBy(
        F.col(run).alias("_run")).agg(F.min(seq).alias("_stop"))
    ran = F.col("_stop").isNull() | (F.col(seq) <= F.col("_stop"))
    return (
        judged.join(fatal, F.col(run) == F.col("_run"), "left")
        .withColumn("_ran", ran).drop("_run", "_stop")
    )


def cut_off(judged: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """Attempts of each run up to its first auth or budget error, that one included."""
    return _with_ran(judged, run, seq).filter("_ran").drop("_ran")


def run_summary(judged: DataFrame, run: str = "run_id", halted=None) -> DataFrame:
    """One ledger row per run. `halted` is a flag column for runs stopped by request."""
    ran = F.col("_ran")
    ok = ran & (F.col("outcome") == "scored")
    auth = F.max(ran & (F.col("outcome") == "auth"))
    budget = F.max(ran & (F.col("outcome") == "budget"))
    stop = F.lit(False) if halted is None else F.max(halted)
    done = _with_ran(judged, run, "seq").groupBy(run).agg(
        F.count("*").alias("jobs"),
        F.count_if(ok).alias("scored"), F.count_if(ran & (F.col("outcome") == "other")).alias("errors"),
        *[F.coalesce(F.sum(F.when(ok, F.col(t))), F.lit(0)).alias(t) for t in TOKENS],
        F.coalesce(F.sum(F.when(ok, F.col("cost"))), F.lit(0.0)).alias("cost_usd"),
        auth.alias("auth_failed"), budget.alias("budget_hit"), stop.alias("halted"),
    )
    note = (F.when(F.col("auth_failed"), "auth failed").when(F.col("budget_hit"), "rate/usage limit")
            .when(F.col("halted"), "halted").otherwise(""))
    return done.withColumn("note", note)


def dedup_requests(log: DataFrame) -> DataFrame:
    """Requests that get queued, from a log (key, at, seq, kind = ask | done).

    An `ask` is dropped while an earlier one of its key still waits; `done` ends the wait. So of all asks between
    two `done`s the first is accepted. One key may hold a large share of the log, so the log is cut into ranges by
    a range partitioning on (key, at, seq): a hot key spans many ranges, each a task of its own. Each range is
    settled by itself as a transition function of the state at its start, {free, waiting} -> state at its end (its
    row in `buckets`); those functions, one row per range, are composed along a key's ranges, and each range's
    asks before its first `done` are accepted only if the key is free at the range's start.
    Rows are ordered by time, then seq; a null key is a key of its own.
    """
    ask, done = F.col("kind") == "ask", F.col("kind") == "done"
    ranged = cut_lineage(log.select("key", "at", "seq", "kind").repartitionByRange("key", "at", "seq")
                         .withColumn("bucket", F.spark_partition_id()), "request-ranges")
    local = Window.partitionBy("key", "bucket").orderBy("at", "seq")
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumn("dones", F.coalesce(F.count_if(done).over(before), F.lit(0)))
    same = Window.partitionBy("key", "bucket", "dones").orderBy("at", "seq").rowsBetween(
        Window.unboundedPreceding, -1)
    firsts = rows.withColumn("earlier", F.coalesce(F.count_if(ask).over(same), F.lit(0)))

    buckets = rows.groupBy("key", "bucket").agg(
        F.max(done).alias("has_done"), F.max(ask).alias("has_ask"),
        F.max_by(ask, F.struct("at", "seq")).alias("ends_waiting"))
    along = Window.partitionBy("key").orderBy("bucket")
    run = F.sum(F.col("has_done").cast("int")).over(along)
    leaves = F.when(F.col("has_done"), F.col("ends_waiting")).otherwise(F.col("has_ask"))
    carried = (
        buckets.withColumn("run", run)
        .withColumn("open", F.max(leaves).over(Window.partitionBy("key", "run").orderBy("bucket")))
        .withColumn("waiting", F.coalesce(F.lag("open").over(along), F.lit(False)))
        .select("key", "bucket", "waiting")
    )
    accepted = firsts.filter(ask & (F.col("earlier") == 0)).join(carried, firsts.key.eqNullSafe(carried.key)
                                                                   & (firsts.bucket == carried.bucket)).drop(carried.key, carried.bucket)
    return accepted.filter((F.col("dones") > 0) | ~F.col("waiting")).select("key", "at", "seq")
