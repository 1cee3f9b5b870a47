"""Counters and ledgers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: the engine whose cost is real money.
API_ENGINES = ("anthropic",)
RUNS_SHOWN = 50


def scan_counts(sightings: DataFrame, keeps: Column, new_rows: DataFrame) -> DataFrame:
    """Per source: found, new, dupes, filtered.

    `new_rows` are the rows the merge inserted; the source of their first sighting gets the credit,
    so nothing has to be counted sighting by sighting.
    """
    seen = sightings.groupBy("source").agg(
        F.count("*").alias("found"), F.count_if(~keeps).alias("filtered"))
    new = new_rows.groupBy("source").agg(F.count("*").alias("new"))
    row = seen.join(new, "source", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    dupes = F.col("found") - F.col("filtered") - F.col("new")
    return row.select("source", "found", "new", dupes.alias("dupes"), "filtered")


def scan_totals(counts: DataFrame) -> DataFrame:
    """The counts plus their sum in a row of source `*`."""
    names = [c for c in ("found", "new", "dupes", "filtered", "errors") if c in counts.columns]
    label = F.when(F.grouping("source") == 1, "*").otherwise(F.col("source"))
    return counts.rollup("source").agg(
        label.alias("label"), *[F.sum(c).alias(c) for c in names],
    ).select(F.col("label").alias("source"), *names)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _sum(name: str) -> Column:
    return F.coalesce(F.sum(name), F.lit(0))


def usage_totals(runs: DataFrame) -> DataFrame:
    """Sums over all runs; calls are what was scored plus what failed."""
    return runs.agg(
        _sum("scored").alias("scored"), (_sum("scored") + _sum("errors")).alias("calls"),
        _sum("input_tokens").alias("input_tokens"), _sum("output_tokens").alias("output_tokens"),
        _sum("cache_read_tokens").alias("cache_read_tokens"),
        F.round(_sum("cost_usd"), 4).alias("cost_usd"), F.count("*").alias("runs"),
    )


def usage_by_engine(runs: DataFrame) -> DataFrame:
    """Per engine, most calls first; a run with either count missing adds no calls."""
    return (
        runs.groupBy(F.coalesce("engine", F.lit("?")).alias("engine"))
        .agg(F.count("*").alias("runs"),
             F.coalesce(F.sum(F.col("scored") + F.col("errors")), F.lit(0)).alias("calls"),
             F.round(_sum("cost_usd"), 4).alias("cost_usd"))
        .orderBy(F.desc("calls"), "engine")
    )


def api_cost(runs: DataFrame, engines: Sequence[str] = API_ENGINES) -> DataFrame:
    paid = runs.filter(F.col("engine").isin(*engines))
    return paid.agg(F.round(_sum("cost_usd"), 4).alias("api_cost"))


def recent_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc_nulls_last("started_at"), "run_id").limit(limit)


def compact(n: Column) -> Column:
    """`1234` -> `1.2k`; below a thousand as it is."""
    n = F.coalesce(n, F.lit(0)).cast("bigint")
    return F.when(n >= 1000, F.concat(F.format_string("%.1f", n / 1000), F.lit("k"))).otherwise(
        n.cast("string"))


def usage_rows(runs: DataFrame) -> DataFrame:
    """What the usage list shows of each run."""
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    tokens_in = zero("input_tokens") + zero("cache_read_tokens") + zero("cache_write_tokens")
    flag = (
        F.when(F.col("note") == "auth failed", "not logged in")
        .when(F.coalesce("budget_hit", F.lit(False)), "limit")
        .when(zero("errors") > 0, F.concat(F.col("errors").cast("string"), F.lit(" err")))
        .otherwise("")
    )
    return runs.select(
        "run_id", F.coalesce(F.nullif("engine", F.lit("")), "stage").alias("engine"),
        (zero("scored") + zero("errors")).cast("bigint").alias("calls"),
        F.concat(F.col("scored").cast("string"), F.lit("/"), F.col("jobs").cast("string")).alias("done"),
        F.concat(compact(tokens_in), F.lit(" / "), compact(F.col("output_tokens"))).alias("tokens"),
        flag.alias("flag"),
    )
