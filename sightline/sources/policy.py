"""How much of a source counts in one scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def budget_per_group(df: DataFrame, keys: Sequence[str], budget: int, order: Sequence) -> DataFrame:
    """The first `budget` rows per (query, place), so that a busy place cannot crowd out others.

    `row_number() <= budget` is cut per map partition before the shuffle, so a busy group costs at
    most `budget` rows per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") <= budget).drop("_rn")


def within_window(
    max_days: int | None = None, max_hours: int | None = None,
    recent_days: int | None = None, deep: bool = False,
) -> int | None:
    """Hours to look back: a regular scan tightens a source's own window, a deep one does not.

    A source without a window of its own has none to tighten.
    """
    own = max_hours if max_hours is not None else None if max_days is None else max_days * 24
    if own is None or deep or not recent_days:
        return own
    return min(own, recent_days * 24)


def fresh_only(df: DataFrame, clock: Column, as_of: Column, hours: int | None) -> DataFrame:
    """Rows whose `clock` lies within `hours` of `as_of`. A plain comparison, so it reaches the scan."""
    if hours is None:
        return df
    return df.filter(clock >= as_of - F.make_dt_interval(hours=F.lit(hours)))
