"""Row filters. Keyword rules are substring rules: `Go` is found in `Google`, as intended."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import PENDING_COLS

# Fixed value: how long a listing counts as recent.
RECENT_HOURS = 48

LANES = {"inbox": ("new", "viewed"), "archived": ("archived",), "all": None}


def any_keyword(c: Column, words: Sequence[str]) -> Column:
    """True when the text contains any of the words, in any case. One pass over the rows."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = [F.contains(low, F.lit(w.lower())) for w in words]
    return reduce(Column.__or__, hits) if hits else F.lit(False)


@dataclass(frozen=True)
class KeywordPolicy:
    """Title: some positive word (if any are given) and no negative one. Place: block beats allow."""

    title_positive: tuple[str, ...] = ()
    title_negative: tuple[str, ...] = ()
    place_allow: tuple[str, ...] = ()
    place_block: tuple[str, ...] = ()

    def title_ok(self, title: Column) -> Column:
        ok = ~any_keyword(title, self.title_negative)
        return ok & any_keyword(title, self.title_positive) if self.title_positive else ok

    def place_ok(self, place: Column) -> Column:
        ok = ~any_keyword(place, self.place_block)
        if self.place_allow:
            ok = ok & any_keyword(place, self.place_allow)
        return (F.coalesce(place, F.lit("")) == "") | ok

    def keeps(self) -> Column:
        return self.title_ok(F.col("title")) & self.place_ok(F.col("location"))


def search_text(df: DataFrame, query: str | None) -> DataFrame:
    """Rows whose title, company or description contains the query; `%` and `_` are wildcards."""
    q = (query or "").strip().lower()
    if not q:
        return df
    part = lambda name: F.coalesce(F.col(name), F.lit(""))
    hay = F.lower(F.concat(part("title"), F.lit(" "), part("company"), F.lit(" "), part("description")))
    if "%" in q or "_" in q:
        # An escape character that no text holds: a backslash in the query is just a backslash.
        return df.filter(F.like(hay, F.lit(f"%{q}%"), F.lit("\u0001")))
    return df.filter(F.contains(hay, F.lit(q)))


def lane(df: DataFrame, key: str) -> DataFrame:
    """Rows of one status lane; an unknown lane is the inbox."""
    statuses = LANES.get(key, LANES["inbox"])
    return df if statuses is None else df.filter(F.col("status").isin(*statuses))


def in_city(df: DataFrame, city: str | None) -> DataFrame:
    return df.filter(F.array_contains("locations", city)) if city else df


def from_source(df: DataFrame, source: str | None) -> DataFrame:
    return df.filter(F.col("source") == source) if source else df


def min_salary(df: DataFrame, least: float | None) -> DataFrame:
    """On the upper salary; rows that state none stay."""
    if not least:
        return df
    return df.filter(F.col("salary_max").isNull() | (F.col("salary_max") >= least))


def _since(as_of: datetime | Column, hours: int) -> Column:
    as_of = as_of if isinstance(as_of, Column) else F.lit(as_of)
    return F.col("first_seen") >= as_of - F.make_dt_interval(hours=F.lit(hours))


def recent_inbox(df: DataFrame, as_of, hours: int = RECENT_HOURS) -> DataFrame:
    """Inbox rows not older than `hours`; a missing first-seen time stays."""
    return lane(df, "inbox").filter(F.col("first_seen").isNull() | _since(as_of, hours))


def recent_new(df: DataFrame, as_of, hours: int = RECENT_HOURS) -> DataFrame:
    """New rows not older than `hours`; a missing first-seen time goes."""
    return df.filter((F.col("status") == "new") & _since(as_of, hours))


def pending(df: DataFrame) -> DataFrame:
    return df.filter(F.col("status") == "new").select(*PENDING_COLS)


def scored(df: DataFrame) -> DataFrame:
    return df.filter(F.col("score").isNotNull())


def by_id(df: DataFrame, job_id: str) -> DataFrame:
    return df.filter(F.col("job_id") == job_id)
