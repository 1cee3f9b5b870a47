"""Read side: sorted and paged lists, counts, facets, text exports.

Lists that are meant to be short end in `limit`, which Spark runs as a per-partition top-k.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import card_text
from ..schema import LIST_COLS
from ..session import cut_lineage
from .filters import LANES, RECENT_HOURS, lane, search_text
from .lifecycle import STAGES

# Rows per list, per page (chat, page), per digest.
LIST_LIMIT, CHAT_PAGE, WEB_PAGE, DIGEST_CARDS = 500, 8, 25, 10


def newest_first() -> tuple[Column, ...]:
    return F.desc_nulls_last("first_seen"), F.asc("job_id")



def newest(df: DataFrame, limit: int | None = None, query: str | None = None) -> DataFrame:
    """Newest first. With a query the description is searched but not returned."""
    rows = search_text(df, query)
    rows = rows.select(*[c for c in LIST_COLS if c in rows.columns]).orderBy(*newest_first())
    return rows if limit is None else rows.limit(limit)


def best_score(df: DataFrame) -> DataFrame:
    """Scored rows of any status, best first, newest breaks ties."""
    return df.filter(F.col("score").isNotNull()).orderBy(F.desc("score"), *newest_first())


def primary_place() -> Column:
    return F.coalesce(
        F.nullif(F.try_element_at("locations", F.lit(1)), F.lit("")),
        F.nullif(F.col("location"), F.lit("")), F.lit("—"))


def sort_order(key: str, collation: str | None = "UNICODE") -> list[Column]:
    """`recent`, `company`, `location` or `score` (unscored count as -1); ties are newest first."""
    def words(c: Column) -> Column:
        return F.collate(c, collation) if collation else c

    first = {
        "recent": [],
        "company": [words(F.coalesce(F.col("company"), F.lit(""))).asc()],
        "location": [words(primary_place()).asc()],
        "score": [F.coalesce(F.col("score"), F.lit(-1.0)).desc()],
    }[key]
    return [*first, *newest_first()]


def sort_by(df: DataFrame, key: str, collation: str | None = "UNICODE") -> DataFrame:
    return df.orderBy(*sort_order(key, collation))


def page(df: DataFrame, number: int, size: int, order: Sequence | None = None) -> DataFrame:
    """Page `number` (0-based, clamped to the last one) plus `total`, `pages` and `page`.

    The rows are numbered by `numbered`, so a late page costs what the first one costs.
    """
    rows = numbered(df, order or newest_first())
    total = rows.count()
    pages = max(1, -(-total // size))
    at = max(0, min(number, pages - 1))
    rows = rows.filter(F.col("place").between(at * size + 1, (at + 1) * size)).orderBy("place").drop("place")
    return rows.withColumns({"total": F.lit(total), "pages": F.lit(pages), "page": F.lit(at + 1)})


def numbered(df: DataFrame, order: Sequence) -> DataFrame:
    """Adds `place`, 1 for the first row in `order`.

    The rows are range-sorted and written; each partition counts its own, and the counts before it (one row per
    partition) are added. No task sees more than its range.
    """
    pid, mid = F.spark_partition_id(), F.monotonically_increasing_id()
    rows = cut_lineage(df.orderBy(*order).withColumns({"_pid": pid, "_at": mid - F.shiftleft(pid.cast("bigint"), 33)}), "numbered")
    before = rows.groupBy("_pid").agg(F.count("*").alias("_n")).withColumn(
        "_before", F.sum("_n").over(_single_window(["_pid"])) - F.col("_n")).drop("_n")
    return rows.join(before, "_pid").withColumn("place", F.col("_before") + F.col("_at") + 1).drop("_pid", "_at", "_before")


def capped(df: DataFrame, cap: int | None) -> DataFrame:
    """The newest `cap` rows, to be filtered afterwards; None looks at the whole table."""
    return df if cap is None else df.orderBy(*newest_first()).limit(cap)


def candidates(df: DataFrame, only_unscored: bool = True, max_jobs: int | None = None) -> DataFrame:
    """New rows to score, newest first, at most `max_jobs` (None = all, in no order)."""
    rows = df.filter(F.col("status") == "new")
    if only_unscored:
        rows = rows.filter(F.col("evaluated_at").isNull())
    return rows.orderBy(*newest_first()).limit(max_jobs) if max_jobs else rows


def skipped(df: DataFrame, only_unscored: bool = True, max_jobs: int | None = None) -> DataFrame:
    """How many candidates the cap left out."""
    rows = df.filter(F.col("status") == "new")
    if only_unscored:
        rows = rows.filter(F.col("evaluated_at").isNull())
    n = F.count("*")
    over = F.greatest(F.lit(0), n - max_jobs) if max_jobs else F.lit(0)
    return rows.agg(n.alias("candidates"), over.cast("bigint").alias("skipped"))


# --- counts ---------------------------------------------------------------------------------------

def funnel(df: DataFrame) -> DataFrame:
    """Rows per status and their total; `grouping` tells the total from a missing status."""
    label = F.when(F.grouping("status") == 1, "total").otherwise(F.coalesce("status", F.lit("None")))
    return df.rollup("status").agg(label.alias("stage"), F.count("*").alias("n")).select("stage", "n")


def count_scored(df: DataFrame) -> DataFrame:
    return df.agg(F.count("score").alias("scored"))


def lane_counts(df: DataFrame) -> DataFrame:
    def n(statuses) -> Column:
        return F.count("*") if statuses is None else F.count_if(F.col("status").isin(*statuses))
    return df.agg(*[n(s).alias(key) for key, s in LANES.items()])


def older_count(df: DataFrame, as_of: Column, hours: int = RECENT_HOURS) -> DataFrame:
    """Inbox rows that the recency rule hides."""
    old = F.col("first_seen") < as_of - F.make_dt_interval(hours=F.lit(hours))
    return lane(df, "inbox").agg(F.count_if(old).alias("older"))


def stage_counts(df: DataFrame) -> DataFrame:
    """Rows per board stage; an empty stage counts 0."""
    counts = df.agg(*[F.count_if(F.col("status") == s).alias(s) for s in STAGES])
    return counts.unpivot([], list(STAGES), "stage", "n")


def funnel_stages(df: DataFrame) -> DataFrame:
    """The six named counts of the chat funnel, in their order."""
    named = {
        "Discovered": F.count("*"), "Scored": F.count("score"),
        **{s.capitalize(): F.count_if(F.col("status") == s)
           for s in ("new", "saved", "applied", "rejected")},
    }
    counts = df.agg(*[c.alias(name) for name, c in named.items()])
    pairs = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(name).alias("stage"), F.col(name).alias("n"))
                      for i, name in enumerate(named)])
    return counts.select(F.inline(pairs))


def untriaged_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count_if((F.col("status") == "new") & F.col("score").isNull()).alias("untriaged"))


def facet(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-empty values, sorted. An array column is flattened."""
    is_array = df.schema[column].dataType.typeName() == "array"
    values = df.select((F.explode(column) if is_array else F.col(column)).alias("value"))
    return values.filter(F.coalesce("value", F.lit("")) != "").distinct().orderBy("value")


# --- texts ----------------------------------------------------------------------------------------

# The wording of a digest and of a pending line.
NEW_LINE = "🆕 <b>%d</b> new job match(es):"
MORE_LINE = "…and %d more — send /jobs to browse all"
BOX = "- [ ] "


def cards(df: DataFrame) -> Column:
    return card_text(lambda name: F.col(name) if name in df.columns else F.lit(None).cast("string"))


def pending_lines(df: DataFrame) -> DataFrame:
    """One unchecked box per new row: (job_id, first_seen, line)."""
    part = lambda name: F.coalesce(F.col(name), F.lit(""))
    line = F.concat(F.lit(BOX), part("url"), F.lit(" | "), part("company"), F.lit(" | "), part("title"))
    return df.filter(F.col("status") == "new").select("job_id", "first_seen", line.alias("line"))


def write_pending(df: DataFrame, path: str, section: str = "Pending") -> None:
    """Write the list as text: header first, then newest first.

    The rows are range-sorted, not gathered: part files in name order are the document.
    """
    lines = pending_lines(df)
    header = lines.sparkSession.createDataFrame(
        [(0, f"## {section}"), (1, "")], "pos int, line string"
    ).select("pos", F.lit(None).cast("timestamp").alias("first_seen"), F.lit("").alias("job_id"), "line")
    body = lines.select(F.lit(2).alias("pos"), "first_seen", "job_id", "line")
    (header.unionByName(body).orderBy("pos", *newest_first())
     .select("line").write.mode("errorifexists").text(path))


def digest(new_rows: DataFrame, order: Sequence | None = None, most: int = DIGEST_CARDS) -> DataFrame:
    """(pos, line): count line, the first cards, how many more. No rows in, no rows out.

    A blank line follows the first and precedes the last. Cards come in the order in which they were found where the
    rows carry it (`found_at`: source rank and position), else newest first.
    """
    order = order or ([F.asc("found_at"), F.asc("job_id")] if "found_at" in new_rows.columns else newest_first())
    total = new_rows.agg(F.count("*").alias("n")).filter("n > 0")
    head = total.select(
        F.lit(0).alias("pos"),
        F.format_string(NEW_LINE + "\n", F.col("n")).alias("line"))
    top = new_rows.orderBy(*order).limit(most)
    spot = F.row_number().over(_single_window(order))
    body = top.select(spot.alias("pos"), cards(top).alias("line"))
    more = total.filter(F.col("n") > most).select(
        F.lit(most + 1).alias("pos"),
        F.format_string("\n" + MORE_LINE, F.col("n") - most).alias("line"))
    return head.unionByName(body).unionByName(more)


def _single_window(order: Sequence):
    """Numbering over a few rows: those a limit has left, or one per partition."""
    from pyspark.sql import Window
    return Window.partitionBy(F.lit(0)).orderBy(*order)
