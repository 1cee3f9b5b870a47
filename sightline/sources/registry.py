"""All adapters, their order, and which sources of a scan succeeded."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PAYLOAD
from .base import meta
from .boards import ashby, greenhouse, lever, workable
from .html_cards import linkedin
from .search_apis import adzuna, indeed, reed
from .tenants import oracle, workday

# To add a source: write an adapter and list it here. The order decides which sighting of one scan
# is the first.
REGISTRY: dict[str, Callable[[DataFrame], DataFrame]] = {
    "adzuna": adzuna, "reed": reed, "indeed": indeed, "linkedin": linkedin,
    "greenhouse": greenhouse, "lever": lever, "ashby": ashby, "workable": workable,
    "workday": workday, "oracle": oracle,
}
SOURCE_ORDER = tuple(REGISTRY)

# Sources whose replies are pages rather than JSON.
HTML_SOURCES = ("linkedin",)


def landed(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The landing table. Partition it by `source`: each adapter then reads its own folder only."""
    return spark.read.schema(PAYLOAD).format(fmt).load(path)


def read_sources(
    payloads: DataFrame,
    enabled: Iterable[str] | None = None,
    only: str | None = None,
    registry: dict[str, Callable[[DataFrame], DataFrame]] = REGISTRY,
) -> DataFrame:
    """Sightings of all enabled sources (or one), with `source_rank` = place in the registry."""
    wanted = set(registry if enabled is None else enabled)
    picked = [(rank, name) for rank, name in enumerate(registry)
              if name in wanted and (only is None or name == only)]
    if not picked:
        raise ValueError("no source is enabled")
    parts = [registry[name](payloads).withColumn("source_rank", F.lit(rank)) for rank, name in picked]
    return reduce(DataFrame.unionByName, parts)


# How a reply that did not come through counts. A failed search page fails its source, as nobody knows what it would have
# shown, and so does a reply that came through but cannot be read. A board that answers with another status than success
# (`status` in the meta data) is closed and only skipped; a tenant or a page of cards is skipped whatever it failed of.
BOARD_SOURCES = ("greenhouse", "lever", "ashby", "workable")
PATIENT_SOURCES = ("workday", "oracle", *HTML_SOURCES)


def _missing() -> Column:
    """Why a reply is no use, or null."""
    unreadable = ~F.col("source").isin(*HTML_SOURCES) & F.try_parse_json("payload").isNull()
    return (
        F.when(F.col("payload").isNull(), F.coalesce(meta("error"), F.lit("no reply")))
        .when(unreadable, "unreadable reply")
    )


def _fails() -> Column:
    """Whether a reply that is no use fails its source."""
    closed = F.col("source").isin(*BOARD_SOURCES) & meta("status").isNotNull()
    skipped = F.col("payload").isNull() & (closed | F.col("source").isin(*PATIENT_SOURCES))
    return (F.coalesce(meta("kind"), F.lit("")) != "detail") & ~skipped


def with_failure(payloads: DataFrame) -> DataFrame:
    """Add `missing` and `failure`. Done by the job that lands replies, it spares each scan a second parse."""
    return payloads.withColumn("missing", _missing()).withColumn("failure", F.when(_fails(), F.col("missing")))


def _judged(payloads: DataFrame) -> DataFrame:
    return payloads if "failure" in payloads.columns else with_failure(payloads)


def source_status(payloads: DataFrame) -> DataFrame:
    """Per source and scan: replies, replies that fail the source and one of the texts, replies that were skipped."""
    return (
        _judged(payloads).groupBy("source", "fetched_at")
        .agg(F.count("*").alias("replies"), F.count("failure").alias("failed"),
             F.min("failure").alias("error_detail"), (F.count("missing") - F.count("failure")).alias("skipped"))
    )


def skipped_replies(payloads: DataFrame) -> DataFrame:
    """Replies that are no use and do not fail their source, with what they were asked for."""
    return _judged(payloads).filter(F.col("missing").isNotNull() & F.col("failure").isNull()).select(
        "source", "fetched_at", F.coalesce(meta("kind"), F.lit("list")).alias("kind"),
        F.coalesce(meta("slug"), meta("host")).alias("site"), F.col("missing").alias("error_detail"))


def failed_sources(status: DataFrame) -> DataFrame:
    """Ledger rows of the sources that failed: one error, nothing found."""
    zero = F.lit(0)
    return status.filter(F.col("failed") > 0).select(
        "source", "fetched_at", zero.alias("found"), zero.alias("new"), zero.alias("dupes"),
        zero.alias("filtered"), F.lit(1).alias("errors"), "error_detail",
    )


def source_errors(payloads: DataFrame) -> DataFrame:
    return failed_sources(source_status(payloads))


def live_sources(payloads: DataFrame) -> DataFrame:
    """Sources that did not fail; only their listings may be merged or expired."""
    return source_status(payloads).filter(F.col("failed") == 0).select("source", "fetched_at")
