"""Company job boards: one reply per company."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_iso
from ..functions.text import strip_tags, unescape_all
from .base import first_text, items, joined, meta, sightings, text, vget, with_fields


def greenhouse(payloads: DataFrame) -> DataFrame:
    """Descriptions are escaped HTML: decode first, then drop the markup."""
    rows = items(payloads, "greenhouse", "$.jobs").withColumn(
        "content", unescape_all(text("item", "$.content")))
    return sightings(
        rows, "greenhouse",
        url=text("item", "$.absolute_url"), company=meta("slug"), title=text("item", "$.title"),
        location=text("item", "$.location.name"), description=strip_tags(F.col("content")),
    )


def lever(payloads: DataFrame) -> DataFrame:
    return sightings(
        items(payloads, "lever", "$"), "lever",
        url=first_text(vget("item", "$.hostedUrl"), vget("item", "$.applyUrl")),
        company=meta("slug"), title=text("item", "$.text"),
        location=text("item", "$.categories.location"),
        description=text("item", "$.descriptionPlain"),
    )


def ashby(payloads: DataFrame) -> DataFrame:
    return sightings(
        items(payloads, "ashby", "$.jobs"), "ashby",
        url=text("item", "$.jobUrl"), company=meta("slug"), title=text("item", "$.title"),
        location=text("item", "$.location"), description=text("item", "$.descriptionPlain"),
    )


def workable(payloads: DataFrame) -> DataFrame:
    rows = with_fields(
        items(payloads, "workable", "$.jobs"), "item",
        "url string, shortlink string, application_url string, title string, city string, state string, "
        "country string, description string, published_on string, telecommuting boolean")
    return sightings(
        rows, "workable",
        url=first_text(F.col("f.url"), F.col("f.shortlink"), F.col("f.application_url")),
        company=first_text(vget("doc", "$.name"), meta("slug")),
        title=first_text(F.col("f.title")),
        location=joined(F.col("f.city"), F.col("f.state"), F.col("f.country")),
        description=strip_tags(F.col("f.description")),
        posted_at=parse_date_iso(F.col("f.published_on")),
        remote=F.col("f.telecommuting"),
    )
