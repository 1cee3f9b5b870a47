"""Search pages that answer with HTML cards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import html_text
from .base import first_wins, sightings
from .search_apis import remote_flag

# How a result page marks cards and their parts.
CARD = r"(?s)<li>(.*?)</li>"
LINK = r'href="(https://[^"?]*?linkedin\.com/jobs/view/[^"?]+)'
TITLE = r'(?s)base-search-card__title"[^>]*>(.*?)</h3>'
COMPANY = r'(?s)base-search-card__subtitle"[^>]*>(.*?)</h4>'
LOCATION = r'(?s)job-search-card__location"[^>]*>(.*?)</span>'
POSTED = r'datetime="(\d{4}-\d{2}-\d{2})"'


def _part(pattern: str) -> Column:
    return F.regexp_extract("card", pattern, 1)


def linkedin(payloads: DataFrame) -> DataFrame:
    cards = (
        payloads.filter(F.col("source") == "linkedin")
        .select("fetched_at", "page",
                F.posexplode(F.regexp_extract_all("payload", F.lit(CARD), F.lit(1)))
                .alias("item_no", "card"))
        .withColumn("link", _part(LINK)).filter(F.col("link") != "")
    )
    cards = first_wins(cards, ["fetched_at", "link"], ["page", "item_no"])
    parts = cards.select(
        "fetched_at", "page", "item_no", "link",
        html_text(_part(TITLE)).alias("title"), html_text(_part(COMPANY)).alias("company"),
        html_text(_part(LOCATION)).alias("place"),
        F.try_to_date(F.nullif(_part(POSTED), F.lit("")), "yyyy-MM-dd").alias("posted"),
    )
    return sightings(
        parts, "linkedin",
        url=F.col("link"), company=F.col("company"), title=F.col("title"), location=F.col("place"),
        posted_at=F.col("posted"), remote=remote_flag(F.col("title"), F.col("place")),
        raw=F.to_variant_object(F.struct(F.col("link").alias("card_url"))),
    )
