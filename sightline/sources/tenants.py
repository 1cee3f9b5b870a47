"""Self-hosted career sites. A posting in several places gives one sighting per place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_iso
from ..functions.keys import host_tenant
from ..functions.text import strip_tags
from .base import first_text, items, meta, sightings, vget, with_fields

# `key` is a hash of the columns after it: sorting by it first spares comparing texts that are mostly the same.
_SITE = ["key", "fetched_at", "host", "site", "path"]


def _site_rows(payloads: DataFrame, source: str) -> DataFrame:
    """Replies of entries that name both host and site."""
    whole = (F.coalesce(meta("host"), F.lit("")) != "") & (F.coalesce(meta("site"), F.lit("")) != "")
    return payloads.filter((F.col("source") == source) & whole)


def _places(primary: Column, others: Column) -> Column:
    all_places = F.concat(F.array(primary), F.coalesce(others, F.array().cast("array<string>")))
    return F.filter(all_places, lambda p: F.coalesce(p, F.lit("")) != "")


def workday(payloads: DataFrame) -> DataFrame:
    """List entries with their detail replies; without a detail the list entry stands alone."""
    # Replies of both kinds go one way: what they come from is computed once, and an entry and its detail meet in a sum per
    # posting, which is formed in each task before the only shuffle.
    pages = _site_rows(payloads, "workday").filter(meta("kind").isin("list", "detail"))
    tags = [meta(name).alias(name) for name in ("host", "site", "path", "lang", "tenant", "name")]
    pages = pages.select("fetched_at", "page", "payload", (meta("kind") == "list").alias("listed"), *tags)
    elements = F.when(F.col("listed"), vget(F.try_parse_json("payload"), "$.jobPostings", "array<variant>")).otherwise(
        F.array(vget(F.try_parse_json("payload"), "$.jobPostingInfo", "variant")))
    rows = pages.select(*[c for c in pages.columns if c != "payload"], F.posexplode(elements).alias("item_no", "item"))
    rows = with_fields(
        rows, "item", "externalPath string, title string, locationsText string, externalUrl string, location string, "
        "additionalLocations array<string>, jobDescription string, startDate string")
    rows = rows.select(
        "fetched_at", "page", "item_no", "item", "listed", "host", "site", "lang", "tenant", "name", "f",
        F.when(F.col("listed"), F.col("f.externalPath")).otherwise(F.col("path")).alias("path"),
    ).filter((F.col("path") != "") & F.col("item").isNotNull())
    # The first is the smallest in (page, item_no); the fields after these only settle ties.
    entry = F.when(F.col("listed"), F.struct("page", "item_no", "lang", "tenant", "name", "f.title", "f.locationsText"))
    shown = F.when(~F.col("listed"), F.struct(
        "page", "f.externalUrl", "f.title", "f.location", "f.additionalLocations", "f.jobDescription", "f.startDate"))
    rows = rows.withColumn("key", F.xxhash64(*_SITE[1:])).groupBy(*_SITE).agg(
        F.min(entry).alias("entry"), F.min(shown).alias("shown"), F.min_by("item", entry).alias("item"))
    # A reply without a clock has no detail.
    rows = rows.filter(F.col("entry").isNotNull()).select(
        "fetched_at", "host", "site", "path", "item", "entry", "entry.page", "entry.item_no",
        F.when(F.col("fetched_at").isNotNull(), F.col("shown")).alias("shown"))

    places = _places(F.col("shown.location"), F.col("shown.additionalLocations"))
    rows = rows.select("*", F.posexplode_outer(places).alias("place_no", "place"))
    link = F.concat(F.lit("https://"), F.col("host"), F.lit("/"),
                    F.coalesce(F.col("entry.lang"), F.lit("en-US")), F.lit("/"), F.col("site"), F.col("path"))
    tenant = first_text(F.col("entry.tenant"), host_tenant(F.col("host")))
    return sightings(
        rows.withColumn("item_no", item_and_place()), "workday",
        url=first_text(F.col("shown.externalUrl"), link),
        company=first_text(F.col("entry.name"), tenant),
        title=first_text(F.col("shown.title"), F.col("entry.title")),
        location=F.coalesce("place", "entry.locationsText", F.lit("")),
        description=strip_tags(F.col("shown.jobDescription")),
        posted_at=parse_date_iso(F.col("shown.startDate")),
    )


def item_and_place() -> Column:
    """Order of an item's places (null: it has none) inside the page's order of items, as one number.

    An array holds fewer than 2**31 elements, so item_no * 2**31 + place_no never collides and keeps the order of
    (item_no, place_no), whatever the number of places.
    """
    return F.col("item_no").cast("bigint") * (1 << 31) + F.coalesce("place_no", F.lit(0))


def oracle(payloads: DataFrame) -> DataFrame:
    """Only the first element of `items` holds requisitions; other places may be text or object."""
    def name(v: Column) -> Column:
        is_object = F.schema_of_variant(v).startswith("OBJECT")
        return F.when(is_object, vget(v, "$.Name")).otherwise(vget(v, "$"))

    rows = with_fields(
        items(_site_rows(payloads, "oracle"), "oracle", "$.items[0].requisitionList"), "item",
        "Id string, Title string, PostedDate string, ShortDescriptionStr string, PrimaryLocation string, "
        "secondaryLocations array<variant>")
    rows = rows.filter(F.col("f.Id") != "")
    places = _places(F.col("f.PrimaryLocation"), F.transform("f.secondaryLocations", name))
    rows = rows.select("*", F.posexplode_outer(places).alias("place_no", "place"))
    return sightings(
        rows.withColumn("item_no", item_and_place()), "oracle",
        url=F.concat(F.lit("https://"), meta("host"), F.lit("/hcmUI/CandidateExperience/en/sites/"),
                     meta("site"), F.lit("/job/"), F.col("f.Id")),
        company=host_tenant(meta("host"), meta("name")),
        title=first_text(F.col("f.Title")),
        location=F.coalesce("place", F.lit("")),
        description=strip_tags(F.col("f.ShortDescriptionStr")),
        posted_at=parse_date_iso(F.col("f.PostedDate")),
    )
