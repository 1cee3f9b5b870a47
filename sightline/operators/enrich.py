"""Lookups that add to rows: full descriptions, candidate ids, place names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def needs_detail(snapshot: DataFrame) -> DataFrame:
    """Rows whose description is a snippet."""
    return snapshot.filter(~F.col("jd_full"))


def enrich_detail(snapshot: DataFrame, details: DataFrame, listing_id, source: str = "reed") -> DataFrame:
    """Put the full description where a detail reply has text; otherwise the row is left to retry.

    The replies have landed already, so all of them are used; how many are asked for is up to the job that lands them.

    `listing_id` gives the provider's id of a snapshot row, `details` is (listing_id, description).
    """
    wanted = needs_detail(snapshot).filter(F.col("source") == source)
    texts = details.filter(F.coalesce(F.col("description"), F.lit("")) != "")
    texts = texts.groupBy("listing_id").agg(F.max("description").alias("_text"))
    found = (
        wanted.select(F.col("job_id").alias("_id"), listing_id.alias("listing_id"))
        .join(texts, "listing_id").select("_id", "_text")
    )
    hit = F.col("_id").isNotNull()
    return (
        snapshot.join(found, F.col("job_id") == F.col("_id"), "left")
        .withColumn("description", F.when(hit, F.col("_text")).otherwise(F.col("description")))
        .withColumn("jd_full", hit | F.col("jd_full"))
        .select(*snapshot.columns)
    )


def only_ids(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose job_id is listed."""
    return df.join(ids.select("job_id"), "job_id", "left_semi")


def not_scored(df: DataFrame, score_log: DataFrame) -> DataFrame:
    """Rows without an entry in the score log."""
    return df.join(score_log.select("job_id"), "job_id", "left_anti")


def gazetteer_join(df: DataFrame, gazetteer: DataFrame, country: str = "GB") -> DataFrame:
    """Comma parts of `location` that are a place name of the country, one row each.

    An equi-join on the lower-case name: no pattern, so the gazetteer may be of any size.
    """
    names = gazetteer.filter(F.col("country_code") == country).select(
        F.lower("name").alias("_name"), F.col("name").alias("city"))
    parts = df.withColumn("_part", F.explode(F.split("location", ",")))
    return parts.withColumn("_name", F.lower(strip(F.col("_part")))).join(names, "_name").drop(
        "_part", "_name")
