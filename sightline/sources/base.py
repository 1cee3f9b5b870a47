"""Shared steps of the adapters. Replies are read as VARIANT, so unknown fields survive in `raw`."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import SIGHTING

def vget(v, path: str, dtype: str = "string") -> Column:
    return F.try_variant_get(v, path, dtype)


def text(v, path: str) -> Column:
    return F.coalesce(vget(v, path), F.lit(""))


def first_text(*cols: Column) -> Column:
    """First column that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit(""))


def joined(*cols: Column) -> Column:
    """Non-empty parts joined with a comma."""
    return F.concat_ws(", ", *[F.nullif(c, F.lit("")) for c in cols])


def meta(name: str) -> Column:
    # A plain map access: null where the key is missing, and the planner settles it where the map is written out.
    return F.col("meta")[name]


def items(payloads: DataFrame, source: str, path: str) -> DataFrame:
    """One row per element of the array at `path`; a reply without that array gives none."""
    return (
        payloads.filter(F.col("source") == source)
        .select("fetched_at", "page", "meta", F.try_parse_json("payload").alias("doc"))
        .select("fetched_at", "page", "meta", "doc",
                F.posexplode(vget("doc", path, "array<variant>")).alias("item_no", "item"))
    )


def with_fields(rows: DataFrame, v: str, shape: str, name: str = "f") -> DataFrame:
    """Add struct `name`: the fields of object `v`, each read as by `vget`; null where `v` is no object.

    Generated rather than projected: the planner copies a projected expression into every filter and use above it.
    """
    return rows.select("*", F.explode(F.array(vget(v, "$", f"struct<{shape}>"))).alias(name))


def sightings(rows: DataFrame, source: str, **cols: Column) -> DataFrame:
    """Project to the sighting shape; fields an adapter does not name get their default."""
    defaults = {
        "company": F.lit(""), "title": F.lit(""), "location": F.lit(""), "description": F.lit(""),
        "jd_full": F.lit(True), "raw": F.col("item"), "fetched_at": F.col("fetched_at"),
        "pos": F.struct(F.col("page").cast("bigint").alias("page"),
                        F.col("item_no").cast("bigint").alias("item")),
    }
    values = {**defaults, **cols, "source": F.lit(source)}
    return rows.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in SIGHTING.fields
    ]).filter(F.col("url") != "")


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """First row per key in the given order.

    Written as `row_number() = 1`: the planner cuts every map partition to one row per key before
    the shuffle, so a key with many copies costs one row per task.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rn", rank).filter(F.col("_rn") == 1).drop("_rn")
