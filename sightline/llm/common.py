"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.session import cut_lineage, shared_dir

__all__ = ["batches", "components", "cut_lineage", "read", "shared_dir", "small_batches"]

#: Rows that cross to Python at once. Whole texts cross, so a batch is kept far below Spark's default.
BATCH_ROWS = 512


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """Have the session hand Python at most BATCH_ROWS rows at once, unless it is set lower already."""
    conf = df.sparkSession.conf
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        conf.set(key, str(BATCH_ROWS))
    return df


def batches(rows: Iterable[tuple], schema: pa.Schema, at_most: int = 4096) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most `at_most` rows."""
    held = []
    for row in rows:
        held.append(row)
        if len(held) == at_most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(col, f.type) for col, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def components(links: DataFrame, purpose: str, cut: Callable = cut_lineage) -> DataFrame:
    """Connected components of `links` (a, b: long): one row (id, root) per linked id, root the smallest reachable.

    Alternating large-star and small-star steps. Each step joins and groups the links, so no neighbour list is
    ever gathered; the number of links never grows. Every round is written to the shared folder; the loop ends
    when a round leaves every link pointing at a root. Null ends and links of an id with itself are ignored.
    An empty table gives an empty table.
    """
    e = cut(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(),
            purpose)
    while True:
        # Large star: the larger neighbours of u point at u's smallest neighbour (or u).
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # Small star: the smaller neighbours of u, and u, point at the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = cut(
            large.join(low, "u").select(F.explode(F.array(
                F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
                F.struct(F.col("u"), F.col("m").alias("v")))).alias("s"))
            .select("s.u", "s.v").where("u <> v").distinct(), purpose)
        # Stars only: no end of a link is also the root side of another one, and each id has one root.
        nodes = small.groupBy("u").count()
        open_links = (small.join(nodes.select(F.col("u").alias("x")), small.v == F.col("x"), "left_semi").count()
                      + nodes.where("count > 1").count())
        e = small
        if not open_links:
            break
    roots = e.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("root"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(roots)
