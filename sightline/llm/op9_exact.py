"""Exact dedup against an immutable snapshot, screened by static binary-fuse filters.

A snapshot holds, per distinct text, its digest, the id that represents it and how many rows had it, in buckets by
digest; each bucket has one static binary-fuse filter of 16-bit fingerprints. An incoming batch is grouped by digest
first (its own duplicates are settled there), so a text that a third of all rows share is one row from then on. The
digests are screened by the filter of their bucket; only positives are joined to the exact buckets, and a match counts
after the bytes of the two texts were compared.

Buckets are chosen so that each holds about BUCKET_KEYS digests whatever the size of the snapshot: digests are spread
evenly, so no bucket can become hot. Nothing is broadcast and nothing is gathered by the driver but one count.

Defined results: a null text counts as empty. Rows with a null id take part like others: a null id never represents a
group unless all its ids are null. Repeated rows are counted each and appear each. An empty snapshot or batch is fine.
Only the id and text columns are read, so extra columns of any name do no harm.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage, shared_dir, small_batches

BUCKET_KEYS = 20_000
_U = np.uint64


def normal(text: str | None) -> bytes:
    """The bytes by which texts are compared: UTF-8, with A-Z (and nothing else) in lower case."""
    return (text or "").encode().lower()


def digested(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, digest): SHA-256 of the normalised text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            got = [hashlib.sha256(normal(t.as_py())).digest() for t in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.binary())], names=["doc_id", "digest"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, digest binary")


def grouped(rows: DataFrame) -> DataFrame:
    """One row per digest: digest, keep_id (largest id), n. Partial sums leave one row per digest and task to shuffle."""
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n"))


def in_bucket(buckets: int):
    """Bucket of a digest: its first 60 bits, cut to the number of buckets."""
    return F.pmod(F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long"), F.lit(buckets)).cast("int")


# -- binary-fuse filter -------------------------------------------------------------------------------------------


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over key + seed; numpy wraps as wanted."""
    x = keys + _U(seed)
    x ^= x >> _U(33)
    x *= _U(0xFF51AFD7ED558CCD)
    x ^= x >> _U(33)
    x *= _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _places(h: np.ndarray, segment: int, starts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The three slots of a hash: one in each of three segments that follow each other."""
    first = ((h >> _U(32)) * _U(starts) >> _U(32)) * _U(segment)
    a = first + (h & _U(segment - 1))
    b = first + _U(segment) + (h >> _U(18) & _U(segment - 1))
    c = first + _U(2 * segment) + (h * _U(0x9E3779B97F4A7C15) >> _U(40) & _U(segment - 1))
    return a.astype(np.int64), b.astype(np.int64), c.astype(np.int64)


def _print(h: np.ndarray) -> np.ndarray:
    return ((h * _U(0xD6E8FEB86659FD93)) >> _U(48)).astype(np.uint16)


def build_filter(keys: np.ndarray) -> tuple[int, int, bytes]:
    """(seed, segment length, fingerprints) of a 3-wise binary-fuse filter over distinct 64-bit keys.

    Keys are hashed to one slot in each of three neighbouring segments. Slots that only one key uses are peeled off
    until none is left (all such slots of a round at once); fingerprints are set in the reverse order. A seed for which
    peeling gets stuck is replaced by the next.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    if not n:
        return 0, 0, b""
    segment = 1 << max(2, int(math.floor(math.log(n) / math.log(3.33) + 2.25))) if n > 1 else 4
    size = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + 8
    starts = max(1, -(-size // segment) - 2)
    for seed in range(1, 1000):
        h = _mix(keys, seed)
        places = np.stack(_places(h, segment, starts))
        slots = (starts + 2) * segment
        degree = np.bincount(places.ravel(), minlength=slots)
        # The exclusive or of the keys' indices that use a slot is the key itself once only one is left.
        holder = np.zeros(slots, np.int64)
        for row in places:
            np.bitwise_xor.at(holder, row, np.arange(n))
        rounds, left = [], n
        while left:
            free = np.flatnonzero(degree == 1)
            if not len(free):
                break
            owner, at = np.unique(holder[free], return_index=True)
            rounds.append((owner, free[at]))
            for row in places[:, owner]:
                np.subtract.at(degree, row, 1)
                np.bitwise_xor.at(holder, row, owner)
            left -= len(owner)
        if not left:
            break
        seed += 1
    else:
        raise ValueError("no seed gives a filter: keys are not distinct")
    table, prints = np.zeros(slots, np.uint16), _print(h)
    for owner, slot in reversed(rounds):
        # No other key of the same round uses these slots' owners' free slots, so the round can be set at once.
        others = np.bitwise_xor.reduce(table[places[:, owner]], axis=0) ^ table[slot]
        table[slot] = prints[owner] ^ others
    return seed, segment, table.tobytes()


def in_filter(keys: np.ndarray, seed: int, segment: int, prints: bytes) -> np.ndarray:
    """Whether each key may be in the filter's set: always for its keys, for others once in 65,536."""
    if not segment:
        return np.zeros(len(keys), bool)
    table = np.frombuffer(prints, np.uint16)
    h = _mix(keys.astype(np.uint64), seed)
    a, b, c = _places(h, segment, len(table) // segment - 2)
    return (table[a] ^ table[b] ^ table[c]) == _print(h)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(bytes(d[8:16]) for d in digests), np.uint64)


# -- snapshot and batch ---------------------------------------------------------------------------------------------


class Snapshot:
    """Written once, then only read: exact buckets, filters, and the number of buckets."""

    def __init__(self, exact: DataFrame, filters: DataFrame, buckets: int, texts: DataFrame):
        self.exact, self.filters, self.buckets, self.texts = exact, filters, buckets, texts


def build_snapshot(spark: SparkSession, docs: DataFrame, path: str, id_col: str = "doc_id",
                   text_col: str = "text") -> Snapshot:
    """Write the snapshot of `docs` below `path`. `docs` stays the source of the texts that are byte-checked."""
    groups = grouped(digested(docs, id_col, text_col))
    groups.write.mode("overwrite").parquet(f"{path}/groups")
    groups = spark.read.parquet(f"{path}/groups")
    buckets = max(1, -(-groups.count() // BUCKET_KEYS))
    exact = groups.withColumn("bucket", in_bucket(buckets))

    def fuse(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        seed, segment, prints = build_filter(_keys(rows["digest"]))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "segment": [segment], "prints": [prints]})

    filters = exact.select("bucket", "digest").groupBy("bucket").applyInPandas(
        fuse, "bucket int, seed int, segment int, prints binary")
    filters.write.mode("overwrite").parquet(f"{path}/filters")
    return Snapshot(exact, spark.read.parquet(f"{path}/filters"), buckets,
                    docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))


def screen(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """`groups` (digest, keep_id, n) with `maybe`: whether the filter of the digest's bucket lets it pass."""

    def probe(rows: pd.DataFrame, fuse: pd.DataFrame) -> pd.DataFrame:
        if len(fuse):
            f = fuse.iloc[0]
            rows["maybe"] = in_filter(_keys(rows["digest"]), int(f["seed"]), int(f["segment"]), f["prints"])
        else:
            rows["maybe"] = False
        return rows[["digest", "keep_id", "n", "maybe"]]

    kind = groups.schema["keep_id"].dataType.simpleString()
    left = groups.withColumn("bucket", in_bucket(snapshot.buckets)).groupBy("bucket")
    return left.cogroup(snapshot.filters.groupBy("bucket")).applyInPandas(
        probe, f"digest binary, keep_id {kind}, n long, maybe boolean")


def _text_of(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """(digest, bytes) of the rows in `ids` (digest, keep_id)."""
    low = F.encode(F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                               "abcdefghijklmnopqrstuvwxyz"), "UTF-8")
    # Repeated ids may carry other texts: only the one with the digest is meant.
    return (texts.join(ids.withColumnRenamed("keep_id", "doc_id"), "doc_id").withColumn("bytes", low)
            .where(F.unhex(F.sha2("bytes", 256)) == F.col("digest")).select("digest", "bytes").dropDuplicates(["digest"]))


def dedupe(spark: SparkSession, snapshot: Snapshot, batch: DataFrame, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """Groups of equal texts over the snapshot and the batch: (digest, keep_id, group_size), one row per distinct text.

    The largest id represents a group.
    """
    new = cut_lineage(screen(grouped(digested(batch, id_col, text_col)), snapshot), "exact-batch")
    known = snapshot.exact.select("digest", F.col("keep_id").alias("old_id"), F.col("n").alias("old_n"))
    hits = cut_lineage(new.where("maybe").join(known, "digest"), "exact-hits")
    texts = batch.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    old = _text_of(hits.select("digest", F.col("old_id").alias("keep_id")), snapshot.texts)
    fresh = _text_of(hits.select("digest", "keep_id"), texts)
    # A null id cannot be looked up; its digest stands for its bytes.
    differ = old.join(fresh.select("digest", F.col("bytes").alias("other")), "digest").where("bytes <> other")
    same = cut_lineage(hits.join(differ.select("digest"), "digest", "left_anti"), "exact-same")
    met = same.select("digest", F.greatest("keep_id", "old_id").alias("keep_id"), (F.col("n") + F.col("old_n")).alias("group_size"))
    done = same.select("digest")
    only_new = new.join(done, "digest", "left_anti").select("digest", "keep_id", F.col("n").alias("group_size"))
    only_old = known.join(done, "digest", "left_anti").select("digest", F.col("old_id").alias("keep_id"), F.col("old_n").alias("group_size"))
    return met.unionByName(only_new).unionByName(only_old)


def dedupe_all(spark: SparkSession, parts: list[DataFrame], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Dedup of a snapshot (the first part) and a batch (the second), one row per document of either.

    doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). Of rows that repeat an id and a text, each
    says kept if the id is the one that stays.
    """
    first, second = parts
    snap = build_snapshot(spark, first, shared_dir(spark, "exact-snapshot"), id_col, text_col)
    groups = dedupe(spark, snap, second, id_col, text_col)
    rows = digested(first, id_col, text_col).unionByName(digested(second, id_col, text_col))
    # The left side may have a third of its rows in one digest; the right one has one row per digest, so the
    # adaptive skew join can cut the left side as it likes.
    return rows.join(groups, "digest").select(
        "doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"),
        F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
