"""Approximate nearest neighbours by largest inner product: multiprobe p-stable hashing.

Inner products become distances: with M the largest norm, x is extended by sqrt(M^2 - |x|^2) and a query by 0, so the
nearest extended vector is the one with the largest inner product.

Each of `tables` tables hashes a vector with `hashes` p-stable (Gaussian) functions floor((a.x + b) / width); the bucket
is the list of values. A query visits, per table, its own bucket and those that differ by one step in some functions, in
the order of their estimated success: the sum of squared distances of the query to the boundaries that are crossed. For one
query `perturbations` finds them with a heap over perturbation sets that are shifted and expanded; for many queries at once
`probed` finds the same sets by merging sorted halves of the functions. Within each visited bucket candidates are ranked by the
exact inner product, in double precision on the original vectors; the best `k` over all buckets and tables are kept.

Scale. Vectors are dealt by their ids to shards of about SHARD_BYTES, and each query goes to every shard. One task holds the
buckets of one shard in all tables and reads queries as a stream, QUERIES at a time, so its memory depends neither on the
number of vectors nor on that of queries, nor on the size of a bucket: visits are worked off once VISITS are gathered, a
bucket is compared in blocks of BLOCK vectors, and per query the k best so far are kept. Probes are listed where they
are looked up and never cross a shuffle. What goes on per query and shard is at most `k` rows. Where there are fewer
shards than cores, the queries of a shard are dealt to several tasks. The number of functions grows with log2 of the
count, so that buckets keep their size.

Recall is held by the data. The true neighbours of SAMPLE queries (the smallest hashes of their ids; a bounded sample) are
found by brute force in blocks; a neighbour is found if one of its buckets is probed. From PROBES on, probes are doubled
until that share is TARGET; where more probes than buckets would be needed, there is one function less, down to none, which
is brute force. Queries with fewer than `k` candidates are asked again with half the functions, down to none, so that a
query has fewer than `k` rows only if there are fewer vectors. The driver gets M, counts, and the sample with its neighbours.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no part, neither as query
nor as candidate; nor do vectors of another length than most have, or rows with a null id. Rows that repeat an id are one
candidate (its best score counts) and one query per id (the first by its components). A query never finds its own id.
Ties go to the smaller id. Empty tables give empty tables. Only the id and vector columns are read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage, small_batches

TABLES, PROBES = 8, 100
#: Queries whose recall is measured, and the recall from which there are probes enough.
SAMPLE, TARGET = 100, 0.95
#: The number of functions is log2(vectors / BUCKET). Vectors per block of a bucket; bytes of the vectors of a shard.
BUCKET, BLOCK, SHARD_BYTES = 200, 4000, 32_000_000
#: Queries a task holds at once; visits and candidates gathered before they are worked off; sums of costs formed at once;
#: queries from which a task more is worth while.
QUERIES, VISITS, HITS, SUMS, PART = 8192, 3_000_000, 1_000_000, 2_000_000, 256
#: Width of a step in units of the largest norm.
WIDTH = 2.0


class Hashes:
    """The functions of all tables: drawn from a fixed seed, so that each task has the same."""

    def __init__(self, dim: int, tables: int, hashes: int, width: float, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.tables, self.hashes, self.width = tables, hashes, width
        self.a = rng.standard_normal((dim, tables * hashes))
        self.b = rng.random(tables * hashes) * width
        self.mix = rng.integers(1, 2**62, (tables, hashes), dtype=np.int64) * 2 + 1

    def project(self, x: np.ndarray) -> np.ndarray:
        """Values in steps, before they are cut to whole numbers: rows x tables x hashes."""
        return ((x @ self.a + self.b) / self.width).reshape(len(x), self.tables, self.hashes)

    def total(self, values: np.ndarray, table: int | np.ndarray) -> np.ndarray:
        """What the name of the bucket with these whole values (... x hashes) in `table` is made of; linear in the values."""
        return (values.astype(np.int64) * self.mix[table]).sum(axis=-1) + np.asarray(table) * np.int64(0x5851F42D4C957F2D)

    @staticmethod
    def name(total: np.ndarray) -> np.ndarray:
        return total ^ (total >> np.int64(29))

    def bucket(self, values: np.ndarray, table: int | np.ndarray) -> np.ndarray:
        """64-bit name of the bucket with these whole values (... x hashes) in `table`."""
        return self.name(self.total(values, table))


def perturbations(inside: np.ndarray, probes: int) -> list[list[int]]:
    """Sets of steps in ascending estimated cost. inside: distance to the lower boundary per function, in steps.

    A step is a function's number, with ~ for upward. Costs are squared distances to the boundaries crossed. A heap holds
    sets over the steps sorted by cost; taking one adds it with its last step shifted by one, and with one more step.
    """
    n = len(inside)
    if not n:
        return [[]]
    steps = sorted([(float(d) ** 2, i) for i, d in enumerate(inside)] + [(float(1 - d) ** 2, ~i) for i, d in enumerate(inside)])
    out: list[list[int]] = [[]]
    heap = [(steps[0][0], (0,))]
    while heap and len(out) < probes:
        cost, at = heapq.heappop(heap)
        last = at[-1]
        if last + 1 < 2 * n:
            nxt = steps[last + 1][0]
            heapq.heappush(heap, (cost - steps[last][0] + nxt, (*at[:-1], last + 1)))
            heapq.heappush(heap, (cost + nxt, (*at, last + 1)))
        chosen = [steps[i][1] for i in at]
        if len({i if i >= 0 else ~i for i in chosen}) == len(chosen):  # not one function both ways
            out.append(chosen)
    return out


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, vec array<double>, norm) of the vectors that take part."""
    v = F.col(vec_col) if dict(vectors.dtypes)[vec_col] == "array<float>" else F.col(vec_col).cast("array<double>")
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vec"))
    good = (F.size("vec") > 0) & F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return rows.where(good).withColumn("norm", norm).where("norm > 0")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


@lru_cache(maxsize=64)
def _pairs(n: int, m: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) in two ascending lists of n and m whose sum can be among the `most` lowest: (i + 1)(j + 1) are no larger."""
    counts = np.minimum(m, most // np.arange(1, n + 1))
    i = np.repeat(np.arange(n), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def _lowest(cost: np.ndarray, change: np.ndarray, most: int, ordered: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The `most` lowest sums (ascending, if `ordered`) of one cost per function, per query, and the sums of the changes with them.

    cost: queries x functions x choices; change: functions x choices. Both halves of the functions are settled first.
    """
    n, functions = cost.shape[:2]
    if not functions:
        return np.zeros((n, 1)), np.zeros((n, 1), np.int64)
    if functions == 1:
        at = np.argsort(cost[:, 0], axis=1)[:, :most]
        return np.take_along_axis(cost[:, 0], at, 1), change[0][at]
    half = functions // 2
    a, change_a = _lowest(cost[:, :half], change[:half], most)
    b, change_b = _lowest(cost[:, half:], change[half:], most)
    i, j = _pairs(a.shape[1], b.shape[1], most)
    sums = a[:, i] + b[:, j]
    if sums.shape[1] > most:
        at = np.argpartition(sums, most - 1, axis=1)[:, :most]
        if ordered:
            at = np.take_along_axis(at, np.argsort(np.take_along_axis(sums, at, 1), axis=1), 1)
    else:
        at = np.argsort(sums, axis=1)
    return np.take_along_axis(sums, at, 1), np.take_along_axis(change_a, i[at], 1) + np.take_along_axis(change_b, j[at], 1)


def probed(family: Hashes, at: np.ndarray, table: int, probes: int) -> np.ndarray:
    """Names of the buckets in `table` that queries with projections `at` (queries x hashes) visit."""
    whole = np.floor(at)
    inside = at - whole
    cost = np.stack([np.zeros_like(inside), inside**2, (1 - inside) ** 2], axis=2)
    change = family.mix[table][:, None] * np.array([0, -1, 1])
    return family.name(family.total(whole, table)[:, None] + _lowest(cost, change, probes, False)[1])


def _extended(x: np.ndarray, most: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(0.0, most**2 - (x**2).sum(axis=1)))])


def true_neighbours(rows: DataFrame, queries: DataFrame, k: int, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(query, its k nearest vectors) of the sampled queries, by comparing them with all rows. Each task keeps k per query."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()
    if not asked:
        return []
    q, own = np.array([r["vec"] for r in asked], np.float64), np.array([r["vec_id"] for r in asked], np.int64)

    def scan(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[dict[int, tuple[float, np.ndarray]]] = [{} for _ in own]
        for part in parts:
            ids, x = part.column(0).to_numpy(), _matrix(part.column(1), dim)
            score = q @ x.T
            for i, held in enumerate(best):
                level = min(s for s, _ in held.values()) if len(held) >= k else -np.inf
                for j in np.flatnonzero((score[i] >= level) & (ids != own[i])).tolist():
                    if (v := int(ids[j])) not in held or held[v][0] < score[i, j]:
                        held[v] = (float(score[i, j]), x[j])
                if len(held) > k:
                    best[i] = dict(sorted(held.items(), key=lambda h: (-h[1][0], h[0]))[:k])
        out = [(i, v, s, x.tolist()) for i, held in enumerate(best) for v, (s, x) in held.items()]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (
                pa.int32(), pa.int64(), pa.float64(), pa.list_(pa.float64())), strict=True)], names=["q", "vec_id", "score", "vec"])

    found = small_batches(rows).select("vec_id", "vec").mapInArrow(scan, "q int, vec_id long, score double, vec array<double>")
    found = found.groupBy("q", "vec_id").agg(F.max("score").alias("score"), F.max_by("vec", "score").alias("vec"))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    near: list[list[list[float]]] = [[] for _ in own]
    for r in found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "vec").collect():
        near[r["q"]].append(r["vec"])
    return [(q[i], np.array(v)) for i, v in enumerate(near) if v]


def _rows_at_once(hashes: int, probes: int) -> int:
    """Queries whose probes are listed at once, so that about SUMS sums are held."""
    half = min(probes, 3 ** min(-(-hashes // 2), 30))
    return max(1, SUMS // len(_pairs(half, half, probes)[0]))


def chosen(sample: list[tuple[np.ndarray, np.ndarray]], dim: int, most: float, tables: int, hashes: int) -> tuple[int, int, float]:
    """(hashes, probes, recall of the sample): the first in the order given above with TARGET or more."""
    total = sum(len(v) for _, v in sample)
    for h in range(hashes, 0, -1):
        family = Hashes(dim + 1, tables, h, WIDTH * most)
        asked = family.project(np.column_stack([np.array([q for q, _ in sample]), np.zeros(len(sample))])) if sample else []
        held = [np.floor(family.project(_extended(v, most))) for _, v in sample]
        missed = [np.ones(len(v), bool) for _, v in sample]
        probes = PROBES
        while True:
            step = _rows_at_once(h, probes)
            for t in range(tables):
                for a in range(0, len(sample), step):
                    names = probed(family, asked[a:a + step, t], t, probes)
                    for seen, values, left in zip(names, held[a:a + step], missed[a:a + step], strict=True):
                        left &= ~np.isin(family.bucket(values[:, t], t), seen)
            recall = 1 - sum(int(left.sum()) for left in missed) / max(total, 1)
            if recall >= TARGET:
                return h, probes, recall
            probes *= 2
            if probes > max(PROBES, 2**h):
                break
    return 0, 1, 1.0


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
           tables: int = TABLES, probes: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each row for which `is_query` (over vec_id) holds.

    probes: per table; by default chosen from the data.
    """
    rows = cut_lineage(usable(vectors, id_col, vec_col), "lsh-vectors")
    dims = rows.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("most")).orderBy(
        F.desc("n"), "dim").first()
    dim, n, most = (dims["dim"], dims["n"], dims["most"]) if dims else (1, 0, 1.0)
    rows = rows.where(F.size("vec") == dim)
    queries = cut_lineage(rows.where(is_query).groupBy("vec_id").agg(F.min("vec").alias("vec")), "lsh-queries")
    hashes = max(1, round(math.log2(max(n, 2) / BUCKET)))
    if probes is None:
        hashes, probes, _ = chosen(true_neighbours(rows, queries, k, dim), dim, most, tables, hashes)
    wanted = min(k, rows.select("vec_id").distinct().count() - 1)
    found = cut_lineage(candidates(rows, queries, k, dim, n, most, tables, hashes, probes), "lsh-found")
    while hashes:
        enough = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("held")).where(F.col("held") >= wanted)
        short = cut_lineage(queries.join(enough, queries["vec_id"] == enough["query_id"], "left_anti"), "lsh-short")
        if wanted < 1 or short.isEmpty():
            break
        hashes //= 2
        found = cut_lineage(found.unionByName(candidates(rows, short, k, dim, n, most, tables, hashes, probes)), "lsh-found")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


class Shard:
    """Some vectors in their buckets of all tables. ids: ascending."""

    def __init__(self, family: Hashes, ids: np.ndarray, x: np.ndarray, most: float):
        self.family, self.ids, self.x, self.most = family, ids, x, most
        self.place = np.searchsorted(ids, ids)  # one for all rows of an id
        names = np.empty((family.tables, len(ids)), np.int64)
        for a in range(0, len(ids), BLOCK):
            values = np.floor(family.project(_extended(x[a:a + BLOCK].astype(np.float64), most)))
            for t in range(family.tables):
                names[t, a:a + BLOCK] = family.bucket(values[:, t], t)
        self.tables = []
        for own in names:
            order = np.argsort(own, kind="stable")
            kinds, first = np.unique(own[order], return_index=True)
            self.tables.append((pd.Index(kinds), np.append(first, len(ids)), order.astype(np.int32)))

    def best(self, own: np.ndarray, q: np.ndarray, k: int, probes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, vector, score) by place: the k best of the vectors in the buckets that the queries `q` with ids `own` visit."""
        at = self.family.project(np.column_stack([q, np.zeros(len(q))]))
        # A product's last bits depend on its shape; what is kept is scored again in one order of the components.
        slack = 4 * q.shape[1] * np.finfo(float).eps * self.most**2
        level = np.full(len(q), -np.inf)
        kept = [(np.zeros(0, np.int32), np.zeros(0, np.int32))]

        def settle() -> np.ndarray:
            i, row = (np.concatenate(c) for c in zip(*kept, strict=True))
            other = self.ids[row] != own[i]
            i, row = i[other], row[other]
            score = np.empty(len(i))
            for a in range(0, len(i), BLOCK):
                score[a:a + BLOCK] = (q[i[a:a + BLOCK]] * self.x[row[a:a + BLOCK]]).sum(axis=1)
            # Of what was met in several tables, or under an id that repeats, the best stays.
            place = self.place[row]
            order = np.lexsort((-score, i.astype(np.int64) << 32 | place))
            order = order[np.append(True, (np.diff(i[order]) != 0) | (np.diff(place[order]) != 0))[:len(order)]]
            order = order[np.lexsort((place[order], -score[order], i[order]))]
            i, row, score = i[order], row[order], score[order]
            rank = np.arange(len(i)) - np.searchsorted(i, i)
            level[i[rank == k - 1]] = score[rank == k - 1]
            kept[:] = [(i[rank < k], row[rank < k])]
            return score[rank < k]

        def visit(first: np.ndarray, order: np.ndarray, found: list[tuple[np.ndarray, np.ndarray]]) -> None:
            """Compare the queries with the vectors of their buckets; found: (bucket, query)."""
            bucket, who = (np.concatenate(c) for c in zip(*found, strict=True))
            if len(first) <= 1 << 16:
                bucket = bucket.astype(np.uint16)  # sorts faster
            by = np.argsort(bucket, kind="stable")
            bucket, who = bucket[by], who[by]
            del by
            cuts = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)).tolist()
            held = 0
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                begin, end = first[int(bucket[a])], first[int(bucket[a]) + 1]
                for f in range(begin, end, BLOCK):
                    rows = order[f:min(f + BLOCK, end)]
                    x = self.x[rows].T.astype(np.float64)
                    for c in range(a, b, 256):
                        asked = who[c:min(c + 256, b)]
                        i, j = np.nonzero(q[asked] @ x >= (level[asked] - slack)[:, None])
                        if len(i):
                            kept.append((asked[i], rows[j]))
                            held += len(i)
                            if held > HITS:
                                settle()
                                held = 0

        step = _rows_at_once(self.family.hashes, probes)
        for t, (names, first, order) in enumerate(self.tables):
            found, n = [], 0
            for a in range(0, len(q), step):
                asked = probed(self.family, at[a:a + step, t], t, probes)
                b = names.get_indexer(asked.ravel()).astype(np.int32)
                there = np.flatnonzero(b >= 0)
                found.append((b[there], (a + there // asked.shape[1]).astype(np.int32)))
                n += len(there)
                if n > VISITS:
                    visit(first, order, found)
                    found, n = [], 0
            if n:
                visit(first, order, found)
            settle()
        score = settle()
        return *kept[0], score


def candidates(rows: DataFrame, queries: DataFrame, k: int, dim: int, n: int, most: float, tables: int, hashes: int,
               probes: int) -> DataFrame:
    """(query_id, vec_id, score): at least the k best of the vectors in the buckets that a query visits."""
    tables = tables if hashes else 1
    family = Hashes(dim + 1, tables, hashes, WIDTH * most)
    size = 4 if dict(rows.dtypes)["vec"] == "array<float>" else 8
    shards = -(-n * dim * size // SHARD_BYTES) or 1
    cores = rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores // shards, queries.count() // PART))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The vectors of one shard, and after them queries."""
        ids, xs, own, q, shard = [], [], [], [], None

        def answer() -> pa.RecordBatch:
            who, asked = np.concatenate(own), np.concatenate(q)
            i, row, score = shard.best(who, asked, k, probes)
            own.clear(), q.clear()
            return pa.RecordBatch.from_arrays([pa.array(who[i]), pa.array(shard.ids[row]), pa.array(score)],
                                              names=["query_id", "vec_id", "score"])

        for batch in batches:
            cut = batch.num_rows - batch.column(0).true_count
            for part, at in ((batch.slice(0, cut), ids), (batch.slice(cut), own)):
                if part.num_rows:
                    x = part.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    at.append(part.column(1).to_numpy())
                    (xs if at is ids else q).append(x if at is ids else x.astype(np.float64))
            if own and ids:
                shard = Shard(family, np.concatenate(ids), np.concatenate(xs), most)
                ids.clear(), xs.clear()
            if shard is not None and sum(map(len, own)) >= QUERIES:
                yield answer()
        if own and shard is not None:
            yield answer()

    # A cell is a shard with a part of the queries; each cell is a task.
    small_batches(rows)
    shard, part = F.pmod(F.xxhash64("vec_id"), F.lit(shards)), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(parts))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    held = rows.select(F.lit(False).alias("asked"), "vec_id", "vec", shard.alias("shard"), every(parts).alias("part"))
    asked = queries.select(F.lit(True).alias("asked"), "vec_id", "vec", every(shards).alias("shard"), part.alias("part"))
    dealt = held.unionByName(asked).repartitionById(shards * parts, (F.col("shard") * parts + F.col("part")).cast("int"))
    dealt = dealt.sortWithinPartitions("asked", "vec_id").select("asked", "vec_id", "vec")
    return dealt.mapInArrow(scan, "query_id long, vec_id long, score double")
