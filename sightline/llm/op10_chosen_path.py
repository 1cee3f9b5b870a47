"""Near-duplicate documents by a chosen-path set similarity join.

Documents are sets of word shingles. TREES independent trees branch them: at a node, the node's own hash chooses one or
(in 18 of 100 nodes) two coordinates of the minwise signature, about 1 / 0.85 on average, and a set goes to the child of
its token there. A node of at most NODE sets is compared exhaustively, by signature sketches; a larger one branches on,
down to DEPTH tokens. A large node is not compared but linked whole to one of its sets if half of it agrees with one of
a few sets drawn from it (it is one group of near copies, which branching would only drag along), or if it is still large at the end.

These links only say which sets have to be looked at together. Their components are then clustered exactly, on the full
shingle sets: a link counts if 100 * intersection >= percent * union. A component too large for a task is cut into
blocks, and each pair of blocks is one group, so no task ever holds more than two blocks. Inside a group, sets already
connected are not compared again, so a group of thousands of near copies costs a few comparisons per set and gives one
link per set, never all pairs.

Recall. Two sets of similarity 0.85 meet in one tree with probability 0.87 at one level, 0.78, 0.70 and 0.64 at two to
four; 14 trees miss them with probability 6e-7 at most, as a rule (nodes end at the first level) below 1e-12. A sketch
of 128 one-byte tokens passes from 0.68 on, over five standard deviations below 0.85. At 0.8 the figures are 2e-5 at most
and below 1e-10 as a rule.

Equal sets (copies, changes of case or spacing) are one set from the start. Sets are told apart by 64 bits of a BLAKE2
digest of the set.

Defined results: a null text counts as empty; texts without words have no shingles, are linked with nothing and stay.
Rows that repeat an id count as one document: they stay or go together if their texts are equal. A row with a null id
takes part; the component id is the smallest id that is not null, and it stays only if its component has no id at all.
Only the id and text columns are read. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, components, cut_lineage, small_batches
from sightline.llm.shingles import shingle_sets

SIGNATURE, TREES, DEPTH, NODE = 128, 14, 4, 200
#: Nodes of 100 that choose two coordinates: 1 + 0.18 is 1 / 0.85.
TWICE = 18
#: Sets a large node is held against, so that one far from the rest does not make a group of near copies branch on.
HEADS = ("head", "head_b", "head_c")
#: Standard deviations below the similarity asked for from which on sketches agree.
SKETCH_SLACK = 5.3
#: Shingles in one block of the exact step.
BLOCK = 2_000_000

_A = np.random.default_rng(10).integers(0, 2**63, SIGNATURE, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def minwise(s: np.ndarray) -> np.ndarray:
    """Signature of a set: per coordinate the smallest hash, as int32."""
    low = np.full(SIGNATURE, 2**32 - 1, np.uint64)
    for k in range(0, len(s), 1024):
        low = np.minimum(low, ((s[k:k + 1024, None] * _A) >> np.uint64(32)).min(axis=0))
    return low.astype(np.uint32).view(np.int32)


def set_id(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5) -> DataFrame:
    """(doc_id, mark, n_shingles, sid, sig): sid and sig are null without words. mark: hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = shingle_sets(part.column(2).to_pylist(), words)
            full = [len(s) > 0 for s in sets]
            yield pa.RecordBatch.from_arrays([
                part.column(0), part.column(1), pa.array([len(s) for s in sets], pa.int64()),
                pa.array([set_id(s) if ok else None for s, ok in zip(sets, full, strict=True)], pa.int64()),
                pa.array([minwise(s) if ok else None for s, ok in zip(sets, full, strict=True)], pa.list_(pa.int32())),
            ], names=["doc_id", "mark", "n_shingles", "sid", "sig"])

    rows = small_batches(docs).select(id_col, F.xxhash64(text_col), text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, mark long, n_shingles long, sid long, sig array<int>")


def _children(rows: DataFrame) -> DataFrame:
    """(node, sid, sig) -> the child nodes of each set."""
    def child(salt: int):
        at = F.pmod(F.xxhash64("node", F.lit(salt)), F.lit(SIGNATURE)).cast("int")
        return F.xxhash64("node", F.lit(salt), F.get("sig", at))

    second = F.when(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(100)) < TWICE, child(2))
    return rows.select("sid", F.explode(F.array_compact(F.array(child(1), second))).alias("node"))


def agreeing(percent: int) -> int:
    """Tokens of two sketches that have to be equal for their sets to be looked at together."""
    p = percent / 100
    return math.floor(SIGNATURE * (p - SKETCH_SLACK * math.sqrt(p * (1 - p) / SIGNATURE)))


def _compare(parts: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Rows (node, sid, sketch) sorted by node -> links that connect what agrees by its sketch."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def links() -> Iterator[tuple[int, int]]:
        for _, sids, (sketches,) in _groups(parts, 1):
            n = len(sids)
            sk = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, SIGNATURE)
            if n == 2:
                if (sk[0] == sk[1]).sum() >= least:
                    yield sids[0], sids[1]
                continue
            same = np.stack([(sk == x).sum(axis=1) for x in sk]) >= least
            root = list(range(n))
            for i, j in np.argwhere(np.triu(same, 1)).tolist():
                x, y = _find(root, i), _find(root, j)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    yield sids[i], sids[j]

    yield from batches(links(), schema)


def _groups(parts: Iterator[pa.RecordBatch], more: int) -> Iterator[tuple]:
    """Runs of equal keys in sorted rows (key, sid, more columns ...): key, sids, lists of the other columns."""
    key, sids, rest = None, [], [[] for _ in range(more)]
    for part in parts:
        keys = part.column(0).to_pylist()
        cols = [part.column(1 + i).to_pylist() for i in range(more + 1)]
        for k, row in zip(keys, zip(*cols, strict=True), strict=True):
            if k != key and sids:
                yield key, sids, rest
                sids, rest = [], [[] for _ in range(more)]
            key = k
            sids.append(row[0])
            for have, x in zip(rest, row[1:], strict=True):
                have.append(x)
    if sids:
        yield key, sids, rest


def _find(root: list[int], i: int) -> int:
    while root[i] != i:
        root[i] = root[root[i]]
        i = root[i]
    return i


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets (sid, sig) that have to be looked at together."""
    least = agreeing(percent)
    first = []
    for t in range(TREES):
        first.append((t, t))
        if (t + 1) * TWICE // 100 > t * TWICE // 100:
            first.append((t, TREES + t))
    sig = reps.select("sid", "sig")
    rows = sig.select("sid", F.explode(F.array(*(
        F.xxhash64(F.lit(t), F.lit(c), F.get("sig", F.lit(c))) for t, c in first))).alias("node"))
    leaves, links, sigs = [], [], None
    for level in range(1, DEPTH + 1):
        counts = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"), *(
            F.min_by("sid", F.xxhash64("sid", F.lit(k))).alias(h) for k, h in enumerate(HEADS))).where("n > 1")
        shared = cut_lineage(rows.join(counts, "node"), "paths")
        leaves.append(shared.where(F.col("n") <= NODE).select("node", "sid"))
        large = shared.where(F.col("n") > NODE)
        if large.isEmpty():
            break
        if sigs is None:
            sigs = cut_lineage(sig.hint("merge").join(large.select("sid").distinct(), "sid", "left_semi"), "paths")
        if level < DEPTH:
            alike = _alike(large, sigs, least)
            # Written, since the rows are read twice: counted by node, and joined with the counts.
            rows = cut_lineage(_children(large.join(alike, "node", "left_anti").select("node", "sid").join(sigs, "sid")), "paths")
            large = large.join(alike, "node", "left_semi")
        links.append(large.select(F.col("head").alias("a"), F.col("sid").alias("b")).where("a <> b"))
    sketch = reps.select("sid", "sketch")
    small = leaves[0]
    for more in leaves[1:]:
        small = small.unionByName(more)
    found = (small.join(sketch, "sid").select("node", "sid", "sketch").repartition("node").sortWithinPartitions("node")
             .mapInArrow(lambda parts: _compare(parts, least), "a long, b long"))
    for more in links:
        found = found.unionByName(more)
    return found


def _alike(large: DataFrame, sigs: DataFrame, least: int) -> DataFrame:
    """(node) of the large nodes in which at least half of the sets agree with one of the node's heads."""
    heads = (large.select("node", *HEADS).distinct().select("node", F.explode(F.array_distinct(F.array(*HEADS))).alias("of"))
             .join(sigs.withColumnRenamed("sid", "of"), "of").select("node", "of", F.col("sig").alias("head_sig")))
    heads = heads.groupBy("node").agg(F.collect_list("head_sig").alias("head_sigs"))  # a few a node
    rows = large.select("node", "sid").join(sigs, "sid").join(heads, "node")

    def agrees(k: int) -> Column:
        same = F.zip_with("sig", F.get("head_sigs", F.lit(k)), lambda x, y: (x == y).cast("int"))
        return (F.aggregate(same, F.lit(0), lambda s, x: s + x) >= least).cast("double")

    share = F.greatest(*(F.coalesce(F.avg(agrees(k)), F.lit(0.0)) for k in range(len(HEADS))))
    return rows.groupBy("node").agg(share.alias("share")).where("share >= 0.5").select("node")


def cluster(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links (i, j) that connect what is connected by pairs with 100 * intersection >= percent * union.

    Every set outside the largest component is compared with all others; that finds every link between components.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(token, kind="stable")
    posted = owner[order]
    bounds = np.concatenate(([0], np.cumsum(np.bincount(token))))
    ends = np.concatenate(([0], np.cumsum(sizes)))
    root, size, done, out = list(range(n)), [1] * n, [False] * n, []
    largest, again = 0, True
    while again:
        again = False
        for i in range(n):
            if done[i] or _find(root, i) == _find(root, largest) and size[_find(root, i)] > 1:
                continue
            done[i], again = True, True
            own = token[ends[i]:ends[i + 1]]
            a, b = bounds[own], bounds[own + 1]
            length = b - a
            at = np.repeat(a - np.concatenate(([0], np.cumsum(length)[:-1])), length) + np.arange(length.sum())
            both = np.bincount(posted[at], minlength=n)
            for j in np.flatnonzero(100 * both >= percent * (sizes + sizes[i] - both)).tolist():
                x, y = _find(root, i), _find(root, j)
                if x != y:
                    root[y] = x
                    size[x] += size[y]
                    out.append((i, j))
            if size[_find(root, i)] > size[_find(root, largest)]:
                largest = _find(root, i)
    return out


def _exact(percent: int, words: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links() -> Iterator[tuple[int, int]]:
            for _, sids, (texts,) in _groups(parts, 1):
                own = dict(zip(sids, texts, strict=True))  # rows that repeat an id and a text
                if len(own) > 1:
                    sids = list(own)
                    for i, j in cluster(shingle_sets(list(own.values()), words), percent):
                        yield sids[i], sids[j]

        yield from batches(links(), pa.schema([("a", pa.int64()), ("b", pa.int64())]))

    return run


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles, component_id (smallest id reachable, itself included), kept."""
    sets = cut_lineage(signatures(docs, id_col, text_col, words), "near-signatures")
    with_words = sets.where(F.col("sid").isNotNull())
    reps = cut_lineage(with_words.select("sid", "sig").dropDuplicates(["sid"]).mapInArrow(
        _with_sketch, "sid long, sig array<int>, sketch binary"), "near-sets")
    coarse = components(candidates(reps, percent), "near-coarse")

    # One row that has each set: with its mark the join finds it even among rows that repeat an id.
    one = with_words.groupBy("sid").agg(F.min(F.struct("doc_id", "mark")).alias("at"), F.min("doc_id").alias("least"),
                                        F.max("n_shingles").alias("n"))
    members = coarse.join(one, coarse["id"] == one["sid"]).select("root", "sid", "at.doc_id", "at.mark", "n")
    members = cut_lineage(members, "near-members")
    blocks = members.groupBy("root").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")
    placed = (members.join(blocks, "root").withColumn("own", own).select(
        "sid", "doc_id", "mark", F.explode(F.transform(
            F.sequence(F.lit(0), F.col("blocks") - 1),
            lambda k: F.xxhash64("root", F.least(k, "own"), F.greatest(k, "own")))).alias("place")))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    p = placed.withColumnRenamed("doc_id", "of").withColumnRenamed("mark", "of_mark")
    # The members grow with the corpus, so they are never broadcast, however few they are.
    exact = (texts.join(p.hint("merge"), F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")))
             .select("place", "sid", "text").repartition("place").sortWithinPartitions("place")
             .mapInArrow(_exact(percent, words), "a long, b long"))
    comps = components(exact, "near-exact")

    named = one.select("sid", "least").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
    named = named.select("sid", "least", F.coalesce("root", "sid").alias("root"))
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    named = named.join(roots, "root").select("sid", "component")
    out = sets.select("doc_id", "n_shingles", "sid").join(named, "sid", "left")
    component = F.when(F.col("sid").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      component.eqNullSafe(F.col("doc_id")).alias("kept"))


def _with_sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sketch: the lowest byte of each token of the signature."""
    for part in parts:
        flat = part.column(1).flatten().to_numpy().astype(np.uint8).reshape(-1, SIGNATURE)
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([x.tobytes() for x in flat], pa.binary())],
                                         names=["sid", "sig", "sketch"])
