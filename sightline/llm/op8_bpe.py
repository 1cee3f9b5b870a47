"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a pre-token that is a vocabulary entry as a whole.
Tier two: every other pre-token is merged from its bytes, with a heap of candidate pairs over a linked list, so a
pre-token of n bytes costs O(n log n) however long it is.

The vocabulary is a rank file whose path is a parameter. It is read once by the driver and broadcast: its size is
fixed by the vocabulary and does not depend on the data.

Defined results: a null text counts as empty and gives no ids; a null list of ids decodes to no bytes; an id outside
the vocabulary raises ValueError. Rows are treated one by one, so repeated rows, ties and extra columns of any name
change nothing: only `id_col` and the text or ids column are read. Empty tables give empty tables.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

#: Pre-tokens a Python worker remembers, and the longest it remembers, in bytes. Only speed depends on them.
MEMO, MEMO_BYTES = 300_000, 64
#: Ids per batch that goes back to Spark.
OUT_IDS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings by hash and displace.

    A key's first hash picks a bucket. A bucket of several keys stores a displacement that sends them to free slots;
    a bucket of one key stores its slot itself. There are exactly as many slots as keys. A slot also holds its key's
    fingerprint index, so a string outside the set is told apart by comparing the key there.
    """

    def __init__(self, ids: dict[bytes, int]):
        n = self.n = len(ids)
        self.shift = np.zeros(max(n, 1), np.int64)
        self.keys: list[bytes | None] = [None] * n
        self.ids = np.zeros(n, np.int64)
        buckets: dict[int, list[bytes]] = {}
        for key in ids:
            buckets.setdefault(xxhash.xxh3_64_intdigest(key) % n, []).append(key)
        single = []
        for bucket, held in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(held) == 1:
                single.append((bucket, held[0]))
                continue
            d = 1
            while True:
                slots = [xxhash.xxh3_64_intdigest(k, d) % n for k in held]
                if len(set(slots)) == len(slots) and all(self.keys[s] is None for s in slots):
                    break
                d += 1
            self.shift[bucket] = d
            for k, s in zip(held, slots, strict=True):
                self.keys[s] = k
        free = (s for s in range(n) if self.keys[s] is None)
        for (bucket, k), s in zip(single, list(free), strict=True):
            self.shift[bucket] = -s - 1
            self.keys[s] = k
        for s, k in enumerate(self.keys):
            self.ids[s] = ids[k]
        self.shift, self.ids = self.shift.tolist(), self.ids.tolist()

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        d = self.shift[xxhash.xxh3_64_intdigest(key) % self.n]
        s = -d - 1 if d < 0 else xxhash.xxh3_64_intdigest(key, d) % self.n
        return self.ids[s] if self.keys[s] == key else None


def pair_table(ranks: dict[bytes, int]) -> dict[int, int]:
    """left id << 32 | right id -> id of the two joined, for every pair that the vocabulary can join."""
    out = {}
    for token, rank in ranks.items():
        for i in range(1, len(token)):
            left, right = ranks.get(token[:i]), ranks.get(token[i:])
            if left is not None and right is not None:
                out[left << 32 | right] = rank
    return out


def merge(raw: bytes, ids: list[int], first: list[int], pairs: dict[int, int]) -> list[int]:
    """Ids of a pre-token: joins the pair of lowest rank, leftmost first, until no pair can be joined.

    ids: the ids of its bytes. first: the rank of each pair of bytes at index left << 8 | right, or -1. The parts are a
    linked list over the byte positions; `rank[i]` is the rank of the pair that starts at byte i, or -1. A heap entry is
    rank << 32 | start, and stale if the pair there has another rank by now.
    """
    n = len(raw)
    rank = [first[a << 8 | b] for a, b in zip(raw, raw[1:], strict=False)]
    heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
    if not heap:
        return ids
    rank.append(-1)
    heapify(heap)
    get = pairs.get
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while heap:
        top = heappop(heap)
        i, new = top & 0xFFFFFFFF, top >> 32
        if rank[i] != new:
            continue
        j = after[i]
        ids[i], ids[j], rank[j] = new, -1, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            rank[i] = r = get(new << 32 | ids[k], -1)
            if r >= 0:
                heappush(heap, r << 32 | i)
        else:
            rank[i] = -1
        k = before[i]
        if k >= 0:
            rank[k] = r = get(ids[k] << 32 | new, -1)
            if r >= 0:
                heappush(heap, r << 32 | k)
    return [x for x in ids if x >= 0]


class Encoder(dict):
    """Both tiers. As a dict it is a bounded memory: pre-token -> its ids as the bytes of an int32 array."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        super().__init__()
        self.whole, self.pairs = PerfectHash(ranks), pair_table(ranks)
        self.bytes = [ranks[bytes([i])] for i in range(256)]
        self.first = [ranks.get(bytes([i, j]), -1) for i in range(256) for j in range(256)]
        self.find = regex.compile(pattern).findall

    def __missing__(self, token: str) -> bytes:
        raw = token.encode()
        one = self.whole.get(raw)
        ids = [one] if one is not None else merge(raw, [self.bytes[x] for x in raw], self.first, self.pairs)
        out = array("i", ids).tobytes()
        if len(raw) <= MEMO_BYTES:
            if len(self) >= MEMO:
                self.clear()
            self[token] = out
        return out

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), np.int32)


#: The last encoder of this Python worker, so that tasks that follow each other share its memory.
_last: dict[str, Encoder] = {}


def _encoder(shared, pattern: str, key: str) -> Encoder:
    if key not in _last:
        _last.clear()
        _last[key] = Encoder(shared.value, pattern)
    return _last[key]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def encode(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) per row of `df`: each match of `pattern` encoded by itself, no special tokens."""
    shared = df.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))
    kind = df.schema[id_col].dataType
    key = f"{ranks_path}\n{pattern}"

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(shared, pattern, key)
        for part in parts:
            at, held, size = 0, [], 0
            for i, text in enumerate(part.column(1)):
                held.append(enc.encode(text.as_py() or ""))
                size += len(held[-1])
                if size >= OUT_IDS or i + 1 == part.num_rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).slice(at, len(held)), _lists(held)],
                                                     names=[id_col, "ids"])
                    at, held, size = i + 1, [], 0

    out = small_batches(df).select(id_col, text_col)
    return out.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, ids array<int>")


def decode(df: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """`df` with a binary column `decoded`: the bytes its ids stand for."""
    ranks = load_ranks(ranks_path)
    table: list[bytes | None] = [None] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = df.sparkSession.sparkContext.broadcast(table)
    at = df.columns.index(ids_col)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for part in parts:
            out = []
            for ids in part.column(at):
                ids = ids.values.to_numpy(zero_copy_only=False).tolist() if ids.is_valid else []
                if ids and (min(ids) < 0 or max(ids) >= len(words) or None in (got := [words[i] for i in ids])):
                    raise ValueError("an id is not in the vocabulary")
                out.append(b"".join(got) if ids else b"")
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())],
                                             names=[*part.schema.names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return small_batches(df).mapInArrow(run, f"{fields}, decoded binary")


def digests(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: its id, number of ids, SHA-256 of the ids in decimal joined by one space, SHA-256 of the decoded bytes."""
    done = decode(encode(df, ranks_path, pattern, id_col, text_col), ranks_path)
    return done.select(
        id_col, F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))
