"""Periodic runs of words by descending-LCP Kruskal.

The words of a batch of documents are written one after the other, each document closed by a separator word of its own,
and sorted into one suffix array by prefix doubling (NumPy sorts; the ranks of every doubling level are kept). The
suffixes of each document, taken in suffix-array order, are neighbours whose longest common prefix (LCP) is read from
the kept ranks by binary lifting. Kruskal then unites suffix classes by decreasing LCP with a union-find whose classes
hold their positions as ordered lists (the smaller class is merged into the larger). When two classes are united at
level L, two positions p < q that become neighbours in the united list and lie at most L apart seed a repetition of
period d = q - p: the text from p on has period d for at least d + L words. A seed is grown to the maximal stretch of
period d, the smallest period q of that stretch (a divisor of d, by Fine and Wilf) is found, and the stretch is a run if
it is at least max(MIN_LENGTH, MIN_EXPONENT * q) words long.

Only edges of LCP >= MIN_LEVEL are united: the first two occurrences of a run's period are a pair of LCP length - q, and
length - q >= max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q) >= 16 for every q, so lower levels can seed no run. This
is a proof, not a cut; the query checks it against brute force.

Spark deals the documents to tasks as they are read (no shuffle); each task treats the documents of an Arrow batch,
split into chunks of at most CHUNK_WORDS words (a longer document is a chunk of its own), so memory is bounded by the
longest document. Nothing is gathered across documents.

Defined results: a null or empty text has no words and no runs; words are maximal stretches of code points other than
ASCII blanks (space, tab, LF, VT, FF, CR). Rows are treated one by one, so repeated rows, ties and extra columns of any
name change nothing: only the id and text columns are read. A null id is carried as null. Empty tables give empty tables.
Of runs of equal length / period the smallest start, then the smallest period, is the `best` one.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import small_batches

#: A run is at least this long and repeats its period at least this often (fixed values of the task).
MIN_LENGTH, MIN_EXPONENT = 24, 3
#: No run can be seeded below this LCP (see the module's text).
MIN_LEVEL = min(max(MIN_LENGTH - q, (MIN_EXPONENT - 1) * q) for q in range(1, MIN_LENGTH + 1))
#: Words sorted together in one suffix array. Only memory and speed depend on it.
CHUNK_WORDS = 400_000

WORD = re.compile(r"[^\x20\x09-\x0D]+")

RESULT = ("doc_id {kind}, n_runs long, start long, length long, period long, exponent_milli long, "
          "runs_sha256 string, collapsed_sha256 string")


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text) if text else []


def planted(doc_id, words: list[str]) -> list[str]:
    """The words with a planted period: see op11 of the task. A null id plants nothing."""
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def suffix_levels(w: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Suffix array of `w` (non-negative ints) and the rank of every suffix's first 2**j words for j = 0, 1, ...

    Two suffixes have equal rank at level j exactly when their first 2**j words agree (a suffix that ends earlier
    is padded by -1, which no word equals). The last level has every rank distinct.
    """
    n = len(w)
    _, rank = np.unique(w, return_inverse=True)
    rank = rank.astype(np.int64)
    levels = [rank]
    order = np.argsort(rank, kind="stable")
    k = 1
    while n and int(rank.max()) < n - 1:
        second = np.full(n, -1, np.int64)
        second[:n - k] = rank[k:]
        order = np.lexsort((second, rank))
        a, b = rank[order], second[order]
        new = np.empty(n, bool)
        new[0] = True
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        levels.append(rank)
        k *= 2
    return order, levels


def pair_lcp(x: np.ndarray, y: np.ndarray, levels: list[np.ndarray]) -> np.ndarray:
    """LCP of suffixes x[i] and y[i], by binary lifting over the ranks of the doubling levels."""
    n = len(levels[0])
    lcp = np.zeros(len(x), np.int64)
    for j in range(len(levels) - 1, -1, -1):
        a, b = x + lcp, y + lcp
        ok = (a < n) & (b < n)
        r = levels[j]
        ok[ok] = r[a[ok]] == r[b[ok]]
        lcp += ok.astype(np.int64) << j
    return lcp


def kruskal_seeds(x: np.ndarray, y: np.ndarray, lcp: np.ndarray) -> list[tuple[int, int, int]]:
    """(p, d, level) for every pair of positions that become neighbours at distance d <= level while classes are
    united by decreasing LCP. x, y, lcp: the edges (neighbouring suffixes of one document and their LCP)."""
    parent: dict[int, int] = {}
    members: dict[int, list[int]] = {}

    def find(v: int) -> int:
        root = v
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(v, v) != root:
            parent[v], v = root, parent[v]
        return root

    seeds = []
    for i in np.argsort(-lcp, kind="stable").tolist():
        level, u, v = int(lcp[i]), find(int(x[i])), find(int(y[i]))
        if u == v:
            continue
        small, big = members.pop(u, [u]), members.pop(v, [v])
        if len(small) > len(big):
            small, big, u, v = big, small, v, u
        last_at, prev = -1, None
        for e in small:
            at = bisect_left(big, e)
            if at != last_at:
                if prev is not None and last_at < len(big) and big[last_at] - prev <= level:
                    seeds.append((prev, big[last_at] - prev, level))
                if at > 0 and e - big[at - 1] <= level:
                    seeds.append((big[at - 1], e - big[at - 1], level))
                last_at = at
            prev = e
        if prev is not None and last_at < len(big) and big[last_at] - prev <= level:
            seeds.append((prev, big[last_at] - prev, level))
        if len(small) * 8 < len(big):
            for e in small:
                insort(big, e)
        else:
            big = sorted(big + small)
        parent[u] = v
        members[v] = big
    return seeds


def runs_from_seeds(w: list[int], seeds: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run that a seed lies in; positions are of `w` (one document's words)."""
    arr = np.asarray(w, np.int64)
    found: set[tuple[int, int, int]] = set()
    seen: dict[int, list[tuple[int, int]]] = {}
    n = len(w)
    for p, d, _ in seeds:
        spans = seen.setdefault(d, [])
        at = bisect_left(spans, (p + 1, -1)) - 1
        if at >= 0 and spans[at][0] <= p < spans[at][1]:
            continue
        s = p
        while s > 0 and w[s - 1] == w[s - 1 + d]:
            s -= 1
        e = p + d
        while e < n and w[e] == w[e - d]:
            e += 1
        insort(spans, (s, e))
        length = e - s
        q = d
        for t in range(1, d):
            if d % t == 0 and np.array_equal(arr[s:e - t], arr[s + t:e]):
                q = t
                break
        if length >= max(MIN_LENGTH, MIN_EXPONENT * q):
            found.add((s, length, q))
    return sorted(found)


def find_runs(docs: list[list[str]]) -> list[list[tuple[int, int, int]]]:
    """Runs (start, length, period) of each word list, ordered by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in docs]
    live = [i for i, d in enumerate(docs) if len(d) > MIN_LEVEL]
    if not live:
        return out
    codes, vocab = pd.factorize(pd.Series([x for i in live for x in docs[i]], dtype=object), sort=False)
    codes = codes.astype(np.int64)
    lengths = np.array([len(docs[i]) for i in live], np.int64)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    # Each document is closed by a separator word of its own.
    text = np.empty(len(codes) + len(live), np.int64)
    owner = np.repeat(np.arange(len(live)), lengths + 1)
    local = np.arange(len(text)) - np.repeat(begins + np.arange(len(live)), lengths + 1)
    sep = local == np.repeat(lengths, lengths + 1)
    text[~sep] = codes
    text[sep] = len(vocab) + np.arange(len(live))
    order, levels = suffix_levels(text)
    order = order[~sep[order]]
    by_doc = order[np.argsort(owner[order], kind="stable")]
    same = owner[by_doc[1:]] == owner[by_doc[:-1]]
    x, y = by_doc[:-1][same], by_doc[1:][same]
    lcp = pair_lcp(x, y, levels)
    keep = lcp >= MIN_LEVEL
    x, y, lcp = x[keep], y[keep], lcp[keep]
    if not len(x):
        return out
    doc_of = owner[x]
    for k in np.unique(doc_of).tolist():
        pick = doc_of == k
        shift = int(begins[k] + k)
        seeds = kruskal_seeds(x[pick] - shift, y[pick] - shift, lcp[pick])
        if seeds:
            w = codes[begins[k]:ends[k]].tolist()
            out[live[k]] = runs_from_seeds(w, seeds)
    return out


def summary(words: list[str], runs: list[tuple[int, int, int]]) -> tuple:
    """n_runs, start, length, period, exponent_milli of the best run, runs_sha256, collapsed_sha256."""
    best = None
    for r in runs:
        if best is None or Fraction(r[1], r[2]) > Fraction(best[1], best[2]):
            best = r
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    drop = np.zeros(len(words) + 1, np.int64)
    for s, n, q in runs:
        drop[s + q] += 1
        drop[s + n] -= 1
    kept = np.cumsum(drop[:-1]) == 0 if words else np.zeros(0, bool)
    collapsed = " ".join(w for w, k in zip(words, kept.tolist(), strict=True) if k)
    head = (None,) * 4 if best is None else (best[0], best[1], best[2], 1000 * best[1] // best[2])
    return (len(runs), *head, hashlib.sha256(listing.encode()).hexdigest(),
            hashlib.sha256(collapsed.encode("utf-8", "surrogatepass")).hexdigest())


def _chunks(texts: list, limit: int) -> Iterator[tuple[int, int]]:
    at, size = 0, 0
    for i, words in enumerate(texts):
        if size and size + len(words) > limit:
            yield at, i
            at, size = i, 0
        size += len(words)
    if at < len(texts):
        yield at, len(texts)


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", plant: bool = True) -> DataFrame:
    """One row per row of `df`: RESULT. plant: apply the planted period of the task before runs are sought."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} must be a whole-number column, not {kind}")
    schema = pa.schema([(id_col, pa.int64()),
                        *((c, pa.int64()) for c in ("n_runs", "start", "length", "period", "exponent_milli")),
                        ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            words = [planted(i, words_of(t)) if plant else words_of(t) for i, t in zip(ids, texts, strict=True)]
            rows = []
            for a, b in _chunks(words, CHUNK_WORDS):
                for w, r in zip(words[a:b], find_runs(words[a:b]), strict=True):
                    rows.append(summary(w, r))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(7)]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in
                                              zip(cols, list(schema)[1:], strict=True))], schema=schema)

    rows = small_batches(df).select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias(text_col))
    return rows.mapInArrow(run, RESULT.replace("doc_id {kind}", f"`{id_col}` long"))
