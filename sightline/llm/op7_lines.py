"""Line dedup by a segment-partition edit join.

A line counts as a copy if an equal line, or one within `max_edits` edits (insert, delete, replace a code point), occurs
earlier. Earlier is by (id, line number). Lines are compared without blanks at their ends. Lines of fewer than MIN_CHARS
code points always stay; equality counts from MIN_CHARS on, likeness from NEAR_CHARS on.

Equal lines are settled by a 128-bit digest, grouped with partial aggregation. For likeness a line of length n is cut
into max_edits + 1 segments; of two lines within max_edits edits the longer one holds some segment of the shorter one
unchanged, near its old place. So segments are indexed by (length, number, content), and each line probes the lengths
n - max_edits to n with the few substrings that can match (those that leave enough edits to both sides). Index and probes
meet in one equi-join; rows carry a parity sketch of the line's characters, which two edits move by four bits at most, so
unlike lines that share a segment are dropped inside the join. What is left is verified on the lines themselves with a
banded bit-parallel edit distance.

Texts to verify are found again by one scan with a filter bitmap of fixed size (FILTER_BITS) of the candidates: its false
positives only cost a row each. Everything else is joined or grouped by Spark; a line that a third of all documents
share is one row per task after the first step.

Defined results: a null text stays null and has no lines. Rows that repeat an id count as one document: a line stays in
all of them or in none. Null ids come after all others. Columns other than id and text pass through untouched; a column
named n_chars is set to the new length where it is a whole number. A document that loses all its lines gets an empty
text; `drop_empty` removes it. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import batches, cut_lineage, small_batches
from sightline.llm.shingles import mix, powers

MIN_CHARS, NEAR_CHARS = 20, 40
#: Bits of the filter that finds the texts of candidates again, and of the parity sketch.
FILTER_BITS, SKETCH_BITS = 1 << 25, 20
#: Lines a task remembers so as not to index them twice.
SEEN = 200_000
BLANK = " \t\r"
_U = np.uint64
_LAST = 2**63 - 1


def digest(line: str) -> bytes:
    return hashlib.blake2b(line.encode(), digest_size=16).digest()


def lines_of(text: str | None) -> list[str]:
    return [] if text is None else text.split("\n")


class Lines:
    """Hashes over the lines of a batch."""

    BASE = 0x9E3779B97F4A7C15
    UNDO = pow(BASE, -1, 2**64)

    def __init__(self, lines: list[str]):
        codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(_U)
        self.n = np.fromiter(map(len, lines), np.int64, len(lines))
        self.first = np.concatenate(([0], np.cumsum(self.n)))
        longest = int(self.n.max(initial=0))
        place = np.arange(len(codes)) - np.repeat(self.first[:-1], self.n)
        self.sums = np.concatenate(([_U(0)], np.cumsum((codes + _U(1)) * powers(self.BASE, longest + 1)[place])))
        self.undo = powers(self.UNDO, longest + 1)
        self.codes = codes

    def part(self, which: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Hash of `length` code points from `start` of the lines `which`; equal parts hash equal wherever they are."""
        a = self.first[which] + start
        return (self.sums[a + length] - self.sums[a]) * self.undo[start]

    def refs(self) -> np.ndarray:
        """Parity sketch in the high bits, hash of the line in the low ones."""
        if not len(self.n):
            return np.zeros(0, _U)
        bit = _U(1) << (mix(self.codes) % _U(SKETCH_BITS))
        # No line here is empty, as reduceat needs.
        sketch = np.bitwise_xor.reduceat(bit, self.first[:-1])
        which = np.arange(len(self.n))
        return sketch << _U(64 - SKETCH_BITS) | mix(self.part(which, np.zeros_like(which), self.n)) >> _U(SKETCH_BITS)


def segment(n: np.ndarray, edits: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of segment i (from 0) of lines of n code points: even, the longer ones last."""
    base, long = n // (edits + 1), n % (edits + 1)
    short = edits + 1 - long
    return i * base + np.maximum(0, i - short), base + (i >= short)


def _key(n: np.ndarray, i: int, h: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(n.astype(_U) * _U(64) + _U(i)))


def index_keys(lines: Lines, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    which = np.arange(len(lines.n))
    for i in range(edits + 1):
        start, length = segment(lines.n, edits, i)
        yield which, _key(lines.n, i, lines.part(which, start, length))


def probe_keys(lines: Lines, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each shorter length and segment, the substrings that still leave as many edits as needed on either side."""
    for less in range(edits + 1):
        n = lines.n - less
        for i in range(edits + 1):
            start, length = segment(n, edits, i)
            low, high = max(-i, less - (edits - i)), min(i, less + (edits - i))
            for move in range(low, high + 1):
                which = np.flatnonzero((n > 0) & (start + move >= 0) & (start + move + length <= lines.n))
                yield which, _key(n[which], i, lines.part(which, (start + move)[which], length[which]))


def edit_distance_within(a: str, b: str, most: int) -> bool:
    """Whether a and b are at most `most` edits apart: bit-parallel, over a band of 2 * most + 1 diagonals.

    Equal ends are cut off first. Bit k of the vectors at column j stands for row j - most + k, so the band moves down
    the diagonal by itself.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return False
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    a, b = a[lo:], b[lo:]
    lo, hi = 0, len(a)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[len(a) - mid:] == b[len(b) - mid:] else (lo, mid - 1)
    a, b = a[:len(a) - lo], b[:len(b) - lo]
    if not a:
        return len(b) <= most
    m, full, top = len(a), (1 << 2 * most + 1) - 1, 1 << 2 * most
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    up, down = full & ~((1 << most) - 1), 0  # column 0 in the band of column 1: each row one more than the row above
    dist = min(most, m)  # at the lowest row of the band, or at row m once the band has passed it
    for j in range(1, len(b) + 1):
        shift = j - most - 1  # bit 0 is row j - most, whose character is a[shift]
        match = rows.get(b[j - 1], 0)
        match = (match >> shift if shift >= 0 else match << -shift) & full
        level = ((((match & up) + up) ^ up) | match | down) & full
        more, fewer = down | ~(level | up) & full, level & up & full
        if j + most <= m:
            dist += not level & top
        else:
            row = m - j + most  # bit of row m
            dist += (more >> row & 1) - (fewer >> row & 1)
        level >>= 1
        up, down = (fewer | ~(level | more)) & full, level & more
    return dist <= most


def _occurrences(min_chars: int):
    schema = pa.schema([("line", pa.binary()), ("ord", pa.int64()), ("pos", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen = set()
                for pos, line in enumerate(lines_of(text)):
                    line = line.strip(BLANK)
                    if len(line) >= min_chars and (d := digest(line)) not in seen:
                        seen.add(d)
                        rows.append((d, i, pos))
            yield from batches(rows, schema, 100_000)

    return run, "line binary, ord long, pos int"


def _near_lines(parts: Iterator[pa.RecordBatch], near_chars: int) -> Iterator[list[tuple[str, int, int]]]:
    for part in parts:
        out = []
        for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
            for pos, line in enumerate(lines_of(text)):
                line = line.strip(BLANK)
                if len(line) >= near_chars:
                    out.append((line, i, pos))
        if out:
            yield out


def _segments(edits: int, near_chars: int, keys):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in _near_lines(parts, near_chars):
            lines = Lines([r[0] for r in rows])
            refs, new = lines.refs(), []
            for i, ref in enumerate(refs.tolist()):
                if ref not in seen:
                    seen.add(ref)
                    new.append(i)
            if len(seen) > SEEN:
                seen.clear()
            fresh = np.zeros(len(refs), bool)
            fresh[new] = True
            for which, key in keys(lines, edits):
                ok = fresh[which]
                yield pa.RecordBatch.from_arrays([pa.array(key[ok].view(np.int64)), pa.array(refs[which[ok]].view(np.int64))],
                                                 names=["key", "ref"])

    return run, "key long, ref long"


def slots(refs: np.ndarray) -> list[np.ndarray]:
    h = mix(refs)
    return [(h * _U(s) >> _U(32)) % _U(FILTER_BITS) for s in (0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5)]


def filter_of(refs: DataFrame) -> np.ndarray:
    """The bitmap of refs (ref long): set per task, joined by bitwise or. Its size is fixed, whatever refs hold."""
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(FILTER_BITS // 64, _U)
        for part in parts:
            for at in slots(part.column(0).to_numpy().view(_U)):
                np.bitwise_or.at(bits, (at // _U(64)).astype(np.int64), _U(1) << at % _U(64))
        words = np.flatnonzero(bits)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(bits[words].view(np.int64))], names=["word", "bits"])

    words = refs.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, _U)
    bits[words.column("word").to_numpy()] = words.column("bits").to_numpy().view(_U)
    return bits


def _find_texts(shared, near_chars: int):
    schema = pa.schema([("ref", pa.int64()), ("line", pa.binary()), ("ord", pa.int64()), ("pos", pa.int32()), ("text", pa.string())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = shared.value, {}
        for rows in _near_lines(parts, near_chars):
            refs = Lines([r[0] for r in rows]).refs()
            ok = np.ones(len(refs), bool)
            for at in slots(refs):
                ok &= (bits[(at // _U(64)).astype(np.int64)] >> at % _U(64) & _U(1)).astype(bool)
            out = []
            for k in np.flatnonzero(ok).tolist():
                line, i, pos = rows[k]
                d = digest(line)
                if seen.get(d, (_LAST, 0)) > (i, pos):
                    seen[d] = (i, pos)
                    out.append((int(refs[k].view(np.int64)), d, i, pos, line))
            if len(seen) > SEEN:
                seen.clear()
            yield from batches(out, schema)

    return run, "ref long, line binary, ord long, pos int, text string"


def _verified(edits: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ok = [edit_distance_within(a, b, edits) for a, b in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(2).filter(pa.array(ok))], names=["line"])

    return run, "line binary"


def similar_lines(rows: DataFrame, max_edits: int, near_chars: int) -> DataFrame:
    """(line) digests of the lines of `rows` (ord, text) that have an earlier line within max_edits, not equal to them."""
    index = rows.mapInArrow(*_segments(max_edits, near_chars, index_keys)).select("key", F.col("ref").alias("a"))
    probe = rows.mapInArrow(*_segments(max_edits, near_chars, probe_keys)).select("key", F.col("ref").alias("b"))
    moved = F.bit_count(F.shiftrightunsigned(F.col("a").bitwiseXOR(F.col("b")), 64 - SKETCH_BITS))
    pairs = index.join(probe, "key").where((F.col("a") != F.col("b")) & (moved <= 2 * max_edits))
    pairs = cut_lineage(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "line-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("ref"))
    shared = rows.sparkSession.sparkContext.broadcast(filter_of(ends))
    found = rows.mapInArrow(*_find_texts(shared, near_chars)).join(ends.distinct(), "ref", "left_semi")
    found = cut_lineage(found.groupBy("ref", "line").agg(F.min(F.struct("ord", "pos")).alias("at"), F.first("text").alias("text")), "line-texts")
    one = found.select(F.col("ref").alias("a"), F.col("line").alias("a_line"), F.col("at").alias("a_at"), F.col("text").alias("a_text"))
    two = found.select(F.col("ref").alias("b"), F.col("line").alias("b_line"), F.col("at").alias("b_at"), F.col("text").alias("b_text"))
    later = F.when(F.col("a_at") < F.col("b_at"), F.col("b_line")).otherwise(F.col("a_line"))
    return (pairs.join(one, "a").join(two, "b").select("a_text", "b_text", later.alias("later"))
            .mapInArrow(*_verified(max_edits)).distinct())


def _rebuild(names: list[str], at: int, size_at: int | None, min_chars: int, drop_empty: bool):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts, before, after = [], [], []
            for text, gone in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True):
                gone, seen, out, all_lines = set(gone or ()), set(), [], lines_of(text)
                for line in all_lines:
                    s = line.strip(BLANK)
                    if len(s) >= min_chars:
                        d = digest(s)
                        if d in gone or d in seen:
                            continue
                        seen.add(d)
                    out.append(line)
                texts.append(None if text is None else "\n".join(out))
                before.append(len(all_lines))
                after.append(len(out))
            cols = list(part.columns[:len(names)])
            cols[at] = pa.array(texts, pa.string())
            if size_at is not None:
                cols[size_at] = pa.array([None if t is None else len(t) for t in texts], cols[size_at].type)
            out = pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(after, pa.int64())],
                                             names=[f"c{i}" for i in range(len(names) + 2)])
            if drop_empty:
                out = out.filter(pa.array([not (b and not t) or b == a for b, a, t in zip(before, after, texts, strict=True)]))
            yield out

    return run


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_chars: int = MIN_CHARS, near_chars: int = NEAR_CHARS,
                id_col: str = "doc_id", text_col: str = "text", drop_empty: bool = False, counts: bool = False) -> DataFrame:
    """`docs` with later copies of lines taken out of the texts. counts: adds n_lines and n_kept."""
    rows = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST)).alias("ord"), F.col(text_col).alias("text"))
    seen = rows.mapInArrow(*_occurrences(min_chars))
    groups = seen.groupBy("line").agg(F.min("ord").alias("owner"), F.count(F.lit(1)).alias("n"))
    near = similar_lines(rows, max_edits, near_chars).select("line", F.lit(True).alias("near")) if max_edits else None
    known = groups.where("n > 1").select("line", "owner")
    if near is not None:
        known = known.join(near, "line", "full")
    else:
        known = known.withColumn("near", F.lit(None).cast("boolean"))
    known = cut_lineage(known, "line-known")
    gone = (seen.select("line", "ord").join(known, "line").where(F.coalesce("near", F.lit(False)) | (F.col("owner") != F.col("ord")))
            .groupBy("ord").agg(F.collect_set("line").alias("gone")))
    names = docs.columns
    plain = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)])
    key = F.coalesce(F.col(f"c{names.index(id_col)}").cast("long"), F.lit(_LAST))
    joined = plain.join(gone, key == F.col("ord"), "left").select(*plain.columns, "gone")
    whole = {"bigint", "int"}
    size_at = names.index("n_chars") if dict(docs.dtypes).get("n_chars") in whole else None
    schema = ", ".join([f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema)]
                       + [f"c{len(names)} long, c{len(names) + 1} long"])
    out = joined.mapInArrow(_rebuild(names, names.index(text_col), size_at, min_chars, drop_empty), schema)
    cols = [F.col(f"c{i}").alias(c) for i, c in enumerate(names)]
    if counts:
        cols += [F.col(f"c{len(names)}").alias("n_lines"), F.col(f"c{len(names) + 1}").alias("n_kept")]
    return out.select(*cols)
