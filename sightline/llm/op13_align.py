"""Alignment of two tokenizers by lockstep vectorised merging.

Each text is encoded by tokenizer A (a byte-level BPE of the tokenizers library, on space + text) and B (a
sentencepiece model, which adds the space itself); special tokens are not added and their strings are plain text. Each
token has the bytes it stands for: A's vocabulary entry mapped back through the byte-level alphabet, B's piece in UTF-8
with U+2581 as a space and <0xHH> as the byte HH. Where both tokenizations end at the same byte offset they are cut; the
tokens between two cuts are a group, and every A token of a group is linked to every B token of it.

Merging. The end offsets of all tokens of a batch of documents lie in two flat arrays. One NumPy state vector holds
the A pointer, the B pointer and the group number of every document still running; each step compares the two ends
under the pointers of all of them at once, gives the token(s) that end first the document's group, advances those
pointers, counts a cut where both end together, and drops the documents that are done from the vectors. The steps of a
batch are as many as the tokens of its longest piece, whatever the number of documents: a long document is cut into pieces
where every SPAN-th A token ends, if a B token ends there too, and groups are numbered on from piece to piece.

Counting. Per document, each distinct (A id, B id) pair it links is emitted once with the number of its links.
Spark counts, per id pair, the documents that hold it (a grouped count, combined before the shuffle), takes each A id's
highest count, and joins both back; nothing is gathered in one task but one document's pairs.

Defined results: a null or empty text, or one whose joined A or B bytes differ from space + text, has no tokens: all
counts 0 and groups ''. Every row is a document of its own for the counts, repeated rows included. A null id is carried
as null. Only the id and text columns are read; extra columns change nothing. Empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage, small_batches

RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
OUT = ("row long, id long, kind int, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
       "pair long, mult long")
#: A long document is cut into pieces at the first cut after this many A tokens or a multiple; only speed depends on it.
SPAN = 256
#: Bits of a token id where ids are packed into one number.
ID_BITS = 20
#: Pre-tokens a Python worker remembers, and the longest it remembers; only speed depends on them.
MEMO, MEMO_CHARS = 300_000, 64
#: The byte-level pre-tokenizer's pattern for texts up to the code point LATIN, with letters, numbers and white space listed.
LATIN = "\u017f"
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-\u017f", "0-9²³¹¼½¾", " \t-\r\x85\xa0"
LATIN_WORDS = f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"
BYTE_PIECE = re.compile(r"<0x([0-9A-Fa-f]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the other 68 for the code points from 256 on."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    shown = {b: chr(b) for b in printable}
    extra = 0
    for b in range(256):
        if b not in shown:
            shown[b] = chr(256 + extra)
            extra += 1
    return {c: b for b, c in shown.items()}


def a_table(path: str):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    alphabet = byte_alphabet()
    vocab = tok.get_vocab(with_added_tokens=True)
    table: list[bytes] = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        table[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
    return tok, table


class Words(dict):
    """A's ids by pre-token, for texts without code points above LATIN; a bounded memory, pre-token -> its int32 ids as bytes.

    None of it is used (`usable`) unless A is a byte-level BPE with the pre-tokenizer known here and special tokens only.
    """

    def __init__(self, tok, path: str):
        super().__init__()
        config = json.load(open(path, encoding="utf-8"))
        pre = config["pre_tokenizer"] or {}
        self.usable = (config["normalizer"] is None and config["model"]["type"] == "BPE" and not config["model"]["dropout"]
                       and pre.get("type") == "ByteLevel" and pre.get("use_regex") is True and not pre["add_prefix_space"]
                       and all(t["special"] for t in config["added_tokens"]))
        self.model, self.alphabet = tok.model, {b: c for c, b in byte_alphabet().items()}
        self.find, self.other = re.compile(LATIN_WORDS).findall, re.compile(f"[^\x00-{LATIN}]").search

    def __missing__(self, word: str) -> bytes:
        ids = self.model.tokenize("".join([self.alphabet[b] for b in word.encode()]))
        out = array("i", [t.id for t in ids]).tobytes()
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = out
        return out

    def knows(self, text: str) -> bool:
        return self.usable and (text.isascii() or not self.other(text))

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.find(text))), np.int32).astype(np.int64)


def b_table(path: str):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        m = BYTE_PIECE.fullmatch(piece)
        table.append(bytes([int(m.group(1), 16)]) if m and sp.is_byte(i) else piece.replace("▁", " ").encode())
    return sp, table


def _pieces(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of A and B tokens of the pieces of a document: it is cut where every SPAN-th A token ends, if a B token does."""
    at = np.arange(SPAN - 1, len(ea) - 1, SPAN)
    pos = np.searchsorted(eb[:-1], ea[at])
    hit = pos < len(eb) - 1
    hit[hit] = eb[pos[hit]] == ea[at[hit]]
    return (np.diff(np.concatenate(([0], at[hit] + 1, [len(ea)]))), np.diff(np.concatenate(([0], pos[hit] + 1, [len(eb)]))))


def lockstep(ends_a: list[np.ndarray], ends_b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group number of every A and B token (flat, documents one after the other) and groups per document."""
    cuts = [_pieces(x, y) for x, y in zip(ends_a, ends_b, strict=True)]
    na = np.concatenate([*(x for x, _ in cuts), np.zeros(0, np.int64)]).astype(np.int64)
    nb = np.concatenate([*(y for _, y in cuts), np.zeros(0, np.int64)]).astype(np.int64)
    owner = np.repeat(np.arange(len(cuts)), [len(x) for x, _ in cuts])
    ea = np.concatenate([*ends_a, [0]]).astype(np.int64)
    eb = np.concatenate([*ends_b, [0]]).astype(np.int64)
    ga, gb = np.zeros(len(ea) - 1, np.int64), np.zeros(len(eb) - 1, np.int64)
    groups = np.zeros(len(owner), np.int64)
    stop_a, stop_b = np.cumsum(na), np.cumsum(nb)
    ia, ib = stop_a - na, stop_b - nb
    piece = np.arange(len(owner))
    g = np.zeros(len(owner), np.int64)
    live = (ia < stop_a) | (ib < stop_b)
    ia, ib, stop_a, stop_b, piece, g = ia[live], ib[live], stop_a[live], stop_b[live], piece[live], g[live]
    big = np.iinfo(np.int64).max
    while len(piece):
        a = np.where(ia < stop_a, ea[ia], big)
        b = np.where(ib < stop_b, eb[ib], big)
        step_a, step_b = a <= b, b <= a
        ga[ia[step_a]] = g[step_a]
        gb[ib[step_b]] = g[step_b]
        ia, ib = ia + step_a, ib + step_b
        g = g + (step_a & step_b)
        done = (ia >= stop_a) & (ib >= stop_b)
        if done.any():
            groups[piece[done]] = g[done]
            keep = ~done
            ia, ib, stop_a, stop_b, piece, g = ia[keep], ib[keep], stop_a[keep], stop_b[keep], piece[keep], g[keep]
    # Groups of a piece are numbered on from those of the pieces before it of its document.
    total = np.bincount(owner, weights=groups, minlength=len(cuts)).astype(np.int64)
    before = np.cumsum(groups) - groups - (np.cumsum(total) - total)[owner]
    return ga + np.repeat(before, na), gb + np.repeat(before, nb), total


def _group_text(ids_a: np.ndarray, ga: np.ndarray, ids_b: np.ndarray, gb: np.ndarray, size_a: np.ndarray, size_b: np.ndarray,
                names: np.ndarray) -> bytes:
    """`a1,a2|b1;a3|b2,b3`: every group has a token of each side, as both end at its cut. names: see `_names`."""
    out = np.empty(len(ids_a) + len(ids_b), np.uint64)
    opens_a, opens_b = np.diff(ga, prepend=-1) > 0, np.diff(gb, prepend=-1) > 0
    out[np.arange(len(ids_a)) + (np.cumsum(size_b) - size_b)[ga]] = names[np.where(opens_a, 2, 0), ids_a]
    out[np.arange(len(ids_b)) + np.cumsum(size_a)[gb]] = names[np.where(opens_b, 1, 0), ids_b]
    raw = out.view(np.uint8)
    return raw[raw != 0][1:].tobytes()


def _names(n: int) -> np.ndarray:
    """The first n numbers in decimal, after a comma, a bar and a semicolon: eight bytes each, filled up with zeros."""
    return np.array([[f"{sep}{i}" for i in range(n)] for sep in ",|;"], "S8").view(np.uint64)


def align_batch(texts: list, tok_a, table_a: list[bytes], sp_b, table_b: list[bytes], words: Words | None = None,
                names: np.ndarray | None = None):
    """Per text: (n_a, n_b, n_groups, n_links, groups_sha256) and its distinct linked pairs (a, b, links).

    words: encodes by A what it knows; the rest goes to `tok_a`.
    """
    len_a = np.fromiter(map(len, table_a), np.int64, len(table_a))
    len_b = np.fromiter(map(len, table_b), np.int64, len(table_b))
    names = _names(max(len(table_a), len(table_b))) if names is None else names
    valid = [i for i, t in enumerate(texts) if t]
    by_a = {i: words.encode(" " + texts[i]) for i in valid if words.knows(texts[i])} if words is not None else {}
    rest = [i for i in valid if i not in by_a]
    if rest:
        got = tok_a.encode_batch([" " + texts[i] for i in rest], add_special_tokens=False)
        by_a |= {i: np.asarray(e.ids, np.int64) for i, e in zip(rest, got, strict=True)}
    enc_b = sp_b.encode([texts[i] for i in valid], num_threads=1) if valid else []
    rows = [(0, 0, 0, 0, "") for _ in texts]
    pairs: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
    docs, ids_a, ids_b, ends_a, ends_b = [], [], [], [], []
    for i, xb in zip(valid, enc_b, strict=True):
        want = (" " + texts[i]).encode("utf-8", "surrogatepass")
        xa = by_a[i]
        if b"".join(map(table_a.__getitem__, xa.tolist())) != want or b"".join(map(table_b.__getitem__, xb)) != want:
            continue
        docs.append(i)
        ids_a.append(xa)
        ids_b.append(np.asarray(xb, np.int64))
        ends_a.append(np.cumsum(len_a[ids_a[-1]]))
        ends_b.append(np.cumsum(len_b[ids_b[-1]]))
    if not docs:
        return rows, pairs
    ga, gb, n_groups = lockstep(ends_a, ends_b)
    at_a = np.concatenate(([0], np.cumsum([len(x) for x in ids_a])))
    at_b = np.concatenate(([0], np.cumsum([len(x) for x in ids_b])))
    # Groups numbered through the batch; a group's document by its number.
    base = np.cumsum(n_groups) - n_groups
    all_a, all_b = ga + np.repeat(base, np.diff(at_a)), gb + np.repeat(base, np.diff(at_b))
    size_a, size_b = (np.bincount(x, minlength=n_groups.sum()) for x in (all_a, all_b))
    owner = np.repeat(np.arange(len(docs)), n_groups)
    links = np.bincount(owner, weights=size_a * size_b, minlength=len(docs)).astype(np.int64)
    # Links of a group: each A token with each B token of it; pairs of ids are counted, not listed per token.
    ua, ca = np.unique(all_a << ID_BITS | np.concatenate(ids_a), return_counts=True)
    ub, cb = np.unique(all_b << ID_BITS | np.concatenate(ids_b), return_counts=True)
    grp_a, grp_b = ua >> ID_BITS, ub >> ID_BITS
    distinct_b = np.bincount(grp_b, minlength=n_groups.sum())
    first_b, reps = (np.cumsum(distinct_b) - distinct_b)[grp_a], distinct_b[grp_a]
    left = np.repeat(np.arange(len(ua)), reps)
    right = first_b[left] + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
    mask = (1 << ID_BITS) - 1
    key = (owner[grp_a[left]] << ID_BITS | ua[left] & mask) << ID_BITS | ub[right] & mask
    order = np.argsort(key)
    key, weight = key[order], (ca[left] * cb[right])[order]
    start = np.flatnonzero(np.diff(key, prepend=-1))
    keys, mult = key[start], np.add.reduceat(weight, start)
    cut = np.searchsorted(keys >> 2 * ID_BITS, np.arange(len(docs) + 1))
    for k, i in enumerate(docs):
        a, b, own = ids_a[k], ids_b[k], slice(base[k], base[k] + n_groups[k])
        mine = slice(cut[k], cut[k + 1])
        pairs.append((i, keys[mine] >> ID_BITS & mask, keys[mine] & mask, mult[mine]))
        text = _group_text(a, ga[at_a[k]:at_a[k + 1]], b, gb[at_b[k]:at_b[k + 1]], size_a[own], size_b[own], names)
        rows[i] = (len(a), len(b), int(n_groups[k]), int(links[k]), hashlib.sha256(text).hexdigest())
    return rows, pairs


#: The models of this Python worker, so that tasks that follow each other share them and the memory of words.
_last: dict[tuple[str, str], tuple] = {}


def _models(a_path: str, b_path: str) -> tuple:
    if (a_path, b_path) not in _last:
        _last.clear()
        (tok_a, table_a), (sp_b, table_b) = a_table(a_path), b_table(b_path)
        _last[a_path, b_path] = (tok_a, table_a, Words(tok_a, a_path), sp_b, table_b, _names(max(len(table_a), len(table_b))))
    return _last[a_path, b_path]


def align(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id_col, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = small_batches(df).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                                    F.col(text_col).cast("string").alias("text"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        # Spark runs a task per core already; the library's own threads would only spin.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok_a, table_a, words, sp_b, table_b, names = _models(a_path, b_path)
        for part in parts:
            keys = part.column(0).to_numpy()
            got, pairs = align_batch(part.column(2).to_pylist(), tok_a, table_a, sp_b, table_b, words, names)
            cols = list(zip(*got, strict=True))
            n = len(got)
            yield pa.RecordBatch.from_pydict({
                "row": keys, "id": part.column(1), "kind": np.zeros(n, np.int32), **{c: np.asarray(v, np.int64) for c, v in
                                                                zip(["n_a", "n_b", "n_groups", "n_links"], cols[:4], strict=True)},
                "groups_sha256": pa.array(cols[4], pa.string()), "pair": pa.nulls(n, pa.int64()),
                "mult": pa.nulls(n, pa.int64())}, schema=SCHEMA)
            if pairs:
                # All linked id pairs of the part in one batch.
                m = np.array([len(a) for _, a, _, _ in pairs], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "row": np.repeat(keys[[i for i, _, _, _ in pairs]], m), "id": pa.nulls(int(m.sum()), pa.int64()),
                    "kind": np.ones(int(m.sum()), np.int32),
                    **{c: pa.nulls(int(m.sum()), pa.int64()) for c in ["n_a", "n_b", "n_groups", "n_links"]},
                    "groups_sha256": pa.nulls(int(m.sum()), pa.string()),
                    "pair": np.concatenate([a for _, a, _, _ in pairs]) << ID_BITS | np.concatenate([b for _, _, b, _ in pairs]),
                    "mult": np.concatenate([x for _, _, _, x in pairs])}, schema=SCHEMA)

    done = cut_lineage(rows.mapInArrow(run, OUT), "align")
    # One number for both ids: the sorts of the join need its eight bytes only, not a comparison of rows.
    pairs = done.where("kind = 1").select("row", "pair", "mult")
    counts = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("cnt")).withColumn("a", F.shiftright("pair", ID_BITS))
    # Each A id's highest count joins the (much smaller) table of counts, so the pairs are shuffled for one join only.
    counts = counts.join(counts.groupBy("a").agg(F.max("cnt").alias("top")), "a")
    scored = (pairs.join(counts, "pair").groupBy("row")
              .agg(F.sum(F.when(F.col("cnt") == F.col("top"), F.col("mult")).otherwise(0)).alias("n_best"),
                   F.sum(F.col("mult") * F.col("cnt")).alias("count_sum")))
    docs = done.where("kind = 0")
    return docs.join(scored, "row", "left").select(
        F.col("id").cast(kind).alias(id_col), "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"), "groups_sha256")


SCHEMA = pa.schema([("row", pa.int64()), ("id", pa.int64()), ("kind", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                    ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()),
                    ("pair", pa.int64()), ("mult", pa.int64())])
