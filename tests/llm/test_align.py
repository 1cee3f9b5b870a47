import bisect
import hashlib
from collections import Counter

import public_tokenizers
import pytest

from sightline.llm import op13_align as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tables():
    return al.a_table(A), al.b_table(B)


def brute(text, tables):
    (ta, bytes_a), (tb, bytes_b) = tables
    if not text:
        return None
    want = (" " + text).encode()
    a = ta.encode(" " + text, add_special_tokens=False).ids
    b = tb.encode(text)
    if b"".join(bytes_a[x] for x in a) != want or b"".join(bytes_b[x] for x in b) != want:
        return None
    ends_a, ends_b, at = [], [], 0
    for x in a:
        at += len(bytes_a[x])
        ends_a.append(at)
    at = 0
    for x in b:
        at += len(bytes_b[x])
        ends_b.append(at)
    cuts = sorted(set(ends_a) & set(ends_b))
    ga = [bisect.bisect_left(cuts, e) for e in ends_a]
    gb = [bisect.bisect_left(cuts, e) for e in ends_b]
    links, text_groups = [], []
    in_a, in_b = [[] for _ in cuts], [[] for _ in cuts]
    for x, g in zip(a, ga, strict=True):
        in_a[g].append(x)
    for x, g in zip(b, gb, strict=True):
        in_b[g].append(x)
    for xa, xb in zip(in_a, in_b, strict=True):
        text_groups.append(",".join(map(str, xa)) + "|" + ",".join(map(str, xb)))
        links += [(p, q) for p in xa for q in xb]
    return len(a), len(b), len(cuts), links, hashlib.sha256(";".join(text_groups).encode()).hexdigest()


def test_alignment_equals_brute_force(spark, edge_docs, no_docs, tables):
    texts = ["Hello world", "Hello  world", "naïve Straße 日本語 🎉", "<|endoftext|> <s> </s> spelled out", "a\tb\nc",
             "x" * 3000, "The the THE the.", "Hello world"]
    extra = spark.createDataFrame([(100 + i, t, "en", "s", 0, "x", "y", "z") for i, t in enumerate(texts)], edge_docs.schema)
    df = edge_docs.unionByName(extra)
    rows = df.collect()
    found = [brute(r.text, tables) for r in rows]
    counts = Counter(p for f in found if f for p in set(f[3]))
    top = Counter()
    for (a, _), c in counts.items():
        top[a] = max(top[a], c)
    want = []
    for r, f in zip(rows, found, strict=True):
        if f is None:
            want.append((r.doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_best = sum(1 for p in f[3] if counts[p] == top[p[0]])
        want.append((r.doc_id, f[0], f[1], f[2], len(f[3]), n_best, sum(counts[p] for p in f[3]), f[4]))
    got = [tuple(r) for r in al.align(df, A, B).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert any(w[1] for w in want) and any(w[1] == 0 and w[0] is not None for w in want)
    assert al.align(no_docs, A, B).count() == 0


def test_lockstep_cuts_where_both_end():
    import numpy as np

    ga, gb, groups = al.lockstep([np.array([2, 3, 5]), np.array([1])], [np.array([1, 3, 5]), np.array([1])])
    assert ga.tolist() == [0, 0, 1, 0] and gb.tolist() == [0, 0, 1, 0] and groups.tolist() == [2, 1]


def test_words_give_the_library_ids_of_latin_texts():
    """Ids of Latin texts come from remembered words; before, each text went through the whole library."""
    import random

    rng = random.Random(7)
    texts = [f" a{chr(c)}b  {chr(c)} 1'll" for c in range(0x180)] + [" <|endoftext|> x\n\n y "]
    texts += [" " + "".join(rng.choice([chr(rng.randrange(0x180)), "Ab", " ", "  ", "'s", "12"]) for _ in range(40)) for _ in range(500)]
    tok, _, words, *_ = al._models(A, B)
    assert words.usable and all(words.knows(t) for t in texts) and not words.knows("日")
    assert [words.encode(t).tolist() for t in texts] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert len(words) > 0


def test_lockstep_of_a_long_document_takes_pieces(monkeypatch):
    """Documents are cut where both end, and groups are numbered on; before, a long document was one run of steps."""
    import numpy as np

    rng = np.random.default_rng(1)
    docs = [np.unique(rng.integers(1, 900, n)) for n in (1, 5, 400, 300)]
    ends_a = [np.union1d(x, [900]) for x in docs]
    ends_b = [np.union1d(np.unique(rng.integers(1, 900, n)), [900]) for n in (700, 3, 500, 1)]
    monkeypatch.setattr(al, "SPAN", 10_000)
    want = al.lockstep(ends_a, ends_b)
    monkeypatch.setattr(al, "SPAN", 3)
    assert len(al._pieces(ends_a[2], ends_b[2])[0]) > 20
    for x, y in zip(al.lockstep(ends_a, ends_b), want, strict=True):
        assert x.tolist() == y.tolist()
    cuts = [np.intersect1d(x, y) for x, y in zip(ends_a, ends_b, strict=True)]
    assert want[2].tolist() == [len(c) for c in cuts]
    assert want[0].tolist() == np.concatenate([np.searchsorted(c, x) for c, x in zip(cuts, ends_a, strict=True)]).tolist()


def test_group_text_is_built_in_numbers_of_eight_bytes():
    """Before, the text was joined of one string per token."""
    import numpy as np

    names = al._names(1 << al.ID_BITS)
    assert names.dtype == np.uint64 and names.shape == (3, 1 << al.ID_BITS)
    a, b = np.array([0, 1048575, 10]), np.array([7, 100000])
    got = al._group_text(a, np.array([0, 0, 1]), b, np.array([0, 1]), np.array([2, 1]), np.array([1, 1]), names)
    assert got == b"0,1048575|7;10|100000"


def test_pairs_are_joined_by_one_number(spark):
    """Before, the pairs were sorted by two ids, of which a sort compares only the first without looking at the rows."""
    plan = al.align(spark.createDataFrame([(1, "the words")], "doc_id long, text string"), A, B)._jdf.queryExecution().toString()
    assert "hashpartitioning(pair" in plan and ", b#" not in plan
