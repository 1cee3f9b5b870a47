import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import op7_lines as ln


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, s, n, alphabet):
    s = list(s)
    for _ in range(n):
        k = rng.randrange(len(s))
        what = rng.random()
        if what < 0.34:
            s.insert(k, rng.choice(alphabet))
        elif what < 0.67 and len(s) > 1:
            s.pop(k)
        else:
            s[k] = rng.choice(alphabet)
    return "".join(s)


@given(st.text(alphabet="abc", max_size=12), st.text(alphabet="abc", max_size=12), st.integers(0, 4))
@settings(max_examples=500, deadline=None)
def test_banded_distance(a, b, most):
    assert ln.edit_distance_within(a, b, most) == (distance(a, b) <= most)


def test_segments_meet_whenever_lines_are_alike():
    rng = random.Random(2)
    for _ in range(1500):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(6, 20)))
        edits = rng.randint(1, 3)
        b = edited(rng, a, rng.randint(1, edits), "ab")
        if a == b or distance(a, b) > edits:
            continue
        short, long = sorted((a, b), key=len)
        index = {int(k) for _, keys in ln.index_keys(ln.Lines([short]), edits) for k in keys}
        probe = {int(k) for _, keys in ln.probe_keys(ln.Lines([long]), edits) for k in keys}
        assert index & probe
        x, y = ln.Lines([a, b]).refs().tolist()
        assert bin((x ^ y) >> 64 - ln.SKETCH_BITS).count("1") <= 2 * edits


def brute(docs, edits, min_chars, near_chars):
    """(id, text) of distinct ids -> id -> text without later copies."""
    first, order = {}, []
    for i, text in sorted(docs):
        for pos, line in enumerate(ln.lines_of(text)):
            s = line.strip(ln.BLANK)
            if len(s) >= min_chars and s not in first:
                first[s] = (i, pos)
                order.append(s)
    near = {s for k, s in enumerate(order) if len(s) >= near_chars
            and any(len(o) >= near_chars and abs(len(o) - len(s)) <= edits and distance(o, s) <= edits for o in order[:k])} if edits else set()
    return {i: None if t is None else "\n".join(
        x for pos, x in enumerate(ln.lines_of(t))
        if len(s := x.strip(ln.BLANK)) < min_chars or first[s] == (i, pos) and s not in near) for i, t in docs}


@pytest.mark.parametrize("edits", [0, 1, 2])
def test_equals_brute_force(spark, edits):
    rng = random.Random(edits)
    pool = ["".join(rng.choice("abcd é") for _ in range(rng.randint(3, 18))) for _ in range(40)]
    docs = []
    for i in range(60):
        docs.append((i, "\n".join(edited(rng, rng.choice(pool), rng.randint(0, 2), "abcd") for _ in range(rng.randint(1, 6)))))
    docs += [(60, None), (61, ""), (62, "\n \n")]
    got = ln.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), edits, 4, 8).collect()
    assert {r.doc_id: r.text for r in got} == brute(docs, edits, 4, 8)


def test_edge_cases(spark, edge_docs, no_docs):
    out = ln.dedup_lines(edge_docs, counts=True)
    assert out.columns == [*edge_docs.columns, "n_lines", "n_kept"]
    rows = out.collect()
    assert len(rows) == 17 and all(r.Line == "x" and r.c0 == "z" for r in rows)
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert [r.n_kept for r in rows if r.doc_id == 1] == [1, 1]  # rows that repeat an id are one document
    assert by[4].text is None and by[4].n_lines == 0 and by[5].text == "" and by[6].text == " \t\n "
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in rows)
    lost = ln.dedup_lines(edge_docs, drop_empty=True).collect()
    assert len(lost) == 17 - sum(r.n_lines > r.n_kept and not r.text for r in rows)
    assert ln.dedup_lines(no_docs).collect() == []
