import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import prose
from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import op10_chosen_path as near
from sightline.llm.common import components
from sightline.llm.shingles import shingle_sets

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text):
    w = WORD.findall((text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(docs, percent):
    """id -> (set size, smallest id reachable), for distinct ids."""
    sets = {i: plain_set(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            shared.update((j, i) for j in holders[x])
            holders[x].append(i)
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(rng):
    words = [prose(rng, 1) + str(k) for k in range(400)]
    docs = []
    for g in range(40):
        base = [rng.choice(words) for _ in range(rng.randint(6, 150))]
        for _ in range(rng.choice([1, 1, 2, 6])):
            new = list(base)
            for _ in range(rng.randint(0, 3)):
                new[rng.randrange(len(new))] = rng.choice(words)
            docs.append(" ".join(new))
    rng.shuffle(docs)
    return list(enumerate(docs))


@given(st.lists(st.text(alphabet="ab AÉ\t\n\x1c", max_size=40), max_size=6))
@settings(max_examples=100, deadline=None)
def test_shingle_sets_have_the_size_of_plain_ones(texts):
    assert [len(s) for s in shingle_sets(texts)] == [len(plain_set(t)) for t in texts]


@pytest.mark.parametrize("percent, node", [(85, 200), (80, 3)])
def test_components_equal_brute_force(spark, monkeypatch, percent, node):
    """node 3 makes the trees branch to the end and link whole nodes."""
    monkeypatch.setattr(near, "NODE", node)
    monkeypatch.setattr(near, "BLOCK", 400)  # components are cut into blocks
    docs = corpus(random.Random(percent))
    got = near.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edge_cases(spark, edge_docs, no_docs):
    rows = near.near_duplicates(edge_docs).collect()
    assert len(rows) == 17
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [(r.component_id, r.kept) for r in by[1]] == [(1, True)] * 2
    assert by[2][0].component_id == 1 and by[3][0].component_id == 1
    assert all((by[i][0].n_shingles, by[i][0].component_id, by[i][0].kept) == (0, i, True) for i in (4, 5, 6))
    assert by[8][0].component_id == 7 and by[10][0].component_id == 9
    assert sorted((r.n_shingles > 0, r.component_id, r.kept) for r in by[None] if r.component_id) == [(True, 1, False)]
    assert sum(r.component_id is None and r.kept for r in by[None]) == 2
    assert near.near_duplicates(no_docs).collect() == []


def test_cluster_equals_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(30):
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12)).astype(np.uint64)) for _ in range(rng.integers(2, 12))]
        root = list(range(len(sets)))
        for i, j in near.cluster(sets, 60):
            a, b = near._find(root, i), near._find(root, j)
            root[max(a, b)] = min(a, b)
        want = list(range(len(sets)))
        for i, x in enumerate(sets):
            for j, y in enumerate(sets):
                both = len(np.intersect1d(x, y))
                if i != j and 100 * both >= 60 * (len(x) + len(y) - both):
                    a, b = near._find(want, i), near._find(want, j)
                    want[max(a, b)] = min(a, b)
        groups = lambda r: {frozenset(k for k in range(len(sets)) if near._find(r, k) == near._find(r, i)) for i in range(len(sets))}
        assert groups(root) == groups(want)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (200, None)]
    got = {r["id"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), "test").collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys(range(100, 140), 100)}
    assert components(spark.createDataFrame([], "a long, b long"), "test").collect() == []


def test_a_level_of_branches_is_computed_once(spark, monkeypatch):
    """Before, the children of a level were made twice, to be counted and to be joined with their counts."""
    plans = []
    cut = near.cut_lineage

    def seen(df, purpose="step"):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString().count("Generate explode(knownnotcontainsnull(filter("))
        return cut(df, purpose)

    monkeypatch.setattr(near, "NODE", 3)
    rng = random.Random(11)
    words = [f"w{k}" for k in range(300)]
    base = " ".join(rng.choice(words) for _ in range(40))
    docs = [(i, base + " " + " ".join(rng.choice(words) for _ in range(60))) for i in range(60)]
    sets = near.signatures(spark.createDataFrame(docs, "doc_id long, text string"))
    reps = cut(sets.select("sid", "sig").mapInArrow(near._with_sketch, "sid long, sig array<int>, sketch binary"), "t")
    monkeypatch.setattr(near, "cut_lineage", seen)
    near.candidates(reps, 85)
    assert max(plans) == 1 and sum(plans) == near.DEPTH - 1


def test_one_odd_head_does_not_make_a_group_branch(spark):
    """Before, a large node was held against its smallest set only."""
    alike, odd = list(range(near.SIGNATURE)), list(range(1000, 1000 + near.SIGNATURE))
    sigs = spark.createDataFrame([(i, odd if i == 0 else alike) for i in range(20)], "sid long, sig array<int>")
    large = sigs.selectExpr("1L node", "sid", "0L head", "3L head_b", "7L head_c")
    assert [r.node for r in near._alike(large, sigs, near.agreeing(85)).collect()] == [1]
    apart = spark.createDataFrame([(i, [i] * near.SIGNATURE) for i in range(20)], "sid long, sig array<int>")
    assert near._alike(large, apart, near.agreeing(85)).collect() == []
