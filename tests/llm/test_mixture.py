import hashlib
import random
from collections import defaultdict

import pytest
from conftest import prose
from pyspark.sql import functions as F

from sightline.llm import op3_mixture as mix

WEIGHTS = {"a": 3, "b": 1, "a/en": 2, "a/en/s1": 5, "b/fr": 4}


def shared(budget, children):
    """children: name -> (weight, held). Fill the emptiest first, again and again, until nothing changes."""
    full, left = {}, dict(children)
    while left:
        level = (budget - sum(full.values())) / sum(w for w, _ in left.values())
        over = {n: h for n, (w, h) in left.items() if h <= w * level}
        if not over:
            break
        full |= over
        left = {n: x for n, x in left.items() if n not in over}
    return full | {n: int(w * level) for n, (w, _) in left.items()}


def brute(rows, percent, seed, epochs):
    """rows: (id, domain, lang, source, tokens) -> sorted (id, epoch)."""
    held = defaultdict(int)
    for _, d, la, s, n in rows:
        for path in ("", d, f"{d}/{la}", f"{d}/{la}/{s}"):
            held[path] += n
    budgets = {"": held[""] * percent // 100}
    for depth in (1, 2, 3):
        nodes = {p for p in held if p and p.count("/") == depth - 1}
        for parent in {p.rpartition("/")[0] for p in nodes}:
            budgets |= shared(budgets[parent], {p: (WEIGHTS.get(p, 1), held[p] * epochs) for p in nodes if p.rpartition("/")[0] == parent})
    out = []
    leaves = defaultdict(list)
    for i, d, la, s, n in rows:
        leaves[f"{d}/{la}/{s}"].append((i, n))
    for leaf, docs in leaves.items():
        if not held[leaf]:
            continue
        whole, rest = divmod(budgets[leaf], held[leaf])
        out += [(i, e) for i, _ in docs for e in range(whole)]
        upto, groups = 0, defaultdict(list)
        for i, n in docs:
            groups[hashlib.md5(f"{seed}:{whole}:{'' if i is None else i}".encode()).hexdigest()].append((i, n))
        for key in sorted(groups):
            upto += sum(n for _, n in groups[key])
            if rest and upto <= rest:
                out += [(i, whole) for i, _ in groups[key]]
    return sorted(out, key=str)


@pytest.mark.parametrize("percent, epochs", [(5, 1), (60, 1), (95, 3), (100, 1)])
def test_equals_brute_force(spark, percent, epochs):
    rng = random.Random(percent)
    rows = [(i if i % 17 else None, rng.choice("aab"), rng.choice(["en", "en", "fr"]), rng.choice(["s1", "s1", "s1", "s2"]),
             prose(rng, rng.choice([0, 1, 5, 30]))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, text string")
    got = mix.mix(docs, F.col("domain"), WEIGHTS, percent, 7, epochs, report=True).collect()
    assert sorted(((r.doc_id, r.epoch) for r in got), key=str) == brute(
        [(i, d, la, s, len(t.split())) for i, d, la, s, t in rows], percent, 7, epochs)


def test_edge_cases(spark, edge_docs, no_docs):
    out = mix.mix(edge_docs, F.lit(None).cast("string"), {}, 100, 1, 1)
    assert out.columns == edge_docs.columns
    ids = [r.doc_id for r in out.collect()]
    assert ids.count(1) in (0, 2) and 7 in ids
    assert mix.mix(no_docs, F.lit("x"), WEIGHTS, 50, 1).collect() == []
    with pytest.raises(ValueError):
        mix.mix(edge_docs, F.lit("x"), {"x": 0}, 50, 1)


def test_plan_has_no_python(spark, edge_docs):
    plan = mix.mix(edge_docs, F.lit("x"), WEIGHTS, 50, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
