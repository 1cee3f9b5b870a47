import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sightline.llm import op9_exact as exact


@pytest.mark.parametrize("n", [0, 1, 2, 7, 500, 30_000])
def test_filter_has_its_keys_and_few_others(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**63, n, dtype=np.int64).astype(np.uint64)
    made = exact.build_filter(np.concatenate([keys, keys]))
    assert exact.in_filter(keys, *made).all()
    assert exact.in_filter(rng.integers(0, 2**63, 100_000, dtype=np.int64).astype(np.uint64), *made).mean() < 1e-3


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[exact.normal(t)].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(str(i), keep, len(ids), i == keep, hashlib.sha256(text).hexdigest()) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("buckets", [20_000, 2])
def test_equals_brute_force(spark, monkeypatch, edge_docs, buckets):
    monkeypatch.setattr(exact, "BUCKET_KEYS", buckets)
    more = spark.createDataFrame([(100 + i, f"Text {i % 30} É") for i in range(200)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").unionByName(more)
    late = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(True))
    got = exact.dedupe_all(spark, [docs.where(~late), docs.where(late)]).collect()
    assert sorted(((str(r.doc_id), r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == brute(
        [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_sides(spark, no_docs, edge_docs):
    assert exact.dedupe_all(spark, [no_docs, no_docs]).collect() == []
    for parts in ([no_docs, edge_docs], [edge_docs, no_docs]):
        assert exact.dedupe_all(spark, parts).count() == 17
