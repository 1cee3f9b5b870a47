import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import op5_language as lang

SYLLABLES = {"en": ["the", "ing", "wh", "ou", "th", "ed"], "de": ["sch", "ung", "ein", "ß", "ch", "tz"], "fr": ["eau", "é", "oi", "que", "ment", "ç"]}


def text(rng, la, n=20):
    return " ".join("".join(rng.choice(SYLLABLES[la]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        la = rng.choice(list(SYLLABLES))
        host = {"en": "a.example.com", "de": "b.example.de", "fr": "c.example.fr"}[la]
        # One in ten declares another language than it is written in.
        rows.append((i, text(rng, la), la, la if rng.random() < 0.9 else rng.choice(list(SYLLABLES)), host))
    return spark.createDataFrame(rows, "doc_id long, text string, truth string, declared string, host string")


def test_held_out_accuracy(docs):
    """Trained on even ids with noisy labels, judged on odd ones."""
    model = lang.train(docs.where("doc_id % 2 = 0"), "declared")
    odd = docs.where("doc_id % 2 = 1")
    got = lang.identify(odd, F.col("declared"), F.col("host"), model=model).join(odd.select("doc_id", "truth"), "doc_id").collect()
    assert sum(r.lang_found == r.truth for r in got) >= 0.97 * len(got) and all(r.kept for r in got)


def test_other_evidence_decides_where_the_text_does_not(spark, docs):
    model = lang.train(docs, "truth")
    shared = [(1000 + i, "x", None, d, h) for i, (d, h) in enumerate([("de", None), (None, "c.example.fr"), (None, "new.example.fr"), ("en", "a.example.com")])]
    both = docs.unionByName(spark.createDataFrame(shared, docs.schema))
    got = {r.doc_id: r.lang_found for r in lang.identify(both, F.col("declared"), F.col("host"), model=model).where("doc_id >= 1000").collect()}
    assert got == {1000: "de", 1001: "fr", 1002: "fr", 1003: "en"}


def test_channels_and_hosts_equal_brute_force(spark, docs):
    """Count tables against counts of the same decisions made one by one."""
    import math

    model = lang.train(docs, "truth")
    rows = docs.select("doc_id", "text", "declared", "host", lang.suffix_of(F.col("host")).alias("suffix"))
    said = lang.with_text_evidence(rows, model, "text", "said").collect()
    n = len(model.languages)
    best = [max(range(n), key=lambda k: (r.said[k], -k)) for r in said]
    evidence = lang.Evidence(spark.createDataFrame([(r.said, r.declared, r.suffix, r.host) for r in said],
                                                   "said array<double>, declared string, suffix string, host string"), model)
    for r in evidence.declared.collect():
        every = sum(x.declared == r.declared for x in said)
        for k in range(n):
            c = sum(b == k and x.declared == r.declared for b, x in zip(best, said, strict=True))
            assert r.declared_log[k] == pytest.approx(math.log((c + lang.SMOOTH * every / len(said)) / (best.count(k) + lang.SMOOTH)))
    for r in evidence.host.collect():
        own = [b for b, x in zip(best, said, strict=True) if x.host == r.host]
        domain = [b for b, x in zip(best, said, strict=True) if x.host.split(".")[-2:] == r.host.split(".")[-2:]]
        for k in range(n):
            share = (best.count(k) + 1) / (len(best) + n)
            up = (domain.count(k) + lang.SMOOTH * share) / (len(domain) + lang.SMOOTH)
            assert r.host_log[k] == pytest.approx(math.log((own.count(k) + lang.SMOOTH * up) / (len(own) + lang.SMOOTH)))


def test_pipeline_goes_on_with_the_language_found(spark, docs):
    """Rows that declare another language than they are written in, or none, leave the first stage with the one found."""
    import corpus_pipeline

    declared = F.when(F.col("doc_id") % 50 == 7, None).otherwise(F.col("declared"))
    rows = docs.select("doc_id", "text", declared.alias("lang"), F.col("host").alias("source"), F.length("text").alias("n_chars"))
    kept = corpus_pipeline.language(spark, rows, "")
    assert kept.columns == rows.columns
    truth = {r.doc_id: r.truth for r in docs.collect()}
    got = {r.doc_id: r.lang for r in kept.collect()}
    assert len(got) >= 0.97 * len(truth) and sum(truth[i] == la for i, la in got.items()) >= 0.97 * len(got)


def test_edge_cases(spark, edge_docs, no_docs):
    got = lang.identify(edge_docs, F.col("lang"), F.col("source"))
    rows = got.collect()
    assert len(rows) == 17
    by = {r.doc_id: r for r in rows}
    assert all(not by[i].kept and by[i].lang_found is None for i in (4, 5, 6, 13))
    kept = lang.keep_identified(edge_docs, F.col("lang"), F.col("source"))
    assert kept.columns == edge_docs.columns and kept.count() == sum(r.kept for r in rows) == 12
    assert lang.identify(no_docs, F.col("lang"), F.col("source")).collect() == []
    unlabelled = edge_docs.withColumn("lang", F.lit(None).cast("string"))
    assert lang.keep_identified(unlabelled, F.col("lang"), F.col("source")).count() == 0


def test_text_evidence_holds_one_language_of_a_batch_at_a_time(monkeypatch):
    """The largest arrays of a batch take some 40 bytes a character, whatever the number of languages; before, 8 more
    for every language, twice."""
    import tracemalloc
    from types import SimpleNamespace as Fake

    import numpy as np
    import pyarrow as pa

    from sightline.llm import op5_language as op

    monkeypatch.setattr(op, "small_batches", lambda df: df)
    context = Fake(broadcast=lambda x: Fake(value=x))
    docs = Fake(columns=["text"], schema=[], sparkSession=Fake(sparkContext=context), mapInArrow=lambda run, schema: run)
    model = op.Model(list("abcdefgh"), np.random.default_rng(0).random((op.FEATURES, 9)).astype(np.float32))
    run = op.with_text_evidence(docs, model, "text", "said")
    part = pa.RecordBatch.from_arrays([pa.array(["some words " * 500] * 100 + [None, ""])], names=["text"])
    tracemalloc.start()
    got = list(run(iter([part])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 100 * 5500
    said = got[0].column(1).to_pylist()
    assert len(said[0]) == 9 and said[100:] == [None, None]
