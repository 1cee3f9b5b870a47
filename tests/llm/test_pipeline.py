import corpus_pipeline
import public_tokenizers
from test_bpe import RANKS
from test_lines import brute as lines_brute
from test_near import brute as near_brute

from sightline.llm import op7_lines, op8_bpe
from sightline.llm.common import cut_lineage


def test_each_stage_against_its_own_input(spark, tmp_path_factory):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        after = cut_lineage(stage(spark, docs, "/root/testdata/sf0.001"))
        rows = {r.doc_id: r for r in after.collect()}
        assert len(rows) == after.count() and rows.keys() <= before.keys() and rows
        if name != "encode":
            assert after.columns == docs.columns
        if name == "language":
            assert all(before[i].text == r.text for i, r in rows.items()) and len(rows) >= 0.98 * len(before)
        if name == "lines":
            want = lines_brute([(i, r.text) for i, r in before.items()], 0, 20, 40)
            exact = {r.doc_id: r.text for r in op7_lines.dedup_lines(docs, 0).collect()}
            assert exact == want and all(rows[i].text in (t, rows[i].text) and len(rows[i].text) <= len(t) for i, t in exact.items() if i in rows)
        if name == "near_duplicates":
            assert rows.keys() == {i for i, (_, c) in near_brute([(i, r.text) for i, r in before.items()], 80).items() if i == c}
        if name == "mixture":
            total = sum(len(r.text.split()) for r in before.values())
            assert 0.3 * total < sum(len(r.text.split()) for r in rows.values()) <= corpus_pipeline.PERCENT / 100 * total
        if name == "encode":
            enc = op8_bpe.Encoder(op8_bpe.load_ranks(RANKS), public_tokenizers.PATTERN)
            assert {i: r.n_tokens for i, r in rows.items()} == {i: len(enc.encode(r.text)) for i, r in before.items()}
        docs = after


def test_catalogue_has_every_operator():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {f"op{n}_" for n in range(1, 11)} == {x.split("_")[0] + "_" for x in names if x.startswith("op") and x[2].isdigit()}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
