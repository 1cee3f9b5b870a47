import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from sightline.llm import op8_bpe as bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def both():
    ranks = bpe.load_ranks(RANKS)
    return bpe.Encoder(ranks, public_tokenizers.PATTERN), tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_perfect_hash_is_minimal_and_exact(both):
    ranks = bpe.load_ranks(RANKS)
    table = both[0].whole
    assert table.n == len(ranks) == len({*table.keys})
    assert all(table.get(k) == v for k, v in ranks.items())
    assert table.get(b"no such token at all") is None and bpe.PerfectHash({}).get(b"a") is None


def test_encodes_as_the_library_does(both):
    rng = random.Random(1)
    texts = ["", "'s 'RE don't", "\u0000\x1c  \n\n x", "a" * 3000, " " * 500, "naïve Straße 日本語 🎉🎉", "<|endoftext|>"]
    texts += ["".join(rng.choice("abc éß\n12.'日") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    for t in texts:
        assert both[0].encode(t).tolist() == both[1].encode_ordinary(t)


def test_round_trip_and_edge_cases(spark, edge_docs, no_docs, both):
    rows = bpe.digests(edge_docs, RANKS, public_tokenizers.PATTERN).collect()
    want = sorted((str(r.doc_id), len(ids := both[1].encode_ordinary(r.text or "")),
                   hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                   hashlib.sha256((r.text or "").encode()).hexdigest()) for r in edge_docs.collect())
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == want
    assert bpe.digests(no_docs, RANKS, public_tokenizers.PATTERN).collect() == []


def test_decode_of_null_and_unknown_ids(spark):
    got = bpe.decode(spark.createDataFrame([(1, None), (2, [])], "k int, ids array<int>"), RANKS).collect()
    assert [bytes(r.decoded) for r in got] == [b"", b""]
    with pytest.raises(Exception, match="vocabulary"):
        bpe.decode(spark.createDataFrame([(1, [60000])], "k int, ids array<int>"), RANKS).collect()
