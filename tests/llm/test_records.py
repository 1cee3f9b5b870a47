import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sightline.llm import op12_records as rec
from sightline.llm.common import shared_dir

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_frames_round_trip_and_damage_is_found():
    datas = [b"", b"\x00\x01\x02\x03", np.arange(1000, dtype="<u4").tobytes()]
    blob = b"".join(map(rec.frame, datas)) + b"\n"
    assert [d for _, d in rec.unframe(blob)] == datas
    broken = bytearray(blob)
    broken[30] ^= 1
    with pytest.raises(ValueError):
        list(rec.unframe(bytes(broken)))


def test_records_equal_the_library_in_id_order(spark, edge_docs, no_docs, monkeypatch):
    monkeypatch.setattr(rec, "SHARD_BYTES", 300)  # many shard files, and documents longer than a shard
    path = shared_dir(spark, "records-test")
    rec.write_records(edge_docs, path, WORDS, 2)
    got = sorted(rec.read_back(spark, path).collect(), key=lambda r: r.start)
    tok = Tokenizer.from_file(WORDS)
    rows = sorted(edge_docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [r.doc_id for r in got] == [r.doc_id for r in rows]
    start = 0
    by_id: dict = {}
    for r in rows:
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        by_id.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
    for g in got:
        assert g.start == start
        assert (g.n_tokens, g.ids_crc32) in by_id[g.doc_id]
        start += g.n_tokens
    index = spark.read.parquet(f"{path}/index").collect()
    assert len(index) == len(rows) and len({(r.range, r.file) for r in index}) > 3
    empty = shared_dir(spark, "records-empty")
    rec.write_records(no_docs, empty, WORDS, 2)
    assert spark.read.parquet(f"{empty}/index").count() == 0


def test_encoder_gives_the_library_ids():
    import random

    rng = random.Random(2)
    texts = ["", "Hello  World", "ΟΔΟΣ Σ σ", "İstanbul ǅ", "it's 'RE 12.5%", "\x1c\x85 a\u2028b", "x" * 5000, "<|endoftext|>"]
    texts += ["".join(rng.choice("aZ é\x1c\x85  \t\n1'sT日!?—İ́Σ") for _ in range(rng.randint(0, 80))) for _ in range(2000)]
    tok = Tokenizer.from_file(WORDS)
    got = rec.WordEncoder(WORDS).encode_many(texts)
    assert [g.tolist() for g in got] == [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


def test_wide_ids_and_null_ids_serialize():
    import zstandard

    ids = np.array([1, 70_000, 2], np.int64)
    for doc_id in (None, 5, -3):
        back = rec.deserialize(rec.serialize(doc_id, ids, zstandard.ZstdCompressor()), zstandard.ZstdDecompressor())
        assert back[0] == doc_id and back[1].tolist() == ids.tolist()


def test_encoder_takes_latin_texts_past_the_normalizer_and_remembers_words():
    """Latin texts are split as the library splits them without its normalizer; tasks of a worker share one memory.
    Before, every text went through the normalizer and every task began with an empty memory."""
    import random

    rng = random.Random(5)
    texts = [f"a{chr(c)}B {chr(c)}1'S" for c in range(0x180)]
    texts += ["".join(rng.choice([chr(rng.randrange(0x180)), "Ab", " ", "'ll", "12"]) for _ in range(40)) for _ in range(500)]
    want = [e.ids for e in Tokenizer.from_file(WORDS).encode_batch(texts, add_special_tokens=False)]
    enc = rec._encoder(WORDS)
    normalize, enc.normalize = enc.normalize, None
    try:
        assert [g.tolist() for g in enc.encode_many(texts)] == want
    finally:
        enc.normalize = normalize
    assert rec._encoder(WORDS) is enc and "ab" in enc
