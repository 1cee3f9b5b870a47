import hashlib
import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import op2_warc as warc
from sightline.session import shared_dir


@given(st.lists(st.binary(max_size=60) | st.just(b"WARC/1.1\r\n\r\n" * 3), max_size=6))
@settings(max_examples=200, deadline=None)
def test_records_hold_any_block(blocks):
    data = b"".join(warc.pack([("WARC-Type", "response"), ("WARC-Record-ID", f"<{i}>")], b) for i, b in enumerate(blocks))
    got = list(warc.unpack(data + b"\r\n"))
    assert [b for _, b in got] == blocks and [h["warc-record-id"] for h, _ in got] == [[f"<{i}>"] for i in range(len(blocks))]


def brute(pages):
    raw = {k: (t or "").encode() for k, (_, t) in enumerate(pages)}
    least = defaultdict(list)
    for k, (i, _) in enumerate(pages):
        if len(raw[k]) >= warc.MIN_PAYLOAD and i is not None:
            least[raw[k]].append(i)
    out = []
    for k, (i, _) in enumerate(pages):
        first = min(least[raw[k]], default=i) if len(raw[k]) >= warc.MIN_PAYLOAD else i
        out.append((str(i), len(raw[k]), hashlib.sha256(raw[k]).hexdigest(), "response" if i == first else "revisit", None if i == first else first))
    return sorted(out, key=str)


def run(spark, df):
    path = shared_dir(spark, "warc-test")
    warc.write_archives(df, path)
    records = warc.read_archives(spark, path)
    return records, warc.assemble(records)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)  # many archives
    rng = random.Random(1)
    pages = [(i, "é\r\n\r\nWARC/1.1\r\n" * rng.choice([0, 1, 5, 6, 7, 400])) for i in range(80)] + [(90, None), (91, "")]
    df = spark.createDataFrame([(i, f"http://h/{i}\r\nX: y", t, "k") for i, t in pages], "page_id long, url string, html string, digest string")
    records, captures = run(spark, df)
    assert records.count() == 3 * len(pages)
    texts = {r.page_id: bytes(r.payload).decode() for r in records.where("record_type = 'response'").collect()}
    assert all(t == (dict(pages)[i] or "") for i, t in texts.items())
    got = warc.resolve(captures).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages)
    assert all(r.n_requests == r.n_metadata == 1 for r in got)


def test_edge_cases(spark):
    pages = [(None, "x" * 200), (None, "x" * 200), (3, "x" * 200), (3, "x" * 200), (4, "x" * 200), (5, None), (5, None), (None, None)]
    df = spark.createDataFrame([(i, None, t) for i, t in pages], "page_id long, url string, html string")
    got = warc.resolve(run(spark, df)[1]).collect()
    assert sorted(((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(pages)
    assert run(spark, df.limit(0))[1].count() == 0


def test_links_either_way_and_over_one_record(spark):
    rows = [("r1", "response", ["q1"], 1), ("q1", "request", [], 1), ("m1", "metadata", ["q1"], 1), ("m2", "metadata", ["r1"], 1),
            ("r2", "response", [], 2), ("q2", "request", ["r2", "gone"], 2), ("m9", "metadata", ["nowhere"], 9), ("v3", "revisit", [], 3)]
    df = spark.createDataFrame([(i, t, c, None, None, p, 0, "", None) for i, t, c, p in rows], warc.RECORD.format(kind="long"))
    got = {r.capture: ([x.record_id for x in r.requests or []], [x.record_id for x in r.metadata or []]) for r in warc.assemble(df).collect()}
    assert got == {"r1": (["q1"], ["m1", "m2"]), "r2": (["q2"], []), "v3": ([], [])}
