import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from sightline.llm import op4_pii as pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda m: [int(c) for c in m[0] if c.isdigit()]
    luhn = lambda d: sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(d[::-1])) % 10 == 0
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 16 <= len(d := digits(m)) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(digits(m)) <= 15]


@given(st.text(alphabet="aZ@.-_ 0123456789+()é\n", max_size=60))
@settings(max_examples=1500, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == plain(text)


def test_long_runs_take_linear_time():
    for text in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "+1" + " " * 10**6, "@" * 10**5, "a@b.c@" * 10**5):
        pii.base_spans(text)
    assert pii.base_spans("1.2.3." + "0" * 6000 + " x@y.z") == [("email", 6007, 6012), ("ip", 0, 6006)]
    assert pii.base_spans("4111 1111 1111 1111")[0] == ("card", 0, 19)


def test_terms_that_disclose(spark, no_docs):
    rows = [(i, f"plain talk number{i} about {'zebra' if i % 2 else 'apple'} things") for i in range(60)]
    # Velvet and the code stand by one address only; "things" stands everywhere; copies of one text count once.
    rows += [(100 + i, f"write item{i} to Velvet 7777 at boss@corp.example.com about things") for i in range(5)]
    rows += [(200 + i, "once only hapax near solo@corp.example.com") for i in range(6)]
    rows += [(300, "Velvet 7777 without address")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, rows_text[s.start:s.end]) for s in r.spans] for r in pii.annotate(docs).collect()
           if (rows_text := dict(rows)[r.doc_id])}
    assert got[0] == [] and got[200] == [("email", "solo@corp.example.com")]
    assert got[100][0] == ("email", "boss@corp.example.com")
    assert {t for k, t in got[100][1:]} >= {"Velvet", "7777", "write"} and not {t for _, t in got[100]} & {"things", "item0"}
    assert [t for _, t in got[300]] == ["Velvet", "7777"]
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert clean[0] == rows[0][1] and "boss" not in clean[101] and "Velvet" not in clean[101] and "[EMAIL]" in clean[101]
    # Disclosure by hand: 5 surroundings of the address, 6 documents with the term, of 72.
    import math
    terms = {r.term: r.disclosure for r in pii.disclosing_terms(docs, pii.find(docs)).collect()}
    assert abs(terms["velvet"] - math.log2(5 * 72 / (6 * 5)) / math.log2(72 / 5)) < 1e-9
    assert pii.annotate(no_docs).collect() == [] and pii.sanitise(no_docs).collect() == []


def test_every_document_of_an_entity_counts(spark):
    """Terms far from the address, of two code points, or of an entity with a single document are judged by the same formula."""
    import math
    from collections import Counter

    far = " ".join(f"filler{i}" for i in range(30))
    rows = [(i, f"plain {far} talk number{i}") for i in range(400)]
    rows += [(1000 + i, f"Zq {far} write to twin@corp.example.com") for i in range(2)]
    rows += [(2000, f"Quokka {far} write to solo@corp.example.com")]
    rows += [(3000 + i, f"Quokka number{i}") for i in range(20)] + [(4000, "Zq without address")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    held = [(pii.terms_of(t, s), {t[a:b] for _, a, b in s}, t) for _, t in rows for s in [pii.base_spans(t)]]
    n_t, n_e = Counter(w for x, _, _ in held for w in x), Counter(e for _, x, _ in held for e in x)
    n_te = Counter((e, w) for ws, es, _ in held for e in es for w in ws)
    d_te = Counter((e, w) for ws, es, _ in {t: x for x in held for t in [x[2]]}.values() for e in es for w in ws)
    want = {}
    for (e, w), n in n_te.items():
        p, seen = n_e[e] / len(rows), d_te[e, w] * n_t[w] / n
        judged = 1 + math.log2((n / n_t[w] * seen + pii.PRIOR * p) / (seen + pii.PRIOR)) / math.log2(1 / p)
        if judged >= pii.GENERALISE:
            want[w] = max(want.get(w, 0), judged)
    got = {r.term: r.judged for r in pii.disclosing_terms(docs, pii.find(docs)).collect()}
    assert got.keys() == want.keys() and all(abs(got[w] - want[w]) < 1e-9 for w in want)
    assert {"zq", "write"} <= got.keys() and not {"quokka", "filler1", "plain"} & got.keys()


def test_edge_cases(spark, edge_docs):
    rows = pii.digests(pii.annotate(edge_docs)).collect()
    assert len(rows) == 17 and all(r.n_email == r.n_ip == r.n_card == r.n_phone == 0 and r.spans == "" for r in rows)
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}
    assert pii.sanitise(edge_docs).count() == 17


def test_masking():
    assert pii.replaced("ab cd ef", [("email", 0, 2), ("general", 3, 5), ("remove", 6, 8)]) == "[EMAIL] [WORD] "
    assert pii.replaced("abcdef", [("card", 0, 4), ("phone", 2, 6)]) == "[CARD][PHONE]"
