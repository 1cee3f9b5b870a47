"""Personal data, and information-theoretic sanitisation of the terms that give it away.

Protected entities are found by pattern: e-mail addresses, IPv4 addresses, card numbers and phone numbers. A term can
reveal an entity that has been masked if the corpus shows the two together: with p(x) the share of documents with x,

    disclosure(t; e) = log2(p(t, e) / (p(t) p(e))) / log2(1 / p(e))

is 1 if t occurs with e only and 0 if they are independent. Terms of a document are all its words outside of the entities
in it, and p counts documents, each copy as one, in all three places. A term is judged by

    judged(t; e) = 1 + log2(q) / log2(1 / p(e)),    q = (p(e|t) d_t + PRIOR p(e)) / (d_t + PRIOR)

which is the disclosure with p(e|t) drawn towards p(e) by PRIOR documents that know nothing. d_t counts the documents with t
less what copies add: n_t times the share of distinct texts in the documents with both. So every pair is judged, however
rare; copies of one text are no more evidence than one. A term judged to disclose some entity by GENERALISE or more is
replaced by what kind of word it is, by REMOVE or more it is taken out, wherever it occurs.

Counts run over all documents. Entities, pairs and terms are grouped with partial aggregation, copies of a text before
their pairs are made. Two scans of the texts look for terms with a filter bitmap of fixed size; what it lets pass is joined
exactly.

Defined results: null texts count as empty and have no spans. Rows that repeat an id each have a result of their own, a
null id is an id like others. Only the id and text columns are read. Empty tables give empty tables. Offsets are code
points, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sightline.llm.common import batches, cut_lineage, small_batches
from sightline.llm.op7_lines import filter_of, slots

KINDS = ("email", "ip", "card", "phone")
#: Documents by which a share is drawn towards independence.
PRIOR = 3.0
GENERALISE, REMOVE = 0.7, 0.9

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run that does not start a match at its first digit starts none at a later one, so runs are tried once.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"[^0-9]+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Each @ is looked at once, so a long run of letters without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end), by kind as in KINDS, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_DIGITS.sub("", m[0])) <= 15]
    return out


def entity_key(kind: str, value: str) -> int:
    """Names of one entity: addresses in lower case, numbers without what separates digits."""
    value = value.lower() if kind == "email" else value if kind == "ip" else _DIGITS.sub("", value)
    return _hash(f"{kind}:{value}")


def _hash(value: str) -> int:
    return np.uint64(xxhash.xxh3_64_intdigest(value)).view(np.int64).item()


def words(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _WORD.finditer(text):
        yield m[0].lower(), *m.span()


def terms_of(text: str, spans: list[tuple[str, int, int]]) -> set[str]:
    """The words of a document that overlap none of its spans."""
    if not spans:
        return {w.lower() for w in set(_WORD.findall(text))}
    covered: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if covered and a <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], b)
        else:
            covered.append([a, b])
    found, at = set(), 0
    for w, a, b in words(text):
        while at < len(covered) and covered[at][1] <= a:
            at += 1
        if at == len(covered) or covered[at][0] >= b:
            found.add(w)
    return found


def _find(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.null()), ("mark", pa.int64()), ("spans", pa.list_(pa.struct(
        [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))),
        ("entities", pa.list_(pa.int64())), ("terms", pa.list_(pa.string()))])
    for part in parts:
        spans, entities, terms = [], [], []
        for text in part.column(2).to_pylist():
            got = base_spans(text or "")
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in got])
            entities.append(sorted({entity_key(k, text[a:b]) for k, a, b in got}))
            terms.append(sorted(terms_of(text, got)) if got else [])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(x, schema.field(i).type) for i, x in (
            (2, spans), (3, entities), (4, terms)))], names=schema.names)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, spans, entities, terms) per row: base spans, the distinct entities in them, and where there are some,
    the document's terms. mark: hash of the text."""
    kind = docs.schema[id_col].dataType.simpleString()
    return small_batches(docs).select(id_col, F.xxhash64(text_col), text_col).mapInArrow(
        _find, f"doc_id {kind}, mark long, spans array<struct<kind:string,start:int,end:int>>, "
               "entities array<long>, terms array<string>")


def _count_terms(shared):
    schema = pa.schema([("term", pa.string()), ("n", pa.int64())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents with each term that the filter lets pass, per batch."""
        for part in parts:
            held: Counter[str] = Counter()
            for text in part.column(0).to_pylist():
                held.update(terms_of(text or "", base_spans(text or "")))
            terms = list(held)
            ok = _passes(shared.value, terms)
            yield from batches(((t, held[t]) for t, good in zip(terms, ok, strict=True) if good), schema)

    return run


def _passes(bits: np.ndarray, terms: list[str]) -> np.ndarray:
    refs = np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))
    ok = np.ones(len(terms), bool)
    for at in slots(refs):
        ok &= (bits[(at // np.uint64(64)).astype(np.int64)] >> at % np.uint64(64) & np.uint64(1)).astype(bool)
    return ok


def _locate_terms(shared, kind: pa.DataType):
    schema = pa.schema([("doc_id", kind), ("mark", pa.int64()), ("term", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, marks, texts = [c.to_pylist() for c in part.columns]
            # The filter is asked once per distinct word of the batch; only texts holding a word it passes are walked.
            own = [set(map(str.lower, _WORD.findall(t or ""))) for t in texts]
            distinct = list(set().union(*own)) if own else []
            passing = {w for w, good in zip(distinct, _passes(shared.value, distinct), strict=True) if good}
            found = [(i, m, w, a, b) for i, m, text, held in zip(ids, marks, texts, own, strict=True) if held & passing
                     for w, a, b in words(text or "") if w in passing]
            yield from batches(iter(found), schema)

    return run


def disclosing_terms(docs: DataFrame, found: DataFrame, text_col: str = "text") -> DataFrame:
    """(term, disclosure, judged) of the terms that are judged to disclose some entity by GENERALISE or more; the largest of each."""
    spark = docs.sparkSession
    texts = found.where(F.size("entities") > 0).groupBy("mark").agg(
        F.count(F.lit(1)).alias("copies"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    texts = cut_lineage(texts, "pii-texts")
    held = texts.select("copies", "terms", F.explode("entities").alias("entity"))
    entities = held.groupBy("entity").agg(F.sum("copies").alias("n_e"))
    pairs = (held.select("entity", "copies", F.explode("terms").alias("term")).groupBy("entity", "term")
             .agg(F.sum("copies").alias("n_te"), F.count(F.lit(1)).alias("d_te")))
    pairs = cut_lineage(pairs.join(entities, "entity"), "pii-pairs")
    empty = spark.createDataFrame([], "term string, disclosure double, judged double")
    if pairs.isEmpty():
        return empty
    shared = spark.sparkContext.broadcast(_bitmap(texts.select(F.explode("terms").alias("term")).distinct()))
    counts = (small_batches(docs).select(text_col).mapInArrow(_count_terms(shared), "term string, n long")
              .groupBy("term").agg(F.sum("n").alias("n_t")))
    total = F.lit(float(docs.count()))
    share, seen = F.col("n_e") / total, F.col("d_te") * F.col("n_t") / F.col("n_te")
    q = (F.col("n_te") / F.col("n_t") * seen + PRIOR * share) / (seen + PRIOR)
    # An entity that all documents show is no secret, and dividing by its zero information gives null.
    rows = pairs.join(counts, "term").withColumns({
        "disclosure": F.try_divide(F.log2(F.col("n_te") * total / (F.col("n_t") * F.col("n_e"))), F.log2(1 / share)),
        "judged": 1 + F.try_divide(F.log2(q), F.log2(1 / share))})
    return cut_lineage(rows.groupBy("term").agg(F.max("disclosure").alias("disclosure"), F.max("judged").alias("judged"))
                       .where(F.col("judged") >= GENERALISE), "pii-terms")


def _bitmap(terms: DataFrame) -> np.ndarray:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_arrays([pa.array([_hash(t) for t in part.column(0).to_pylist()], pa.int64())], names=["ref"])

    return filter_of(terms.mapInArrow(run, "ref long"))


def annotate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, mark, spans) per row: base spans, then spans of kind `general` and `remove` for disclosing terms, each by
    start."""
    found = cut_lineage(find(docs, id_col, text_col), "pii-found")
    terms = disclosing_terms(docs, found, text_col)
    base = found.select("doc_id", "mark", "spans")
    if terms.isEmpty():
        return base
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(terms.select("term")))
    kind = docs.schema[id_col].dataType
    at = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    seen = at.mapInArrow(_locate_terms(shared, to_arrow_type(kind)),
                         f"doc_id {kind.simpleString()}, mark long, term string, start int, end int")
    more = (seen.join(terms, "term").select("doc_id", "mark", F.struct(
        F.when(F.col("judged") >= REMOVE, F.lit("remove")).otherwise(F.lit("general")).alias("kind"), "start", "end").alias("s"))
        .groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("s")).alias("more")))
    m = more.withColumnsRenamed({"doc_id": "of", "mark": "of_mark"})
    free = F.filter("more", lambda s: ~F.exists("spans", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    return (base.join(m, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark")), "left")
            .select("doc_id", "mark", F.concat("spans", F.coalesce(free, F.array().cast(dict(base.dtypes)["spans"]))).alias("spans")))


def replaced(text: str, spans: list[tuple[str, int, int]]) -> str:
    """`text` with its spans masked: entities by their kind, general terms by the kind of word, the others taken out."""
    out, done = [], 0
    for a, b, kind in sorted((a, b, k) for k, a, b in spans):
        if a < done:  # overlaps a span of another kind that began earlier
            a = done
        if b <= a:
            continue
        out.append(text[done:a])
        word = text[a:b]
        out.append("" if kind == "remove" else ("[NUMBER]" if word.isdigit() else "[NAME]" if word[:1].isupper() else "[WORD]")
                   if kind == "general" else f"[{kind.upper()}]")
        done = b
    return "".join([*out, text[done:]])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, text): texts with all spans masked. Null texts stay null."""
    spans = annotate(docs, id_col, text_col).withColumnsRenamed({"doc_id": "of", "mark": "of_mark"}).dropDuplicates(["of", "of_mark"])
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("mark", F.xxhash64("text"))
    both = rows.join(spans, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("of_mark"))).select("doc_id", "spans", "text")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = [None if t is None else replaced(t, [(x["kind"], x["start"], x["end"]) for x in s])
                     for s, t in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string())], names=["doc_id", "spans", "text"])

    return small_batches(both).mapInArrow(run, both.schema)


def digests(annotated: DataFrame) -> DataFrame:
    """Counts per kind, SHA-256 of the base spans as kind:start:end, and all spans written so."""
    def written(kinds):
        rows = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans")
        return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return annotated.select("doc_id", *map(count, KINDS), F.sha2(written(KINDS).cast("binary"), 256).alias("base_sha256"),
                            written(()).alias("spans"))
