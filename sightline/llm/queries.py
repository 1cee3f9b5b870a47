"""The operators of this subpackage as catalogue queries over the test tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import (op1_lsh, op2_warc, op3_mixture, op4_pii, op5_language, op6_urls, op7_lines, op8_bpe, op9_exact,
                           op10_chosen_path, op11_runs, op12_records, op13_align)
from sightline.llm.common import cut_lineage, read, shared_dir


def op1_multiprobe_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_lsh.search(read(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0, k=20)


def op2_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as archives in the shared folder, read back, assembled to captures, revisits resolved."""
    path = shared_dir(spark, "warc")
    op2_warc.write_archives(read(spark, sf_dir, "pages"), path)
    records = cut_lineage(op2_warc.read_archives(spark, path, payload=False).drop("payload"), "warc-records")
    return op2_warc.resolve(op2_warc.assemble(records)).drop("capture")


OP2_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha256(coalesce(html, '')) as payload_digest
  from pages),
q as (select *, case when payload_bytes >= 100 then min(page_id) over (partition by payload_digest) else page_id end as first from p)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id <> first then first end as refers_to, 1 as n_requests, 1 as n_metadata
from q
"""


#: Target weights of the mixture: curated sources count double, and languages by how much of each is wanted.
WEIGHTS = {"web": 2, "curated": 3,
           "web/en": 4, "web/de": 2, "web/fr": 2, "web/es": 1,
           "curated/en": 3, "curated/de": 2, "curated/fr": 2, "curated/es": 2}
SEED, PERCENT, EPOCHS = 2024, 60, 2


def domain_of_source(source: str = "source"):
    """Sources numbered below ten are the web, the others curated."""
    number = F.regexp_extract(F.col(source), r"([0-9]+)$", 1)
    return F.when(F.length(number) == 1, F.lit("web")).otherwise(F.lit("curated"))


def op3_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_mixture.mix(read(spark, sf_dir, "documents"), domain_of_source(), WEIGHTS, PERCENT, SEED, EPOCHS, report=True)


def _level_sql(depth: int) -> str:
    """Budgets of one level of the tree, by the same closed form."""
    cols = ["domain", "lang", "source"][:depth]
    parent = " || '/' || ".join(["''", *cols[:-1]])
    node = " || '/' || ".join(["''", *cols])
    known = " ".join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())
    return f"""
n{depth} as (
  select {", ".join(cols)}, {parent} as parent, {node} as node,
         case {" || '/' || ".join(cols)} {known} else 1 end as weight, sum(tokens) * {EPOCHS} as held
  from leaves group by all),
q{depth} as (
  select n{depth}.*, (budget - coalesce(sum(held) over before, 0))::double / (sum(weight) over onward)::double as level
  from n{depth} join b{depth - 1} on n{depth}.parent = b{depth - 1}.node
  window before as (partition by n{depth}.parent order by held / weight, n{depth}.node rows between unbounded preceding and 1 preceding),
         onward as (partition by n{depth}.parent order by held / weight, n{depth}.node rows between current row and unbounded following)),
b{depth} as (
  select {", ".join(cols)}, node,
         least(held, floor(weight::double * max(level) over (partition by parent)))::bigint as budget
  from q{depth})"""


OP3_SQL = f"""
with d as (
  select doc_id, case when length(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1)) = 1 then 'web' else 'curated' end as domain,
         coalesce(lang, '') as lang, coalesce(source, '') as source,
         len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens
  from documents),
leaves as (select domain, lang, source, sum(n_tokens)::bigint as tokens from d group by all),
b0 as (select '' as node, (sum(tokens) * {PERCENT} // 100)::bigint as budget from leaves),
{_level_sql(1)},
{_level_sql(2)},
{_level_sql(3)},
plan as (
  select l.domain, l.lang, l.source, case when tokens > 0 then budget // tokens else 0 end as epochs,
         case when tokens > 0 then budget % tokens else budget end as rest
  from leaves l join b3 on l.domain = b3.domain and l.lang = b3.lang and l.source = b3.source),
placed as (
  select d.*, epochs, rest, sum(n_tokens) over (
           partition by d.domain, d.lang, d.source order by md5('{SEED}:' || epochs || ':' || coalesce(doc_id::varchar, ''))) as upto
  from d join plan p on d.domain = p.domain and d.lang = p.lang and d.source = p.source),
taken as (select *, epochs + case when rest > 0 and upto <= rest then 1 else 0 end as copies from placed)
select doc_id, domain, lang, source, n_tokens, unnest(range(copies))::int as epoch
from taken where copies > 0
"""


def op4_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op4_pii.digests(op4_pii.annotate(read(spark, sf_dir, "documents")))


def op5_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language column is what a document declares; its source stands for the host."""
    return op5_language.identify(read(spark, sf_dir, "documents"), F.col("lang"), F.col("source"))


#: The block and allow list.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op6_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_urls.judge(read(spark, sf_dir, "pages"), URL_RULES)


def op7_line_edit_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its lines, the lines that stay, and the SHA-256 of the text they make."""
    out = op7_lines.dedup_lines(read(spark, sf_dir, "documents"), counts=True)
    return out.select("doc_id", "n_lines", "n_kept", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


OP7_SQL = """
with pieces as (
  select doc_id, unnest(string_split(text, chr(10))) as line,
         generate_subscripts(string_split(text, chr(10)), 1) as pos
  from documents where text is not null),
lines as (select *, trim(line, chr(32) || chr(9) || chr(13)) as s from pieces),
numbered as (
  select *, length(s) as n, row_number() over (partition by s order by doc_id, pos) as nth from lines),
firsts as (select s, n, doc_id, pos from numbered where nth = 1 and n >= 40),
-- One edit leaves the first or the second half of the shorter line whole, at the same end of the longer one.
halves as (
  select a.s, a.n, k.less, k.tail, a.doc_id, a.pos,
         case when k.tail then right(a.s, a.n - k.less - (a.n - k.less) // 2) else left(a.s, (a.n - k.less) // 2) end as half
  from firsts a, (values (0, false), (0, true), (1, false), (1, true)) k(less, tail)),
near as (
  select distinct case when (x.doc_id, x.pos) < (y.doc_id, y.pos) then y.s else x.s end as s
  from halves x join halves y on x.less = 0 and x.n = y.n - y.less and x.tail = y.tail and x.half = y.half and x.s <> y.s
  where levenshtein(x.s, y.s) <= 1),
judged as (
  select *, n < 20 or (nth = 1 and s not in (select s from near)) as stays from numbered),
texts as (
  select doc_id, count(*) as n_lines, count(*) filter (stays) as n_kept,
         coalesce(string_agg(line, chr(10) order by pos) filter (stays), '') as kept
  from judged group by doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_kept, 0) as n_kept, sha256(coalesce(kept, '')) as text_sha256
from documents d left join texts t on d.doc_id = t.doc_id
"""


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op8_bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"),
                           public_tokenizers.PATTERN)


def op9_fuse_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One half of the documents is the snapshot, the other half the batch that comes in; all rows are returned."""
    docs = read(spark, sf_dir, "documents")
    late = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(2)), F.lit(0)) == 1
    return op9_exact.dedupe_all(spark, [docs.where(~late), docs.where(late)])


OP9_SQL = """
with t as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from t
"""


def op10_chosen_path_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_chosen_path.near_duplicates(read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the task's planted period, its runs of words and the text they collapse to."""
    return op11_runs.periodic_runs(read(spark, sf_dir, "documents"))


#: The id appended to every document by op12 (a fixed value of the task).
END_ID = 2


def op12_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as token-id records in the shared folder, read back record by record."""
    import public_tokenizers

    path = shared_dir(spark, "records")
    op12_records.write_records(read(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return op12_records.read_back(spark, path)


def op13_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return op13_align.align(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                            public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe_search": op1_multiprobe_search,
    "op2_warc_transactions": op2_warc_transactions,
    "op3_source_mixture": op3_source_mixture,
    "op4_pii_disclosure": op4_pii_disclosure,
    "op5_language_fusion": op5_language_fusion,
    "op6_url_templates": op6_url_templates,
    "op7_line_edit_join": op7_line_edit_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_fuse_dedup": op9_fuse_dedup,
    "op10_chosen_path_dedup": op10_chosen_path_dedup,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_token_records": op12_token_records,
    "op13_tokenizer_alignment": op13_tokenizer_alignment,
}
ORACLES: dict[str, str] = {
    "op2_warc_transactions": OP2_SQL,
    "op3_source_mixture": OP3_SQL,
    "op7_line_edit_join": OP7_SQL,
    "op9_fuse_dedup": OP9_SQL,
}


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    return QUERIES | {"pipeline": run}


def llm_oracles() -> dict[str, str]:
    from corpus_pipeline import ORACLE_SQL

    return ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})
