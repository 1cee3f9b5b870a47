"""From documents to token ids: language ID, line dedup, near-dedup, mixture, byte-level BPE.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's docs. All
but the last return the columns of documents. `run` does that below the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightline.llm import op3_mixture, op5_language, op7_lines, op8_bpe, op10_chosen_path
from sightline.llm.common import cut_lineage, read
from sightline.llm.queries import PERCENT, SEED, WEIGHTS, domain_of_source


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified, by text, declared language and source; the others go. `lang` becomes the one found."""
    return op5_language.keep_identified(docs, F.col("lang"), F.col("source"), found_col="lang")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of lines taken out, and with them the documents that were nothing else."""
    return op7_lines.dedup_lines(docs, drop_empty=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document (the smallest doc_id) of each group linked by a similarity of 0.8 or more on shingles of five words."""
    kept = op10_chosen_path.near_duplicates(docs, percent=80).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(F.col("kept_id")), "left_semi")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token budget shared out by domain, language and source; every document at most once."""
    return op3_mixture.mix(docs, domain_of_source(), WEIGHTS, PERCENT, SEED, max_epochs=1)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, counted and digested, and the digest of what they decode to."""
    import public_tokenizers

    return op8_bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encode", encode),
]

#: The language model is trained, which SQL cannot express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
