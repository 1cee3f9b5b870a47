"""Language identification by Bayesian evidence fusion.

Four sources of evidence, each a factor of the posterior over languages: the text (letter trigrams, naive Bayes), the
declared markup language, the suffix of the address, and where the page comes from (host).

* The text model is trained on a bounded sample: about TRAIN_ROWS labelled rows, those whose id hash is below a
  threshold, or all if there are fewer. Trigrams are hashed to FEATURES counters. Trigrams of one text depend on each other, so its evidence counts as that of at most
  EVIDENCE trigrams. Besides the languages there is a class "unknown", under which all trigrams are equally likely.
* Declared language and suffix: P(value | language) from counts over all rows of value by the language the text speaks
  for, smoothed by SMOOTH of each value's overall share.
* Host: P(language | host), smoothed by SMOOTH rows of the host's registered domain, which is smoothed by all rows.
All counts are grouped aggregations over all rows; hot hosts are pre-aggregated per task, and the tables of counts have a
row per value, not per document.

A row is kept if its best language has at least MIN_POSTERIOR, "unknown" counted. Defined results: null or empty texts
and texts without letters have no text evidence; they are rejected, as nothing is known of their language. Null declared
values, suffixes and hosts give no evidence (the host prior is then that of all rows). Without any labelled row
everything is rejected. Ties go to the language first in the alphabet. Columns of any name pass through `keep_identified`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage, small_batches

TRAIN_ROWS, FEATURES, EVIDENCE = 3000, 1 << 16, 60
SMOOTH, UNKNOWN, MIN_POSTERIOR = 20.0, 0.001, 0.5

_LETTER = np.array([chr(c).isalpha() and not 0xD800 <= c < 0xE000 for c in range(0x10000)])


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(features, where each text's begin, and their end): letters lower-cased, all else one space."""
    lows = ["\n" + (t or "").lower() for t in texts]
    sizes = np.fromiter(map(len, lows), np.int64, len(lows)) + 1
    codes = np.frombuffer("\n".join([*lows, ""]).encode("utf-32-le"), np.uint32)
    letter = np.where(codes < 0x10000, _LETTER[np.minimum(codes, 0xFFFF)], True)
    text = np.repeat(np.arange(len(lows), dtype=np.int32), sizes)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    keep[np.cumsum(sizes) - sizes] = True
    c = np.where(letter, codes, 32).astype(np.uint32)[keep]
    text = text[keep]
    if len(c) < 3:
        return np.zeros(0, np.int32), np.zeros(len(lows) + 1, np.int64)
    h = (c[:-2] * np.uint32(0x9E3779B1) ^ c[1:-1] * np.uint32(0x85EBCA77) ^ c[2:] * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
    ok = text[:-2] == text[2:]
    feature = (h >> np.uint32(16)).astype(np.int32)[ok]
    return feature, np.searchsorted(text[:-2][ok], np.arange(len(lows) + 1))


class Model:
    """Log-probabilities (features x languages, unknown last) and the names of the languages."""

    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table


def train(docs: DataFrame, label_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Counts trigrams per label in the tasks; the driver gets one counter array per language."""
    labelled = docs.where(F.col(label_col).isNotNull())
    # Rows below a threshold of the id hash: nothing is sorted or gathered to find them.
    share = min(1.0, TRAIN_ROWS / max(labelled.count(), 1))
    rows = (labelled.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 32)) < F.lit(int(share * (1 << 32))))
            .select(F.col(label_col).cast("string").alias("label"), F.col(text_col).alias("text")))

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            labels = part.column(0).to_pylist()
            feature, ends = trigrams(part.column(1).to_pylist())
            for lang in sorted(set(labels)):
                own = np.repeat([x == lang for x in labels], np.diff(ends))
                hit, n = np.unique(feature[own], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int64()), pa.array(n)],
                                                 names=["label", "feature", "n"])

    counts = (small_batches(rows).mapInArrow(count, "label string, feature long, n long")
              .groupBy("label", "feature").agg(F.sum("n").alias("n")).toArrow())
    names = counts.column("label").to_pylist()
    languages = sorted(set(names))
    table = np.full((FEATURES, len(languages) + 1), 0.5)
    where = {x: i for i, x in enumerate(languages)}
    table[counts.column("feature").to_numpy(), [where[x] for x in names]] += counts.column("n").to_numpy()
    table[:, -1] = 1.0
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32))


def with_text_evidence(docs: DataFrame, model: Model, at: str, name: str) -> DataFrame:
    """Adds array<double> `name`: log-likelihood of column `at` per language, unknown last; null without letters.

    All other columns of `docs` pass through.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model.table)
    n, where = len(model.languages) + 1, docs.columns.index(at)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            feature, ends = trigrams(part.column(where).to_pylist())
            got = np.empty((n, part.num_rows))
            # One language at a time: running sums over all trigrams of a batch are large, and a worker holds one of them.
            for k in range(n):
                sums = np.concatenate(([0.0], np.cumsum(shared.value[feature, k], dtype=np.float64)))
                got[k] = sums[ends[1:]] - sums[ends[:-1]]
            length = np.diff(ends)
            got *= np.minimum(1.0, EVIDENCE / np.maximum(length, 1))
            values = pa.FixedSizeListArray.from_arrays(pa.array(got.T.ravel()), n).cast(pa.list_(pa.float64()))
            values = pa.array([v if k else None for v, k in zip(values.to_pylist(), length, strict=True)], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns, values], names=[*part.schema.names, name])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"`{name}` array<double>"])
    return small_batches(docs).mapInArrow(run, schema)


def _best(scores: Column) -> Column:
    """Index of the largest score, the first of equals; null without scores."""
    return F.array_position(scores, F.array_max(scores)) - 1


def registered(host: Column) -> Column:
    """The last two labels of a host."""
    return F.substring_index(F.lower(host), ".", -2)


class Evidence:
    """Count tables over all rows: declared and suffix given the language, host given its domain, and everything."""

    def __init__(self, rows: DataFrame, model: Model):
        """rows: (said, declared, suffix, host), said the log-likelihoods."""
        self.model, n = model, len(model.languages)
        spoken = rows.where(F.col("said").isNotNull()).select(
            _best(F.slice("said", 1, n)).cast("int").alias("k"), "declared", "suffix", "host") if n else rows.limit(0).select(
            F.lit(0).alias("k"), "declared", "suffix", "host")
        # One grouping of everything; what follows works on its result.
        counts = cut_lineage(spoken.groupBy("k", "declared", "suffix", "host").agg(F.count(F.lit(1)).alias("n")), "language-counts")
        total = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}
        every = sum(total.values())
        self.share = [(total.get(k, 0) + 1.0) / (every + n) for k in range(n)]
        self.declared = self._channel(counts, "declared", every, total)
        self.suffix = self._channel(counts, "suffix", every, total)
        self.host = self._hosts(counts)

    def _per_language(self, key: str, counts: DataFrame) -> DataFrame:
        return counts.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*[
            F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).cast("double") for k in range(len(self.share))]).alias("c"),
            F.sum("n").cast("double").alias("all"))

    def _channel(self, counts: DataFrame, key: str, every: int, total: dict[int, int]) -> DataFrame:
        """(key, log P(value | language) per language, unknown last)."""
        logs = [F.log((F.col("c")[k] + SMOOTH * F.col("all") / max(every, 1)) / (total.get(k, 0) + SMOOTH)) for k in range(len(self.share))]
        rows = self._per_language(key, counts)
        return cut_lineage(rows.select(key, F.array(*logs, F.log(F.col("all") / max(every, 1))).alias(f"{key}_log")), "language-channel")

    def _hosts(self, counts: DataFrame) -> DataFrame:
        """(host, log P(language | host), unknown last)."""
        n = len(self.share)
        hosts = self._per_language("host", counts).withColumn("domain", registered(F.col("host")))
        domains = hosts.groupBy("domain").agg(*[F.sum(F.col("c")[k]).alias(f"d{k}") for k in range(n)], F.sum("all").alias("d_all"))
        rows = hosts.join(domains, "domain")
        logs = [F.log((F.col("c")[k] + SMOOTH * (F.col(f"d{k}") + SMOOTH * self.share[k]) / (F.col("d_all") + SMOOTH))
                      / (F.col("all") + SMOOTH)) for k in range(n)]
        return cut_lineage(rows.select("host", F.array(*logs, F.lit(math.log(UNKNOWN))).alias("host_log")), "language-hosts")

    def judge(self, rows: DataFrame) -> DataFrame:
        """rows with said, declared, suffix, host: adds lang_found, posterior, kept."""
        names, n = self.model.languages, len(self.share)
        flat = F.array(*[F.lit(0.0)] * (n + 1))
        prior = F.array(*[F.lit(math.log(x)) for x in self.share], F.lit(math.log(UNKNOWN)))
        rows = (rows.join(self.declared, "declared", "left").join(self.suffix, "suffix", "left").join(self.host, "host", "left"))
        score = F.coalesce("host_log", prior)
        for more in (F.coalesce("declared_log", flat), F.coalesce("suffix_log", flat), F.col("said")):
            score = F.zip_with(score, more, lambda a, b: a + b)
        rows = rows.withColumn("score", score)
        weight = F.aggregate("score", F.lit(0.0), lambda s, x: s + F.exp(x - F.array_max("score")))
        at = _best(F.col("score"))
        known = (at < n) & F.col("said").isNotNull()
        lang = F.get(F.array(*map(F.lit, names)), at.cast("int")) if names else F.lit(None).cast("string")
        return (rows.withColumn("lang_found", F.when(known, lang)).withColumn("posterior", 1 / weight)
                .withColumn("kept", F.coalesce(known & (F.col("posterior") >= MIN_POSTERIOR), F.lit(False)))
                .drop("score", "declared_log", "suffix_log", "host_log"))


def suffix_of(host: Column) -> Column:
    """Address suffix: the last label of a host."""
    return F.when(F.instr(host, ".") > 0, F.lower(F.substring_index(host, ".", -1)))


def identify(docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, label_col: str = "lang",
             id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """(doc_id, declared, lang_found, posterior, kept), a row per row of `docs`. Trains on `docs` unless given a model."""
    model = model or train(docs, label_col, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), declared.cast("string").alias("declared"),
                       host.cast("string").alias("host"), (suffix_of(host) if suffix is None else suffix).alias("suffix"))
    said = cut_lineage(with_text_evidence(rows, model, "text", "said").drop("text"), "language-said")
    return Evidence(said, model).judge(said).select("doc_id", "declared", "lang_found", "posterior", "kept")


def keep_identified(docs: DataFrame, declared: Column, host: Column, suffix: Column | None = None, label_col: str = "lang",
                    id_col: str = "doc_id", text_col: str = "text", found_col: str | None = None) -> DataFrame:
    """The rows of `docs`, with all their columns, whose language is identified. It takes the place of column `found_col`.

    Rows are joined to tables of one row per declared value, suffix and host, and are not shuffled while those are small
    enough for Spark to broadcast them by size.
    """
    model = train(docs, label_col, id_col, text_col)
    names = docs.columns
    rows = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], declared.cast("string").alias("declared"),
                       host.cast("string").alias("host"), (suffix_of(host) if suffix is None else suffix).alias("suffix"))
    at = f"c{names.index(text_col)}"
    said = with_text_evidence(rows, model, at, "said")
    narrow = cut_lineage(with_text_evidence(rows.select(at, "declared", "suffix", "host"), model, at, "said").drop(at), "language-said")
    judged = Evidence(narrow, model).judge(said).where("kept")
    return judged.select(*[F.col("lang_found" if c == found_col else f"c{i}").alias(c) for i, c in enumerate(names)])
