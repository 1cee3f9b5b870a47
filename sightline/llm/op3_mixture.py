"""Mixing sources to target weights by hierarchical budgeting. DataFrame functions only.

The tree is domain, language, source; a token budget flows down from its root. At each node it is split among the children
by weight. A child can take no more than its subtree holds (tokens times `max_epochs`); what it cannot take goes to its
siblings, by weight again, and only what all siblings together cannot take is left to the node's own siblings: since a
node never gets more than its subtree holds, the shortage has then been shared out one level higher.

The split is closed-form. With siblings in order of capacity / weight, child k fills up if that ratio is at most
(budget - capacities before k) / (weights from k on); the largest such quotient is the level all others get per weight.

A leaf with budget b and t tokens takes b div t whole epochs, and of the next epoch a prefix. The order in epoch e is
that of md5(seed:e:id), so it changes with each epoch and is the same wherever it is computed. The prefix is found by
summing tokens per 1/4096 of the hash range first: only rows of the one range that holds the cut are sorted, so a source
with a third of all rows is never sorted or summed in one task. Documents are not shuffled: they are joined to a table of
one row per source.

Defined results: a null or empty text has no tokens; it comes along with the part of the order it falls in, and a leaf
without tokens gets nothing. Null tree columns count as the empty name. Rows that repeat an id have the same place in the
order, and stay or go together. Documents are taken whole, up to the budget and never beyond; at each node less than one
token per child is lost by rounding. Columns of any name pass through untouched. Empty tables give empty tables.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage

#: Hex digits of the hash range that is summed first.
RANGE_DIGITS = 3


def words(text_col: str = "text") -> Column:
    """Tokens for budgeting: runs that hold no space, tab or line break."""
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def split_budget(children: DataFrame, budgets: DataFrame) -> DataFrame:
    """children (parent, node, weight, held) and budgets (parent, budget): adds `budget` per child, a whole number."""
    rows = children.join(budgets, "parent")
    order = Window.partitionBy("parent").orderBy(F.col("held") / F.col("weight"), "node")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    onward = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = ((F.col("budget") - F.coalesce(F.sum("held").over(before), F.lit(0))).cast("double")
             / F.sum("weight").over(onward).cast("double"))
    best = F.max("level").over(Window.partitionBy("parent"))
    return (rows.withColumn("level", level).withColumn("best", best)
            .withColumn("budget", F.least("held", F.floor(F.col("weight").cast("double") * F.col("best"))))
            .drop("level", "best"))


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, int], percent: int, max_epochs: int) -> DataFrame:
    """leaves (domain, lang, source, tokens) -> adds budget. weights: 'domain', 'domain/lang' or 'domain/lang/source'."""
    if any(w < 1 for w in weights.values()):
        raise ValueError("weights are whole numbers from 1 on")
    known = F.create_map(*[F.lit(x) for pair in weights.items() for x in pair]) if weights else None

    def level(depth: int) -> DataFrame:
        cols = ["domain", "lang", "source"][:depth]
        parent = F.concat_ws("/", F.lit(""), *cols[:-1])
        node = F.concat_ws("/", F.lit(""), *cols)
        weight = F.lit(1) if known is None else F.coalesce(F.get(F.array(known[F.concat_ws("/", *cols)]), F.lit(0)), F.lit(1))
        return (leaves.groupBy(*cols).agg((F.sum("tokens") * max_epochs).alias("held"))
                .select(*cols, parent.alias("parent"), node.alias("node"), weight.cast("long").alias("weight"), "held"))

    budgets = leaves.groupBy(F.lit("").alias("parent")).agg((F.sum("tokens") * percent / 100).cast("long").alias("budget"))
    for depth in (1, 2, 3):
        shared = split_budget(level(depth), budgets)
        budgets = shared.select(F.col("node").alias("parent"), "budget")
    return leaves.join(shared.select("domain", "lang", "source", "budget"), ["domain", "lang", "source"])


def mix(docs: DataFrame, domain: Column, weights: Mapping[str, int], percent: int, seed: int, max_epochs: int = 1,
        id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
        report: bool = False) -> DataFrame:
    """Rows of `docs` that the budget of `percent` of all tokens takes, one per epoch.

    report: (id_col, domain, lang, source, n_tokens, epoch) in place of the columns of `docs`.
    """
    names = docs.columns
    base = docs.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)], F.coalesce(domain, F.lit("")).alias("domain"))
    col = {c: f"c{i}" for i, c in enumerate(names)}
    base = base.withColumns({
        "lang": F.coalesce(F.col(col[lang_col]).cast("string"), F.lit("")),
        "source": F.coalesce(F.col(col[source_col]).cast("string"), F.lit("")),
        "doc": F.coalesce(F.col(col[id_col]).cast("string"), F.lit("")),
    })
    path = ["domain", "lang", "source"]
    rows = cut_lineage(base.select(*path, "doc", words(col[text_col]).alias("tokens")), "mix-rows")
    leaves = leaf_budgets(rows.groupBy(*path).agg(F.sum("tokens").alias("tokens")), weights, percent, max_epochs)
    leaves = cut_lineage(leaves.select(
        *path, F.expr("case when tokens > 0 then budget div tokens else 0 end").cast("int").alias("epochs"),
        F.expr("case when tokens > 0 then budget % tokens else 0 end").alias("rest")), "mix-leaves")

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("place", F.md5(F.concat_ws(":", F.lit(seed), "epochs", "doc")))

    cut_off = place(rows.join(leaves.where("rest > 0"), path)).withColumn("part", F.substring("place", 1, RANGE_DIGITS))
    parts = cut_off.groupBy(*path, "part", "rest").agg(F.sum("tokens").alias("in_part"))
    so_far = F.sum("in_part").over(Window.partitionBy(*path).orderBy("part"))
    parts = (parts.withColumn("upto", so_far).withColumn("before", F.col("upto") - F.col("in_part"))
             .where("before <= rest and upto > rest").select(*path, "part", "before"))
    inside = cut_off.join(parts, [*path, "part"])
    upto = F.col("before") + F.sum("tokens").over(Window.partitionBy(*path, "part").orderBy("place"))
    fits = inside.withColumn("fits", upto <= F.col("rest"))
    # Where nothing of the range fits, its digits alone stand before all its rows and after all others.
    cuts = fits.groupBy(*path).agg(F.coalesce(F.max(F.when(F.col("fits"), F.col("place"))), F.min("part")).alias("last"))
    leaves = cut_lineage(leaves.join(cuts, path, "left"), "mix-cuts")

    taken = place(base.join(leaves, path))
    copies = F.col("epochs") + F.coalesce((F.col("place") <= F.col("last")).cast("int"), F.lit(0))
    taken = taken.withColumn("copies", copies).where("copies > 0")
    taken = taken.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    if report:
        return taken.select(F.col(col[id_col]).alias(id_col), *path, words(col[text_col]).alias("n_tokens"), "epoch")
    return taken.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])
