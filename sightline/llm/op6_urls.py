"""URL filters: fixed rules, and a tree of path templates per host for what no rule covers.

Rules are host suffixes with a path prefix; the longest that fits decides. The tree is learnt from labelled rows: those a
rule decides, and any whose label is given.

* Segments that vary by themselves (they hold a digit, or are longer than LONG) are wildcards. That leaves a shape per path.
  Rows are grouped by host and shape first; all further steps work on that table, and a host with a third of all pages has
  no more rows in it than it has shapes.
* Top down, the branches of a node are compared, as deep as paths go; what all paths of a branch share is walked at once.
  Branches are merged under a wildcard if they have less than RARE of the node's rows, or if their node has many values for
  few rows each: with c the largest number such that at least VARIED * c branches have c rows or fewer, those branches. So
  words that vary are found at nodes of any size. The other labelled branches are put in the order of their bad share; neighbours that do not differ
  (two-proportion test, z at most SIMILAR) are merged, so similar branches form runs, named (0), (1), ... Branches
  without any label are no evidence and are left as they are, unless merged under a wildcard.
* The leaves are the templates. One is rejected if it has at least MIN_LABELS labelled rows and its share of bad ones,
  smoothed by SMOOTH rows of its host's share, which is smoothed by SMOOTH rows of the share overall, is at least REJECT.

Defined results: a null url, or one without "://", has an empty host and path; it fits no rule and is judged like others of
the empty host. Rows are never dropped or joined by id, so null or repeated ids are fine. Rules of equal length that both
fit: the first in the alphabet. Without labelled rows everything that no rule decides is allowed. Only the id, url and
label columns are read. An empty table gives an empty table.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightline.llm.common import cut_lineage

#: DEPTH: paths are taken whole.
LONG, DEPTH = 32, sys.maxsize
RARE, VARIED, SIMILAR = 0.01, 5, 1.64
MIN_LABELS, SMOOTH, REJECT = 10, 4.0, 0.9

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(url: Column) -> tuple[Column, Column]:
    """(host, path) of an address; both empty if it is null or has no ://."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null if none. rules: (host/path, allow or block)."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (-len(r[0]), r[0]), reverse=True):
        of, _, prefix = text.partition("/")
        fits = ((host == of) | F.endswith(host, F.lit("." + of))) & F.startswith(path, F.lit("/" + prefix))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def shape(path: Column) -> Column:
    """Segments of a path with what varies by itself as wildcards."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.transform(parts, lambda s: F.when(s.rlike("[0-9]") | (F.length(s) > LONG), F.lit("*")).otherwise(s))


def _shared(lo: Column, hi: Column) -> Column:
    """What the arrays from the smallest to the largest all begin with."""
    differ = F.array_position(F.zip_with(lo, hi, lambda a, b: a.eqNullSafe(b)), F.lit(False))
    return F.slice(lo, F.lit(1), F.when(differ > 0, differ - 1).otherwise(F.size(lo)).cast("int"))


def templates(shapes: DataFrame) -> DataFrame:
    """shapes (host, shape, n, labelled, bad) -> (host, shape, template), from the root down."""
    rows = shapes.withColumns({"node": F.lit("").cast("string"), "rest": F.col("shape")})
    placed, rows = rows.where(F.size("rest") == 0), rows.where(F.size("rest") > 0)
    while not rows.isEmpty():
        rows = rows.withColumns({"seg": F.get("rest", F.lit(0)), "rest": F.slice("rest", F.lit(2), F.size("rest"))})
        branches = rows.groupBy("host", "node", "seg").agg(
            F.sum("n").alias("b_n"), F.sum("labelled").alias("b_l"), F.sum("bad").alias("b_b"),
            _shared(F.min("rest"), F.max("rest")).alias("lead"))
        branches = cut_lineage(branches, "url-branches")
        nodes = branches.groupBy("host", "node").agg(F.sum("b_n").alias("n_n"), F.count(F.lit(1)).alias("n_b"))
        # A row per node and number of rows, of which a node has few.
        sizes = branches.where("seg <> '*'").groupBy("host", "node", "b_n").agg(F.count(F.lit(1)).alias("values"))
        upto = F.sum("values").over(Window.partitionBy("host", "node").orderBy("b_n"))
        varied = (sizes.withColumn("upto", upto).where(F.col("upto") >= VARIED * F.col("b_n"))
                  .groupBy("host", "node").agg(F.max("b_n").alias("varied")))
        split = branches.join(nodes.join(varied, ["host", "node"], "left"), ["host", "node"]).withColumn(
            "wild", (F.col("seg") == "*") | (F.col("b_n") < RARE * F.col("n_n")) | (F.col("b_n") <= F.coalesce("varied", F.lit(0))))
        # At most 1 / RARE branches of a node are left here, so its window is small.
        order = Window.partitionBy("host", "node").orderBy(F.col("b_b") / F.col("b_l"), "seg")
        ranked = split.where(~F.col("wild") & (F.col("b_l") > 0)).withColumns({"p_l": F.lag("b_l").over(order), "p_b": F.lag("b_b").over(order)})
        pooled = (F.col("b_b") + F.col("p_b")) / (F.col("b_l") + F.col("p_l"))
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("b_l") + 1 / F.col("p_l")))
        apart = F.col("b_b") / F.col("b_l") - F.col("p_b") / F.col("p_l") > SIMILAR * spread
        ranked = ranked.withColumn("apart", F.coalesce(apart, F.lit(False)).cast("int")).withColumn("group", F.sum("apart").over(order))
        size = F.count(F.lit(1)).over(Window.partitionBy("host", "node", "group"))
        alike = ranked.withColumn("size", size).where("size > 1").select(
            "host", "node", "seg", F.concat(F.lit("("), F.col("group").cast("string"), F.lit(")")).alias("like"))
        alone = (F.col("n_b") == 1) | (~F.col("wild") & F.col("like").isNull())
        named = split.join(alike, ["host", "node", "seg"], "left").select(
            "host", "node", "seg", F.when(F.col("wild"), F.lit("*")).otherwise(F.coalesce("like", "seg")).alias("as"),
            F.when(alone, F.col("lead")).otherwise(F.array().cast("array<string>")).alias("lead"))
        rows = (rows.join(named, ["host", "node", "seg"])
                .withColumns({"node": F.concat_ws("/", "node", "as", "lead"),
                              "rest": F.slice("rest", F.size("lead") + 1, F.size("rest"))}).drop("as", "lead", "seg"))
        rows = cut_lineage(rows, "url-level")
        placed, rows = placed.unionByName(rows.where(F.size("rest") == 0)), rows.where(F.size("rest") > 0)
    return placed.select("host", "shape", F.col("node").alias("template"), "n", "labelled", "bad")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]], id_col: str = "page_id", url_col: str = "url",
          bad: Column | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, template), a row per row of `pages`.

    bad: a label over the columns of `pages` (true, false or null), besides what the rules say.
    """
    given = F.lit(None).cast("boolean") if bad is None else bad
    host, path = parsed(F.col(url_col).cast("string"))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), given.alias("given"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", "given", rule.alias("rule"), verdict.alias("ruled"), shape(F.col("path")).alias("shape"))
    label = F.coalesce("given", F.col("ruled") == "block")
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count(label).alias("labelled"), F.count(F.when(label, 1)).alias("bad"))
    tree = templates(cut_lineage(shapes, "url-shapes"))
    total = tree.agg(F.sum("bad").alias("b"), F.sum("labelled").alias("l")).first()
    overall = ((total["b"] or 0) + 1) / ((total["l"] or 0) + 2)
    hosts = tree.groupBy("host").agg(((F.sum("bad") + SMOOTH * overall) / (F.sum("labelled") + SMOOTH)).alias("host_share"))
    leaves = tree.groupBy("host", "template").agg(F.sum("labelled").alias("l"), F.sum("bad").alias("b")).join(hosts, "host")
    purity = (F.col("b") + SMOOTH * F.col("host_share")) / (F.col("l") + SMOOTH)
    rejected = leaves.select("host", "template", ((F.col("l") >= MIN_LABELS) & (purity >= REJECT)).alias("rejected"))
    known = cut_lineage(tree.select("host", "shape", "template").join(rejected, ["host", "template"]), "url-templates")
    return rows.join(known, ["host", "shape"]).select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("rejected"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "template")
