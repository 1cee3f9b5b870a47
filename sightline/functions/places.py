"""Free-text location -> one canonical place name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .text import strip

# Default priority, region labels in test order, and the last-resort labels.
DEFAULT_PRIORITY = ("edinburgh", "glasgow", "london")
REGIONS = (
    ("northern ireland", "Northern Ireland"),
    ("scotland", "Scotland"),
    ("wales", "Wales"),
    ("england", "England"),
)
REMOTE, COUNTRY, UNKNOWN = "Remote", "UK", "Unknown"

#: Word runs and the runs between them, as Java's Unicode-aware \b sees them.
_RUNS = r"(?U)(?<=\w)(?=\W)|(?<=\W)(?=\w)"


@dataclass(frozen=True)
class Gazetteer:
    """City names plus the priority order. Hashable, so plans can share one."""

    names: tuple[str, ...]
    priority: tuple[str, ...] = DEFAULT_PRIORITY
    _by_lower: dict = field(init=False, repr=False, compare=False)

    def __post_init__(self):
        object.__setattr__(self, "_by_lower", {n.lower(): n for n in self.names})
        wanted = tuple(p.strip().lower() for p in self.priority if p and p.strip())
        object.__setattr__(self, "priority", wanted or DEFAULT_PRIORITY)

    @classmethod
    def from_names(cls, names, priority=()) -> "Gazetteer":
        """A literal list of names. A table of names of any size goes through `clean_city_table` instead."""
        return cls(tuple(sorted(set(names))), tuple(priority))

    @property
    def pattern(self) -> str:
        """Word-bounded prefix tree of the lower-case names.

        A plain alternation tries every name at every position; the tree walks each text once. At
        one position all names that match lie on one branch, so "deeper first" is "longest first".
        """
        tree: dict = {}
        for name in self._by_lower:
            node = tree
            for ch in name:
                node = node.setdefault(ch, {})
            node[""] = {}

        def render(node: dict) -> str:
            branches = [re.escape(ch) + render(sub) for ch, sub in sorted(node.items()) if ch]
            if not branches:
                return ""
            body = branches[0] if len(branches) == 1 else "(?:" + "|".join(branches) + ")"
            return f"(?:{body})?" if "" in node else body

        return r"(?U)\b(" + render(tree) + r")\b" if tree else r"(?!)()"

    def canonical(self, low: Column) -> Column:
        """Spelling of a matched lower-case name; only names `initcap` misspells need an entry."""
        odd = {k: v for k, v in self._by_lower.items()
               if not k.isascii() or re.search(r"[^a-z ]", k) or k.title() != v}
        if not odd:
            return F.initcap(low)
        table = F.create_map(*[F.lit(x) for pair in sorted(odd.items()) for x in pair])
        return F.coalesce(F.try_element_at(table, low), F.initcap(low))


def _rank(priority: tuple[str, ...], low: Column) -> Column:
    at = F.array_position(F.array(*[F.lit(p) for p in priority]), low)
    return F.when(at > 0, at).otherwise(len(priority) + 1)


def clean_city(raw: Column, gazetteer: Gazetteer) -> Column:
    """Priority city if named, else the longest city named, else remote / region / country."""
    low = F.lower(raw)
    found = F.regexp_extract_all(low, F.lit(gazetteer.pattern), F.lit(1))
    # Smallest struct wins: priority rank, then longest, then leftmost.
    best = F.array_min(F.transform(
        found,
        lambda m, i: F.struct(
            _rank(gazetteer.priority, m).alias("rank"), (-F.length(m)).alias("len"),
            i.alias("i"), m.alias("m"),
        ),
    ))["m"]
    label = F.when(F.contains(low, F.lit("remote")), REMOTE)
    for needle, region in REGIONS:
        label = label.when(F.contains(low, F.lit(needle)), region)
    label = label.when(
        F.contains(low, F.lit("united kingdom")) | low.rlike(r"(?U)\buk\b"), COUNTRY
    ).otherwise(UNKNOWN)
    blank = F.coalesce(strip(raw), F.lit("")) == ""
    return F.when(blank, UNKNOWN).when(best.isNotNull(), gazetteer.canonical(best)).otherwise(label)


def order_cities(cities: Column, priority: tuple[str, ...] = DEFAULT_PRIORITY) -> Column:
    """Priority cities first in their order, the rest by code point."""
    ranked = F.array_sort(F.transform(
        cities, lambda c: F.struct(_rank(priority, F.lower(c)).alias("rank"), c.alias("c"))
    ))
    return F.transform(ranked, lambda s: s["c"])


def _label(raw: Column) -> Column:
    """What a location says when it names no city: remote, a region, the country, or unknown."""
    low = F.lower(raw)
    label = F.when(F.contains(low, F.lit("remote")), REMOTE)
    for needle, region in REGIONS:
        label = label.when(F.contains(low, F.lit(needle)), region)
    return label.when(F.contains(low, F.lit("united kingdom")) | low.rlike(r"(?U)\buk\b"), COUNTRY).otherwise(UNKNOWN)


def clean_city_table(
    df: DataFrame, raw: str, names: DataFrame, priority=(), out: str = "city", places: DataFrame | None = None,
) -> DataFrame:
    """`df` with `out`: what `clean_city` gives, for a table of names (column `name`) of any size.

    A position join: each distinct location is cut into word runs and the runs between them; every stretch from the
    start of a word to the end of a word, of at most as many words as the longest name has, is a candidate, and an
    equi-join to the lower-case names keeps those that are names. The leftmost match, the longest at its start, is
    taken, and the next search starts after it: a fold over the matches sorted by start. Of the matches taken the
    priority city wins, then the longest, then the leftmost; its spelling is the table's (of several spellings of one
    lower-case name, the largest). Only distinct locations are cut and joined, and the cities found are written, so their
    size is measured before rows get their city by an equi-join: where they are few, no row of `df` is shuffled for it.

    `places`: a table that holds every value of `raw` under the same name, and maybe more; without it the distinct
    values of `df` are taken, which computes `df` a second time.

    Names that begin or end with a character other than a letter, digit or underscore never match here.
    Null and blank locations are `Unknown`; extra columns of `df` are kept.
    """
    wanted = tuple(p.strip().lower() for p in priority if p and p.strip()) or DEFAULT_PRIORITY
    lows = names.select(F.lower(F.col("name")).alias("low"), "name").where(F.col("low").rlike(r"(?U)^\w(.*\w)?$"))
    lows = lows.groupBy("low").agg(F.max("name").alias("spelling"))
    words = F.size(F.filter(F.split("low", _RUNS), lambda r: r.rlike(r"(?U)^\w")))
    longest = lows.agg(F.max(words).alias("k")).first()["k"] or 0
    places = (df if places is None else places).select(F.col(raw).alias("_place")).where(F.col("_place").isNotNull()).distinct()
    runs = places.select("_place", F.split(F.lower("_place"), _RUNS).alias("runs"))
    starts = runs.select("_place", "runs", F.posexplode("runs").alias("i", "run")).where(F.col("run").rlike(r"(?U)^\w"))
    # A stretch of w words spans 2 w - 1 runs.
    spans = starts.select("_place", "runs", "i", F.explode(F.sequence(F.lit(1), F.lit(max(longest, 1)))).alias("w"))
    spans = spans.where(F.col("i") + 2 * F.col("w") - 1 <= F.size("runs")).select(
        "_place", "i", (F.col("i") + 2 * F.col("w") - 2).alias("j"),
        F.array_join(F.slice("runs", F.col("i") + 1, 2 * F.col("w") - 1), "").alias("low"))
    hits = spans.join(lows, "low")
    ordered = hits.groupBy("_place").agg(F.array_sort(F.collect_list(F.struct(
        F.col("i"), (-F.col("j")).alias("neg_j"), F.col("low"), F.col("spelling")))).alias("hits"))
    start = F.struct(F.lit(-1).alias("end"), F.array().cast(
        "array<struct<i:int,neg_j:int,low:string,spelling:string>>").alias("taken"))
    taken = F.aggregate("hits", start, lambda acc, h: F.when(
        h["i"] > acc["end"], F.struct((-h["neg_j"]).alias("end"), F.array_append(acc["taken"], h).alias("taken")))
        .otherwise(acc))["taken"]
    best = F.array_min(F.transform(taken, lambda h, n: F.struct(
        _rank(wanted, h["low"]).alias("rank"), (-F.length(h["low"])).alias("len"), n.alias("n"),
        h["spelling"].alias("spelling"))))["spelling"]
    found = cut_lineage(ordered.select(F.col("_place"), best.alias("_found")), "cities")
    blank = F.coalesce(strip(F.col(raw)), F.lit("")) == ""
    return (df.join(found, df[raw].eqNullSafe(found["_place"]), "left")
            .withColumn(out, F.when(blank, UNKNOWN).when(F.col("_found").isNotNull(), F.col("_found")).otherwise(_label(F.col(raw))))
            .drop("_place", "_found"))
