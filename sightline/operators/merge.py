"""Entity resolution of sightings: one row per generation of a vacancy.

A generation is a run of sightings of one key in which no gap is longer than the recency window.
Order decides content, so every input carries it: time, source rank, position.

Skew. Nothing here lines up the raw sightings of one key in one task. Batch merge reduces each key
by partial aggregation before the shuffle. Log replay first reduces each (key, time bucket): a
bucket is as wide as the window, so two sightings in one bucket always belong together, and what
remains per key is bounded by the time span divided by the window.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import clean_url, job_id, vacancy_key
from ..functions.places import DEFAULT_PRIORITY, Gazetteer, clean_city, clean_city_table, order_cities
from ..schema import CONTENT, VACANCY
from ..session import cut_lineage

ORDER = ("source_rank", "pos")
#: Hours of the window from which on the buckets of one key are few enough for one task: at most one a day.
LONG_WINDOW = 24


def with_identity(
    sightings: DataFrame, gazetteer: Gazetteer | DataFrame, priority=DEFAULT_PRIORITY, places: DataFrame | None = None,
) -> DataFrame:
    """Add `vacancy_key` and `city`. `gazetteer`: a literal list, or a table of names of any size with `priority`.

    `places`: with a table of names, a table of every `location` there can be (see `clean_city_table`).
    """
    keyed = sightings.withColumn("vacancy_key", vacancy_key(F.col("company"), F.col("title"), F.col("url")))
    if isinstance(gazetteer, DataFrame):
        return clean_city_table(keyed, "location", gazetteer, priority, places=places)
    return keyed.withColumn("city", clean_city(F.col("location"), gazetteer))


def _content(df: DataFrame, content: Sequence[str]) -> Column:
    return F.struct(*[c for c in content if c in df.columns])


def first_per_key(
    keyed: DataFrame, order: Sequence[str] = ORDER, content: Sequence[str] = CONTENT,
) -> DataFrame:
    """Per key: content of the first sighting, the cities, the number of sightings."""
    return keyed.groupBy("vacancy_key").agg(
        F.min_by(_content(keyed, content), F.struct(*order)).alias("first"),
        F.collect_set("city").alias("cities"),
        F.count("*").alias("sightings"),
    )


def mark_latest(snapshot: DataFrame) -> DataFrame:
    """Add `is_latest`: the row of its key seen last. A key has one row per generation."""
    latest = Window.partitionBy("vacancy_key").orderBy(F.desc("last_seen"), F.desc("job_id"))
    return snapshot.withColumn("is_latest", F.row_number().over(latest) == 1)


def _hours(n: int) -> Column:
    return F.make_dt_interval(hours=F.lit(max(0, n)))


def live_rows(snapshot: DataFrame, scan_ts: datetime | Column, hours: int) -> DataFrame:
    """The rows a sighting at `scan_ts` would merge into: at most one per key."""
    ts = scan_ts if isinstance(scan_ts, Column) else F.lit(scan_ts)
    return mark_latest(snapshot.filter(F.col("last_seen") >= ts - _hours(hours))).filter(
        "is_latest").drop("is_latest")


def _stored(name: str) -> Column:
    """A content field as the table keeps it. Links are cleaned here: only first sightings get so far."""
    return clean_url(F.col(name)) if name.endswith(".url") else F.col(name)


def _combine(snapshot: DataFrame, seen: DataFrame, hours: int, priority: Sequence[str],
             content: Sequence[str] = CONTENT) -> DataFrame:
    """Full outer join of the table with (vacancy_key, gen, first_seen, last_seen, first, cities).

    Only the earliest new generation of a key can continue the latest row of the key. The window that
    finds that row is partitioned by the join key, so the table is shuffled once.
    """
    old = mark_latest(snapshot.select(*VACANCY.fieldNames())).alias("old")
    new = seen.alias("new")
    both = old.join(
        new,
        (F.col("old.vacancy_key") == F.col("new.vacancy_key")) & F.col("old.is_latest")
        & (F.col("new.gen") == 1)
        & (F.col("new.first_seen") <= F.col("old.last_seen") + _hours(hours)),
        "full_outer")

    is_new = F.col("old.job_id").isNull()
    is_hit = ~is_new & F.col("new.vacancy_key").isNotNull()
    known = F.coalesce(F.col("old.locations"), F.array().cast("array<string>"))
    union = F.array_union(known, F.col("new.cities"))
    locations = (
        F.when(is_new, order_cities(F.col("new.cities"), tuple(priority)))
        .when(is_hit & (F.size(union) > F.size(known)), order_cities(union, tuple(priority)))
        .otherwise(F.col("old.locations"))
    )
    fresh = {
        "job_id": job_id(F.col("new.vacancy_key"), F.col("new.first_seen")),
        "vacancy_key": F.col("new.vacancy_key"), "status": F.lit("new"),
        "first_seen": F.col("new.first_seen"), "last_seen": F.col("new.last_seen"),
        **{c: _stored(f"new.first.{c}") for c in content},
    }

    def value(name: str) -> Column:
        if name == "locations":
            return locations
        kept = F.col(f"old.{name}")
        if name == "last_seen":
            kept = F.when(is_hit, F.greatest(kept, F.col("new.last_seen"))).otherwise(kept)
        return F.when(is_new, fresh.get(name, F.lit(None))).otherwise(kept)

    change = F.when(is_new, "new").when(is_hit, "merged").otherwise("kept")
    return both.select(
        *[value(f.name).cast(f.dataType).alias(f.name) for f in VACANCY.fields],
        change.alias("change"),
    )


def merge_scan(
    snapshot: DataFrame, keyed: DataFrame, scan_ts: datetime | Column, hours: int,
    priority: Sequence[str] = DEFAULT_PRIORITY, order: Sequence[str] = ORDER, content: Sequence[str] = CONTENT,
) -> DataFrame:
    """Merge the kept sightings of one scan; adds `change` = kept | merged | new.

    `content`: what a new row takes from its first sighting; the rest of it stays null.
    A sighting of a live row refreshes `last_seen` and may add a city; any other opens a new row.
    All sightings of one scan share its clock.
    """
    ts = scan_ts if isinstance(scan_ts, Column) else F.lit(scan_ts)
    seen = first_per_key(keyed, order, content).withColumns(
        {"gen": F.lit(1), "first_seen": ts, "last_seen": ts})
    return _combine(snapshot, seen, hours, priority, content)


def merge_log(
    snapshot: DataFrame, keyed: DataFrame, hours: int, priority: Sequence[str] = DEFAULT_PRIORITY,
    order: Sequence[str] = ORDER, ts: str = "fetched_at",
) -> DataFrame:
    """As `merge_scan` for sightings of any number of scans, none older than the table."""
    seen = generations(keyed, hours, ts, order, priority=priority).withColumnRenamed("locations", "cities")
    return _combine(snapshot, seen, hours, priority)


def empty_snapshot(spark) -> DataFrame:
    return spark.createDataFrame([], VACANCY)


def _bucket(ts: Column, hours: int) -> Column:
    """Start of the time bucket; whole numbers, so no rounding."""
    us = F.unix_micros(ts)
    return us - F.pmod(us, F.lit(hours * 3_600_000_000))


def generations(
    log: DataFrame, hours: int, ts: str = "fetched_at", order: Sequence[str] = ORDER,
    content: Sequence[str] = CONTENT, key: str = "vacancy_key", city: str | None = "city",
    priority: Sequence[str] = DEFAULT_PRIORITY,
) -> DataFrame:
    """Replay a whole sighting log: (key, gen, first_seen, last_seen, sightings, first, locations).

    `first` is the content of the first sighting; the gap of exactly `hours` still merges. A window
    of zero hours merges only sightings with the same clock.
    """
    has_content = any(c in log.columns for c in content)
    aggs = [F.min(ts).alias("t0"), F.max(ts).alias("t1"), F.count("*").alias("n")]
    if has_content:
        by = F.struct(ts, *order)
        aggs += [F.min_by(_content(log, content), by).alias("first")]
    if city:
        aggs += [F.collect_set(city).alias("cities")]
    bucket = _bucket(F.col(ts), hours) if hours > 0 else F.unix_micros(F.col(ts))
    buckets = log.groupBy(key, bucket.alias("bucket")).agg(*aggs)

    numbered = number_gaps(buckets, key, hours)
    out = [F.min("t0").alias("first_seen"), F.max("t1").alias("last_seen"), F.sum("n").alias("sightings")]
    if has_content:
        out += [F.min_by("first", "bucket").alias("first")]
    if city:
        out += [order_cities(F.array_distinct(F.flatten(F.collect_list("cities"))), tuple(priority))
                .alias("locations")]
    return numbered.groupBy(key, "gen").agg(*out)


def number_gaps(buckets: DataFrame, key: str, hours: int) -> DataFrame:
    """`buckets` (key, bucket, t0, t1, ...) with `gen`: a bucket opens a generation when it starts more than `hours`
    after the one before it of its key.

    From a window of LONG_WINDOW hours on, a key has at most a bucket a day of its history, so its buckets are lined up by
    one shuffle by key, which the grouping into generations and a merge by key use again.

    Shorter windows: a gap scan with a carry. The buckets are cut into ranges by a range partitioning on (key, bucket), so a
    key with a very long history, or a window of zero hours, spans many ranges and tasks. Each range numbers its own gaps;
    per range only (key, range, last t1, gaps) goes on, and those few rows give each range the last clock of the range
    before it and the generations opened before it.
    """
    if hours >= LONG_WINDOW:
        along = Window.partitionBy(key).orderBy("bucket")
        opens = F.coalesce(F.col("t0") > F.lag("t1").over(along) + _hours(hours), F.lit(False))
        return buckets.withColumn("_opens", opens.cast("int")).withColumn(
            "gen", F.sum("_opens").over(along.rowsBetween(Window.unboundedPreceding, 0)) + 1).drop("_opens")
    ranged = cut_lineage(buckets.repartitionByRange(key, "bucket").withColumn("_range", F.spark_partition_id()),
                         "generation-ranges")
    inside = Window.partitionBy(key, "_range").orderBy("bucket")
    local = ranged.withColumn("_prev", F.lag("t1").over(inside)).withColumn(
        "_opens", F.when(F.col("_prev").isNull(), 0).otherwise((F.col("t0") > F.col("_prev") + _hours(hours)).cast("int")))
    local = local.withColumn("_local", F.sum("_opens").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = local.groupBy(key, "_range").agg(
        F.max("t1").alias("_last"), F.sum("_opens").alias("_inside"), F.min_by("t0", "bucket").alias("_start"))
    along = Window.partitionBy(key).orderBy("_range")
    # The first bucket of a range opens a generation unless the range before it of its key ends within the window.
    head = F.coalesce(F.col("_start") > F.lag("_last").over(along) + _hours(hours), F.lit(True)).cast("int")
    carry = ranges.withColumn("_head", head).withColumn(
        "_before", F.sum(F.col("_head") + F.col("_inside")).over(along.rowsBetween(Window.unboundedPreceding, 0))
        - F.col("_inside")).select(key, "_range", "_before")
    return (local.join(carry, local[key].eqNullSafe(carry[key]) & (local["_range"] == carry["_range"]))
            .drop(carry[key]).drop(carry["_range"])
            .withColumn("gen", F.col("_before") + F.col("_local")).drop("_range", "_prev", "_opens", "_local", "_before"))


def generation_rows(gens: DataFrame, content: Sequence[str] = CONTENT) -> DataFrame:
    """Generations in table shape, status `new`."""
    fields = gens.schema["first"].dataType.fieldNames() if "first" in gens.columns else []
    return gens.select(
        job_id(F.col("vacancy_key"), F.col("first_seen")).alias("job_id"), "vacancy_key",
        *[_stored(f"first.{c}").alias(c) for c in content if c in fields],
        "locations", F.lit("new").alias("status"), "first_seen", "last_seen", "sightings",
    )


def expire_by_scans(rows: DataFrame, scans: DataFrame, hours: int) -> DataFrame:
    """Status after the last scan: expired iff the row's first source scanned past its window.

    `scans` is (source, scan_ts) of the scans that succeeded; one row per source reaches the join.
    """
    if hours <= 0:
        return rows
    last = scans.groupBy(F.col("source").alias("_source")).agg(F.max("scan_ts").alias("_last_scan"))
    gone = (F.col("status") == "new") & (
        F.col("last_seen") < F.col("_last_scan") - _hours(hours))
    return (
        rows.join(last, F.col("source") == F.col("_source"), "left")
        .withColumn("status", F.when(gone, "expired").otherwise(F.col("status")))
        .drop("_source", "_last_scan")
    )


def dry_run(keyed: DataFrame, order: Sequence[str] = ORDER) -> DataFrame:
    """Per source, what a merge into an empty table would count; history is not read."""
    firsts = first_per_key(keyed, order, content=("source",))
    new = firsts.groupBy(F.col("first.source").alias("source")).agg(F.count("*").alias("new"))
    found = keyed.groupBy("source").agg(F.count("*").alias("kept"))
    counts = found.join(new, "source", "left").withColumn("new", F.coalesce("new", F.lit(0)))
    return counts.select("source", "kept", "new", (F.col("kept") - F.col("new")).alias("dupes"))
