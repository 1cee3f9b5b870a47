"""Streams over the test tables, run to the end of what is there, checked against the batch rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, shared_dir
from ..streaming.generations import stream_generations
from ..streaming.late import current, stream_late
from ..streaming.landing import each_batch, read_landing, write_available
from ..streaming.merge import alert_batches, merge_batches
from ..streaming.upsert import EVENT, stream_upsert
from .fixtures import PRIORITY, WINDOW_HOURS, ts_text
from .q_merge import _GAPS, _H, log
from .registry import query
from .snapshot import SnapshotTable

HOURS = 24
_RAW = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"

_SESSIONS = """
e as (select concat(cast(user_id as varchar), '|', event_type) key, ts, event_id, event_type from events),
g as (select *, case when ts - lag(ts) over (partition by key order by ts) <= interval 24 hour then 0 else 1 end opens from e),
n as (select *, sum(opens) over (partition by key order by ts rows unbounded preceding) gen from g),
s as (select key, gen, min(ts) first_seen, max(ts) last_seen, count(*) sightings from n group by key, gen)
"""
_TIMES = """strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen"""


def event_stream(spark, sf: str) -> DataFrame:
    rows = read_landing(spark, f"{sf}/events.parquet", _RAW)
    return rows.select(
        F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("key"),
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("city"), "event_id")


def _run(spark, df: DataFrame, name: str) -> DataFrame:
    path, checkpoint = shared_dir(spark, name), shared_dir(spark, f"{name}-state")
    write_available(df, path, checkpoint)
    return spark.read.schema(df.schema).parquet(path)


@query("stream_landing", f"with {_SESSIONS} select key, event_id from e")
def stream_landing(spark, sf):
    return _run(spark, event_stream(spark, sf).select("key", "event_id"), "landing")


@query("stream_generations", f"""
with {_SESSIONS} select key, {_TIMES}, sightings from s
where s.last_seen + interval 24 hour <= (select max(ts) from events)
""")
def generations_stream(spark, sf):
    """Only generations that the clock of the stream has closed are out yet."""
    closed = _run(spark, stream_generations(event_stream(spark, sf), "key", "ts", HOURS), "generations")
    return closed.select("key", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen"), "sightings")


def vacancy_events(spark, sf: str) -> DataFrame:
    return _run(spark, stream_upsert(event_stream(spark, sf), HOURS), "upsert")


@query("stream_upsert", f"with {_SESSIONS} select key, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen from s")
def upsert_stream(spark, sf):
    opened = vacancy_events(spark, sf).filter(F.col("kind") == "new")
    return opened.select("key", ts_text("first_seen").alias("first_seen"))


@query("stream_expire", f"""
with {_SESSIONS}, m as (select key, max(gen) last_gen from s group by key)
select s.key, {_TIMES}, sightings from s join m on s.key = m.key
where gen < last_gen or s.last_seen + interval 25 hour < (select max(ts) from events)
""")
def expire_stream(spark, sf):
    """A generation is gone when its key comes back after the window, or when the watermark passes."""
    gone = vacancy_events(spark, sf).filter(F.col("kind") == "expired")
    return gone.select("key", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen"), "sightings")


#: Deliveries the events land in for the late stream, each read as a micro-batch of its own.
LATE_DELIVERIES = 8


def late_changes(spark, sf: str) -> DataFrame:
    """The events dealt over LATE_DELIVERIES deliveries by a hash of their id, so every delivery after the first brings
    rows older than generations already formed; the change log of the stream over them.

    A delivery lands as files of every task that holds some of it, and the stream goes on from its checkpoint.
    """
    land, path, checkpoint = (shared_dir(spark, f"late-{x}") for x in ("landing", "changes", "state"))
    events = spark.read.parquet(f"{sf}/events.parquet")
    dealt = F.pmod(F.hash(F.xxhash64("event_id")), F.lit(LATE_DELIVERIES))
    for delivery in range(LATE_DELIVERIES):
        events.where(dealt == delivery).write.mode("append").parquet(land)
        rows = read_landing(spark, land, events.schema).select(
            F.concat(F.col("user_id").cast("string"), F.lit("|"), "event_type").alias("key"),
            F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("city"))
        changes = stream_late(rows, HOURS)
        write_available(changes, path, checkpoint)
    return spark.read.schema(changes.schema).parquet(path)


@query("stream_late", f"with {_SESSIONS} select key, {_TIMES}, sightings from s")
def late_stream(spark, sf):
    """Every generation as the batch rule has it, from a stream whose deliveries come out of order."""
    now = current(late_changes(spark, sf))
    return now.select("key", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen"), "sightings")


@query("stream_late_changes")
def late_stream_changes(spark, sf):
    """What the late stream did: changes by kind, and how many of them late rows caused."""
    changes = late_changes(spark, sf)
    return changes.groupBy("kind").agg(F.count(F.lit(1)).alias("changes"),
                                       F.count(F.when(F.col("corrected"), True)).alias("corrected"))


@query("stream_alerts", f"""
with {_SESSIONS}, r as (select *, row_number() over (order by first_seen desc, key) rn from s), c as (select count(*) n from s)
select 0 as pos, concat('🆕 <b>', cast(n as varchar), '</b> new job match(es):', chr(10)) as line from c
union all select rn, concat('⚪ <a href="">', key, '</a>', chr(10), '   <i>', split_part(key, '|', 2), '</i>') from r where rn <= 10
union all select 11, concat(chr(10), '…and ', cast(n - 10 as varchar), ' more — send /jobs to browse all') from c where n > 10
""")
def alerts(spark, sf):
    path, checkpoint = shared_dir(spark, "alerts"), shared_dir(spark, "alerts-state")
    source = shared_dir(spark, "alert-events")
    vacancy_events(spark, sf).write.parquet(source)
    each_batch(read_landing(spark, source, EVENT), alert_batches(path), checkpoint)
    return spark.read.schema("pos int, line string").parquet(f"{path}/batch=*")


@query("stream_merge", f"""
with {_GAPS}, s as (select source, max(scan_ts) last_scan from v1 group by source)
select vacancy_key, strftime(first_seen, '%Y-%m-%d %H:%M:%S') as first_seen, strftime(last_seen, '%Y-%m-%d %H:%M:%S') as last_seen,
  g2.source, clean_url as url, case when last_seen < last_scan - {_H} then 'expired' else 'new' end as status
from g2 join s on g2.source = s.source where rn = 1
""")
def merge_stream(spark, sf):
    """The sighting log lands in four deliveries, oldest first; each is merged as it lands, as one micro-batch.

    A delivery is as many files as tasks hold rows of it, and the stream goes on from its checkpoint.
    """
    landing, root, checkpoint = (shared_dir(spark, f"merge-{x}") for x in ("log", "table", "state"))
    rows = cut_lineage(log(spark, sf), "merge-input")
    cuts = ["1996-10-01", "1998-07-01", "2000-04-01"]
    edges = [None, *cuts, None]
    table = SnapshotTable(spark, root)
    for lo, hi in zip(edges, edges[1:], strict=False):
        part = rows
        if lo:
            part = part.filter(F.col("fetched_at") >= F.to_timestamp(F.lit(lo)))
        if hi:
            part = part.filter(F.col("fetched_at") < F.to_timestamp(F.lit(hi)))
        part.write.mode("append").parquet(landing)
        stream = read_landing(spark, landing, rows.schema)
        each_batch(stream, merge_batches(table, WINDOW_HOURS, PRIORITY), checkpoint)
    return table.read().select(
        "vacancy_key", ts_text("first_seen").alias("first_seen"), ts_text("last_seen").alias("last_seen"),
        "source", "url", "status")
