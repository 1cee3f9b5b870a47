import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from model import Table
from sightline.functions import Gazetteer
from sightline.operators import lifecycle, merge
from sightline.plans.snapshot import SnapshotTable
from sightline.schema import SIGHTING

T0 = dt.datetime(2026, 1, 1)
GAZ = Gazetteer(("London", "Edinburgh", "Glasgow", "Leeds", "Ayr"))
SOURCES = ("adzuna", "reed")
H = 24


def sightings(spark, rows):
    """rows: (time, source, title, location[, url]); position in the list is the order."""
    data = []
    for i, (ts, source, title, place, *url) in enumerate(rows):
        data.append((source, "Acme", title, url[0] if url else f"https://x/{i}?ref=a", place, f"text {i}", True, None, None, None,
                     None, None, None, ts, (0, i)))
    df = spark.createDataFrame(data, SIGHTING)
    return merge.with_identity(df.withColumn("source_rank", F.when(F.col("source") == "adzuna", 0).otherwise(1)), GAZ)


def state(df):
    return sorted((r["title"], r["first_seen"], r["last_seen"], r["source"], tuple(r["locations"]), r["status"]) for r in df.collect())


def random_log(seed, scans=12, keys=4):
    """[(time, {source: [(title, place)]})]; a source missing from the dict failed in that scan."""
    rng, t, log = random.Random(seed), T0, []
    for _ in range(scans):
        t += dt.timedelta(hours=rng.choice([1, 8, 20, 24, 25, 40]))
        ok = [s for s in SOURCES if rng.random() < 0.8]
        log.append((t, {s: [(f"T{rng.randrange(keys)}", rng.choice(GAZ.names)) for _ in range(rng.randrange(4))] for s in ok}))
    return log


def replay(log):
    table = Table(H)
    for t, by_source in log:
        for s in SOURCES:
            for title, place in by_source.get(s, []):
                table.see(title, place, t, s)
        table.expire(list(by_source), t)
    return table


def flat(log):
    return [(t, s, title, place) for t, by in log for s in SOURCES for title, place in by.get(s, [])]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_by_scan_equals_model(spark, tmp_path, seed):
    log = random_log(seed, scans=7)
    table, model = SnapshotTable(spark, str(tmp_path / "t")), Table(H)
    for t, by_source in log:
        rows = [(t, s, title, place) for s in SOURCES for title, place in by_source.get(s, [])]
        new = {s: sum(model.see(title, place, t, s) for title, place in by_source.get(s, [])) for s in SOURCES}
        model.expire(list(by_source), t)
        out = merge.merge_scan(table.read_open(), sightings(spark, rows), t, H)
        got = {r["source"]: r["n"] for r in out.filter("change = 'new'").groupBy("source").agg(F.count("*").alias("n")).collect()}
        assert got == {s: n for s, n in new.items() if n}
        table.commit_scan(lifecycle.expire_stale(out.drop("change"), list(by_source), t, H), t, H)
        assert state(table.read()) == model.state()
    assert table.read_open().count() <= table.read().count()


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_log_replay_equals_model(spark, seed):
    log = random_log(seed, scans=30)
    keyed = sightings(spark, flat(log))
    scans = spark.createDataFrame([(s, t) for t, by in log for s in by], "source string, scan_ts timestamp")
    rows = merge.generation_rows(merge.generations(keyed, H))
    assert state(merge.expire_by_scans(rows, scans, H)) == replay(log).state()


@pytest.mark.parametrize("seed", [6, 7])
def test_merge_log_in_two_halves(spark, seed):
    """Several scans at once on top of a table."""
    log = random_log(seed, scans=24)
    half = len(log) // 2
    scans = lambda part: spark.createDataFrame([(s, t) for t, by in part for s in by], "source string, scan_ts timestamp")
    table = merge.empty_snapshot(spark)
    for part in (log[:half], log[half:]):
        table = merge.merge_log(table, sightings(spark, flat(part)), H).drop("change")
        table = spark.createDataFrame(merge.expire_by_scans(table, scans(part), H).collect(), table.schema)
    assert state(table) == replay(log).state()


def test_hot_key_and_window_edge(spark):
    """One key holds most rows; gaps of exactly the window merge, longer ones do not."""
    at = lambda h, us=0: T0 + dt.timedelta(hours=h, microseconds=us)
    rows = [(at(0), "reed", "hot", "London")] * 200 + [(at(24), "adzuna", "hot", "Leeds"), (at(48, 1), "reed", "hot", "Ayr"), (at(3), "reed", "cold", "")]
    got = merge.generations(sightings(spark, rows), H).orderBy("vacancy_key", "first_seen").collect()
    hot = sorted([r for r in got if r["first"]["title"] == "hot"], key=lambda r: r["first_seen"])
    assert [(r["first_seen"], r["last_seen"], r["sightings"], r["locations"]) for r in hot] == [
        (at(0), at(24), 201, ["London", "Leeds"]), (at(48, 1), at(48, 1), 1, ["Ayr"])]
    assert [r["locations"] for r in got if r["first"]["title"] == "cold"] == [["Unknown"]]


def test_first_content_and_cities(spark):
    rows = [(T0, "reed", "DE", "London", "https://r/1?utm_source=a"), (T0, "adzuna", "DE", "Edinburgh", "https://a/2#x"),
            (T0, "adzuna", "DE", "Leeds", "https://a/3")]
    (r,) = merge.merge_scan(merge.empty_snapshot(spark), sightings(spark, rows), T0, H).collect()
    assert (r["source"], r["url"], r["locations"], r["change"], r["status"]) == (
        "adzuna", "https://a/2", ["Edinburgh", "London", "Leeds"], "new", "new")


def test_merge_keeps_verdicts_and_city_order(spark):
    first = merge.merge_scan(merge.empty_snapshot(spark), sightings(spark, [(T0, "reed", "DE", "London")]), T0, H).drop("change")
    done = first.withColumn("status", F.lit("applied")).withColumn("score", F.lit(9.0)).withColumn("locations", F.array(F.lit("Leeds"), F.lit("London")))
    later = T0 + dt.timedelta(hours=24)
    (r,) = merge.merge_scan(done, sightings(spark, [(later, "adzuna", "DE", "London")]), later, H).collect()
    assert (r["status"], r["score"], r["locations"], r["last_seen"], r["source"]) == ("applied", 9.0, ["Leeds", "London"], later, "reed")


def test_zero_window(spark):
    one = merge.merge_scan(merge.empty_snapshot(spark), sightings(spark, [(T0, "reed", "DE", ""), (T0, "reed", "DE", "")]), T0, 0)
    assert one.count() == 1
    later = T0 + dt.timedelta(microseconds=1)
    assert merge.merge_scan(one.drop("change"), sightings(spark, [(later, "reed", "DE", "")]), later, 0).count() == 2
    assert lifecycle.expire_stale(one.drop("change"), ["reed"], later, 0).filter("status = 'expired'").count() == 0


def test_expire_rules(spark):
    at = lambda h: T0 - dt.timedelta(hours=h)
    rows = [("a", "reed", "new", at(25)), ("b", "reed", "new", at(24)), ("c", "reed", "applied", at(99)), ("d", "adzuna", "new", at(99)),
            ("e", "reed", "viewed", at(99))]
    df = spark.createDataFrame(rows, "job_id string, source string, status string, last_seen timestamp")
    for live in (["reed"], spark.createDataFrame([("reed",)], "source string")):
        got = {r["job_id"]: r["status"] for r in lifecycle.expire_stale(df, live, T0, H).collect()}
        assert got == {"a": "expired", "b": "new", "c": "applied", "d": "new", "e": "viewed"}
    assert lifecycle.expire_stale(df, [], T0, H).filter("status = 'expired'").count() == 0


BOARD = "job_id string, url string, status string, score double, report_num int, first_seen timestamp"


def test_verdicts(spark):
    board = spark.createDataFrame([("j1", "u1", "new", 5.0, None, T0), ("j2", "u1", "new", 5.0, None, T0 + dt.timedelta(1)),
                                   ("j3", "u3", "new", 5.0, None, T0), ("j4", "u4", "new", 5.0, None, T0)], BOARD)
    verdicts = spark.createDataFrame(
        [(None, "u1", 8.0, "applied", 1, 1), ("j3", "u1", 1.0, None, None, 2), ("j3", None, None, "", 4, 3), (None, "nope", 1.0, None, None, 4),
         ("dead", None, 1.0, None, None, 5)], "job_id string, url string, score double, status string, report_num int, seq int")
    out, hits = lifecycle.apply_verdicts(board, verdicts)
    assert hits.first()["updated"] == 3
    assert {r["job_id"]: (r["status"], r["score"], r["report_num"]) for r in out.collect()} == {
        "j1": ("new", 5.0, None), "j2": ("applied", 8.0, 1), "j3": ("evaluated", None, 4), "j4": ("new", 5.0, None)}


def test_status_views_scores(spark):
    board = spark.createDataFrame([(f"j{i}", "u", "new", 5.0, None, T0) for i in range(5)], BOARD)
    events = spark.createDataFrame(
        [("j0", "open", None, 1), ("j1", "set", "applied", 1), ("j1", "open", None, 2), ("j2", "open", None, 1), ("j2", "set", "new", 2),
         ("j3", "set", "oops", 1), ("j4", "set", "new", 1), ("j4", "open", None, 2)], "job_id string, kind string, status string, seq int")
    got = {r["job_id"]: r["status"] for r in lifecycle.apply_status_and_views(board, events).collect()}
    assert got == {"j0": "viewed", "j1": "applied", "j2": "new", "j3": "new", "j4": "viewed"}
    ok, bad = lifecycle.split_settable(events.filter("kind = 'set'"))
    assert (ok.count(), bad.count()) == (3, 1)
    assert {r["move"] for r in lifecycle.stage_moves(board.withColumn("status", F.lit("applied"))).collect()} == {"rejected", "new"}


def test_gap_scan_spans_ranges_of_one_hot_key(spark):
    """A window of zero hours and one key with most of the rows: generations equal a per-key scan, while the key's
    buckets lie in several ranges."""
    import random

    rng = random.Random(9)
    at = lambda h: T0 + dt.timedelta(minutes=h)
    rows = [(at(rng.randrange(3000)), "reed", "hot", "London") for _ in range(600)]
    rows += [(at(rng.randrange(3000)), "reed", f"cold{i % 5}", "") for i in range(60)]
    for hours in (0, 1):
        got = merge.generations(sightings(spark, rows), hours).collect()
        want = []
        for title in {r[2] for r in rows}:
            times = sorted(r[0] for r in rows if r[2] == title)
            gens = []
            for t in times:
                if gens and t - gens[-1][1] <= dt.timedelta(hours=hours):
                    gens[-1] = (gens[-1][0], t, gens[-1][2] + 1)
                else:
                    gens.append((t, t, 1))
            want += [(title, *g) for g in gens]
        assert sorted((r["first"]["title"], r["first_seen"], r["last_seen"], r["sightings"]) for r in got) == sorted(want)


def test_update_outcomes_answer_false_for_unknown_ids(spark):
    snap = spark.createDataFrame([("j1", "new"), ("j2", "new")], "job_id string, status string")
    events = spark.createDataFrame([(1, "j1", "applied"), (2, "j9", "applied"), (3, "j1", "typo"), (4, None, "saved"),
                                    (5, "j2", None)], "event_id int, job_id string, status string")
    got = {r.event_id: r.applied for r in lifecycle.update_outcomes(snap, events).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False}


def test_sightings_carry_keys_through_the_joins_and_cities_need_no_shuffle(spark, tmp_path):
    """Line items meet orders that already hold their customer; names of nations and cities come by broadcast, after
    the shuffles. Before, every row was shuffled by its location and the whole join ran twice for the city list."""
    import re

    from sightline.plans import fixtures as fx
    from sightline.plans import q_merge
    sf = "/root/testdata/sf0.001"
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1000")
    try:
        plan = q_merge.log(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    read = re.findall(r"Relation \[([a-z]+)_", plan)
    assert read.count("l") == 1 and read.count("o") == 1
    known = {r["location"] for r in fx.locations(spark, sf).collect()}
    assert {r["location"] for r in fx.sightings(spark, sf).select("location").distinct().collect()} <= known


def test_merged_queries_carry_only_the_content_they_show(spark):
    """Texts a query does not show are not read for its merge, and the replay's log is joined once; before, they were."""
    import re

    from sightline.plans import q_merge
    sf = "/root/testdata/sf0.001"
    plan = q_merge.merged(spark, sf, ("source",)).select("source", "change")._jdf.queryExecution().optimizedPlan().toString()
    assert "min_by(" in plan and "c_mktsegment#" not in "".join(re.findall(r"Project \[.*", plan))
    plan = q_merge.expire_replayed(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan


def test_merge_scan_takes_only_the_content_asked_for(spark):
    rows = sightings(spark, [(T0, "adzuna", "Cook", "London"), (T0, "reed", "Cook", "Leeds")])
    out = merge.merge_scan(merge.empty_snapshot(spark), rows, F.lit(T0), H, content=("source", "url")).collect()
    assert [(r["source"], r["url"], r["title"], r["company"], r["locations"], r["change"]) for r in out] == [
        ("adzuna", "https://x/0", None, None, ["London", "Leeds"], "new")]


def test_generations_of_long_windows_line_up_by_one_shuffle_by_key(spark):
    """From a day's window on, numbering, generations and a merge by key share one shuffle of the buckets, and nothing is
    written; before, buckets were dealt by range, written, and shuffled three times more. Rows equal a per-key scan."""
    import random

    rng = random.Random(4)
    rows = [(T0 + dt.timedelta(hours=rng.randrange(4000)), "reed", f"Cook {i % 7}", "London") for i in range(300)]
    gens = merge.generations(sightings(spark, rows), 24)
    plan = merge.mark_latest(merge.generation_rows(gens))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and "rangepartitioning" not in plan and "FileScan" not in plan
    want = []
    for title in {r[2] for r in rows}:
        found = []
        for t in sorted(r[0] for r in rows if r[2] == title):
            if found and t - found[-1][1] <= dt.timedelta(hours=24):
                found[-1] = (found[-1][0], t, found[-1][2] + 1)
            else:
                found.append((t, t, 1))
        want += [(title, i + 1, *g) for i, g in enumerate(found)]
    got = [(r["first"]["title"], r["gen"], r["first_seen"], r["last_seen"], r["sightings"]) for r in gens.collect()]
    assert sorted(got) == sorted(want)
