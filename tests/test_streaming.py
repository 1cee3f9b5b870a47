import datetime as dt
import random

from pyspark.sql import functions as F

from model import Table
from sightline.streaming.generations import stream_generations
from sightline.streaming.landing import read_landing, write_available
from sightline.streaming.upsert import EVENT, stream_upsert

T0 = dt.datetime(2026, 1, 1)
SCHEMA = "key string, ts timestamp, city string"


def land(spark, path, batches):
    """One file per batch, in order."""
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def log(seed, scans=20):
    rng, t, out = random.Random(seed), T0, []
    for _ in range(scans):
        t += dt.timedelta(hours=rng.choice([2, 12, 24, 26]))
        out.append([(rng.choice("abcd"), t, rng.choice(["London", "Leeds"])) for _ in range(rng.randrange(1, 5))])
    return out


def model(batches, hours=24):
    table = Table(hours)
    for rows in batches:
        for key, t, city in rows:
            table.see(key, city, t, "s")
    return table.rows


def test_state_over_batches(spark, tmp_path):
    batches = log(1)
    land(spark, str(tmp_path / "in"), [sum(batches[i:i + 5], []) for i in range(0, 20, 5)])
    df = read_landing(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    write_available(stream_upsert(df, 24), str(tmp_path / "out"), str(tmp_path / "cp"))
    events = spark.read.schema(EVENT).parquet(str(tmp_path / "out")).collect()
    want, end = model(batches), max(r[1] for b in batches for r in b)
    assert sorted((e["key"], e["first_seen"]) for e in events if e["kind"] == "new") == sorted((r["key"], r["first"]) for r in want)
    gone = {(e["key"], e["first_seen"], e["last_seen"]) for e in events if e["kind"] == "expired"}
    starts = {(r["key"], r["first"]) for r in want}
    later = lambda r: any(k == r["key"] and f > r["first"] for k, f in starts)
    must = {(r["key"], r["first"], r["last"]) for r in want if later(r) or r["last"] + dt.timedelta(hours=25) < end}
    assert gone == must
    sizes = {}
    for e in events:
        sizes[(e["key"], e["first_seen"])] = max(sizes.get((e["key"], e["first_seen"]), 0), e["sightings"])
    assert sum(sizes.values()) == sum(len(b) for b in batches)


def test_sessions_over_batches(spark, tmp_path):
    batches = log(2)
    land(spark, str(tmp_path / "in"), [sum(batches[i:i + 5], []) for i in range(0, 20, 5)])
    df = read_landing(spark, str(tmp_path / "in"), SCHEMA, files_per_batch=1)
    out = stream_generations(df, "key", "ts", 24, delay="1 hour", content=("city",))
    write_available(out, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {(r["key"], r["first_seen"], r["last_seen"]) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()}
    want, end = model(batches), max(r[1] for b in batches for r in b)
    assert got == {(r["key"], r["first"], r["last"]) for r in want if r["last"] + dt.timedelta(hours=25) <= end}


def test_streams_read_a_table_as_file_or_folder(spark, tmp_path):
    """The same rows whether `events` is one file or a folder of eight; an empty landing raises."""
    import pytest

    from sightline.plans.q_streams import expire_stream, generations_stream, stream_landing, upsert_stream

    src = "/root/testdata/sf0.001"
    folder = tmp_path / "sf"
    spark.read.parquet(f"{src}/events.parquet").repartition(8).write.parquet(str(folder / "events.parquet"))
    assert len(spark.read.parquet(str(folder / "events.parquet")).inputFiles()) == 8
    for q in (stream_landing, generations_stream, upsert_stream, expire_stream):
        one, many = q(spark, src).collect(), q(spark, str(folder)).collect()
        assert one and sorted(map(tuple, one)) == sorted(map(tuple, many)), q.__name__
    (tmp_path / "empty" / "events.parquet").mkdir(parents=True)
    with pytest.raises(Exception):
        stream_landing(spark, str(tmp_path / "empty"))


def test_late_rows_are_laid_in_as_the_batch_rule_has_them():
    """Sightings in random batches and random order give the generations of the batch rule."""
    from sightline.streaming.late import lay

    def batch_rule(times, window):
        out = []
        for t in sorted(times):
            out[-1:] = [(out[-1][0], t, out[-1][2] + 1)] if out and t - out[-1][1] <= window else [*out[-1:], (t, t, 1)]
        return out

    rng = random.Random(5)
    for _ in range(300):
        times = [rng.randrange(400) for _ in range(rng.randint(1, 40))]
        gens, nxt, kinds = {}, 0, set()
        cuts = sorted(rng.sample(range(len(times) + 1), min(rng.randint(1, 6), len(times) + 1)))
        for a, b in zip([0, *cuts], [*cuts, len(times)], strict=True):
            gens, gone, made, nxt = lay(gens, [(t, t, 1) for t in times[a:b]], 24, nxt)
            kinds |= {k for k, _ in made.values()}
        assert sorted(gens.values()) == batch_rule(times, 24)
    assert lay({0: (0, 10, 2), 1: (50, 60, 3)}, [(30, 30, 1)], 24, 2) == ({2: (0, 60, 6)}, [0, 1], {2: ("remerged", True)}, 3)


def test_stream_late_equals_the_batch_rule(spark):
    import duckdb

    from sightline.plans.q_streams import late_stream, late_stream_changes
    from sightline.plans.registry import all_oracles

    src = "/root/testdata/sf0.001"
    got = sorted(map(tuple, late_stream(spark, src).collect()))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{src}/events.parquet'")
    want = sorted(con.execute(all_oracles()["stream_late"]).fetchall())
    assert got == want and len(got) > 100
    changes = {r.kind: (r.changes, r.corrected) for r in late_stream_changes(spark, src).collect()}
    assert changes["remerged"][0] > 0 and changes["extended"][1] > 0


def test_condense_builds_no_python_list_per_row(spark):
    """One row per key and bucket: nulls in any column, and a frame of 20,000 keys within a few seconds of one task."""
    import time

    import pandas as pd

    from sightline.streaming.upsert import condense
    hour = pd.Timedelta(hours=1)
    at = pd.Timestamp("2026-01-05")
    pdf = pd.DataFrame([("a", at, "York"), ("a", at + hour, "Leeds"), ("a", at + hour, "York"), ("a", at + 24 * hour, None),
                        (None, at, "Bath"), ("b", pd.NaT, "Bath")], columns=["key", "ts", "city"])
    got = next(condense(24)([pdf])).sort_values(["key", "t0"]).astype(object)
    rows = [(r.key, r.t0, r.t1, r.sightings, r.cities) for r in got.itertuples()]
    assert rows[:2] == [("a", at, at + hour, 3, ["Leeds", "York"]), ("a", at + 24 * hour, at + 24 * hour, 1, [])]
    assert rows[2][0] == "b" and rows[2][3:] == (1, ["Bath"]) and pd.isna(rows[2][1])
    assert next(condense(24)([pdf.iloc[:0]])).empty
    many = pd.DataFrame({"key": [f"k{i}" for i in range(20_000)], "ts": at, "city": "Leeds"})
    start = time.process_time()
    assert len(next(condense(24)([many]))) == 20_000
    assert time.process_time() - start < 1.5  # an aggregate function called per group took 2 s and more


def test_keyed_state_needs_no_call_per_key(spark):
    """State comes with the rows in Arrow batches: the plans hold no state processor that asks the store key by key."""
    from sightline.streaming.late import stream_late
    rows = spark.readStream.format("rate").load().selectExpr("cast(value as string) key", "timestamp ts", "'x' city")
    for df in (stream_late(rows, 24), stream_upsert(rows, 24)):
        plan = df._jdf.queryExecution().logical().toString()
        assert "FlatMapGroupsInPandasWithState" in plan and "TransformWithState" not in plan


def test_deliveries_land_as_several_files(spark, tmp_path, monkeypatch):
    """The late stream lands a delivery as a file of each task that holds some of it: no task holds a delivery whole."""
    import pandas as pd

    import __spark_entry__ as entry
    from sightline.plans import q_streams
    monkeypatch.setattr(q_streams, "shared_dir", lambda spark, purpose: str(tmp_path / purpose))
    (tmp_path / "events.parquet").mkdir()
    rows = [(i, pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=i * 7), i % 5, "view", 1.0, "{}") for i in range(400)]
    pdf = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    for k in range(2):
        pdf.iloc[k::2].astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet" / f"{k}.parquet")
    n = {r["kind"]: r["changes"] for r in entry.queries()["stream_late_changes"](spark, str(tmp_path)).collect()}
    assert n["new"] >= 5
    assert len([x for x in (tmp_path / "late-landing").iterdir() if x.suffix == ".parquet"]) > q_streams.LATE_DELIVERIES
