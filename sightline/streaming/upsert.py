"""The merge with keyed state: what happens to each vacancy, as it happens.

Sightings are condensed per Arrow batch and (key, time bucket) before the shuffle. A bucket is as
wide as the window, so its sightings always share a generation, and a key that makes up a large part
of a batch reaches its state task as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .landing import ROCKSDB

CONDENSED = "key string, t0 timestamp, t1 timestamp, sightings bigint, cities array<string>"
EVENT = ("key string, kind string, at timestamp, first_seen timestamp, last_seen timestamp, "
         "sightings bigint, cities array<string>")
_EVENT = ["key", "kind", "at", "first_seen", "last_seen", "sightings", "cities"]
_STATE = ("key array<string>, first_seen array<bigint>, last_seen array<bigint>, sightings array<bigint>, "
          "cities array<string>")
#: Parts of the keyed state: a batch rewrites the parts it touches.
GROUPS = 2048


def _micros(s: pd.Series) -> pd.Series:
    return s.astype("datetime64[us]").astype("int64")


def condense(hours: int):
    """(key, ts, city) -> one row per key and bucket of each batch."""
    width = hours * 3_600_000_000

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            us = _micros(pdf["ts"])
            pdf = pdf.assign(bucket=us // width if width else us)
            by = ["key", "bucket"]
            out = pdf.groupby(by).agg(t0=("ts", "min"), t1=("ts", "max"), sightings=("ts", "size")).reset_index()
            # One sort lines up the cities of each group; groups and their cities then stand in the same order.
            cities = pdf[[*by, "city"]].dropna(subset=["key", "city"]).drop_duplicates().sort_values([*by, "city"])
            sizes = cities.groupby(by, as_index=False).size()
            held = sizes.merge(out[by], on=by, how="right")["size"].fillna(0).to_numpy().astype("int64")
            ends, names = held.cumsum(), cities["city"].tolist()
            lists = [names[a:b] for a, b in zip((ends - held).tolist(), ends.tolist(), strict=True)]
            yield out.assign(key=out["key"].astype(object), cities=pd.Series(lists, out.index, object)).drop(columns="bucket")
    return run


def key_group(groups: int) -> Column:
    """Which of `groups` parts of the state a key belongs to. Their number stays as the stream's first run has it."""
    return F.pmod(F.xxhash64("key"), F.lit(groups))


def _generations(hours: int):
    """State of a group of keys: the open generation of each. Timeout: when the first of their windows has passed.

    State comes and goes with a group's rows in one Arrow batch, so a key costs neither a call to the state store nor
    a frame of its own.
    """
    window_us = hours * 3_600_000_000

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []

        def emit(name, kind, at, held):
            first, last, n, cities = held
            out.append((name, kind, at, first, last, n, cities.split("\n") if cities else []))

        def expire(name, held):
            emit(name, "expired", held[1] + window_us, held)

        held = {}
        if state.exists:
            names, *columns = state.get
            held = dict(zip(names, zip(*columns, strict=True), strict=True))
        todo = []
        if not state.hasTimedOut:
            # Condensed rows only: at most one per key, upstream task, batch and bucket.
            for rows in frames:
                todo += zip(_micros(rows["t0"]).tolist(), _micros(rows["t1"]).tolist(), rows["key"],
                            rows["sightings"].tolist(), rows["cities"], strict=True)
        for a, b, name, n, cities in sorted(todo, key=lambda r: r[:2]):
            cities, now = set(cities), held.get(name)
            if now is not None and a - now[1] > window_us:
                # Rows run before timeouts, so a generation that this row ends is closed here.
                expire(name, now)
                now = None
            if now is None:
                held[name] = (a, b, n, "\n".join(sorted(cities)))
                emit(name, "new", a, held[name])
            else:
                known = set(now[3].split("\n")) if now[3] else set()
                held[name] = (min(now[0], a), max(now[1], b), now[2] + n, "\n".join(sorted(known | cities)))
                emit(name, "merged", b, held[name])
        passed, over = state.getCurrentWatermarkMs(), lambda h: (h[1] + window_us) // 1000 + 1
        for name in [x for x, h in held.items() if over(h) < passed]:
            expire(name, held.pop(name))
        if held:
            state.update((list(held), *map(list, zip(*held.values(), strict=True))))
            state.setTimeoutTimestamp(min(map(over, held.values())))
        elif state.exists:
            state.remove()
        events = pd.DataFrame(out, columns=_EVENT)
        for name in ("at", "first_seen", "last_seen"):
            events[name] = events[name].astype("int64").astype("datetime64[us]")
        yield events
    return run


def stream_upsert(sightings: DataFrame, hours: int, delay: str = "1 hour", groups: int = GROUPS) -> DataFrame:
    """(key, ts, city) -> `new`, `merged` and `expired` events of each vacancy.

    The watermark delay has to exceed the spread of one scan's clock over micro-batches: a row that
    is not newer than the watermark counts as late and is dropped.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    condensed = sightings.select("key", "ts", "city").mapInPandas(condense(hours), CONDENSED)
    return (
        condensed.withWatermark("t1", delay).withColumn("group", key_group(groups)).groupBy("group")
        .applyInPandasWithState(
            _generations(hours), outputStructType=EVENT, stateStructType=_STATE, outputMode="append",
            timeoutConf=GroupStateTimeout.EventTimeTimeout)
    )
