"""Generations that stay right when sightings land late.

No watermark drops a row here. The state of a key is the set of its generations (version id, first seen, last seen and
number of sightings of each); generations of one key lie more than the window apart. A micro-batch's
sightings, condensed per (key, bucket) before the shuffle, are laid into that set: a sighting that comes within the
window of no generation opens one (`new`); of one, extends it (`extended`); of two or more, joins them (`remerged`).
Every change is written to an append-only change log: the old versions are retracted and the new version inserted
under a fresh id, so the generations of a key at any point are its inserts that no retraction names. An insert is
`corrected` when a sighting older than the generation's last sighting changed it, which is what a late row does.

Keys are dealt over a fixed number of groups (`GROUPS`), and a batch rewrites the state of the groups it touches. State
grows with the number of generations, never with sightings.

Defined results: rows with a null key or time are set aside in the change log as kind `unusable` (key and time kept)
instead of being dropped; repeated rows count as sightings each; columns besides key, ts and city are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .landing import ROCKSDB
from .upsert import CONDENSED, GROUPS, _micros, condense, key_group

CHANGE = ("key string, version long, kind string, first_seen timestamp, last_seen timestamp, sightings bigint, "
          "corrected boolean")
_STATE = ("key array<string>, next array<bigint>, generations array<bigint>, version array<bigint>, "
          "first_seen array<bigint>, last_seen array<bigint>, sightings array<bigint>")
_COLS = ["key", "version", "kind", "first_seen", "last_seen", "sightings", "corrected"]


def lay(gens: dict[int, tuple[int, int, int]], rows: list[tuple[int, int, int]], window: int, next_id: int):
    """Lay sightings (t0, t1, n) into generations {id: (first, last, n)}.

    Returns the new generations, the ids of the given ones taken away, {id: (kind, late)} of the ids made here, and
    the next free id. kind: `new`, `extended` or `remerged` as the made generation holds 0, 1 or more of the given
    ones; late: a sighting older than the last one of a generation it joined changed it. Ids made and taken away
    within the same call are not reported.
    """
    gens = dict(gens)
    made: dict[int, tuple[int, bool]] = {}  # id -> (given generations it holds, late)
    gone: list[int] = []
    for a, b, n in sorted(rows):
        near = [i for i, (f, last, _) in gens.items() if a - last <= window and f - b <= window]
        held = sum(made[i][0] if i in made else 1 for i in near)
        late = any(a < gens[i][1] or made.get(i, (0, False))[1] for i in near)
        first, last = min([a, *(gens[i][0] for i in near)]), max([b, *(gens[i][1] for i in near)])
        total = n + sum(gens[i][2] for i in near)
        for i in near:
            del gens[i]
            if made.pop(i, None) is None:
                gone.append(i)
        gens[next_id] = (first, last, total)
        made[next_id] = (held, late)
        next_id += 1
    kinds = {i: ("new" if held == 0 else "extended" if held == 1 else "remerged", late) for i, (held, late) in made.items()}
    return gens, gone, kinds, next_id


def _late(hours: int):
    """State of a group of keys: the generations and the next free id of each. It comes and goes with the group's rows
    in one Arrow batch, so a key costs neither a call to the state store nor a frame of its own."""
    window_us = hours * 3_600_000_000

    def run(group, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[int, dict]] = {}
        if state.exists:
            names, free, counts, *columns = state.get
            each = zip(*columns, strict=True)
            held = {name: (nxt, {i: (f, last, n) for i, f, last, n in islice(each, count)})
                    for name, nxt, count in zip(names, free, counts, strict=True)}
        todo: dict[str, list] = {}
        for pdf in frames:
            for name, a, b, n in zip(pdf["key"], _micros(pdf["t0"]).tolist(), _micros(pdf["t1"]).tolist(),
                                     pdf["sightings"].tolist(), strict=True):
                todo.setdefault(name, []).append((a, b, n))
        out = []
        for name, rows in todo.items():
            start, gens = held.get(name, (0, {}))
            gens, gone, made, nxt = lay(gens, rows, window_us, start)
            held[name] = (nxt, gens)
            out += [(name, i, "retract", None, None, None, None) for i in gone]
            out += [(name, i, kind, *gens[i], late) for i, (kind, late) in made.items()]
        laid = [(i, *g) for _, gens in held.values() for i, g in gens.items()]
        state.update((list(held), [nxt for nxt, _ in held.values()], [len(gens) for _, gens in held.values()],
                      *map(list, zip(*laid, strict=True))))
        changes = pd.DataFrame(out, columns=_COLS).astype({"sightings": "Int64", "corrected": object})
        for name in ("first_seen", "last_seen"):
            changes[name] = changes[name].astype("Int64").astype("datetime64[us]")
        yield changes
    return run


def stream_late(sightings: DataFrame, hours: int, groups: int = GROUPS) -> DataFrame:
    """(key, ts, city) -> the change log of generations (CHANGE). No row is dropped for being late."""
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    usable = sightings.where(F.col("key").isNotNull() & F.col("ts").isNotNull())
    condensed = usable.select("key", "ts", "city").mapInPandas(condense(hours), CONDENSED)
    changes = condensed.withColumn("group", key_group(groups)).groupBy("group").applyInPandasWithState(
        _late(hours), outputStructType=CHANGE, stateStructType=_STATE, outputMode="append",
        timeoutConf=GroupStateTimeout.NoTimeout)
    unusable = sightings.where(F.col("key").isNull() | F.col("ts").isNull()).select(
        F.col("key").cast("string"), F.lit(None).cast("long").alias("version"), F.lit("unusable").alias("kind"),
        F.col("ts").cast("timestamp").alias("first_seen"), F.col("ts").cast("timestamp").alias("last_seen"),
        F.lit(1).cast("long").alias("sightings"), F.lit(None).cast("boolean").alias("corrected"))
    return changes.unionByName(unusable)


def current(changes: DataFrame) -> DataFrame:
    """The generations the change log holds now: inserts that no retraction names."""
    inserts = changes.where(~F.col("kind").isin("retract", "unusable"))
    retracted = changes.where(F.col("kind") == "retract").select("key", "version")
    return inserts.join(retracted, ["key", "version"], "left_anti")
