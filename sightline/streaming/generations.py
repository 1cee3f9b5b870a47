"""Generations as session windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LOCAL_MERGE = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"


def stream_generations(
    sightings: DataFrame, key: str, ts: str, hours: int, delay: str = "0 seconds",
    content: Sequence[str] = (), order: Sequence[str] = (),
) -> DataFrame:
    """Closed generations: a run of sightings with no gap above `hours`.

    A session is emitted once the watermark has passed its end. Sessions are merged inside each map
    partition first, so a key with very many sightings sends one row per session and task.
    """
    sightings.sparkSession.conf.set(_LOCAL_MERGE, "true")
    aggs = [F.min(ts).alias("first_seen"), F.max(ts).alias("last_seen"), F.count("*").alias("sightings")]
    if content:
        aggs.append(F.min_by(F.struct(*content), F.struct(ts, *order)).alias("first"))
    window = F.session_window(ts, f"{hours} hours")
    return (
        sightings.withWatermark(ts, delay).groupBy(key, window.alias("session")).agg(*aggs)
        .drop("session")
    )
