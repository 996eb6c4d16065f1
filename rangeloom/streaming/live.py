"""The same operators over streams: frames with allowed lateness, a growing voxel map, sessions, and the tracker with its state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rangeloom.operators.tracking import TRACKED, Rules, Tracker, track_frames
from rangeloom.operators.voxels import with_voxel


def frames(events: DataFrame, time: str, length: str = "100 milliseconds", lateness: str = "100 milliseconds") -> DataFrame:
    """(start, n, first, last) of tumbling frames; a frame closes when the watermark passes it. `time` must be a TIMESTAMP."""
    return events.withWatermark(time, lateness).groupBy(F.window(time, length)).agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("first"), F.max(time).alias("last")).select(F.col("window.start").alias("start"), "n", "first", "last")


def sessions(events: DataFrame, time: str, by: str, gap: str = "2 seconds", lateness: str = "10 seconds") -> DataFrame:
    """(by, start, end, n): a gap ends a session."""
    return events.withWatermark(time, lateness).groupBy(by, F.session_window(time, gap)).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def voxel_map(points: DataFrame, size: int, time: str) -> DataFrame:
    """The voxel aggregate as a running table (update mode); keyed state, never evicted: its size is the map's."""
    return with_voxel(points, size).groupBy("key").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{c}") for c in "xyz"], F.min(time).alias("first"), F.max(time).alias("last"))


def track(clusters: DataFrame, rules: Rules | None = None, silent: str | None = None) -> DataFrame:
    """The tracker over a stream of clusters (sensor, t, cluster, x, y, z, extent); frames must arrive in time order.

    State is a sensor's open tracks and samples as plain numbers. With `silent` ("10 minutes") it is freed when the sensor
    has sent nothing for so long; such a query runs by a processing-time trigger, as one for what is available now would never end.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        tracker = Tracker(rules, tuple(state.get) if state.exists else None)
        yield from track_frames(tracker, key[0], pd.concat(list(parts), ignore_index=True))
        state.update(tracker.state())
        if silent:
            state.setTimeoutDuration(int(pd.Timedelta(silent).total_seconds() * 1000))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if silent else GroupStateTimeout.NoTimeout
    return clusters.groupBy("sensor").applyInPandasWithState(run, TRACKED, "last double, following long, tracks array<double>, samples array<double>", "append", timeout)
