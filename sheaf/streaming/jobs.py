"""Streams: attempt limits with a lock, last state of jobs, stale jobs, windows with late data and merged snapshots."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def throttle(events: DataFrame, *, key: str = "user_id", ts: str = "ts", limit: int = 5, window_s: int = 300, lock_s: int = 900) -> DataFrame:
    """(key, ts, allowed, locked_until) per failure: `limit` failures within the window lock a key and clear its list; while it is locked,
    failures are refused and don't count. State is the list of times within the window, and goes once a key has
    been still for the longer of window and lock (by the clock of the processing)."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        times, until = state.get if state.exists else ([], 0.0)
        if state.hasTimedOut:
            state.remove()
            return
        times, out = list(times), []
        for frame in frames:
            for at in sorted(frame[ts].astype("int64") / 1e9 if frame[ts].dtype.kind == "i" else frame[ts].map(lambda t: t.timestamp())):
                allowed = at >= until
                if allowed:
                    times = [t for t in times if t > at - window_s] + [at]
                    if len(times) >= limit:
                        times, until = [], at + lock_s
                out.append((keys[0], at, allowed, until))
        state.update((times, until))
        state.setTimeoutDuration(1000 * max(window_s, lock_s))
        yield pd.DataFrame(out, columns=[key, "at", "allowed", "locked_until"])

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, at double, allowed boolean, locked_until double", "times array<double>, until double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, *, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour", key: str = "event_type") -> DataFrame:
    """Counts per tumbling window and key, once a window can no longer change (an extension; nothing like it in the original)."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), key, "n")


def deduplicated(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """First event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def merge_batches(events: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str):
    """Every micro-batch through a merge function; with a merge that can be repeated, each batch takes effect once."""
    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
