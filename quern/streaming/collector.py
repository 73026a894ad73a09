"""Structured Streaming forms of the collectors; each also runs on a batch DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "2 hours", time: str = "ts", kind: str = "event_type") -> DataFrame:
    """Counts and sums by event kind and tumbling (or sliding) window; rows later than `late` are dropped in a stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, length, slide) if slide else F.window(time, length)
    out = timed.groupBy(window.alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start"), kind, "n", "total")


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours", time: str = "ts", key: str = "user_id") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.unix_seconds("w.start").alias("start"), key, "n")


def streak_states(events: DataFrame, key: str = "user_id", value: str = "event_type", order: str = "event_id") -> DataFrame:
    """Per key the current streak of equal values, kept as state for 30 minutes: key, value, streak, hot (at 2).

    State is one value and one number per key. Rows of one trigger come in the order of `order`.
    """

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, streak = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for v in rows[value]:
            streak = streak + 1 if v == last else 1
            last = v
        state.update((last, int(streak)))
        state.setTimeoutDuration(30 * 60 * 1000)
        yield pd.DataFrame({"key": [k[0]], "value": [last], "streak": [int(streak)], "hot": [streak >= 2]})

    narrow = events.select(F.col(key).cast("long").alias(key), value, order)
    return narrow.groupBy(key).applyInPandasWithState(step, "key long, value string, streak long, hot boolean", "value string, streak long", "update", "ProcessingTimeTimeout")
