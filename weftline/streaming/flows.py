"""Structured Streaming forms: windows with watermarks, sinks by year, and carried state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_time(df: DataFrame, column: str, delay: str) -> DataFrame:
    """Adds ``event_at`` with a watermark; times without zone are read in the session's."""
    return df.withColumn("event_at", F.col(column).cast("timestamp")).withWatermark("event_at", delay)


def windowed(df: DataFrame, keys: list[str], size: str, slide: str | None, *aggs: Column) -> DataFrame:
    """Aggregates in tumbling or sliding windows of ``event_at``; the same on a stream and a table."""
    window = F.window("event_at", size, slide) if slide else F.window("event_at", size)
    got = df.groupBy(*keys, window.alias("w")).agg(*aggs)
    return got.select(*keys, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *[c for c in got.columns if c not in (*keys, "w")])


def sessions(df: DataFrame, keys: list[str], gap: str, *aggs: Column) -> DataFrame:
    got = df.groupBy(*keys, F.session_window("event_at", gap).alias("w")).agg(*aggs)
    return got.select(*keys, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *[c for c in got.columns if c not in (*keys, "w")])


def smoothed_state(df: DataFrame, key: str, signal: str, keep: float, state_type: str = "string") -> DataFrame:
    """Stream of ``key, state`` after each micro-batch: ``state = keep * state + signal`` over its rows in event order.

    The state is one number for each key and stays with the query's checkpoint.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(group, parts, state: GroupState):
        import pandas as pd

        value = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(["event_at", signal])
        for s in rows[signal].fillna(0.0):
            value = keep * value + float(s)
        state.update((value,))
        yield pd.DataFrame({key: [group[0]], "state": [value]})

    kept = df.select(key, "event_at", F.col(signal).cast("double").alias(signal))
    return kept.groupBy(key).applyInPandasWithState(step, f"{key} {state_type}, state double", "value double", "update", GroupStateTimeout.NoTimeout)


def append_by_year(df: DataFrame, path: str, checkpoint: str, year: str = "event_year"):
    """A query that adds a stream to a log laid out by year, once the input there is has been read."""
    return df.writeStream.format("parquet").partitionBy(year).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def each_batch(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands over its micro-batches, such as a year's rows at a time."""
    return df.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
