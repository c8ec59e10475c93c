"""Sliding-window limits and retention, in batch and as streams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding_counts(events: DataFrame, key: str, at: str, seconds: int, name: str = "n") -> DataFrame:
    """events with the number of the key's events in (at - seconds, at], itself included."""
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    window = Window.partitionBy(key).orderBy(micros).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.withColumn(name, F.count("*").over(window))


def _admit(times: list[int], recent: list[int], limit: int, window: int) -> tuple[list[bool], list[int]]:
    """Which of the times are admitted after the recent ones, and what is recent then; a refused one isn't recorded."""
    out = []
    for t in times:
        recent = [r for r in recent if r > t - window]
        out.append(len(recent) < limit)
        if out[-1]:
            recent.append(t)
    return out, recent


def limited(events: DataFrame, key: str, at: str, order: str, limit: int, seconds: int) -> DataFrame:
    """(key, order, at, admitted): events by time, each admitted while fewer than `limit` were within the window.

    What was refused doesn't count later, so the answer is sequential within a
    key: a key's events pass one task, sorted (what memory doesn't hold is
    spilled), and what stays from one Arrow batch to the next is the recent
    admitted times, at most `limit`. A null key is one key; an event without a
    time is admitted and doesn't count.
    """

    rows = events.select(key, order, at, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    kinds = dict(rows.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, recent = None, []
        for batch in batches:
            flags = []
            for k, events_of in itertools.groupby(zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True), lambda x: x[0]):
                if k != last:
                    last, recent = k, []
                times = [t for _, t in events_of]
                timed = [t for t in times if t is not None]  # those without a time are sorted last
                found, recent = _admit(timed, recent, limit, seconds * 1_000_000)
                flags += found + [True] * (len(times) - len(timed))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(flags, pa.bool_())], names=[key, order, at, "admitted"])

    # Sorting is Spark's own, so a hot key is spilled to disk where it has to be.
    sorted_rows = rows.repartition(key).sortWithinPartitions(F.col(key), F.col("_t").asc_nulls_last(), F.col(order).asc_nulls_last())
    return sorted_rows.mapInArrow(run, f"{key} {kinds[key]}, {order} {kinds[order]}, {at} {kinds[at]}, admitted boolean")


def limited_stream(events: DataFrame, key: str, at: str, limit: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """The same for a stream: the state of a key is its recent admitted times, at most `limit` of them, and ends when they expire."""
    kinds = dict(events.dtypes)

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = list(state.get[0]) if state.exists else []
        for frame in frames:
            frame = frame.sort_values(at, kind="stable")
            times = (frame[at].astype("int64") // 1000 if str(frame[at].dtype).endswith("[ns]") else frame[at].astype("datetime64[us]").astype("int64")).tolist()
            flags, recent = _admit(times, recent, limit, seconds * 1_000_000)
            yield pd.DataFrame({key: keys[0], at: frame[at], "admitted": flags})
        state.update((recent,))
        last = max(recent) // 1000 + seconds * 1000 if recent else 0
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    rows = events.withWatermark(at, late).select(key, at)
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {at} {kinds[at]}, admitted boolean", "recent array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)


def windowed_counts(events: DataFrame, at: str, kind: str, size: str, slide: str, late: str = "10 minutes") -> DataFrame:
    """(start, kind, n): events of each kind in sliding event-time windows; on streams, late rows within the watermark count."""
    counts = events.withWatermark(at, late).groupBy(F.window(at, size, slide).alias("w"), kind).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), kind, "n")


def expired(rows: DataFrame, created: str, as_of: str, hours: int) -> DataFrame:
    """Rows older than so many hours at as_of, and those whose time can't be read; none if hours is 0 or less."""
    if hours <= 0:
        return rows.limit(0)
    time = F.col(created) if dict(rows.dtypes)[created].startswith("timestamp") else F.try_to_timestamp(created)
    return rows.where(F.coalesce(F.timestamp_diff("MICROSECOND", time, F.to_timestamp(F.lit(as_of))) > hours * 3_600_000_000, F.lit(True)))


def orphans(parts: DataFrame, owners: DataFrame, key: str) -> DataFrame:
    return parts.join(owners.select(key).distinct(), key, "left_anti")
