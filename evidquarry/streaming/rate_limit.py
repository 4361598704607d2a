"""Sliding-log rate limiter: denied requests leave no trace in the log.

Whether a request is admitted depends on earlier admissions, so this is keyed state,
not a window. The log never holds more than *limit* timestamps per key.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

WINDOW_MICROS = 60_000_000
STATE = StructType([StructField("log", ArrayType(LongType()))])
OUTPUT = "user_id bigint, event_id bigint, micros bigint, admitted boolean"


def admit(log: deque, micros: int, limit: int, window: int) -> bool:
    """Evict expired entries, then admit and record unless the log is full."""
    while log and log[0] <= micros - window:
        log.popleft()
    if len(log) >= limit:
        return False
    log.append(micros)
    return True


def _stream_step(limit: int, window: int):
    def run(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        log = deque(state.get[0]) if state.exists else deque()
        for frame in frames:
            frame = frame.sort_values(["micros", "event_id"])
            verdicts = [admit(log, int(m), limit, window) for m in frame["micros"]]
            yield pd.DataFrame(
                {"user_id": frame["user_id"], "event_id": frame["event_id"], "micros": frame["micros"], "admitted": verdicts}
            )
        state.update((list(log),))

    return run


def _keyed(events: DataFrame) -> DataFrame:
    return events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))


def limited_stream(events: DataFrame, limit: int, window: int = WINDOW_MICROS) -> DataFrame:
    """Streaming verdicts; rows of a key must arrive in time order across batches."""
    return _keyed(events).groupBy("user_id").applyInPandasWithState(
        _stream_step(limit, window), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout
    )


def idle_segments(keyed: DataFrame, window: int) -> DataFrame:
    """Cut each key's log where it was idle for a whole window.

    After such a pause the log is empty, so the pieces are independent and a hot key
    spreads over many tasks. Pauses are found on per-minute minima and maxima, a map-side
    combined aggregation that no longer holds single requests.
    """
    slots = keyed.withColumn("slot", F.floor(F.col("micros") / window))
    spans = slots.groupBy("user_id", "slot").agg(F.min("micros").alias("lo"), F.max("micros").alias("hi"))
    order = Window.partitionBy("user_id").orderBy("slot")
    fresh = F.coalesce((F.lag("hi").over(order) <= F.col("lo") - window).cast("int"), F.lit(1))
    marked = spans.withColumn("fresh", fresh).select(
        "user_id", "slot", F.sum("fresh").over(order).alias("segment")
    )
    return slots.join(marked, ["user_id", "slot"]).drop("slot")


def limited_batch(events: DataFrame, limit: int, window: int = WINDOW_MICROS) -> DataFrame:
    """The same verdicts over a finished log.

    Rows are shuffled by (key, idle segment) and sorted by time; one pass per partition
    keeps only the admitted timestamps of the segment at hand and streams the rest.
    """
    parts = idle_segments(_keyed(events), window)
    ordered = parts.repartition("user_id", "segment").sortWithinPartitions("user_id", "segment", "micros", "event_id")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, log = None, deque()
        for frame in frames:
            verdicts = []
            for user, segment, micros in zip(frame["user_id"], frame["segment"], frame["micros"]):
                if (user, segment) != current:
                    current, log = (user, segment), deque()
                verdicts.append(admit(log, int(micros), limit, window))
            yield frame.assign(admitted=verdicts)[["user_id", "event_id", "micros", "admitted"]]

    return ordered.mapInPandas(run, OUTPUT)
