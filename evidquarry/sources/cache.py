"""Keyed, time-limited reuse of an authorized corpus frame."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable, Hashable

from pyspark import StorageLevel
from pyspark.sql import DataFrame


class CorpusCache:
    """Least-recently-used frames kept in executor storage until they expire.

    The key has to name everything that shapes the view: table, project, policies,
    source types and required versions. Lost executors only cost a recomputation.
    """

    def __init__(self, seconds: float, entries: int, clock: Callable[[], float] = time.monotonic) -> None:
        self._seconds, self._entries, self._clock = seconds, entries, clock
        self._frames: OrderedDict[Hashable, tuple[float, DataFrame]] = OrderedDict()

    def get(self, key: Hashable, load: Callable[[], DataFrame]) -> DataFrame:
        held = self._frames.pop(key, None)
        if held and held[0] <= self._clock():
            held[1].unpersist()
            held = None
        if held is None:
            frame = load().persist(StorageLevel.MEMORY_AND_DISK)
            held = (self._clock() + self._seconds, frame)
        self._frames[key] = held
        while len(self._frames) > self._entries:
            self._frames.popitem(last=False)[1][1].unpersist()
        return held[1]

    def __len__(self) -> int:
        return len(self._frames)
