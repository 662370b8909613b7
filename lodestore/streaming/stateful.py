"""Continuous operators with state of their own for each key, and timers in event time.

A processor reads and writes a key's state once a batch, whatever its rows; states are
one value or a list that the window bounds, so they do not grow with the stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _kept(stream: DataFrame) -> DataFrame:
    """States of this kind need this store."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    return stream


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows), ignore_index=True).sort_values(by, kind="stable", ignore_index=True)


def _repeated(key: Any, n: int) -> pd.Series:
    """A key's column, as objects whatever pandas would make of it."""
    return pd.Series([key] * n, dtype=object)


class _Motion(StatefulProcessor):
    """State: a camera's last value."""

    def __init__(self, threshold: float):
        self.threshold = threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "value double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        frames = _sorted(rows, ["at"])
        held = self.last.get()
        before = np.concatenate([[np.nan if held is None else held[0]], frames["value"].to_numpy()[:-1]])
        change = np.abs(frames["value"].to_numpy() - before)
        self.last.update((float(frames["value"].iloc[-1]),))
        moved = change > self.threshold  # of the first frame there is no change
        yield pd.DataFrame({"key": _repeated(key[0], int(moved.sum())), "at": frames["at"][moved].to_numpy(), "change": change[moved]})

    def close(self) -> None:
        pass


def frame_motion(stream: DataFrame, threshold: float) -> DataFrame:
    """Frames of ``stream(key, at, value)`` that differ from their key's one before by more than ``threshold``: key, at, change.

    Frames of a key come in order of ``at`` within a batch and in order of batches; a
    frame after a restart is held against the last before it.
    """
    kind = stream.schema["key"].dataType.simpleString()
    at = stream.schema["at"].dataType.simpleString()
    return _kept(stream).groupBy("key").transformWithStateInPandas(_Motion(threshold), f"key {kind}, at {at}, change double", "append", "none")


class _Beats(StatefulProcessor):
    """State: a node's last beat, in milliseconds, until it is declared dead."""

    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "ms long")

    def _dead(self, key: Any, last: list[int]) -> pd.DataFrame:
        return pd.DataFrame({"node": _repeated(key[0], len(last)), "last_ms": last, "dead_ms": [x + self.timeout for x in last]})

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        beats = np.sort(np.concatenate([r["ms"].to_numpy() for r in rows]))
        held = self.last.get()
        if held is not None:
            self.handle.deleteTimer(held[0] + self.timeout)
            beats = np.concatenate([[held[0]], beats])
        # it was dead between two beats that lie so far apart, even if no timer ran meanwhile
        silent = beats[:-1][np.diff(beats) >= self.timeout]
        last = int(beats.max())
        self.last.update((last,))
        self.handle.registerTimer(last + self.timeout)
        yield self._dead(key, silent.tolist())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = self.last.get()
        if held is not None and held[0] + self.timeout <= expiredTimerInfo.getExpiryTimeInMs():
            self.last.clear()
            yield self._dead(key, [held[0]])

    def close(self) -> None:
        pass


def deaths(stream: DataFrame, timeout: str, delay: str) -> DataFrame:
    """Nodes of ``stream(node, time)`` that are silent for ``timeout``: node, last_ms and dead_ms (milliseconds), once each time.

    A node is declared dead when the watermark (``delay`` behind the newest beat of any
    node) passes its last beat and ``timeout``, without a beat of its own; its state is
    dropped then, and a later beat begins a new life.
    """
    kind = stream.schema["node"].dataType.simpleString()
    ms = stream.sparkSession.range(1).select(F.expr(f"cast(interval {timeout} as interval day to second)").alias("i")).first()[0]
    beats = _kept(stream).withWatermark("time", delay).select("node", "time", F.unix_millis("time").alias("ms"))
    return beats.groupBy("node").transformWithStateInPandas(_Beats(int(ms.total_seconds() * 1000)), f"node {kind}, last_ms long, dead_ms long", "append", "eventTime")


class _Errors(StatefulProcessor):
    """State: a block's errors within the window before its last one, in microseconds."""

    def __init__(self, window_us: int, threshold: int):
        self.window, self.threshold = window_us, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "us long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        errors = _sorted(rows, ["us", "line_number"])
        held = [x[0] for x in self.times.get()]
        if held:
            self.handle.deleteTimer(self._end(held))
        counts = []
        for t in errors["us"].tolist():
            held = [x for x in held if x > t - self.window]
            held.append(t)
            counts.append(len(held))
        self.times.put([(x,) for x in held])
        self.handle.registerTimer(self._end(held))
        yield pd.DataFrame({"block_id": _repeated(key[0], len(counts)), "line_number": errors["line_number"], "survivors": counts, "error_burst": [n >= self.threshold for n in counts]})

    def _end(self, held: list[int]) -> int:
        """Milliseconds after which no held error counts any more."""
        return (max(held) + self.window) // 1000 + 1

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        held = [x[0] for x in self.times.get()]
        if held and self._end(held) <= expiredTimerInfo.getExpiryTimeInMs():
            self.times.clear()
        yield from ()

    def close(self) -> None:
        pass


def error_bursts(errors: DataFrame, window: int = 60, threshold: int = 5, delay: str = "10 minutes") -> DataFrame:
    """For each error of ``errors(block_id, line_number, time)``, how many of its block survive it (itself and those less than ``window`` seconds before), and whether these make a burst.

    A later error prunes what lies too far before it, so a state holds a window's errors
    at most; it is dropped when the watermark has passed the window of the last.
    """
    kind = errors.schema["block_id"].dataType.simpleString()
    rows = _kept(errors).withWatermark("time", delay).select("block_id", "line_number", "time", F.unix_micros("time").alias("us"))
    schema = f"block_id {kind}, line_number long, survivors long, error_burst boolean"
    return rows.groupBy("block_id").transformWithStateInPandas(_Errors(window * 1_000_000, threshold), schema, "append", "eventTime")
