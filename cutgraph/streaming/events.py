"""Sliding windows, sessions and hysteresis over a stream of events (media_id, ts, value)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sliding(stream: DataFrame, late: str = "10 seconds", length: str = "2 seconds", every: str = "1 second") -> DataFrame:
    """(media_id, start, n, most) of each sliding window."""
    g = stream.withWatermark("ts", late).groupBy("media_id", F.window("ts", length, every))
    return g.agg(F.count("*").alias("n"), F.max("value").alias("most")).select("media_id", F.col("window.start").alias("start"), "n", "most")


def sessions(stream: DataFrame, gap: str = "300 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(media_id, start, end, n) of the parts of activity that silences of ``gap`` separate."""
    g = stream.withWatermark("ts", late).groupBy("media_id", F.session_window("ts", gap))
    return g.agg(F.count("*").alias("n")).select("media_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def hysteresis(stream: DataFrame, enter: float = 0.5, leave: float = 0.3, hop_us: int = 1_000_000) -> DataFrame:
    """(media_id, start_us, end_us, confidence, n) of each event once it is left; rows of a batch go in time order.

    The state is one open event per media item.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, total, n = state.get if state.exists else (-1, 0.0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values("t_us", kind="stable")
        for t, v in zip(rows.t_us, rows.value, strict=True):
            if start < 0 and v > enter:
                start, total, n = int(t), 0.0, 0
            if start >= 0 and v < leave:
                out.append((key[0], start, int(t) + hop_us, total / n, n))
                start = -1
            elif start >= 0:
                total, n = total + v, n + 1
        state.update((start, total, n))
        yield pd.DataFrame(out, columns=["media_id", "start_us", "end_us", "confidence", "n"])

    timed = stream.select("media_id", F.unix_micros("ts").alias("t_us"), "value")
    return timed.groupBy("media_id").applyInPandasWithState(step, "media_id long, start_us long, end_us long, confidence double, n long", "start long, total double, n long", "append", GroupStateTimeout.NoTimeout)


#: The state store that timers need.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class _OpenEvent(StatefulProcessor):
    """Rows wait until the watermark has passed them and are then taken in time order, so that it doesn't matter in which order they came."""

    def __init__(self, enter: float, leave: float, hop_us: int, quiet_us: int):
        self.enter, self.leave, self.hop, self.quiet = enter, leave, hop_us, quiet_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "t long, v double")
        self.open = handle.getValueState("open", "start long, last long, total double, n long")

    def _drained(self, key: tuple, watermark_us: int, came: list[tuple[int, float]]) -> list[tuple]:
        rows = sorted([*(self.waiting.get() if self.waiting.exists() else ()), *came])
        start, last, total, n = self.open.get() if self.open.exists() else (-1, -1, 0.0, 0)
        out = []
        ready = [r for r in rows if r[0] <= watermark_us]
        for t, v in ready:
            if start >= 0 and t - last > self.quiet:
                out.append((key[0], start, last + self.hop, total / n, n, True))
                start = -1
            if start < 0 and v > self.enter:
                start, total, n = t, 0.0, 0
            if start >= 0 and v < self.leave:
                out.append((key[0], start, t + self.hop, total / n, n, False))
                start = -1
            elif start >= 0:
                total, n, last = total + v, n + 1, t
        left = rows[len(ready) :]
        if start >= 0 and watermark_us - last > self.quiet and (not left or left[0][0] - last > self.quiet):
            out.append((key[0], start, last + self.hop, total / n, n, True))
            start = -1
        self.waiting.put(left) if left else self.waiting.clear()
        self.open.update((start, last, total, n)) if start >= 0 else self.open.clear()
        # wake up when the watermark passes what waits, or the open event has been quiet for too long
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        wake = [r[0] for r in left[:1]] + ([last + self.quiet] if start >= 0 else [])
        if wake:
            self.handle.registerTimer(max(min(wake) // 1000 + 1, watermark_us // 1000 + 1))
        return out

    def _frames(self, out: list[tuple]) -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=["media_id", "start_us", "end_us", "confidence", "n", "cut_short"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark_us = timerValues.getCurrentWatermarkInMs() * 1000
        # what lies behind the watermark has been judged without them
        came = [(int(t), float(v)) for batch in rows for t, v in zip(batch.t_us, batch.value, strict=True) if t > watermark_us]
        yield from self._frames(self._drained(key, watermark_us, came))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield from self._frames(self._drained(key, timerValues.getCurrentWatermarkInMs() * 1000, []))

    def close(self) -> None:
        pass


def hysteresis_with_timers(stream: DataFrame, enter: float = 0.5, leave: float = 0.3, hop_us: int = 1_000_000, late: str = "10 seconds", quiet_us: int = 30_000_000) -> DataFrame:
    """(media_id, start_us, end_us, confidence, n, cut_short) of each event once it is left, or once its media item has been quiet for ``quiet_us``.

    Rows up to ``late`` behind the latest count in their place in time; later ones are dropped. An event that quiet has ended is ``cut_short`` and ends with its last row. The
    state is an item's rows within ``late`` and one open event. The session's state store must be that of STORE.
    """
    timed = stream.filter("ts is not null and value is not null").withWatermark("ts", late).select("media_id", "ts", F.unix_micros("ts").alias("t_us"), "value")
    return timed.groupBy("media_id").transformWithStateInPandas(_OpenEvent(enter, leave, hop_us, quiet_us), "media_id long, start_us long, end_us long, confidence double, n long, cut_short boolean", "Append", "EventTime")
