"""The kept-up tracks as a stream: each camera's tracks lie in a map state by id, its clock in a value state, and its frames
that have to wait in a list state.

A frame is complete when the camera has a later one (its rows may come in several batches), so the newest frame of a camera waits
in the list. A camera that stays silent has its waiting frame taken by a timer, and loses its tracks.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from orrery.operators import tracker

_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb(spark: SparkSession):
    """State stores that can hold several variables of a key; the session's own setting comes back afterwards. Start streams inside."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_STORE, before) if before else spark.conf.unset(_STORE)


class Tracker(StatefulProcessor):
    def __init__(self, camera: str, tick: str, kinds: dict[str, str], settings: tracker.Settings, motion, silence_ms: int | None):
        self.camera, self.tick, self.kinds, self.settings, self.motion, self.silence = camera, tick, kinds, settings, motion, silence_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "next_id bigint, last bigint, carried binary")
        self.live = handle.getMapState("live", "track_id bigint", "place bigint, x double, y double, length bigint")
        self.waiting = handle.getListState("waiting", ", ".join(f"`{c}` {self.kinds[c]}" for c in (self.tick, *self.motion.columns)))

    def _load(self) -> tuple[tracker.Live, int | None]:
        clock = self.clock.get() if self.clock.exists() else None
        if clock is None:
            return tracker.Live(), None
        rows = sorted((v[0], k[0], *v[1:]) for k, v in self.live.iterator()) if self.live.exists() else []
        a = np.array(rows, float).reshape(-1, 5)
        return tracker.Live(a[:, 1].astype(np.int64), a[:, 2:4], a[:, 4].astype(np.int64), clock[0], True, bytes(clock[2] or b"")), clock[1]

    def _store(self, live: tracker.Live, last: int) -> None:
        """Only tracks that changed are written; those that are gone are taken out."""
        known = {k[0] for k in self.live.keys()} if self.live.exists() else set()
        for i in known - set(live.ids.tolist()):
            self.live.removeKey((i,))
        for place, (i, (x, y), n) in enumerate(zip(live.ids.tolist(), live.xy.tolist(), live.length.tolist(), strict=True)):
            self.live.updateValue((i,), (place, x, y, n))
        self.clock.update((live.next_id, int(last), live.carried))

    def _rows(self, key: tuple, got: pd.DataFrame) -> pd.DataFrame:
        return got.assign(**{self.camera: key[0]})[[self.camera, self.tick, "track_id", "x", "y", "length", "event"]]

    def _held(self) -> list[tuple]:
        return list(self.waiting.get()) if self.waiting.exists() else []

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[self.tick, *self.motion.columns])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = [self.tick, *self.motion.columns]
        live, last = self._load()
        held = self._held()
        new = pd.concat([*([self._frame(held)] if held else []), *(r[names] for r in rows)], ignore_index=True)
        if last is not None:
            new = new[new[self.tick] > last]  # frames that were taken already don't change what followed
        if len(new):
            newest = new[self.tick].max()
            whole, wait = new[new[self.tick] < newest], new[new[self.tick] == newest]
            self.waiting.put([tuple(None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for v in r) for r in wait.astype(object).itertuples(index=False, name=None)])
            if len(whole):
                live, got = tracker.folded(live, whole, self.tick, self.settings, self.motion)
                self._store(live, whole[self.tick].max())
                yield self._rows(key, got)
        if self.silence is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silence)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        live, _ = self._load()
        held = self._held()
        if held:
            live, got = tracker.folded(live, self._frame(held), self.tick, self.settings, self.motion)
            yield self._rows(key, got)
        if len(live.ids):
            at = held[0][0] if held else self.clock.get()[1]
            yield self._rows(key, pd.DataFrame({self.tick: at, "track_id": live.ids, "x": live.xy[:, 0], "y": live.xy[:, 1], "length": live.length, "event": "closed"}))
        for state in (self.clock, self.live, self.waiting):
            state.clear()

    def close(self) -> None:
        pass


def track(stream: DataFrame, camera: str, tick: str, settings: tracker.Settings, motion, silence_ms: int | None = None) -> DataFrame:
    """(camera, tick, tracker.OUT) of a stream of frames (camera, tick, the motion's columns). A camera without frames for
    silence_ms is closed: its last frame is taken and its tracks end. Start the query inside rocksdb()."""
    slim = stream.where(f"`{tick}` IS NOT NULL").select(camera, tick, *motion.columns)
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema}
    out = f"`{camera}` {kinds[camera]}, `{tick}` {kinds[tick]}, {tracker.OUT}"
    processor = Tracker(camera, tick, kinds, settings, motion, silence_ms)
    # with timers Spark keeps making batches, so a trigger that stops by itself would not end
    return slim.groupBy(camera).transformWithStateInPandas(processor, out, "Append", "None" if silence_ms is None else "ProcessingTime")
