"""Structured Streaming twins of the ordered operators: keyed state with the batch forms' own step functions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from orrery.operators.poses import sample_step

POSE_COLUMNS = ["tx", "ty", "tz", "qx", "qy", "qz", "qw"]


def sample_poses(stream: DataFrame, key: str, order: str, displacement: float = 0.25, theta: float = math.radians(20), history: int = 10) -> DataFrame:
    """Keyframes of each trajectory as they come: the accepted history is the state. Rows of one batch are taken in order."""
    schema = f"`{key}` {stream.schema[key].dataType.simpleString()}, `{order}` {stream.schema[order].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in POSE_COLUMNS)

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        past = [np.array(x) for x in np.array(state.get[0]).reshape(-1, 7)] if state.exists else []
        pdf = pd.concat(list(batches)).sort_values(order)
        kept = []
        for i, row in enumerate(pdf[POSE_COLUMNS].to_numpy(float)):
            if sample_step(np.array(past), row, displacement, theta):
                kept.append(i)
                past = [*past, row][-history:]
        state.update((np.concatenate(past).tolist() if past else [],))
        yield pdf.iloc[kept][[key, order, *POSE_COLUMNS]]

    return stream.groupBy(key).applyInPandasWithState(run, schema, "past array<double>", "append", GroupStateTimeout.NoTimeout)


def last_n(stream: DataFrame, key: str, order: str, value: str, n: int = 100) -> DataFrame:
    """(key, total, values): each key's newest n values in order and its lifetime count, after each batch."""
    kind = stream.schema[key].dataType.simpleString()

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, values = state.get if state.exists else (0, [])
        pdf = pd.concat(list(batches)).sort_values(order)
        values = [*values, *pdf[value].astype(float).tolist()][-n:]
        total += len(pdf)
        state.update((total, values))
        yield pd.DataFrame({key: [k[0]], "total": [total], "values": [values]})

    return stream.groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, total bigint, values array<double>", "total bigint, values array<double>", "update", GroupStateTimeout.NoTimeout)


def tracks(stream: DataFrame, camera: str, maxlen: int = 2) -> DataFrame:
    """(camera, track_id, tick, x, y, length, event): state of each camera's tracks. A row is 'seen' for each observation
    and 'lost' for a track without one at its camera's next tick."""
    kind = stream.schema[camera].dataType.simpleString()
    out = f"`{camera}` {kind}, track_id bigint, tick bigint, x double, y double, length bigint, event string"

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        ids, ticks, xs, ys, lengths = (list(v) for v in state.get) if state.exists else ([], [], [], [], [])
        live = {i: (t, x, y, n) for i, t, x, y, n in zip(ids, ticks, xs, ys, lengths, strict=True)}
        rows = []
        for tick, frame in pd.concat(list(batches)).sort_values(["tick", "track_id"]).groupby("tick"):
            for o in frame.itertuples():
                if np.isfinite([o.x, o.y]).all():
                    n = live.get(o.track_id, (0, 0, 0, 0))[3] + 1
                    live[o.track_id] = (tick, o.x, o.y, n)
                    rows.append((k[0], o.track_id, tick, o.x, o.y, n, "seen"))
            for i in [i for i, v in live.items() if v[0] < tick]:
                t, x, y, n = live.pop(i)
                rows.append((k[0], i, t, x, y, n, "lost"))
        keep = sorted(live.items())
        state.update(([i for i, _ in keep], *[[v[j] for _, v in keep] for j in range(4)]))
        yield pd.DataFrame(rows, columns=[camera, "track_id", "tick", "x", "y", "length", "event"])

    kept = "ids array<bigint>, ticks array<bigint>, xs array<double>, ys array<double>, lengths array<bigint>"
    return stream.groupBy(camera).applyInPandasWithState(run, out, kept, "append", GroupStateTimeout.NoTimeout)


def every_kth(stream: DataFrame, key: str, order: str, k: int, count_first: bool = True) -> DataFrame:
    """Rows k, 2k, ... (or 1, k + 1, ...) of each key, counted over all batches."""

    def run(g: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        pdf = pd.concat(list(batches)).sort_values(order)
        at = np.arange(n + 1, n + 1 + len(pdf))
        state.update((int(n + len(pdf)),))
        yield pdf[(at % k == 0) if count_first else ((at - 1) % k == 0)]

    return stream.groupBy(key).applyInPandasWithState(run, stream.schema, "n bigint", "append", GroupStateTimeout.NoTimeout)


def windowed(stream: DataFrame, ts: str, late: str, width: str, keys: list[str]) -> DataFrame:
    """Counts in event-time windows; rows later than the watermark are dropped by Spark."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"))
