"""Point tracks that are kept up: points move from frame to frame, lost ones go, and new ones are detected where too few are left.

One step makes a frame's tracks of those before it; the batch form folds it over a camera's frames and the stream
(streaming/tracker.py) keeps what it needs in state. Points move by a motion: a shift that the frame itself tells, or what the
images show.

A step: points that leave the image (or aren't finite) are lost. If the camera is new, or had fewer than `least` points before
the frame, its detections that lie farther than `radius` from all points before the frame are taken by falling response (then x,
then y), as many as were missing. They get the next ids.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, GroupedData

from orrery.operators import imaging

OUT = "track_id bigint, x double, y double, length bigint, event string"


@dataclass(frozen=True)
class Settings:
    """Size of the images, points that a camera should have, and the distance that new ones keep."""

    h: float
    w: float
    least: int = 1200
    radius: float = 9.0


@dataclass
class Live:
    """A camera's tracks: ids, places, frames seen; the next id; what the motion carries to the next frame."""

    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    xy: np.ndarray = field(default_factory=lambda: np.empty((0, 2)))
    length: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    next_id: int = 0
    started: bool = False
    carried: bytes = b""


class Shift:
    """Frames say how all points move: columns dx and dy, the same in each row of a frame; its rows are detections (x, y,
    response), those without a place none."""

    columns = ("x", "y", "response", "dx", "dy")

    def moved(self, live: Live, frame: pd.DataFrame) -> np.ndarray:
        return live.xy + frame[["dx", "dy"]].iloc[0].to_numpy(float)

    def found(self, frame: pd.DataFrame) -> np.ndarray:
        return frame[["x", "y", "response"]].dropna().to_numpy(float)

    def carry(self, frame: pd.DataFrame) -> bytes:
        return b""


class Images:
    """Frames are images (one row each): points are followed from the image before, kept if they come back within `tol`, and
    corners are the detections."""

    columns = ("image",)

    def __init__(self, tol: float = 1.5, threshold: float = 0.01):
        self.tol, self.threshold = tol, threshold

    @staticmethod
    def _grey(image) -> np.ndarray:
        return imaging.to_gray(imaging.decode(image)).astype(float)

    def moved(self, live: Live, frame: pd.DataFrame) -> np.ndarray:
        new = self._grey(frame["image"].iloc[0])
        old = np.frombuffer(live.carried, np.float32).reshape(new.shape).astype(float)
        there = imaging.track_points(old, new, live.xy)
        back = imaging.track_points(new, old, there)
        there[(np.abs(back - live.xy) >= self.tol).any(1)] = np.nan
        return there

    def found(self, frame: pd.DataFrame) -> np.ndarray:
        r = imaging.corner_response(self._grey(frame["image"].iloc[0]))
        y, x = np.nonzero((r >= imaging.dilate(r)) & (r > self.threshold * max(r.max(), 1e-12)))
        return np.stack([x, y, r[y, x]], 1).astype(float)

    def carry(self, frame: pd.DataFrame) -> bytes:
        return self._grey(frame["image"].iloc[0]).astype(np.float32).tobytes()


def away(found: np.ndarray, taken: np.ndarray, radius: float) -> np.ndarray:
    """Detections with no taken point within the radius; taken points are looked up by cells of its size."""
    if not len(found) or not len(taken):
        return found
    cells: dict[tuple[int, int], list[int]] = {}
    side = max(radius, 1e-9)
    for k, (cx, cy) in enumerate(np.floor(taken / side).astype(int).tolist()):
        cells.setdefault((cx, cy), []).append(k)
    keep = np.ones(len(found), bool)
    for i, (cx, cy) in enumerate(np.floor(found[:, :2] / side).astype(int).tolist()):
        near = [k for dx in (-1, 0, 1) for dy in (-1, 0, 1) for k in cells.get((cx + dx, cy + dy), ())]
        keep[i] = not near or (((taken[near] - found[i, :2]) ** 2).sum(1) > radius * radius).all()
    return found[keep]


def step(live: Live, frame: pd.DataFrame, settings: Settings, motion) -> tuple[Live, pd.DataFrame]:
    """The tracks after a frame, and its rows (OUT): 'seen' and 'new' ones with their place, 'lost' ones with the last."""
    moved = motion.moved(live, frame) if len(live.xy) else live.xy
    ok = np.isfinite(moved).all(1)
    ok &= (np.nan_to_num(moved, nan=-1) >= 0).all(1) & (np.nan_to_num(moved, nan=-1) < [settings.w, settings.h]).all(1)
    new = np.empty((0, 2))
    if not live.started or len(live.xy) < settings.least:
        found = away(motion.found(frame), live.xy, settings.radius)
        new = found[np.lexsort((found[:, 1], found[:, 0], -found[:, 2]))][: max(0, settings.least - len(live.xy)), :2]
    new_ids = live.next_id + np.arange(len(new))
    after = Live(np.concatenate([live.ids[ok], new_ids]), np.concatenate([moved[ok], new]), np.concatenate([live.length[ok] + 1, np.ones(len(new), np.int64)]), live.next_id + len(new), True, motion.carry(frame))
    lost = ~ok
    event = ["seen"] * int(ok.sum()) + ["new"] * len(new) + ["lost"] * int(lost.sum())
    xy = np.concatenate([after.xy, live.xy[lost]])
    return after, pd.DataFrame({"track_id": np.concatenate([after.ids, live.ids[lost]]), "x": xy[:, 0], "y": xy[:, 1], "length": np.concatenate([after.length, live.length[lost]]), "event": pd.Series(event, dtype=object)})


def folded(live: Live, rows: pd.DataFrame, tick: str, settings: Settings, motion) -> tuple[Live, pd.DataFrame]:
    """The step over all frames of the rows, in order of their ticks."""
    out = [pd.DataFrame({"track_id": np.empty(0, np.int64), "x": np.empty(0), "y": np.empty(0), "length": np.empty(0, np.int64), "event": pd.Series([], dtype=object), tick: np.empty(0, np.int64)})]
    for at, frame in rows.sort_values(tick, kind="stable").groupby(tick):
        live, got = step(live, frame, settings, motion)
        got[tick] = at
        out.append(got)
    return live, pd.concat([x for x in out if len(x)] or out[:1], ignore_index=True)


def sorted_groups(df: DataFrame, by: Sequence[str], tick: str) -> GroupedData:
    """Groups whose rows come in order of their ticks, in batches: for functions that needn't hold a group."""
    dealt = df.repartition(*by) if by else df.coalesce(1)
    return dealt.sortWithinPartitions(*by, tick).groupBy(*by)


def in_turn(batches: Iterator[pd.DataFrame], by: Sequence[str], tick: str) -> tuple[dict, Iterator[tuple[object, pd.DataFrame]]]:
    """The keys of a sorted group, and its frames (tick, rows) one after the other."""
    first = next(batches)

    def frames() -> Iterator[tuple[object, pd.DataFrame]]:
        at, held = None, []
        for pdf in itertools.chain([first], batches):
            for now, part in pdf.groupby(tick):
                if held and now != at:
                    if now < at:
                        raise ValueError("frames of a group are not in order")
                    yield at, pd.concat(held, ignore_index=True)
                    held = []
                at = now
                held.append(part)
        if held:
            yield at, pd.concat(held, ignore_index=True)

    return {c: first[c].iloc[0] for c in by}, frames()


def track(frames: DataFrame, by: Sequence[str], tick: str, settings: Settings, motion) -> DataFrame:
    """frames (by, tick, the motion's columns) -> (by, tick, OUT). Each frame's tracks come of those before, so a camera's
    frames are one task's work in turn, read in their order, so that it holds a frame at a time; cameras spread over tasks. Frames without a tick are left out."""
    slim = frames.where(f"`{tick}` IS NOT NULL").select(*by, tick, *motion.columns)
    kinds = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in [*by, tick])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        live, (keys, turns) = Live(), in_turn(batches, by, tick)
        for at, frame in turns:
            live, got = step(live, frame, settings, motion)
            yield got.assign(**{**keys, tick: at})[[*by, tick, "track_id", "x", "y", "length", "event"]]

    return sorted_groups(slim, by, tick).applyInPandas(run, f"{kinds}, {OUT}")
