"""Numbered frames as a data source of Spark: `spark.read.format("frames")` and `spark.readStream.format("frames")`.

A folder holds frames named by a printf template with one number (`%06d.bin`), or videos whose frames lie at known offsets. Which
frames are read is settled when the read is planned: the options start, stop and every, and filters on idx (=, <, <=, >, >=,
IN), leave frames out before any is opened. Partitions are of about equal bytes; a partition of a video is a seek and a run
of frames.

Kinds and their columns:
  raw    idx, path, content
  lidar  idx, pt_idx, x, y, z, reflectance: little-endian float32 quadruples
  video  video, idx, image (h, w, c, data): YUV4MPEG2 files, grey or with full or halved colour planes

A stream takes numbered frames in order from `start`: the offset is the next frame's number, and it waits at a gap, so a frame
that is written late is not lost. Folders are read through pyarrow's file systems, which the driver and all executors need to see.
"""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_IMAGE = "struct<h: int, w: int, c: int, data: binary>"
SCHEMAS = {
    "raw": "idx bigint, path string, content binary",
    "lidar": "idx bigint, pt_idx bigint, x double, y double, z double, reflectance double",
    "video": f"video string, idx bigint, image {_IMAGE}",
}
#: Bytes of frames in a partition, about; bytes of a video's header line at most.
BYTES, HEADER = 16 << 20, 4096
#: Bytes that opening a file counts for; most partitions of the videos of a folder; bytes of a batch of video frames.
OPEN, MOST_RUNS, BATCH = 64 << 10, 1000, 1 << 20
#: Planes of a video's pixel by the name of its colours, and bytes a pixel of all planes.
PLANES = {"mono": 1.0, "420": 1.5, "420jpeg": 1.5, "420mpeg2": 1.5, "444": 3.0}


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def pattern(template: str) -> re.Pattern:
    """What names of a printf template look like; its one number is group 1."""
    found = re.search(r"%0?\d*[di]", template)
    if not found:
        raise ValueError(f"a template needs a number, such as %06d: {template}")
    return re.compile(re.escape(template[: found.start()]) + r"(\d+)" + re.escape(template[found.end() :]) + r"\Z")


@dataclass
class Chosen:
    """Frame numbers that are asked for: from start, below stop, each every-th; and of a list, where there is one."""

    start: int = 0
    stop: int | None = None
    every: int = 1
    listed: frozenset | None = None
    low: int | None = None

    def take(self, f: Filter) -> bool:
        """Narrows the choice by a filter on idx; False if Spark has to filter by itself."""
        if getattr(f, "attribute", None) != ("idx",):
            return False
        if isinstance(f, (EqualTo, In)):
            values = frozenset(f.value if isinstance(f, In) else [f.value])
            self.listed = values if self.listed is None else self.listed & values
        elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
            at = f.value + isinstance(f, GreaterThan)
            self.low = at if self.low is None else max(self.low, at)
        elif isinstance(f, (LessThan, LessThanOrEqual)):
            at = f.value + isinstance(f, LessThanOrEqual)
            self.stop = at if self.stop is None else min(self.stop, at)
        else:
            return isinstance(f, IsNotNull)  # every frame has a number
        return True

    def __contains__(self, idx: int) -> bool:
        return idx >= max(self.start, self.low or 0) and (self.stop is None or idx < self.stop) and (idx - self.start) % self.every == 0 and (self.listed is None or idx in self.listed)


@dataclass
class Run(InputPartition):
    """Frames (idx, path) of a partition; of a video the path, its header and the numbers of its frames."""

    frames: list
    video: dict | None = None


def video_header(data: bytes) -> dict:
    """Size, planes, the place of the first frame and the bytes of each (its own line included)."""
    line, found, _ = data.partition(b"\n")
    words = line.decode("ascii", "replace").split(" ")
    if not found or words[0] != "YUV4MPEG2":
        raise ValueError("no YUV4MPEG2 header")
    tags = {w[0]: w[1:] for w in words[1:] if w}
    colours = tags.get("C", "420")
    if colours not in PLANES:
        raise ValueError(f"colours {colours} are not read; known are {', '.join(PLANES)}")
    w, h = int(tags["W"]), int(tags["H"])
    chroma = ((w + 1) // 2) * ((h + 1) // 2) if colours.startswith("420") else w * h
    planes = w * h + (0 if colours == "mono" else 2 * chroma)
    return {"w": w, "h": h, "colours": colours, "at": len(line) + 1, "size": planes, "step": planes + len(b"FRAME\n")}


def decode_planes(raw: bytes, head: dict) -> dict:
    """An image of blue, green and red (or grey) from the planes of one frame."""
    w, h = head["w"], head["h"]
    a = np.frombuffer(raw, np.uint8)
    y = a[: w * h].reshape(h, w)
    if head["colours"] == "mono":
        return {"h": h, "w": w, "c": 1, "data": y.tobytes()}
    rest = a[w * h :].reshape(2, -1)
    if head["colours"] == "444":
        u, v = rest.reshape(2, h, w)
    else:
        u, v = np.repeat(np.repeat(rest.reshape(2, (h + 1) // 2, (w + 1) // 2), 2, 1), 2, 2)[:, :h, :w]
    # the broadcast standard's studio range: 16 to 235 for light, 16 to 240 for colours
    y, u, v = 1.164 * (y.astype(float) - 16), u.astype(float) - 128, v.astype(float) - 128
    bgr = np.stack([y + 2.017 * u, y - 0.392 * u - 0.813 * v, y + 1.596 * v], -1)
    return {"h": h, "w": w, "c": 3, "data": np.clip(np.rint(bgr), 0, 255).astype(np.uint8).tobytes()}


class _Frames:
    """What the batch and the stream reader share."""

    def __init__(self, options: dict, schema: StructType):
        self.folder, self.kind, self.template = options["path"], options.get("kind", "raw"), options.get("template", "%06d.bin")
        self.bytes = int(options.get("bytes", BYTES))
        self.chosen = Chosen(int(options.get("start", 0)), int(options["stop"]) if "stop" in options else None, int(options.get("every", 1)))
        self.arrow = to_arrow_schema(schema)
        if self.chosen.every < 1:
            raise ValueError("every must be 1 or more")

    def listed(self) -> list[tuple[int, str, int]]:
        """(idx, path, bytes) of all numbered frames, in order of their numbers."""
        from pyarrow import fs

        where, path = file_system(self.folder)
        name = pattern(self.template)
        found = [(name.match(posixpath.basename(f.path)), f) for f in where.get_file_info(fs.FileSelector(path)) if f.is_file]
        return sorted((int(m[1]), f.path, f.size) for m, f in found if m)

    def packed(self, frames: Sequence[tuple[int, str, int]]) -> list[Run]:
        out, held = [Run([])], 0
        for idx, path, size in frames:
            size += OPEN
            if held + size > self.bytes and out[-1].frames:
                out.append(Run([]))
                held = 0
            out[-1].frames.append((idx, path))
            held += size
        return [r for r in out if r.frames]

    def read_run(self, run: Run) -> Iterator[pa.RecordBatch]:
        where, _ = file_system(self.folder)
        if run.video:
            yield from self._video(where, run)
            return
        held, size = [], 0
        for idx, path in run.frames:
            with where.open_input_file(path) as f:
                data = f.read()
            if self.kind == "lidar":
                yield self._lidar(idx, path, data)
                continue
            held.append((idx, path, data))
            if (size := size + len(data)) >= BATCH:
                yield self._batch(held)
                held, size = [], 0
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.arrow.types, strict=True)], schema=self.arrow)

    def _lidar(self, idx: int, path: str, data: bytes) -> pa.RecordBatch:
        if len(data) % 16:
            raise ValueError(f"{path} holds no whole quadruples of float32")
        points = np.frombuffer(data, "<f4").reshape(-1, 4).astype(float)
        n = len(points)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, idx)), pa.array(np.arange(n)), *(pa.array(c) for c in points.T.copy())], schema=self.arrow)

    def _video(self, where, run: Run) -> Iterator[pa.RecordBatch]:
        path, head = run.video["path"], run.video
        with where.open_input_file(path) as f:
            held, size = [], 0
            for idx in run.frames:
                f.seek(head["at"] + idx * head["step"])
                data = f.read(head["step"])
                if not data.startswith(b"FRAME\n"):
                    raise ValueError(f"{path}: frame {idx} doesn't begin where frames of one size would")
                held.append((path, idx, decode_planes(data[6:], head)))
                if (size := size + len(data)) >= BATCH:
                    yield self._batch(held)
                    held, size = [], 0
            if held:
                yield self._batch(held)


class FrameReader(_Frames, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.chosen.take(f):
                yield f

    def partitions(self) -> list[InputPartition]:
        if self.kind == "video":
            return self._video_runs() or [Run([])]
        return self.packed([f for f in self.listed() if f[0] in self.chosen]) or [Run([])]

    def _video_runs(self) -> list[Run]:
        from pyarrow import fs

        where, path = file_system(self.folder)
        files = [f for f in where.get_file_info(fs.FileSelector(path)) if f.is_file and f.path.endswith(".y4m")]
        out, least = [], sum(f.size for f in files) // MOST_RUNS
        for f in sorted(files, key=lambda f: f.path):
            with where.open_input_file(f.path) as data:
                head = video_header(data.read(HEADER))
            n = (f.size - head["at"]) // head["step"]
            wanted = [i for i in range(n) if i in self.chosen]
            each = max(1, max(self.bytes, least) // head["step"])
            out += [Run(wanted[k : k + each], {**head, "path": f.path}) for k in range(0, len(wanted), each)]
        return out

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.read_run(partition)


class FrameStream(_Frames, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"next": self.chosen.start}

    def latestOffset(self) -> dict:
        """After the last frame before a gap (or the stop)."""
        at = self.chosen.start
        for idx, _, _ in self.listed():
            if idx == at and (self.chosen.stop is None or idx < self.chosen.stop):
                at += 1
            elif idx > at:
                break
        return {"next": at}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.packed([f for f in self.listed() if start["next"] <= f[0] < end["next"] and f[0] in self.chosen])

    def read(self, partition: Run) -> Iterator[pa.RecordBatch]:
        return self.read_run(partition)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    """Options: path, kind (raw, lidar, video), template, start, stop, every, bytes (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        kind = self.options.get("kind", "raw")
        if kind not in SCHEMAS:
            raise ValueError(f"kind {kind} is none of {', '.join(SCHEMAS)}")
        return SCHEMAS[kind]

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(dict(self.options), schema)

    def streamReader(self, schema: StructType) -> FrameStream:
        if self.options.get("kind") == "video":
            raise ValueError("a stream takes numbered frames")
        return FrameStream(dict(self.options), schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and has Spark hand filters to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FrameSource)


def scan(spark: SparkSession, folder: str, kind: str = "raw", template: str = "%06d.bin", start: int = 0, stop: int | None = None, every: int = 1, size: int = BYTES) -> DataFrame:
    """The frames of a folder: start, start + every, ... below stop, where they exist."""
    register(spark)
    options = {"kind": kind, "template": template, "start": start, "every": every, "bytes": size} | ({} if stop is None else {"stop": stop})
    return spark.read.format("frames").options(**options).load(folder)


def follow(spark: SparkSession, folder: str, kind: str = "raw", template: str = "%06d.bin", start: int = 0, every: int = 1) -> DataFrame:
    """The same frames as a stream, as they are written."""
    register(spark)
    return spark.readStream.format("frames").options(kind=kind, template=template, start=start, every=every).load(folder)


# writing


def write(df: DataFrame, folder: str, idx: str, content: Callable[[pa.Table], bytes], template: str = "%06d.bin") -> DataFrame:
    """A file for each value of idx, from its rows by content(); gives (idx, path, bytes) when it is run. A file gets its name
    when it is whole, so readers and repeated tasks never see a part. The rows of a frame meet in one task; frames are dealt over tasks
    however small they are."""

    schema = pa.schema([("idx", pa.int64()), ("path", pa.string()), ("bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = file_system(folder)
        where.create_dir(path, recursive=True)
        rng = np.random.default_rng()

        def put(at: int, rows: list[pa.RecordBatch]) -> tuple:
            data = content(pa.Table.from_batches(rows))
            name = f"{path}/{template % at}"
            # a name of its own for each attempt
            part = f"{path}/.{template % at}.{rng.integers(1 << 62):x}"
            with where.open_output_stream(part, compression=None) as f:
                f.write(data)
            where.move(part, name)
            return at, name, len(data)

        packed = lambda done: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        held, last = [], None
        for batch in batches:
            ids, done = batch.column(idx).to_numpy(zero_copy_only=False), []
            edges = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for k, end in zip(edges, edges[1:]):
                if k == end:
                    continue
                if held and int(ids[k]) != last:
                    done.append(put(last, held))
                    held = []
                held.append(batch.slice(k, end - k))
                last = int(ids[k])
            if done:
                yield packed(done)
        if held:
            yield packed([put(last, held)])

    # a number of partitions that isn't lowered where the rows are few bytes: opening files is what takes the time
    parts = max(df.sparkSession.sparkContext.defaultParallelism * 4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.where(f"`{idx}` IS NOT NULL").repartition(parts, idx).sortWithinPartitions(idx).mapInArrow(run, "idx bigint, path string, bytes bigint")


def lidar_content(order: str, columns: Sequence[str]) -> Callable[[pa.Table], bytes]:
    """Quadruples of float32 in the order of a column."""

    def content(table: pa.Table) -> bytes:
        table = table.sort_by(order)
        return np.stack([table.column(c).to_numpy() for c in columns], 1).astype("<f4").tobytes()

    return content


def video_content(order: str, image: str = "image", rate: int = 30) -> Callable[[pa.Table], bytes]:
    """A grey YUV4MPEG2 file of the images (h, w, c = 1) of a group, in the order of a column."""

    def content(table: pa.Table) -> bytes:
        rows = [r for r in table.sort_by(order).column(image).to_pylist()]
        sizes = {(r["h"], r["w"], r["c"]) for r in rows}
        if len(sizes) != 1 or next(iter(sizes))[2] != 1:
            raise ValueError(f"a video needs grey images of one size, not {json.dumps(sorted(sizes))}")
        h, w, _ = sizes.pop()
        return f"YUV4MPEG2 W{w} H{h} F{rate}:1 Ip A1:1 Cmono\n".encode() + b"".join(b"FRAME\n" + bytes(r["data"]) for r in rows)

    return content
