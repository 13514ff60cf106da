"""The frame source: planning, filters, videos, streams over gaps and restarts."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, LessThanOrEqual, StringContains
from pyspark.sql.types import StructType

from orrery.sources import frames


def reader(spark, folder, **options) -> frames.FrameReader:
    kind = options.get("kind", "raw")
    return frames.FrameReader({"path": f"file://{folder}", **{k: str(v) for k, v in options.items()}}, spark.createDataFrame([], frames.SCHEMAS[kind]).schema)


@pytest.fixture()
def sweeps(tmp_path):
    for i in (0, 1, 2, 3, 5, 8, 9, 10, 11, 40):
        np.arange(8 * (1 + i % 3), dtype="<f4").tofile(tmp_path / f"{i:06d}.bin")
    (tmp_path / "notes.txt").write_text("no frame")
    (tmp_path / ".000006.bin.part").write_bytes(b"half")
    return tmp_path


def planned(r: frames.FrameReader) -> list[int]:
    return [i for run in r.partitions() for i, _ in run.frames]


def test_planning(spark, sweeps):
    assert planned(reader(spark, sweeps)) == [0, 1, 2, 3, 5, 8, 9, 10, 11, 40]
    assert planned(reader(spark, sweeps, start=1, every=2)) == [1, 3, 5, 9, 11]
    assert planned(reader(spark, sweeps, start=2, stop=10)) == [2, 3, 5, 8, 9]
    r = reader(spark, sweeps, every=5)
    kept = list(r.pushFilters([GreaterThan(("idx",), 0), LessThanOrEqual(("idx",), 10), StringContains(("path",), "x")]))
    assert [type(f) for f in kept] == [StringContains] and planned(r) == [5, 10]
    r = reader(spark, sweeps)
    assert not list(r.pushFilters([In(("idx",), (3, 4, 8)), EqualTo(("idx",), 8)])) and planned(r) == [8]
    # small partitions hold one frame, large ones all
    assert len(reader(spark, sweeps, bytes=1).partitions()) == 10 and len(reader(spark, sweeps, bytes=1 << 30).partitions()) == 1
    for bad in ({"every": 0}, {"template": "no number"}):
        with pytest.raises(ValueError):
            reader(spark, sweeps, **bad).partitions()


def test_filters_reach_the_source(spark, sweeps):
    got = frames.scan(spark, f"file://{sweeps}", "lidar").where("idx > 3 AND idx <= 9 AND x >= 0")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "idx" not in "".join(line for line in plan.split("\n") if line.strip(" :+-*()0123456789").startswith("Filter"))
    assert sorted({r["idx"] for r in got.collect()}) == [5, 8, 9]
    assert frames.scan(spark, f"file://{sweeps}", "lidar", start=100).count() == 0
    rows = frames.scan(spark, f"file://{sweeps}", "lidar", start=1, stop=2).orderBy("pt_idx").collect()
    assert [(r["pt_idx"], r["x"], r["reflectance"]) for r in rows] == [(k, 4.0 * k, 4.0 * k + 3) for k in range(4)]
    assert frames.scan(spark, f"file://{sweeps}").where("idx = 40").select(F.length("content")).first()[0] == 64


def test_damaged_frames_are_errors(spark, sweeps):
    (sweeps / "000012.bin").write_bytes(b"seventeen bytes..")
    with pytest.raises(Exception, match="quadruples"):
        frames.scan(spark, f"file://{sweeps}", "lidar").count()


@pytest.mark.parametrize("colours", ["mono", "444", "420jpeg"])
def test_videos(spark, tmp_path, colours):
    h, w, n = 5, 7, 9
    head = f"YUV4MPEG2 W{w} H{h} F25:1 Ip A1:1 C{colours}\n".encode()
    chroma = {"mono": 0, "444": 2 * h * w, "420jpeg": 2 * 3 * 4}[colours]
    light = lambda i: 16 + 10 * i
    (tmp_path / "a.y4m").write_bytes(head + b"".join(b"FRAME\n" + bytes([light(i)] * (h * w)) + bytes([128] * chroma) for i in range(n)))
    got = frames.scan(spark, f"file://{tmp_path}", "video", start=2, every=3, size=1).orderBy("idx").collect()
    assert [r["idx"] for r in got] == [2, 5, 8]
    for r in got:
        want = light(r["idx"]) if colours == "mono" else round(1.164 * (light(r["idx"]) - 16))
        assert set(r["image"]["data"]) == {want} and len(r["image"]["data"]) == h * w * (1 if colours == "mono" else 3)
    (tmp_path / "b.y4m").write_bytes(head + b"FRAME X\n" + bytes(h * w + chroma))
    with pytest.raises(Exception, match="doesn't begin"):
        frames.scan(spark, f"file://{tmp_path}", "video").count()
    for bad in (b"RIFF", b"YUV4MPEG2 W2 H2 Cp10\n", b"x" * 5000):
        with pytest.raises(ValueError):
            frames.video_header(bad)


def test_stream_waits_at_a_gap(spark, tmp_path):
    """Frames 0 to 2 come, 4 waits for 3; a restart goes on where the last run ended; each frame comes once."""
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    put = lambda i: np.full(4, i, "<f4").tofile(folder / f"{i:06d}.bin")

    def run() -> list[int]:
        stream = frames.follow(spark, f"file://{folder}", "lidar")
        stream.writeStream.format("parquet").option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start(str(out / "rows")).awaitTermination()
        return sorted(r["idx"] for r in spark.read.parquet(str(out / "rows")).collect())

    for i in (0, 1, 2, 4):
        put(i)
    assert run() == [0, 1, 2]
    assert run() == [0, 1, 2]
    put(3)
    assert run() == [0, 1, 2, 3, 4]
    batch = frames.scan(spark, f"file://{folder}", "lidar").select("idx", "x").collect()
    assert sorted(tuple(r) for r in spark.read.parquet(str(out / "rows")).select("idx", "x").collect()) == sorted(map(tuple, batch))


def test_written_frames_come_back(spark, tmp_path):
    rows = spark.range(1000).select((F.col("id") % 7).alias("frame"), F.col("id").alias("at"), *[(F.col("id") * k).cast("double").alias(c) for k, c in enumerate("abcd")])
    rows = rows.unionByName(rows.limit(1).withColumn("frame", F.lit(None).cast("bigint")))
    wrote = frames.write(rows, f"file://{tmp_path}/x", "frame", frames.lidar_content("at", list("abcd")), "s-%i.bin").collect()
    assert sorted(r["idx"] for r in wrote) == list(range(7)) and sum(r["bytes"] for r in wrote) == 16 * 1000
    got = frames.scan(spark, f"file://{tmp_path}/x", "lidar", "s-%i.bin")
    assert got.agg(F.sum("y"), F.sum("reflectance")).first()[:] == (499500.0, 3 * 499500.0)
    # written again by a repeated task: the same files
    frames.write(rows, f"file://{tmp_path}/x", "frame", frames.lidar_content("at", list("abcd")), "s-%i.bin").count()
    assert got.count() == 1000
    assert isinstance(got.schema, StructType)
