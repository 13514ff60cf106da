"""Recordings, nested stores, settings and cameras on disk."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.functions import camera as C
from orrery.functions import pose as P
from orrery.operators import boxes, linear, sequence, tracks
from orrery.sources import datasets, readers, writers
from orrery.sources.nested import NestedStore


def picture(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(writers.png(np.full((2, 3, 3), value, np.uint8)))


def scan(path, n):
    path.parent.mkdir(parents=True, exist_ok=True)
    np.arange(4 * n, dtype="<f4").tofile(path)


def test_odometry_drive(spark, tmp_path):
    at = tmp_path / "sequences" / "03"
    for i in range(5):
        picture(at / "image_0" / f"{i:06d}.png", i)
        picture(at / "image_1" / f"{i:06d}.png", i + 100)
    for i in range(4):
        scan(at / "velodyne" / f"{i:06d}.bin", i + 1)
    (tmp_path / "poses").mkdir()
    (tmp_path / "poses" / "03.txt").write_text("".join(f"1 0 0 {i} 0 1 0 0 0 0 1 0\n" for i in range(5)))
    d = datasets.Drive.odometry(spark, str(tmp_path), "03")
    got = d.frames().orderBy("idx").collect()
    assert [r["idx"] for r in got] == [0, 1, 2, 3] and [r["pose"]["t"]["x"] for r in got] == [0, 1, 2, 3]
    assert got[2]["left"].endswith("image_0/000002.png") and got[2]["lidar"].endswith("000002.bin")
    truth = d.truth_frames()
    assert truth.count() == 5 and truth.where("lidar IS NOT NULL").count() == 0
    assert d.points().groupBy("idx").count().where("idx = 3").first()["count"] == 4
    assert {r["idx"]: r["image"]["data"][0] for r in d.images("right").collect()} == {i: i + 100 for i in range(5)}
    assert d.calibration().first()["fx"] == 721.5377
    few = datasets.Drive.odometry(spark, str(tmp_path), "03", start=1, most=2)
    assert [r["idx"] for r in few.frames().orderBy("idx").collect()] == [1, 2]
    assert {(r["scene"], r["n"]) for r in datasets.scenes(spark, str(tmp_path), ["03"]).groupBy("scene").agg(F.count("*").alias("n")).collect()} == {("03", 4)}
    with pytest.raises(FileNotFoundError):
        datasets.Drive(spark, str(tmp_path / "nothing"), "raw").frames()


def test_raw_and_omni_drives(spark, tmp_path):
    for i in range(3):
        for side in ("00", "01", "02", "03"):
            picture(tmp_path / f"image_{side}" / "data" / f"{i:010d}.png", i)
        f = tmp_path / "oxts" / "data" / f"{i:010d}.txt"
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(f"49.0 {8.4 + i * 1e-5} 110 0 0 0 1.5\n")
    (tmp_path / "oxts" / "dataformat.txt").write_text("lat: latitude\nlon: longitude\nalt: altitude\nroll: r\npitch: p\nyaw: y\nvn: north\n")
    for kind, left in (("raw", "image_00"), ("omni", "image_02")):
        d = datasets.Drive(spark, str(tmp_path), kind)
        got = d.frames().orderBy("idx").collect()
        assert len(got) == 3 and left in got[0]["left"] and got[0]["lidar"] is None
        assert got[0]["pose"]["t"]["x"] == 0 and math.isclose(got[2]["pose"]["t"]["x"], 2 * got[1]["pose"]["t"]["x"], rel_tol=1e-6) and got[1]["pose"]["t"]["x"] > 0.5
        assert d.packet_fields() == ["lat", "lon", "alt", "roll", "pitch", "yaw", "vn"] and d.packets().first()["vn"] == 1.5


def test_pairs_and_urban_drives(spark, tmp_path):
    for i in (1, 2, 10):
        picture(tmp_path / "p" / f"shot{i}-left.pnm", i)
        picture(tmp_path / "p" / f"shot{i}-right.pnm", i)
    got = datasets.Drive(spark, str(tmp_path / "p"), "pairs").stereo().orderBy("idx").collect()
    assert [r["left"].rsplit("/", 1)[1] for r in got] == ["shot1-left.pnm", "shot2-left.pnm", "shot10-left.pnm"]
    for i in range(3):
        picture(tmp_path / "u" / "data" / "img" / f"img{i + 1:04d}_0.png", i)
    (tmp_path / "u" / "info").mkdir()
    (tmp_path / "u" / "info" / "groundtruth.txt").write_text("".join(f"{i} {i + 5} 0 0 0 0 0 1\n" for i in range(3)))
    (tmp_path / "u" / "info" / "intrinsics.txt").write_text("fx fy\n[[300, 0, 320],\n [0, 310, 240],\n [0, 0, 1]]\n")
    d = datasets.Drive(spark, str(tmp_path / "u"), "urban", scale=0.5)
    assert [r["pose"]["t"]["x"] for r in d.frames().orderBy("idx").collect()] == [0, 1, 2]
    k = d.calibration().first()
    assert (k["fx"], k["fy"], k["cx"], k["h"]) == (150, 155, 160, 240)


def test_nested_store(spark, tmp_path):
    store = NestedStore(spark, f"{tmp_path}/db")
    a = np.arange(6, dtype=np.float32).reshape(2, 3)
    store.write({"n": 3, "s": "text", "none": None, "list": [1, "x"], "group": {"a": a, "deep": {"t": spark.range(4), "empty": {}}}})
    got = store.read()
    assert (got["n"], got["s"], got["none"], got["list"]) == (3, "text", None, [1, "x"])
    assert (got["group"]["a"] == a).all() and got["group"]["a"].dtype == np.float32 and got["group"]["deep"]["t"].count() == 4 and got["group"]["deep"]["empty"] == {}
    assert store.keys() == ["group", "list", "n", "none", "s"] and store.keys("group=group") == ["a", "deep"]
    store.write({"n": {"now": 1}})
    assert store.node("n/now") == 1 and store.node("group/deep/t").count() == 4
    assert [tuple(r) for r in store.leaves("group").collect()] == [("group/a", "array"), ("group/deep/t", "table")]
    for bad in (lambda: store.write({"a/b": 1}), lambda: store.write({"n": 1}, force=False)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        store.node("group/nothing")


def test_settings_and_cameras(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[DEFAULT]\nscale = 1\nName = all\n# c = 1\n[run]\nScale: 2\npath = /a=b\n[other]\n; x\n")
    got = {(r["section"], r["key"]): r["value"] for r in readers.config(spark, f"{tmp_path}/a.ini").collect()}
    assert got == {("run", "scale"): "2", ("run", "path"): "/a=b", ("run", "name"): "all", ("other", "scale"): "1", ("other", "name"): "all"}
    assert readers.config(spark, f"{tmp_path}/a.ini", "other").count() == 2
    cam = C.camera(C.intrinsic(500, 510, 320, 240, k1=0.1, h=480, w=640), P.from_rpyxyz(F.lit(0.1), F.lit(0.2), F.lit(0.3), F.lit(1.0), F.lit(2.0), F.lit(3.0)))
    one = spark.range(1).select(F.lit("front").alias("id"), cam.alias("camera"))
    writers.write_cameras(one, f"{tmp_path}/cams", "id")
    back = readers.cameras(spark, f"{tmp_path}/cams").first()
    want = one.first()["camera"]
    assert back["name"] == "front" and back["intrinsic"] == want["intrinsic"] and back["pose"] == want["pose"]


def test_suppression_in_rounds_is_the_loop(spark):
    rng = np.random.default_rng(3)
    xy = rng.integers(0, 300, (400, 2)).astype(float)
    rows = [(int(i % 2), i, x, y, x + 30 + i % 7, y + 40 + i % 5, float(i % 13)) for i, (x, y) in enumerate(xy.tolist())]
    df = spark.createDataFrame(rows, "g int, id int, x1 double, y1 double, x2 double, y2 double, score double")
    for boundary in ("gt", "ge"):
        a = sorted(r["id"] for r in boxes.nms(df, ["g"], "id", 0.3, boundary=boundary).collect())
        b = sorted(r["id"] for r in boxes.nms(df, ["g"], "id", 0.3, boundary=boundary, crowded=1).collect())
        assert a == b and 20 < len(a) < 400


def test_pairs_by_cells_touch_over_cell_edges(spark):
    a = spark.createDataFrame([(0, 1, 0.0, 0.0, 63.5, 10.0)], "g int, id int, x1 double, y1 double, x2 double, y2 double")
    b = spark.createDataFrame([(0, 2, 64.0, 0.0, 90.0, 10.0)], "g int, id int, x1 double, y1 double, x2 double, y2 double")
    assert boxes.pairs(a, b, ["g"], 64.0, inclusive=True).count() == boxes.pairs(a, b, ["g"], inclusive=True).count() == 1


def test_matrices_that_are_none(spark):
    """What is no rotation, mirror, scaling, projection or shear gives null, and so do null and ragged matrices."""
    eye = np.eye(4).tolist()
    odd = [[[1.0, 2.0, 0.0, 0.0], [0.0, 3.0, 1.0, 0.0], [5.0, 0.0, 1.0, 0.0], [0.0, 0.0, 0.0, 1.0]], None]
    df = spark.createDataFrame([(k, m) for k, m in enumerate([eye, *odd])], "k int, m array<array<double>>")
    m = F.col("m")
    got = df.select("k", linear.rotation_parts(m).alias("r"), linear.reflection_parts(m).alias("f"), linear.scale_parts(m).alias("s"), linear.projection_parts(m).alias("p"), linear.shear_parts(m).alias("h"), linear.inverse(m).alias("i")).orderBy("k").collect()
    # the columns of a null struct are null
    none = lambda x: x is None or all(v is None for v in x)
    assert got[0]["r"]["angle"] == 0 and got[0]["r"]["direction"] == [0, 0, 1] and got[0]["s"]["factor"] == 1 and none(got[0]["f"]) and none(got[0]["h"])
    assert all(none(got[1][c]) for c in "rfsph") and got[1]["i"] is not None
    assert all(none(got[2][c]) for c in "rfsph") and got[2]["i"] is None
    singular = spark.createDataFrame([([[1.0, 2.0], [2.0, 4.0]],)], "m array<array<double>>")
    assert singular.select(linear.inverse(F.col("m")).alias("i")).first()["i"] is None


def test_mesh_of_few_points(spark):
    assert len(tracks.delaunay(np.array([[0.0, 0], [1, 0]]))) == 0 and len(tracks.delaunay(np.array([[0.0, 0], [1, 0], [2, 0]]))) == 0
    assert tracks.delaunay(np.array([[0.0, 0], [4, 0], [0, 4], [1, 1]])).tolist() == [[0, 1, 3], [0, 2, 3], [1, 2, 3]]
    df = spark.createDataFrame([(0, 1, 0.0, 0.0), (0, 2, 4.0, 0.0), (0, 3, 0.0, 4.0), (0, 9, 0.0, 0.0), (1, 1, 0.0, 0.0)], "tick int, track_id int, x double, y double")
    assert [tuple(r) for r in tracks.mesh(df, ["tick"]).collect()] == [(0, 1, 2, 3)]


def test_random_orders(spark):
    df = spark.range(1000)
    a = [r["id"] for r in sequence.random_order(df).orderBy("idx").collect()]
    b = [r["id"] for r in sequence.random_order(df.repartition(7)).orderBy("idx").collect()]
    assert a == b and sorted(a) == list(range(1000)) and a != sorted(a)
    pick = [r["id"] for r in sequence.random_combination(df, 10, ["id"]).orderBy("idx").collect()]
    assert len(pick) == 10 and pick == sorted(pick)
    assert sequence.random_product([df, df], 2).count() == 4 and sequence.repeated(df, 0).count() == 0
    # one value for nearly all rows: cut by the tie
    same = spark.range(2000).select(F.when(F.col("id") < 1900, 5).otherwise(F.col("id")).alias("k"), "id")
    got = [r["id"] for r in sequence.index_all(same, "k", ["id"], cuts=16).orderBy("idx").collect()]
    assert got == list(range(2000))


def test_column_store_notes_and_chunks(spark, tmp_path):
    from orrery.sources.tables import ColumnStore

    s = ColumnStore(spark, f"{tmp_path}/db", "w")
    s.extend("a", spark.range(25), ["id"], "id")
    s["b"] = spark.range(12).select(F.col("id").alias("idx"), (F.col("id") * 2).alias("value"))
    s.describe(rate=30)
    s.describe(name="x")
    assert s.meta() == {"rate": 30, "name": "x"} and s.keys() == ["a", "b"]
    got = {r["chunk"]: (len(r["a"]), len(r["b"])) for r in s.chunks_of(["a", "b"], 10).collect()}
    assert got == {0: (10, 10), 1: (10, 2)}
    assert {k: d.count() for k, d in s.items()} == {"a": 25, "b": 12}
    with pytest.raises(ValueError):
        ColumnStore(spark, f"{tmp_path}/db").describe(a=1)
