"""Cases that earlier forms lost: brackets in settings, poles of a ball, long powersets, hulls over many parts, array ranks,
one-to-one assignments, collections with late messages."""

from __future__ import annotations

import itertools
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import arcball, text, vec
from orrery.operators import boxes, boxtracks, sequence
from orrery.sources import readers, writers
from orrery.sources.collections import Collections, attached


def test_settings_with_brackets(spark, tmp_path):
    (tmp_path / "a.ini").write_text("[DEFAULT]\nshared = [0]\nm: 9\n[one]\nk = [1, 2]\nm = 3\nurl = http://h:80/?a=b\n[not a section] = x\n; c = 1\n[two]\r\nm = a]b\r\n[empty]\n")
    got = {(r["section"], r["key"]): r["value"] for r in readers.config(spark, str(tmp_path / "a.ini")).collect()}
    assert got == {
        ("one", "k"): "[1, 2]", ("one", "m"): "3", ("one", "url"): "http://h:80/?a=b", ("one", "[not a section]"): "x", ("one", "shared"): "[0]",
        ("two", "m"): "a]b", ("two", "shared"): "[0]", ("empty", "shared"): "[0]", ("empty", "m"): "9",
    }


def test_json_objects(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n "x": 1,\n "y": [1, 2]}\n')
    (tmp_path / "b.json").write_text('{"x": 1}\n{"x": 2}\n{"x": 3}\n')
    assert readers.json_dict(spark, str(tmp_path / "a.json")).first()["y"] == [1, 2]
    assert readers.json_dict(spark, str(tmp_path / "b.json")).count() == 3


def test_samples_of_pngs(spark, tmp_path):
    """Each of the five line filters, 8 and 16 bits, several channels."""
    rng = np.random.default_rng(0)
    for bits, channels, colour in ((8, 1, 0), (8, 3, 2), (16, 1, 0), (16, 4, 6)):
        a = rng.integers(0, 1 << bits, (10, 7, channels)).astype(f">u{bits // 8}")
        lines = a.view(np.uint8).reshape(10, -1).astype(int)
        pixel, body = channels * bits // 8, b""
        for y in range(10):
            left = np.concatenate([np.zeros(pixel, int), lines[y, :-pixel]])
            up = lines[y - 1] if y else np.zeros_like(left)
            corner = np.concatenate([np.zeros(pixel, int), up[:-pixel]])
            near = left + up - corner
            d = np.stack([abs(near - left), abs(near - up), abs(near - corner)])
            guess = [0, left, up, (left + up) // 2, np.choose(d.argmin(0), [left, up, corner])][y % 5]
            body += bytes([y % 5]) + ((lines[y] - guess) % 256).astype(np.uint8).tobytes()
        chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
        head = struct.pack(">IIBBBBB", 7, 10, bits, colour, 0, 0, 0)
        packed = zlib.compress(body)
        png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", packed[:9]) + chunk(b"IDAT", packed[9:]) + chunk(b"IEND", b"")
        assert (readers.png_samples(png) == (a[..., 0] if channels == 1 else a)).all()
    for bad in (b"GIF", png[:8] + chunk(b"IHDR", struct.pack(">IIBBBBB", 7, 10, 8, 3, 0, 0, 0)) + chunk(b"IEND", b"")):
        with pytest.raises(ValueError):
            readers.png_samples(bad)
    depth = np.array([[0, 256], [512, 65535]])
    (tmp_path / "000004.png").write_bytes(writers.png16(depth))
    r = readers.depth_images(spark, str(tmp_path)).first()
    assert (r["idx"], r["h"], r["w"]) == (4, 2, 2) and r["values"][:3] == [None, 1.0, 2.0] and abs(r["values"][3] - 65535 / 256) < 1e-3


def test_annotations(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<annotation><filename>a.jpg</filename><object><name>cat</name><difficult>1</difficult><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>3</xmax><ymax>4</ymax></bndbox></object><object><name>dog</name><bndbox><xmin>5</xmin><ymin>6</ymin><xmax>7</xmax><ymax>8</ymax></bndbox></object></annotation>")
    (tmp_path / "b.xml").write_text("<annotation><filename>b.jpg</filename></annotation>")
    assert [(r["name"], r["place"], r["x1"], r["y2"]) for r in readers.annotations(spark, str(tmp_path)).collect()] == [("dog", 1, 5.0, 8.0)]
    assert sorted((r["name"], r["difficult"]) for r in readers.annotations(spark, str(tmp_path), difficult=True).collect()) == [("cat", True), ("dog", False)]


@pytest.mark.parametrize("axis", [(0, 0, 1), (0, 0, -1), (0, 1, 0), (-1, 0, 0), (0.6, 0, 0.8)])
def test_directions_across_an_axis(spark, axis):
    at = lambda p: vec.vec3(*[F.lit(float(x)) for x in p])
    for point in (axis, (0.48, 0.6, 0.64)):
        r = spark.range(1).select(arcball.constrained(at(point), at(axis)).alias("v")).first()["v"]
        v = np.array([r["x"], r["y"], r["z"]])
        assert abs(np.linalg.norm(v) - 1) < 1e-9 and abs(v @ axis) < 1e-9 and v[2] >= -1e-12
    best = arcball.nearest_axis(at((0.1, 0.2, 0.97)), [at(axis), at((1, 0, 0)), at((0, 1, 0))])
    assert spark.range(1).select(best.alias("i")).first()["i"] in (0, 1, 2)


def test_powersets(spark):
    subsets = lambda n: spark.range(1).select(sequence.powerset(F.sequence(F.lit(1), F.lit(n))).alias("p")).first()["p"]
    assert subsets(4) == [list(c) for k in range(5) for c in itertools.combinations(range(1, 5), k)]
    with pytest.raises(Exception, match="more than 20"):
        subsets(21)


def test_hulls_of_parts(spark, monkeypatch):
    monkeypatch.setattr(boxes, "_HELD", 50)
    rng = np.random.default_rng(0)
    xy = np.round(rng.normal(size=(4000, 2)) * 20)
    df = spark.createDataFrame([(int(i % 2) if i % 5 else None, *map(float, p)) for i, p in enumerate(xy)] + [(1, float("nan"), 1.0), (1, None, 2.0), (9, 3.0, 3.0)], "g int, x double, y double").repartition(7)
    got = boxes.convex_hull(df, ["g"]).toPandas()
    for g in (0, 1, None):
        mine = xy[[i for i in range(len(xy)) if (i % 2 if i % 5 else None) == g]]
        want = mine[boxes.hull_order(mine)]
        here = got[got["g"].isna() if g is None else got["g"] == g].sort_values("pos")[["x", "y"]].to_numpy()
        assert (here == want).all()
    assert got[got["g"] == 9][["x", "y"]].values.tolist() == [[3.0, 3.0]]


def test_ranks_of_arrays(spark):
    names = [f"img{i}.png" if i % 2 else f"IMG{i:04d}.png" for i in range(500)]
    df = spark.createDataFrame([(n,) for n in names], "n string").orderBy(F.rand(1)).withColumn("k", text.natural_key(F.col("n")))
    ranked = sequence.rank_all(df, ["k"])
    assert {r["n"]: r["idx"] for r in ranked.collect()} == {n: i for i, n in enumerate(names)}
    windows = [line for line in ranked._jdf.queryExecution().executedPlan().toString().split("\n") if "Window [" in line and "row_number" in line]
    assert windows and all("_part" in line for line in windows)


def test_assignment():
    iou = np.array([[0.5, 0.9, 0.5], [0.9, 0.9, 0.0], [0.5, 0.5, 0.2]])
    assert boxtracks.assign(iou, 0.3) == [(0, 1), (1, 0)]  # ties: smaller row, then column
    assert boxtracks.assign(iou, 0.1) == [(0, 1), (1, 0), (2, 2)]
    live, got = boxtracks.step(boxtracks.Live(), np.array([[5, 5, 9, 9], [0, 0, 4, 4.0]]), 0.3, 1)
    assert got[["track_id", "x1", "event"]].values.tolist() == [[0, 0, "born"], [1, 5, "born"]]
    live, got = boxtracks.step(live, np.array([[0.5, 0, 4.5, 4]]), 0.3, 1)
    assert got[["track_id", "x1", "missed", "event"]].values.tolist() == [[0, 0.5, 0, "matched"], [1, 5, 1, "missed"]]
    live, got = boxtracks.step(live, np.empty((0, 4)), 0.3, 1)
    assert got[["track_id", "event"]].values.tolist() == [[0, "missed"], [1, "died"]]
    live, got = boxtracks.step(live, np.array([[0, 0, 0, 0], [0.5, 0, 4.5, 4]]), 0.3, 1)  # an empty box overlaps nothing
    assert sorted(got[["track_id", "event"]].values.tolist()) == [[0, "matched"], [2, "born"]] and live.next_id == 3


def test_collections(spark, tmp_path):
    """Resets, tombstones, messages that come late after a compaction, and compactions that a reader outlives."""
    store = Collections(spark, str(tmp_path / "s"), T.StructType([T.StructField("v", T.StringType())]))
    put = lambda *rows: store.append(spark.createDataFrame([(*r, None, None)[:7] for r in rows], "channel string, seq bigint, id bigint, v string, reset boolean, deleted boolean, pos bigint"))
    have = lambda **k: {(r["channel"], r["id"]): r["v"] for r in store.elements(**k).collect()}
    assert have() == {}
    put(("a", 1, 1, "x", False, False), ("a", 1, 2, "y", False, False), ("b", 2, 1, "z", False, False))
    put(("a", 5, 1, "new", True, False))
    assert have() == {("a", 1): "new", ("b", 1): "z"} and have(upto=4) == {("a", 1): "x", ("a", 2): "y", ("b", 1): "z"}
    before = store.elements()
    store.compact()
    put(("a", 3, 7, "late", False, False), ("a", 6, 3, "w", False, False), ("a", 7, 1, None, False, True))
    assert have() == {("a", 3): "w", ("b", 1): "z"}  # what is older than a reset stays out
    assert before.count() == 2
    store.compact()
    put(("a", 6, 1, "before the tombstone", False, False), (None, 9, None, None, True, False), ("b", 10, 4, "after", False, False), ("b", 10, 4, "in one message the last", False, False, 1))
    assert have() == {("b", 4): "in one message the last"}
    store.compact()
    store.compact()
    assert have() == {("b", 4): "in one message the last"}
    with pytest.raises(ValueError):
        Collections(spark, str(tmp_path / "t"), T.StructType([T.StructField("id", T.StringType())]))


def test_attached(spark):
    pose = "struct<q: struct<x: double, y: double, z: double, w: double>, t: struct<x: double, y: double, z: double>>"
    at = lambda x: ((0.0, 0.0, 0.0, 1.0), (x, 0.0, 0.0))
    poses = spark.createDataFrame([("poses", 1, "cam", at(1.0)), ("poses", 2, "nowhere", at(2.0))], f"channel string, id bigint, frame string, pose {pose}")
    frames = spark.createDataFrame([("cam", at(10.0))], f"name string, pose {pose}")
    clouds = spark.createDataFrame([(1, "poses", 1), (2, "poses", 2), (3, "poses", 9), (4, None, 1)], "k int, frame string, element_id bigint")
    got = {r["k"]: r["world"] and r["world"]["t"]["x"] for r in attached(clouds, poses, frames).collect()}
    assert got == {1: 11.0, 2: 2.0, 3: None, 4: None}


def test_best_overlaps_by_image_and_by_cells(spark, monkeypatch):
    """Whole images, cells, and both at once give the same; boxes without partners and images on one side only count too."""
    rng = np.random.default_rng(0)
    rows = []
    for k in range(900):
        x, y, w, h = rng.integers(0, 80, 4)
        rows.append((int(min(k % 7, 4)) if k % 31 else None, k, float(x), float(y), float(x + w), float(y + h)))
    every = spark.createDataFrame(rows, "i int, id int, x1 double, y1 double, x2 double, y2 double")
    truth, test = every.where("id % 2 = 0"), every.where("id % 2 = 1 AND (i IS NULL OR i <> 3)")
    get = lambda: {(r["i"], r["id"]): round(r["iou"], 12) for r in boxes.best_iou(truth, test, ["i"], "id", cell=16.0).collect()}
    whole = get()
    monkeypatch.setattr(boxes, "CROWDED", 100)
    both = get()
    monkeypatch.setattr(boxes, "CROWDED", 0)
    cells = get()
    assert whole == both == cells and len(whole) == 450 and any(v > 0.5 for v in whole.values()) and all(v == 0 for (i, _), v in whole.items() if i in (3, None))


def test_images_side_by_side(spark):
    """Pixels of two images of a row, under a mask, at every second place; odd rows are left out or told."""
    from orrery.operators import imaging

    image = "struct<h: int, w: int, c: int, data: binary>"
    enc = lambda a: tuple(imaging.encode(np.asarray(a, np.uint8)).values())
    rng = np.random.default_rng(0)
    a, b, m = rng.integers(0, 255, (5, 7)), rng.integers(0, 255, (5, 7, 3)), rng.integers(0, 2, (5, 7))
    df = spark.createDataFrame([(1, enc(a), enc(b), enc(m)), (2, enc(b), enc(a), enc(m * 0)), (3, enc(a), None, enc(m)), (None, enc(m), enc(m), enc(m))], f"k int, a {image}, b {image}, m {image}")
    got = [tuple(r) for r in imaging.side_by_side(df, ["k"], ["a", "b"], where="m").collect()]
    want = [(1, x, y, float(a[y, x]), float(b[y, x, 0])) for y in range(5) for x in range(7) if m[y, x]] + [(None, x, y, 1.0, 1.0) for y in range(5) for x in range(7) if m[y, x]]
    assert sorted(got, key=str) == sorted(want, key=str)
    few = imaging.side_by_side(df, ["k"], ["a"], step=2).where("k = 1").collect()
    assert {(r["x"], r["y"]): r["a"] for r in few} == {(x, y): float(a[y, x]) for y in range(0, 5, 2) for x in range(0, 7, 2)}
    assert imaging.side_by_side(df.limit(0), ["k"], ["a"]).count() == 0
    with pytest.raises(Exception, match="different sizes"):
        imaging.side_by_side(spark.createDataFrame([(enc(a), enc(a[:2]))], f"a {image}, b {image}"), [], ["a", "b"]).collect()


def test_running_products(spark):
    df = spark.createDataFrame([(1, 3.0), (2, -2.0), (3, None), (4, 0.5), (5, 0.0), (6, 7.0)], "i int, v double")
    assert [r["acc"] for r in sequence.accumulate(df, [], ["i"], "v", "product").orderBy("i").collect()] == [3.0, -6.0, -6.0, -3.0, 0.0, 0.0]
