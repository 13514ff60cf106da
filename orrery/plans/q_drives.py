"""Queries of recordings and stores on disk: given rows are written in each layout, and read back by its reader."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery import shared
from orrery.functions import camera as C
from orrery.functions import pose as P
from orrery.functions import quat, vec
from orrery.plans.fixtures import r, rs, table
from orrery.plans.registry import query
from orrery.sources import datasets, frames, readers, writers
from orrery.sources.nested import NestedStore
from orrery.sources.tables import ColumnStore

_first = lambda t: t.column("content")[0].as_py()


def _put(rows, folder: str, template: str, content, idx="s_suppkey") -> None:
    """A file a row."""
    frames.write(rows.select(F.col(idx).cast("bigint").alias("idx"), content.cast("binary").alias("content")), folder, "idx", _first, template).count()


@F.pandas_udf(T.BinaryType())
def _png(level: pd.Series) -> pd.Series:
    return pd.Series([writers.png(np.full((2, 3, 3), v, np.uint8)) for v in level])


@F.pandas_udf(T.BinaryType())
def _png16(level: pd.Series) -> pd.Series:
    """A 3x4 image of rising values that begins with an unknown one."""
    return pd.Series([writers.png16(np.concatenate([[0], v + 256 * np.arange(11)]).reshape(3, 4)) for v in level])


def _name(c: str):
    return F.regexp_extract(c, "([^/]+/[^/]+)$", 1)


def _suppliers(spark, sf):
    return table(spark, sf, "supplier")


def _odometry(spark, sf) -> str:
    """Images of all suppliers in two folders, scans of nine in ten, poses a line each."""
    root, s = shared.fresh(spark, "odometry"), _suppliers(spark, sf)
    level = (F.col("s_suppkey") % 200).cast("int")
    for side in (0, 1):
        _put(s, f"{root}/sequences/03/image_{side}", "%06d.png", _png(level + side))
    points = F.unhex(F.lit("0000803F000000400000404000008040"))  # 1, 2, 3, 4
    _put(s.where("s_suppkey % 10 <> 9"), f"{root}/sequences/03/velodyne", "%06d.bin", F.unhex(F.repeat(F.hex(points), (F.col("s_suppkey") % 5 + 1).cast("int"))))
    pose = P.pose(quat.identity(), vec.vec3(F.col("s_acctbal"), F.col("s_nationkey").cast("double"), F.lit(0.5)))
    writers.write_poses(s.select("s_suppkey", pose.alias("pose")).coalesce(1), f"{root}/poses/03.txt", "s_suppkey")
    return root


_IMG = "printf('image_%d/%06d.png', {0}, s_suppkey)"


@query("drive_frames", f"SELECT s_suppkey AS idx, {_IMG.format(0)} AS left_image, {_IMG.format(1)} AS right_image, printf('velodyne/%06d.bin', s_suppkey) AS lidar, {rs('s_acctbal', 4)} AS tx, {rs('s_nationkey', 4)} AS ty FROM supplier WHERE s_suppkey % 10 <> 9")
def drive_frames(spark, sf):
    """Frames of a numbered sequence: where images, scans and poses all are."""
    got = datasets.Drive.odometry(spark, _odometry(spark, sf), "03").frames()
    return got.select("idx", _name("left").alias("left_image"), _name("right").alias("right_image"), _name("lidar").alias("lidar"), r(F.col("pose.t.x"), 4).alias("tx"), r(F.col("pose.t.y"), 4).alias("ty"))


@query("drive_truth_frames", f"SELECT s_suppkey AS idx, {_IMG.format(0)} AS left_image, {rs('s_acctbal', 4)} AS tx FROM supplier WHERE s_suppkey >= 3")
def drive_truth_frames(spark, sf):
    """Images with poses, whether or not there are scans, from the third on."""
    got = datasets.Drive.odometry(spark, _odometry(spark, sf), "03", start=3).truth_frames()
    return got.where("lidar IS NULL").select("idx", _name("left").alias("left_image"), r(F.col("pose.t.x"), 4).alias("tx"))


@query("drive_points", "SELECT s_suppkey AS idx, CAST(s_suppkey % 5 + 1 AS BIGINT) AS n, CAST(4 * (s_suppkey % 5 + 1) AS DOUBLE) AS reflectance FROM supplier WHERE s_suppkey % 10 <> 9")
def drive_points(spark, sf):
    got = datasets.Drive.odometry(spark, _odometry(spark, sf), "03").points()
    return got.groupBy("idx").agg(F.count("*").alias("n"), F.sum("reflectance").alias("reflectance"))


@query("drive_images", "SELECT s_suppkey AS idx, 2 AS h, 3 AS w, CAST(s_suppkey % 200 + 1 AS INT) AS level FROM supplier")
def drive_images(spark, sf):
    """The right images, decoded."""
    got = datasets.Drive.odometry(spark, _odometry(spark, sf), "03").images("right")
    return got.select("idx", F.col("image.h").alias("h"), F.col("image.w").alias("w"), F.conv(F.hex(F.substring("image.data", 18, 1)), 16, 10).cast("int").alias("level"))


_EARTH = f"({P.EARTH!r}::DOUBLE)"
_PACKETS = f"""k AS (SELECT s_suppkey AS idx, 49 + s_suppkey / 10000.0::DOUBLE AS lat, 8.4::DOUBLE + s_suppkey / 5000.0::DOUBLE AS lon, 100 + s_suppkey % 7 AS alt, s_suppkey / 100.0::DOUBLE AS yaw, s_acctbal AS vn FROM supplier),
m AS (SELECT *, cos(radians(49)) * lon * {math.pi!r}::DOUBLE * {_EARTH} / 180 AS tx, cos(radians(49)) * {_EARTH} * ln(tan((90 + lat) * {math.pi!r}::DOUBLE / 360)) AS ty FROM k)"""


def _raw(spark, sf) -> datasets.Drive:
    root, s = shared.fresh(spark, "raw"), _suppliers(spark, sf)
    _put(s, f"{root}/image_00/data", "%010d.png", F.lit("x"))
    k = F.col("s_suppkey")
    line = F.concat_ws(" ", *[c.cast("string") for c in (49 + k / 10000.0, F.lit(8.4) + k / 5000.0, 100 + k % 7, F.lit(0.0), F.lit(0.0), k / 100.0, F.col("s_acctbal"))])
    _put(s, f"{root}/oxts/data", "%010d.txt", line)
    spark.createDataFrame([(f"{n}: field",) for n in ("lat", "lon", "alt", "roll", "pitch", "yaw", "vn")], "value string").coalesce(1).write.text(f"{root}/oxts/dataformat.txt")
    return datasets.Drive(spark, root, "raw")


@query("drive_packets", f"WITH {_PACKETS} SELECT idx, {rs('vn', 4)} AS vn, {rs('tx', 3)} AS tx, {rs('ty', 3)} AS ty, {rs('tx - (SELECT tx FROM m WHERE idx = 0)', 3)} AS rx, {rs('ty - (SELECT ty FROM m WHERE idx = 0)', 3)} AS ry FROM m")
def drive_packets(spark, sf):
    """Inertial packets as poses in metres, and as seen from the first."""
    got = _raw(spark, sf).packets()
    return got.select("idx", r(F.col("vn"), 4).alias("vn"), *[r(F.col(f"{p}.t.{k}"), 3).alias(f"{n}{k}") for p, n in (("pose", "t"), ("rel", "r")) for k in "xy"])


@query("drive_raw_frames", f"WITH {_PACKETS} SELECT idx, printf('data/%010d.png', idx) AS left_image, {rs('tx - (SELECT tx FROM m WHERE idx = 0)', 3)} AS tx FROM m")
def drive_raw_frames(spark, sf):
    """Images with poses from packets; other streams are absent."""
    whole = _raw(spark, sf).frames().where("right IS NULL AND lidar IS NULL")
    return whole.select("idx", _name("left").alias("left_image"), r(F.col("pose.t.x"), 3).alias("tx"))


@query("drive_pairs", "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS BIGINT) AS idx, 'shot' || s_suppkey || '-left.pnm' AS left_image, 'shot' || s_suppkey || '-right.pnm' AS right_image FROM supplier")
def drive_pairs(spark, sf):
    """Image pairs told by the natural order of their names."""
    root, s = shared.fresh(spark, "pairs"), _suppliers(spark, sf)
    for side in ("left", "right"):
        _put(s, root, f"shot%d-{side}.pnm", F.lit("x"))
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return datasets.Drive(spark, root, "pairs").stereo().select("idx", base("left").alias("left_image"), base("right").alias("right_image"))


@query("drive_urban", f"SELECT s_suppkey AS idx, printf('img/%d_0.png', s_suppkey) AS left_image, CASE WHEN true THEN printf('depth/%d.png', s_suppkey) END AS depth, CAST(NULL AS VARCHAR) AS mask, {rs('s_acctbal - (SELECT s_acctbal FROM supplier WHERE s_suppkey = 0)', 4)} AS tx FROM supplier")
def drive_urban(spark, sf):
    """Stamped poses as seen from the first, with images and depth; masks are absent."""
    root, s = shared.fresh(spark, "urban"), _suppliers(spark, sf)
    _put(s, f"{root}/data/img", "%d_0.png", F.lit("x"))
    _put(s, f"{root}/data/depth", "%d.png", _png16((F.col("s_suppkey") % 90).cast("int")))
    s.select(F.concat_ws(" ", F.col("s_suppkey").cast("string"), F.col("s_acctbal").cast("string"), F.lit("0 0 0 0 0 1")).alias("value")).coalesce(1).write.text(f"{root}/info/groundtruth.txt")
    got = datasets.Drive(spark, root, "urban").measured_frames()
    return got.select("idx", _name("left").alias("left_image"), _name("depth").alias("depth"), "mask", r(F.col("pose.t.x"), 4).alias("tx"))


@query("drive_disparity_truth", f"SELECT s_suppkey AS idx, CAST(CASE WHEN s_suppkey % 90 = 0 THEN 10 ELSE 11 END AS BIGINT) AS known, {rs('CAST((s_suppkey % 90 + 256) / 256.0::DOUBLE AS FLOAT)', 5)} AS disparity, {rs('700 + s_suppkey', 3)} AS fx, {rs('s_suppkey % 50 + 0.5', 3)} AS baseline_px FROM supplier")
def drive_disparity_truth(spark, sf):
    """Image pairs with true disparities of 16 bits and each frame's own calibration."""
    root, s = shared.fresh(spark, "truth"), _suppliers(spark, sf)
    for folder, content in (("image_0", F.lit("x")), ("image_1", F.lit("x")), ("disp_noc", _png16((F.col("s_suppkey") % 90).cast("int")))):
        _put(s, f"{root}/{folder}", "%06d_10.png", content)
    k = F.col("s_suppkey").cast("string")
    fx = F.concat(F.lit("P0: "), (700 + F.col("s_suppkey")).cast("string"), F.lit(" 0 600 0 0 700 180 0 0 0 1 0\nP1: "), k, F.lit(" 0 600 -"), (F.col("s_suppkey") % 50 + 0.5).cast("string"), F.lit(" 0 700 180 0 0 0 1 0\n"))
    _put(s, f"{root}/calib", "%06d.txt", fx)
    got = datasets.Drive(spark, root, "stereo_truth").truth_stereo()
    return got.select("idx", F.size(F.filter("values", lambda v: v.isNotNull())).cast("bigint").alias("known"), r(F.col("values")[2], 5).alias("disparity"), r(F.col("fx"), 3).alias("fx"), r(F.col("baseline_px"), 3).alias("baseline_px"))


@query("drive_records", "SELECT s_suppkey AS idx, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier")
def drive_records(spark, sf):
    """Key-value files beside rendered images."""
    root, s = shared.fresh(spark, "synthetic"), _suppliers(spark, sf)
    _put(s, root, "scene_%04d.png", F.lit("x"))
    _put(s, root, "scene_%04d.txt", F.concat(F.lit("name = "), F.col("s_name"), F.lit(";\nnation = "), F.col("s_nationkey").cast("string"), F.lit(";\n")))
    got = datasets.Drive(spark, root, "synthetic").frames()
    return got.select("idx", F.col("record")["name"].alias("name"), F.col("record")["nation"].alias("nation"))


@query("annotations_without_difficult", "SELECT s_name || '.jpg' AS image, CAST(k AS BIGINT) AS place, 'n' || s_nationkey AS name, false AS difficult, CAST(k AS DOUBLE) AS x1, CAST(s_suppkey AS DOUBLE) AS y1, CAST(k + 10 AS DOUBLE) AS x2, CAST(s_suppkey + 20 AS DOUBLE) AS y2 FROM supplier, range(3) t(k) WHERE (s_suppkey + k) % 4 <> 0")
def annotations_without_difficult(spark, sf):
    """Boxes of XML annotations, those marked difficult left out."""
    root, s = shared.fresh(spark, "xml"), _suppliers(spark, sf)
    k = F.col("s_suppkey")
    one = lambda i: F.format_string("<object><name>n%s</name><difficult>%s</difficult><bndbox><xmin>%s</xmin><ymin>%s</ymin><xmax>%s</xmax><ymax>%s</ymax></bndbox></object>", F.col("s_nationkey"), ((k + i) % 4 == 0).cast("int"), F.lit(i), k, F.lit(i + 10), k + 20)
    _put(s, root, "%06d.xml", F.concat(F.lit("<annotation><filename>"), F.col("s_name"), F.lit(".jpg</filename>"), one(0), one(1), one(2), F.lit("</annotation>")))
    return readers.annotations(spark, root)


# stores


def _store(spark, sf) -> ColumnStore:
    """Values of events in two appends, and every second event's user."""
    store, e = ColumnStore(spark, shared.fresh(spark, "columns"), "w"), table(spark, sf, "events")
    half = e.agg(F.max("event_id")).first()[0] // 2
    store.extend("value", e.where(F.col("event_id") <= half), ["event_id"], "value")
    store.extend("value", e.where(F.col("event_id") > half), ["event_id"], "value")
    store.extend("user", e.where("event_id % 2 = 0"), ["event_id"], "user_id")
    return store


@query("store_stride", "SELECT event_id AS idx, value FROM events WHERE event_id % 3 = 0")
def store_stride(spark, sf):
    return _store(spark, sf).values("value", every=3)


@query("store_rows_of_keys", "SELECT e.event_id AS idx, e.value AS value, u.user_id AS user FROM events e JOIN (SELECT user_id, row_number() OVER (ORDER BY event_id) - 1 AS idx FROM events WHERE event_id % 2 = 0) u ON u.idx = e.event_id")
def store_rows_of_keys(spark, sf):
    """Two keys side by side, as far as the shorter goes."""
    return _store(spark, sf).rows(["value", "user"])


@query("store_chunks", f"SELECT event_id // 16 AS chunk, count(*) AS n, {rs('sum(value)', 4)} AS total, first(value ORDER BY event_id) AS head FROM events GROUP BY ALL")
def store_chunks(spark, sf):
    got = _store(spark, sf).chunks("value", 16)
    return got.select("chunk", F.size("items").cast("bigint").alias("n"), r(F.aggregate("items", F.lit(0.0), lambda a, v: a + v), 4).alias("total"), F.col("items")[0].alias("head"))


@query("nested_store_table", "SELECT n_nationkey, n_name, n_regionkey FROM nation")
def nested_store_table(spark, sf):
    """A table inside groups, written and read by its path."""
    store = NestedStore(spark, shared.fresh(spark, "nested"))
    store.write({"world": {"notes": [1, "x"], "deep": {"nations": table(spark, sf, "nation")}}})
    return store.node("world/deep/nations").select("n_nationkey", "n_name", "n_regionkey")


@query("nested_store_array", f"SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS BIGINT) AS i, {rs('n_regionkey * 0.5')} AS v FROM nation")
def nested_store_array(spark, sf):
    """A numeric array keeps its values and shape."""
    store = NestedStore(spark, shared.fresh(spark, "nested"))
    values = np.array([x[0] * 0.5 for x in table(spark, sf, "nation").orderBy("n_nationkey").select("n_regionkey").collect()])  # 25 nations
    store.write({"a": values.reshape(5, -1)})
    return spark.createDataFrame(list(enumerate(store.node("a").ravel().tolist())), "i bigint, v double").select("i", r(F.col("v")).alias("v"))


@query("json_dictionaries", "SELECT p_partkey, p_name, [p_size * 1.0::DOUBLE, p_retailprice][1] AS size FROM part")
def json_dictionaries(spark, sf):
    folder = shared.fresh(spark, "json") + "/d"
    writers.write_json(table(spark, sf, "part").select("p_partkey", "p_name", F.array(F.col("p_size").cast("double"), F.col("p_retailprice")).alias("v")), folder, sort_keys=True)
    return readers.json_dict(spark, folder).select("p_partkey", "p_name", F.col("v")[0].alias("size"))


@query("yaml_dictionaries", "SELECT n_nationkey, n_name || ': #1' AS label, n_regionkey FROM nation")
def yaml_dictionaries(spark, sf):
    folder = shared.fresh(spark, "yaml") + "/d"
    writers.write_yaml(table(spark, sf, "nation").select("n_nationkey", F.concat("n_name", F.lit(": #1")).alias("label"), "n_regionkey"), folder)
    return readers.yaml_dict(spark, folder).select("n_nationkey", "label", "n_regionkey")


@query("config_sections", "SELECT s_name AS section, 'limits' AS key, '[' || s_nationkey || ', 2]' AS value FROM supplier UNION ALL SELECT s_name, 'url', 'http://h/?a=b:c' FROM supplier UNION ALL SELECT s_name, 'shared', 'yes' FROM supplier")
def config_sections(spark, sf):
    """A settings file for each supplier, with brackets, colons and equals signs in values and a shared section."""
    root, s = shared.fresh(spark, "config"), _suppliers(spark, sf)
    _put(s, root, "%06d.ini", F.concat(F.lit("["), F.col("s_name"), F.lit("]\nlimits = ["), F.col("s_nationkey").cast("string"), F.lit(", 2]\n# x = 1\nURL: http://h/?a=b:c\n")))
    frames.write(s.where("s_suppkey = 0").select(F.lit(999999).cast("bigint").alias("idx"), F.lit("[DEFAULT]\nshared = yes\n").cast("binary").alias("content")), root, "idx", _first, "%06d.ini").count()
    return readers.config(spark, root)


@query("cameras_on_disk", f"SELECT s_name AS name, {rs('500 + s_suppkey')} AS fx, 480 AS h, {rs('s_acctbal', 4)} AS tx FROM supplier")
def cameras_on_disk(spark, sf):
    folder = shared.fresh(spark, "cameras") + "/c"
    k = C.intrinsic((500 + F.col("s_suppkey")).cast("double"), F.lit(500.0), F.lit(320.0), F.lit(240.0), h=480, w=640)
    pose = P.pose(quat.identity(), vec.vec3(F.col("s_acctbal"), F.lit(0.0), F.lit(0.0)))
    writers.write_cameras(_suppliers(spark, sf).select("s_name", F.struct(k.alias("intrinsic"), pose.alias("pose")).alias("camera")), folder, "s_name")
    return readers.cameras(spark, folder).select("name", r(F.col("intrinsic.fx")).alias("fx"), F.col("intrinsic.h").alias("h"), r(F.col("pose.t.x"), 4).alias("tx"))


@query("image_sequence", "SELECT s_suppkey AS idx, CAST(s_suppkey % 200 AS INT) AS level FROM supplier")
def image_sequence(spark, sf):
    """Images written as a numbered sequence and read by the image reader."""
    root, s = shared.fresh(spark, "sequence"), _suppliers(spark, sf)
    level = F.lpad(F.hex((F.col("s_suppkey") % 200).cast("int")), 2, "0")
    image = F.struct(F.lit(4).alias("h"), F.lit(5).alias("w"), F.lit(1).alias("c"), F.unhex(F.repeat(level, 20)).alias("data"))
    encoded = writers.encode_frames(s.select("s_suppkey", image.alias("image")), "s_suppkey")
    frames.write(encoded.select(F.regexp_extract("name", r"(\d+)", 1).cast("bigint").alias("idx"), "content"), root, "idx", _first, "imgs-%06d.png").count()
    got = readers.frame_index(readers.images(spark, root)).where("image.h = 4 AND image.w = 5")
    return got.select("idx", F.conv(F.hex(F.substring("image.data", 20, 1)), 16, 10).cast("int").alias("level"))


@query("files_by_folder", "SELECT 'f' || s_suppkey % 3 AS folder, count(*) AS n, 'shot' || min(s_suppkey) || '.txt' AS head, 'shot' || max(s_suppkey) || '.txt' AS last FROM supplier GROUP BY ALL")
def files_by_folder(spark, sf):
    """Files of each folder in natural order."""
    root, s = shared.fresh(spark, "folders"), _suppliers(spark, sf)
    for k in range(3):
        _put(s.where(F.col("s_suppkey") % 3 == k), f"{root}/f{k}", "shot%d.txt", F.lit("x"))
    got = readers.by_directory(readers.files(spark, root, "*.txt"), ["f0", "f1", "f2"])
    base = lambda c: F.regexp_extract(c, "([^/]+)$", 1)
    return got.select(base("dir").alias("folder"), F.size("files").cast("bigint").alias("n"), base(F.col("files")[0]).alias("head"), base(F.element_at("files", -1)).alias("last"))
