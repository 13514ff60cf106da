"""Readers of pose texts, lidar frames, packets, key-value records, calibrations, images, dictionaries and file lists.

All go through Spark's own sources, so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from orrery import shared
from orrery.functions import pose as P
from orrery.functions import text


def load(reader: DataFrameReader, path: str) -> DataFrame:
    """reader.load(path). Names of one flat folder are matched by a filter: Spark lists each match of a glob in a task of its own."""
    head, _, last = path.rpartition("/")
    if head and re.search(r"[*?\[{]", last) and not re.search(r"[*?\[{\\]", head):
        spark = reader._spark
        at, fs = shared._hadoop(spark, head)
        if fs.exists(at) and fs.getContentSummary(at).getDirectoryCount() == 1 and len(fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(path)) or ()):
            return reader.option("pathGlobFilter", last).load(head)
    return reader.load(path)


def _whole(spark: SparkSession, path: str) -> DataFrame:
    return load(spark.read.format("text").option("wholetext", True), path)


def files(spark: SparkSession, directory: str, pattern: str = "*.png", recursive: bool = True) -> DataFrame:
    """(path, length) of files that match a pattern; contents aren't read."""
    src = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    return src.load(directory).select("path", "length")


def by_directory(listing: DataFrame, expected: Sequence[str] = ()) -> DataFrame:
    """(dir, files): paths in natural order for each directory, or for the expected ones only."""
    d = listing.withColumn("dir", F.regexp_replace("path", "/[^/]*$", ""))
    if expected:
        d = d.where(F.regexp_extract("dir", "([^/]*)$", 1).isin(list(expected)))
    rows = F.array_sort(F.collect_list(F.struct(text.natural_key(F.col("path")).alias("k"), "path")))
    return d.groupBy("dir").agg(rows.alias("r")).select("dir", F.transform("r", lambda r: r["path"]).alias("files"))


def count_files(listing: DataFrame, contains: str = "") -> DataFrame:
    return listing.agg(F.count_if(F.regexp_extract("path", "([^/]*)$", 1).contains(contains)).alias("n"))


def frame_index(listing: DataFrame) -> DataFrame:
    """Adds idx, the last number in the file's name: what a printf template would count."""
    return listing.withColumn("idx", F.regexp_extract("path", r"([0-9]+)[^0-9/]*$", 1).try_cast("bigint"))


def key_tree(paths: DataFrame, column: str, value: str, depth: int) -> DataFrame:
    """Paths as levels lvl0.. and the first value of each, by order of the value."""
    parts = F.split(column, "/")
    lv = [F.get(parts, i).alias(f"lvl{i}") for i in range(depth)]
    return paths.select(*lv, value).groupBy(*[f"lvl{i}" for i in range(depth)]).agg(F.min(value).alias(value))


def poses(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pose) from lines of twelve numbers; idx counts the lines of a file. Other lines are errors at run time."""
    raw = _whole(spark, path).select(F.posexplode(F.filter(F.split("value", "\r?\n"), lambda x: F.trim(x) != "")).alias("idx", "line"))
    row = raw.withColumn("row", text.floats(F.col("line")))
    ok = F.when(F.size("row") == 12, F.col("row")).otherwise(F.raise_error(F.lit("a pose needs twelve numbers")).cast("array<double>"))
    return row.withColumn("row", ok).select(F.col("idx").cast("bigint").alias("idx"), P.from_row(F.col("row")).alias("pose"))


def stamped_poses(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pose) from lines `id tx ty tz qx qy qz qw`."""
    v = spark.read.text(path).select(text.floats(F.col("value")).alias("v")).where(F.size("v") == 8)
    return v.select(F.col("v")[0].cast("bigint").alias("idx"), P.from_vector(F.slice("v", 2, 7)).alias("pose"))


def packets(spark: SparkSession, path: str, field_file: str) -> DataFrame:
    """One whitespace row a file; field names are what stands before the colon in field_file. -> (idx, fields...)."""
    names = [r[0] for r in spark.read.text(field_file).select(F.trim(F.substring_index("value", ":", 1))).where("value LIKE '%:%'").collect()]
    raw = _whole(spark, path).select(F.col("_metadata.file_path").alias("path"), text.floats(F.col("value")).alias("v"))
    return frame_index(raw).select("idx", *[F.col("v")[i].alias(n) for i, n in enumerate(names)])


def lidar(spark: SparkSession, path: str) -> DataFrame:
    """(idx, pt_idx, x, y, z, reflectance) from files of little-endian float32 quadruples."""
    raw = frame_index(load(spark.read.format("binaryFile"), path)).select("idx", "content")

    schema = pa.schema([("idx", pa.int64()), ("pt_idx", pa.int64()), *[(n, pa.float64()) for n in ("x", "y", "z", "reflectance")]])

    def run(batches):
        for batch in batches:
            for idx, content in zip(batch.column(0), batch.column(1), strict=True):
                a = np.frombuffer(content.as_buffer(), "<f4", len(content.as_buffer()) // 16 * 4).reshape(-1, 4).T.astype(float)
                at = np.full(a.shape[1], idx.as_py()) if idx.is_valid else pa.nulls(a.shape[1], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(np.arange(a.shape[1])), *map(pa.array, a)], schema=schema)

    return raw.mapInArrow(run, "idx bigint, pt_idx bigint, x double, y double, z double, reflectance double")


def key_values(spark: SparkSession, path: str) -> DataFrame:
    """(path, values: map) of files of `name = value;` lines."""
    return _whole(spark, path).select(F.col("_metadata.file_path").alias("path"), text.key_values(F.col("value")).alias("values"))


def stereo_calibration(spark: SparkSession, path: str, left: str = "P0", right: str = "P1") -> DataFrame:
    """(path, fx, cx, cy, baseline_px) from lines `P0: twelve numbers`."""
    raw = _whole(spark, path).select(F.col("_metadata.file_path").alias("path"), "value")
    row = lambda n: text.floats(F.regexp_extract("value", rf"(?m)^{n}:\s*(.*)$", 1))
    got = raw.withColumn("l", row(left)).withColumn("r", row(right))
    return got.select("path", F.col("l")[0].alias("fx"), F.col("l")[2].alias("cx"), F.col("l")[6].alias("cy"), F.abs(F.col("r")[3]).alias("baseline_px"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """(path, image: h, w, c, data) decoded by Spark's image source: channels are blue, green, red."""
    got = load(spark.read.format("image").option("dropInvalid", True), path).select("image.*")
    return got.select(F.col("origin").alias("path"), F.struct(F.col("height").alias("h"), F.col("width").alias("w"), F.col("nChannels").alias("c"), "data").alias("image"))


def png_samples(data: bytes) -> np.ndarray:
    """The samples of a PNG of 8 or 16 bits without a palette or interlacing: (h, w), or (h, w, channels) in the file's order."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG")
    at, body, head = 8, b"", None
    while at < len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        head = struct.unpack(">IIBBBBB", part) if kind == b"IHDR" else head
        body += part if kind == b"IDAT" else b""
        at += size + 12
    w, h, bits, colour, _, _, laced = head
    if bits not in (8, 16) or colour not in (0, 2, 4, 6) or laced:
        raise ValueError(f"a PNG of {bits} bits, colour type {colour}, interlace {laced} is not read")
    channels, step = {0: 1, 2: 3, 4: 2, 6: 4}[colour], bits // 8
    pixel = channels * step
    raw = np.frombuffer(zlib.decompress(body), np.uint8).reshape(h, 1 + w * pixel)
    out = np.zeros((h + 1, w + 1, pixel), np.int64)  # a blank row above and a blank pixel before
    for y in range(h):
        kind, line = raw[y, 0], raw[y, 1:].reshape(w, pixel).astype(np.int64)
        if kind == 0:
            out[y + 1, 1:] = line
        elif kind == 1:
            out[y + 1, 1:] = np.cumsum(line, 0) & 255
        elif kind == 2:
            out[y + 1, 1:] = (line + out[y, 1:]) & 255
        else:
            for x in range(w):
                left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
                if kind == 3:
                    guess = (left + up) // 2
                else:
                    a, b, c = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                out[y + 1, x + 1] = (line[x] + guess) & 255
    samples = out[1:, 1:].astype(np.uint8).reshape(h, w, channels, step)
    values = samples.view(">u2")[..., 0] if step == 2 else samples[..., 0]
    return values[..., 0] if channels == 1 else values


def depth_images(spark: SparkSession, path: str, unit: float = 1 / 256) -> DataFrame:
    """(idx, path, h, w, values: array of float, rows first) of grey PNGs of 16 bits, in units; 0 is unknown and null. Disparity
    truth has 1/256 pixel, depth in millimetres 1/1000 metre."""
    raw = frame_index(load(spark.read.format("binaryFile"), path)).select("idx", "path", "content")
    schema = "idx bigint, path string, h int, w int, `values` array<float>"

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a = png_samples(row["content"])
                flat = pa.array((a * unit).astype(np.float32).ravel(), mask=(a == 0).ravel())
                lists = pa.ListArray.from_arrays(pa.array([0, a.size], pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array([row["idx"]], pa.int64()), pa.array([row["path"]]), pa.array([a.shape[0]], pa.int32()), pa.array([a.shape[1]], pa.int32()), lists], ["idx", "path", "h", "w", "values"])

    return raw.mapInArrow(run, schema)


def annotations(spark: SparkSession, path: str, difficult: bool = False) -> DataFrame:
    """(image, place, name, difficult, x1, y1, x2, y2) of XML annotation files, an `annotation` each with `object`s of a `bndbox`;
    place counts the objects of a file. Objects marked difficult are left out unless asked for."""
    box = "struct<xmin: double, ymin: double, xmax: double, ymax: double>"
    schema = f"filename string, object array<struct<name: string, difficult: int, bndbox: {box}>>"
    rows = spark.read.schema(schema).option("rowTag", "annotation").xml(path).select("filename", F.posexplode("object").alias("place", "o"))
    out = rows.select(F.col("filename").alias("image"), F.col("place").cast("bigint").alias("place"), "o.name", (F.coalesce(F.col("o.difficult"), F.lit(0)) != 0).alias("difficult"), *[F.col(f"o.bndbox.{a}").alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])
    return out if difficult else out.where("NOT difficult")


def disparity(pixels: DataFrame, column: str = "value") -> DataFrame:
    """Ground truth in 1/256 pixel as float."""
    return pixels.withColumn(column, (F.col(column) / 256).cast("float"))


def json_dict(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """One row a JSON object: an object a line, or (lines=False) one a file over any number of lines. None: by whether the first
    line is a whole object."""
    if lines is None:
        first = spark.read.text(path).where("length(trim(value)) > 0").first()
        try:
            lines = first is not None and isinstance(json.loads(first[0]), dict)
        except ValueError:
            lines = False
    return spark.read.option("multiLine", not lines).json(path)


def yaml_dict(spark: SparkSession, path: str) -> DataFrame:
    """One row a YAML document; read as plain data (no objects are built) and handed on as JSON. For settings: more than 1000
    files are an error."""
    import yaml

    whole = [r[0] for r in _whole(spark, path).limit(1001).collect()]
    if len(whole) > 1000:
        raise ValueError("more than 1000 YAML files: these are no settings")
    docs = [(json.dumps(d),) for t in whole for d in yaml.safe_load_all(t)]
    raw = spark.createDataFrame(docs, "value string")
    if not docs:
        return raw
    kind = spark.range(1).select(F.schema_of_json(F.lit("[" + ",".join(d for d, in docs) + "]"))).first()[0]
    row = kind.removeprefix("ARRAY<").removesuffix(">")
    return raw.select(F.from_json("value", row).alias("d")).select("d.*")


def config(spark: SparkSession, path: str, section: str | None = None) -> DataFrame:
    """(section, key, value) of files of `[section]` parts with `key = value` or `key: value` lines. Keys are lower-cased, comment
    lines start with # or ;, what stands under [DEFAULT] belongs to every section that doesn't say it itself."""
    split = F.split("value", r"(?m)^\[(?=[^\]\r\n]*\][ \t]*\r?$)")  # a section's line has nothing behind its bracket
    parts = _whole(spark, path).select(F.posexplode(split).alias("at", "part")).where("at > 0")
    body = F.expr("substr(part, instr(part, ']') + 1)")
    named = parts.select(F.substring_index("part", "]", 1).alias("section"), F.explode(F.split(body, "\r?\n")).alias("line"))
    lines = named.where(~F.ltrim("line").rlike("^[#;]") & F.col("line").rlike("[=:]"))
    pair = lambda k: F.trim(F.regexp_extract("line", r"^\s*([^=:]+?)\s*[=:]\s*(.*)$", k))
    rows = lines.select("section", F.lower(pair(1)).alias("key"), pair(2).alias("value"))
    own, common = rows.where("section <> 'DEFAULT'"), rows.where("section = 'DEFAULT'").select("key", "value")
    names = named.select("section").distinct().where("section <> 'DEFAULT'")
    shared = common.agg(F.collect_list(F.struct("key", "value")).alias("d"))  # one row: what one section says
    missing = names.join(shared).select("section", F.inline("d")).join(own.select("section", "key"), ["section", "key"], "left_anti").select("section", "key", "value")
    out = own.unionByName(missing)
    return out if section is None else out.where(F.col("section") == section)


def cameras(spark: SparkSession, path: str) -> DataFrame:
    """The cameras that writers.write_cameras wrote: name, and the intrinsic and pose of each."""
    from orrery.types import INTRINSIC, POSE

    return spark.read.schema(f"name string, intrinsic {INTRINSIC.simpleString()}, pose {POSE.simpleString()}").json(path)
