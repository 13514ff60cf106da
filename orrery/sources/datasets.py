"""Recorded drives as tables of frames: a folder of images, scans, packets and poses, zipped on the frame index.

A layout says where each stream's files lie below the folder. A stream whose files aren't there is absent: its columns are
null, and it doesn't shorten the others. Frames hold paths; pixels and points are read on demand by their own readers, so
listing a drive reads no contents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from orrery.functions import camera as C
from orrery.functions import text
from orrery.operators import sequence
from orrery.operators import poses as PO
from orrery.operators import zips
from orrery.sources import readers
from orrery.sources.calibration import stereo_calibrations


@dataclass(frozen=True)
class Layout:
    """Glob patterns below a drive's folder, None for a stream that the layout doesn't have. numbered: frames are told by the
    last number in the file name; otherwise by the names' natural order."""

    left: str | None = None
    right: str | None = None
    lidar: str | None = None
    packets: str | None = None
    packet_fields: str | None = None
    poses: str | None = None
    stamped_poses: str | None = None
    records: str | None = None
    intrinsics: str | None = None
    disparity: str | None = None
    depth: str | None = None
    masks: str | None = None
    rig: str | None = None
    numbered: bool = True


#: Folder structures of public recordings.
LAYOUTS = {
    "odometry": Layout(left="image_0/*.png", right="image_1/*.png", lidar="velodyne/*.bin"),
    "raw": Layout(left="image_00/data/*.png", right="image_01/data/*.png", lidar="velodyne_points/data/*.bin", packets="oxts/data/*.txt", packet_fields="oxts/dataformat.txt"),
    "omni": Layout(left="image_02/data/*.png", right="image_03/data/*.png", lidar="velodyne_points/data/*.bin", packets="oxts/data/*.txt", packet_fields="oxts/dataformat.txt"),
    "pairs": Layout(left="*-left.pnm", right="*-right.pnm", numbered=False),
    "stereo_truth": Layout(left="image_0/*_10.png", right="image_1/*_10.png", disparity="disp_noc/*_10.png", rig="calib/*.txt", numbered=False),
    "urban": Layout(left="data/img/*_0.png", depth="data/depth/*.png", masks="data/masks/*.png", stamped_poses="info/groundtruth.txt", intrinsics="info/intrinsics.txt", numbered=False),
    "synthetic": Layout(left="*.png", records="*.txt"),
}


class Drive:
    """One recording. start: the first frame's index; most: frames at most (a feature of the reader, None for all); scale: of
    images and calibration."""

    def __init__(self, spark: SparkSession, folder: str, layout: Layout | str, start: int = 0, most: int | None = None, scale: float = 1.0):
        self.spark, self.folder, self.start, self.most, self.scale = spark, folder.rstrip("/"), start, most, scale
        self.layout = LAYOUTS[layout] if isinstance(layout, str) else layout

    @classmethod
    def odometry(cls, spark: SparkSession, root: str, sequence: str, **how) -> Drive:
        """A numbered sequence below root/sequences, its poses in root/poses."""
        root = root.rstrip("/")
        layout = replace(LAYOUTS["odometry"], poses=f"{root}/poses/{sequence}.txt")
        return cls(spark, f"{root}/sequences/{sequence}", layout, **how)

    def _at(self, pattern: str) -> str:
        # Hadoop writes one slash or three after the scheme
        return pattern if re.match("[A-Za-z][A-Za-z0-9+.-]*:/|/", pattern) else f"{self.folder}/{pattern}"

    def _listed(self, pattern: str | None) -> DataFrame | None:
        """(idx, path), or None if nothing is there."""
        if pattern is None:
            return None
        try:
            found = readers.load(self.spark.read.format("binaryFile"), self._at(pattern)).select("path")
        except AnalysisException as e:
            if e.getCondition() and "PATH_NOT_FOUND" in e.getCondition():
                return None
            raise
        if self.layout.numbered:
            return self._kept(readers.frame_index(found).select("idx", "path"))
        named = found.withColumn("k", text.natural_key(F.col("path")))
        return self._kept(sequence.rank_all(named, ["k", "path"]).select("idx", "path"))

    def _kept(self, frames: DataFrame) -> DataFrame:
        out = frames.where(F.col("idx") >= self.start)
        return out if self.most is None else out.where(F.col("idx") < self.start + self.most)

    def _named(self, pattern: str | None, name: str) -> DataFrame | None:
        found = self._listed(pattern)
        return found.withColumnRenamed("path", name) if found is not None else None

    def packets(self) -> DataFrame | None:
        """(idx, fields..., pose, rel) of inertial packets: the pose in metres, and as seen from the first."""
        if self._listed(self.layout.packets) is None:
            return None
        rows = self._kept(readers.packets(self.spark, self._at(self.layout.packets), self._at(self.layout.packet_fields)))
        return PO.oxts(rows, [], "idx")

    def packet_fields(self) -> list[str]:
        """The packets' field names, in order."""
        return [r[0] for r in self.spark.read.text(self._at(self.layout.packet_fields)).select(F.trim(F.substring_index("value", ":", 1))).where("value LIKE '%:%'").collect()]

    def poses(self) -> DataFrame | None:
        """(idx, pose): from the pose file, the stamped poses as seen from the first, or the packets."""
        try:
            if self.layout.poses:
                return self._kept(readers.poses(self.spark, self._at(self.layout.poses)))
            if self.layout.stamped_poses:
                found = readers.stamped_poses(self.spark, self._at(self.layout.stamped_poses))
                return self._kept(PO.relative_to_first(found, [], "idx").select("idx", F.col("rel").alias("pose")))
        except AnalysisException as e:
            if e.getCondition() and "PATH_NOT_FOUND" in e.getCondition():
                return None
            raise
        found = self.packets()
        return found.select("idx", F.col("rel").alias("pose")) if found is not None else None

    def stereo(self) -> DataFrame:
        """(idx, left, right): paths, as far as both go."""
        sides = [d for d in (self._named(self.layout.left, "left"), self._named(self.layout.right, "right")) if d is not None]
        if not sides:
            raise FileNotFoundError(f"no images below {self.folder}")
        return zips.zip_streams(sides, ["idx"])

    def frames(self) -> DataFrame:
        """(idx, left, right, lidar, pose): a row where all streams that are there have one; nulls for absent streams."""
        streams = {"left": self._named(self.layout.left, "left"), "right": self._named(self.layout.right, "right"), "lidar": self._named(self.layout.lidar, "lidar"), "pose": self.poses()}
        if self.layout.records:
            streams["record"] = self.records()
        there = [d for d in streams.values() if d is not None]
        if not there:
            raise FileNotFoundError(f"nothing below {self.folder}")
        out = zips.zip_streams(there, ["idx"])
        kinds = {"pose": "struct<q:struct<x:double,y:double,z:double,w:double>,t:struct<x:double,y:double,z:double>>"}
        return reduce(lambda d, n: zips.absent(d, n, kinds.get(n, "string")), [n for n, d in streams.items() if d is None], out).select("idx", *streams)

    def truth_frames(self) -> DataFrame:
        """Images with poses, whether or not there are scans."""
        return Drive(self.spark, self.folder, replace(self.layout, lidar=None), self.start, self.most, self.scale).frames()

    def records(self) -> DataFrame | None:
        """(idx, record: map) of key-value files beside the images."""
        if self._listed(self.layout.records) is None:
            return None
        found = readers.key_values(self.spark, self._at(self.layout.records))
        return self._kept(readers.frame_index(found).select("idx", F.col("values").alias("record")))

    def _measured(self, pattern: str, unit: float) -> DataFrame:
        """(idx, h, w, values) of grey images of 16 bits, with the frames' own numbers."""
        found = readers.depth_images(self.spark, self._at(pattern), unit).drop("idx")
        same = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
        listed = self._listed(pattern).select("idx", same.alias("path"))
        return listed.join(found.withColumn("path", same), "path").select("idx", "h", "w", "values")

    def disparity(self) -> DataFrame:
        """(idx, h, w, values): true disparities in pixels, null where they aren't known."""
        return self._measured(self.layout.disparity, 1 / 256)

    def depth(self, unit: float = 0.001) -> DataFrame:
        """(idx, h, w, values): depths in metres, null where they aren't known."""
        return self._measured(self.layout.depth, unit)

    def rigs(self) -> DataFrame:
        """(idx, fx, cx, cy, baseline_px): each frame's own stereo calibration."""
        found = readers.stereo_calibration(self.spark, self._at(self.layout.rig))
        same = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
        listed = self._listed(self.layout.rig).select("idx", same.alias("path"))
        return listed.join(found.withColumn("path", same), "path").drop("path")

    def truth_stereo(self) -> DataFrame:
        """(idx, left, right, h, w, values, fx, cx, cy, baseline_px): image pairs with true disparities and their calibration."""
        return zips.zip_streams([self.stereo(), self.disparity(), self.rigs()], ["idx"])

    def measured_frames(self) -> DataFrame:
        """(idx, left, pose, depth, mask): images with their poses and the paths of depth and mask images; nulls where a stream
        is absent."""
        streams = {"left": self._named(self.layout.left, "left"), "pose": self.poses(), "depth": self._named(self.layout.depth, "depth"), "mask": self._named(self.layout.masks, "mask")}
        out = zips.zip_streams([d for d in streams.values() if d is not None], ["idx"])
        kinds = {"pose": "struct<q:struct<x:double,y:double,z:double,w:double>,t:struct<x:double,y:double,z:double>>"}
        return reduce(lambda d, n: zips.absent(d, n, kinds.get(n, "string")), [n for n, d in streams.items() if d is None], out).select("idx", *streams)

    def images(self, side: str = "left") -> DataFrame:
        """(idx, image) of a side, decoded."""
        found = readers.images(self.spark, self._at(getattr(self.layout, side)))
        # the two readers write one or three slashes after the scheme
        same = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
        listed = self._listed(getattr(self.layout, side)).select("idx", same.alias("path"))
        return listed.join(found.withColumn("path", same), "path").select("idx", "image")

    def points(self) -> DataFrame:
        """(idx, pt_idx, x, y, z, reflectance) of the scans."""
        return self._kept(readers.lidar(self.spark, self._at(self.layout.lidar)))

    def calibration(self) -> DataFrame:
        """One row: the stereo rig of a sequence's number, or the camera of the intrinsics file; scaled."""
        if self.layout.intrinsics:
            body = self.spark.read.text(self._at(self.layout.intrinsics), wholetext=True)
            m = body.select(text.floats(F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n", ""), r"[\[\],]", " ")).alias("m"))
            k = C.scaled(C.intrinsic(F.col("m")[0], F.col("m")[4], F.col("m")[2], F.col("m")[5], h=480, w=640, skew=F.col("m")[1]), self.scale)
            return m.select(k.alias("camera")).select("camera.*")
        number = int(self.folder.rsplit("/", 1)[-1])
        return stereo_calibrations(self.spark, self.scale).where((F.col("lo") <= number) & (F.col("hi") >= number))


def scenes(spark: SparkSession, root: str, sequences: list[str], **how) -> DataFrame:
    """The frames of several sequences, each with its name."""
    return zips.union_scenes({s: Drive.odometry(spark, root, s, **how).frames() for s in sequences})
