"""Collections of messages that are kept by key: an append log with resets and tombstones, merged when it is read.

A message goes to a channel and brings elements with ids. A later element with the id of an earlier one takes its place; an
element marked deleted takes the earlier one away; a message with reset empties its channel first; a reset without channel
empties all. Appending only writes: nothing is read or rewritten. Reading takes of each (channel, id) the last element since
the channel's last reset. Compaction writes what a reader would see as the new base, and then, in one rename, the manifest that
names the base and the parts of the log that it holds. A reader that began before keeps the files it knows: the parts
that a compaction replaced go at the next one.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions import pose as P
from orrery.types import POSE

_OWN = T.StructType([T.StructField("channel", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("reset", T.BooleanType()), T.StructField("id", T.LongType()), T.StructField("deleted", T.BooleanType())])


class Collections:
    """A store in a folder. payload: the columns of its elements beside channel, seq, pos, reset, id and deleted."""

    def __init__(self, spark: SparkSession, folder: str, payload: T.StructType):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.schema = T.StructType([*_OWN.fields, *payload.fields])
        self.names = [f.name for f in payload.fields]
        if clash := set(self.names) & set(_OWN.names):
            raise ValueError(f"columns of a payload can't be named {', '.join(sorted(clash))}")

    # files

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _manifest(self) -> dict:
        at, fs = self._fs(f"{self.folder}/manifest")
        if not fs.exists(at):
            return {"base": None, "held": [], "old": []}
        return json.loads(self.spark.read.text(f"{self.folder}/manifest", wholetext=True).first()[0])

    def _put_manifest(self, manifest: dict) -> None:
        part, fs = self._fs(f"{self.folder}/manifest-{uuid.uuid4().hex}")
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        target, _ = self._fs(f"{self.folder}/manifest")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(part.toUri() if part.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        overwrite = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        overwrite[0] = self.spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        context.rename(part, target, overwrite)

    def _parts(self) -> list[str]:
        """Whole parts of the log: those whose job has ended."""
        at, fs = self._fs(f"{self.folder}/log")
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(n for n in names if fs.exists(self._fs(f"{self.folder}/log/{n}/_SUCCESS")[0]))

    def _read(self, paths: list[str]) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    # writing

    def append(self, messages: DataFrame) -> None:
        """Elements (channel, seq, id, payload; reset, deleted and pos where they are needed). seq tells messages apart and
        gives their order, pos that of elements within one. A row without id is a message without elements: with
        reset it only empties, without it does nothing."""
        have = set(messages.columns)
        default = {"pos": F.lit(0), "reset": F.lit(False), "deleted": F.lit(False)}
        cols = [(F.col(f.name) if f.name in have else default.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in self.schema.fields]
        messages.select(*cols).write.parquet(f"{self.folder}/log/{uuid.uuid4().hex}")

    # reading

    def _merged(self, rows: DataFrame) -> DataFrame:
        """The last element of each (channel, id) since its channel's last reset, tombstones included."""
        resets = rows.where("reset").groupBy("channel").agg(F.max("seq").alias("at"))
        own = resets.where("channel IS NOT NULL").select(F.col("channel").alias("_channel"), F.col("at").alias("_own"))
        everything = resets.where("channel IS NULL").agg(F.max("at").alias("_all"))  # one row
        there = rows.where("id IS NOT NULL AND channel IS NOT NULL").join(own, F.col("channel") == F.col("_channel"), "left").join(everything)
        there = there.where("(_own IS NULL OR seq >= _own) AND (_all IS NULL OR seq > _all)")
        last = there.groupBy("channel", "id").agg(F.max_by(F.struct("seq", "pos", "deleted", *self.names), F.struct("seq", "pos")).alias("_r"))
        return last.select("channel", "id", "_r.*")

    def elements(self, upto: int | None = None) -> DataFrame:
        """(channel, id, seq, payload) as they are now, or after the message upto (of what no compaction has merged yet)."""
        m = self._manifest()
        paths = [f"{self.folder}/log/{n}" for n in self._parts() if n not in m["held"]]
        rows = self._read([*([f"{self.folder}/{m['base']}"] if m["base"] else []), *paths])
        rows = rows if upto is None else rows.where(F.col("seq") <= upto)
        return self._merged(rows).where("NOT deleted").drop("pos", "deleted")

    def compact(self) -> None:
        """Merges the log into a new base. What the base before replaced is deleted now. The channels' last resets stay in it, so
        that elements of earlier messages that come late stay out."""
        m, parts = self._manifest(), self._parts()
        fresh = [n for n in parts if n not in m["held"]]
        rows = self._read([*([f"{self.folder}/{m['base']}"] if m["base"] else []), *(f"{self.folder}/log/{n}" for n in fresh)])
        resets = rows.where("reset").groupBy("channel").agg(F.max("seq").alias("seq")).select("channel", "seq", F.lit(-1).cast("bigint").alias("pos"), F.lit(True).alias("reset"))
        kept = self._merged(rows).withColumn("reset", F.lit(False)).unionByName(resets, allowMissingColumns=True)
        base = f"base-{uuid.uuid4().hex}"
        kept.select(*self.schema.names).write.parquet(f"{self.folder}/{base}")
        self._put_manifest({"base": base, "held": parts, "old": [*([m["base"]] if m["base"] else []), *(f"log/{n}" for n in fresh)]})
        for name in m["old"]:
            at, fs = self._fs(f"{self.folder}/{name}")
            fs.delete(at, True)


def attached(elements: DataFrame, poses: DataFrame, frames: DataFrame | None = None, channel: str = "frame", element: str = "element_id") -> DataFrame:
    """Adds world, the pose that an element is drawn in: that of the element with its id in the channel it names, seen from the
    sensor frame of that pose (frames: name, pose; a frame that isn't known is the origin). Null where the pose isn't there.
    poses: (channel, id, pose and, with frames, frame)."""
    at = poses.select(F.col("channel").alias("_c"), F.col("id").alias("_i"), F.col("pose").alias("_p"), *([F.col("frame").alias("_f")] if frames is not None else []))
    if frames is not None:
        named = frames.select(F.col("name").alias("_n"), F.col("pose").alias("_s"))
        at = at.join(named, F.col("_f") == F.col("_n"), "left").withColumn("_p", F.when(F.col("_s").isNull(), F.col("_p")).otherwise(P.compose(F.col("_s"), F.col("_p")))).drop("_f", "_n", "_s")
    joined = elements.join(at, (F.col(channel) == F.col("_c")) & (F.col(element) == F.col("_i")), "left")
    return joined.withColumn("world", F.col("_p")).drop("_c", "_i", "_p")


POSE_PAYLOAD = T.StructType([T.StructField("pose", POSE)])


def moved_points(elements: DataFrame, points: str = "points") -> DataFrame:
    """The points of attached elements in the world; null without a pose."""
    return elements.withColumn(points, F.when(F.col("world").isNotNull(), F.transform(points, lambda v: _apply(F.col("world"), v))))


def _apply(pose: Column, v: Column) -> Column:
    return P.apply(pose, v)
