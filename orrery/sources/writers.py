"""Writers of pose texts, dictionaries, messages and image sequences."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.functions import pose as P
from orrery.functions import text
from orrery.operators import imaging


def pose_lines(df: DataFrame, order: str, col: str = "pose") -> DataFrame:
    """(order, value): twelve numbers a line."""
    return df.select(order, text.pose_line(P.to_row(F.col(col))).alias("value"))


def write_poses(df: DataFrame, path: str, order: str, col: str = "pose", mode: str = "errorifexists") -> None:
    """Lines in order over the part files, ended by CR LF."""
    pose_lines(df, order, col).repartitionByRange(F.col(order)).sortWithinPartitions(order).select("value").write.mode(mode).option("lineSep", "\r\n").text(path)


def write_json(df: DataFrame, path: str, mode: str = "errorifexists", sort_keys: bool = False) -> None:
    (df.select(*sorted(df.columns)) if sort_keys else df).write.mode(mode).json(path)


def write_yaml(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as a YAML document in flow style on one line."""
    df.select(F.concat(F.lit("--- "), F.to_json(F.struct(*sorted(df.columns)))).alias("value")).write.mode(mode).text(path)


def write_cameras(df: DataFrame, path: str, name: str, col: str = "camera", mode: str = "errorifexists") -> None:
    """Cameras (structs of intrinsic and pose) as JSON lines under a name; readers.cameras reads them."""
    df.select(F.col(name).cast("string").alias("name"), f"{col}.intrinsic", f"{col}.pose").write.mode(mode).json(path)


def write_messages(df: DataFrame, path: str, kind: str, mode: str = "append") -> None:
    """Rows of a viewer message type, checked against its schema."""
    from orrery.types import MESSAGES

    want = MESSAGES[kind]
    df.select(*[F.col(f.name).cast(f.dataType) for f in want.fields]).write.mode(mode).parquet(f"{path}/{kind}")


def png(a: np.ndarray) -> bytes:
    """A PNG of a grey (h, w) or blue-green-red (h, w, 3) array of uint8."""
    h, w = a.shape[:2]
    rgb = a if a.ndim == 2 else a[:, :, 2::-1]
    body = b"".join(b"\0" + np.ascontiguousarray(rgb[i]).tobytes() for i in range(h))
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", w, h, 8, 0 if a.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def png16(a: np.ndarray) -> bytes:
    """A grey PNG of 16 bits of an (h, w) array."""
    h, w = a.shape
    body = b"".join(b"\0" + row.astype(">u2").tobytes() for row in a)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 16, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def encode_frames(df: DataFrame, order: str, template: str = "imgs-%06i.png") -> DataFrame:
    """(name, content): a PNG for each image, named by its place in the order column."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = pdf.to_dict("records")
            yield pd.DataFrame({"name": [template % r[order] for r in rows], "content": [png(imaging.decode(r["image"])) for r in rows]})

    return df.select(order, "image").mapInPandas(run, "name string, content binary")
