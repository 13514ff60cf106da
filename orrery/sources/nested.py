"""A store of nested dictionaries: groups are folders, leaves are Parquet tables or one value as JSON.

Leaves may be tables, numbers, texts, lists, nulls or numpy arrays (kept with their shape and type). Nothing is unpickled.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TABLE, _VALUE, _ARRAY = "table", "value", "array"


class NestedStore:
    """Dictionaries below one folder. Keys are texts without a slash; `a/b/c` names a node."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, node: str = ""):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{node}" if node else self.path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _children(self, node: str) -> list[str]:
        fs, at = self._fs(node)
        return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []

    def keys(self, node: str = "") -> list[str]:
        """The keys of a group."""
        return [n.split("=", 1)[1] for n in self._children(node) if "=" in n]

    def _folder(self, node: str) -> str:
        """Where a node lies: each step is kind=key."""
        at = ""
        for key in [k for k in node.split("/") if k]:
            name = next((n for n in self._children(at) if n.split("=", 1)[-1] == key), None)
            if name is None:
                raise KeyError(node)
            at = f"{at}/{name}" if at else name
        return at

    def write(self, data: dict, node: str = "", force: bool = True) -> None:
        """Writes a dictionary below a group. A key that is there is replaced; without force it is an error."""
        for key, value in data.items():
            if not isinstance(key, str) or "/" in key or "=" in key or not key:
                raise ValueError(f"not a key: {key!r}")
            for name in [n for n in self._children(node) if n.split("=", 1)[-1] == key]:
                if not force:
                    raise ValueError(f"{node}/{key} is there already")
                fs, at = self._fs(f"{node}/{name}" if node else name)
                fs.delete(at, True)
            kind = "group" if isinstance(value, dict) else _TABLE if isinstance(value, DataFrame) else _ARRAY if isinstance(value, np.ndarray) else _VALUE
            at = f"{node}/{kind}={key}" if node else f"{kind}={key}"
            full = f"{self.path}/{at}"
            if kind == "group":
                fs, place = self._fs(at)
                fs.mkdirs(place)
                self.write(value, at, force)
            elif kind == _TABLE:
                value.write.parquet(full)
            elif kind == _ARRAY:
                self.spark.createDataFrame([(str(value.dtype), list(value.shape), value.tobytes())], "dtype string, shape array<int>, data binary").write.parquet(full)
            else:
                self.spark.createDataFrame([(json.dumps(value),)], "value string").write.parquet(full)

    def node(self, path: str):
        """A group as a dictionary (tables stay lazy), or a leaf."""
        return self._read(self._folder(path))

    def read(self) -> dict:
        return self._read("")

    def _read(self, at: str):
        kind = at.rsplit("/", 1)[-1].split("=", 1)[0] if at else "group"
        if kind == "group":
            return {n.split("=", 1)[1]: self._read(f"{at}/{n}" if at else n) for n in self._children(at) if "=" in n}
        table = self.spark.read.parquet(f"{self.path}/{at}")
        if kind == _TABLE:
            return table
        row = table.first()
        if kind == _ARRAY:
            return np.frombuffer(bytes(row["data"]), row["dtype"]).reshape(row["shape"]).copy()
        return json.loads(row["value"])

    def leaves(self, node: str = "") -> DataFrame:
        """(node, kind) of every leaf below a group."""
        found: list[tuple[str, str]] = []

        def walk(at: str, name: str) -> None:
            for n in self._children(at):
                if "=" in n:
                    kind, key = n.split("=", 1)
                    here = f"{name}/{key}" if name else key
                    walk(f"{at}/{n}" if at else n, here) if kind == "group" else found.append((here, kind))

        walk(self._folder(node), node)
        return self.spark.createDataFrame(found, "node string, kind string").orderBy(F.col("node"))
