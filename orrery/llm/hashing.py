"""Hashed features and bounded training samples, used by the classifiers."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct words whose buckets a worker keeps.
CACHE = 1_000_000
#: Rows of this remainder are held out.
HELD_OUT, FOLDS = 2, 4


def fold(doc_id: Column) -> Column:
    """crc32 of doc_id as text, mod 4; null counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % FOLDS


class Buckets(dict):
    """word -> bucket, kept up to CACHE words."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        b = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) % self.size
        return b


def sample_place(key: str) -> Column:
    """A place in [0, 1) by a hash of the key."""
    return F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 20)).cast("double") / float(1 << 20)


def sample_by_class(rows: DataFrame, label: str, key: str, most: int) -> DataFrame:
    """About `most` rows of each class at most, picked by a hash of the key: the class counts cover all rows, and a
    class with more than `most` is thinned to that share."""
    sizes = rows.groupBy(label).agg(F.count("*").alias("_size")).withColumnRenamed(label, "_class")
    return rows.join(sizes, rows[label] == F.col("_class")).where(sample_place(key) * F.col("_size") < most).drop("_class", "_size")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
