"""Calibration of the stereo rigs, by sequence range (fixed values)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: lo, hi, fx, fy, cx, cy, baseline in pixels, h, w.
RIGS = [
    (0, 2, 718.8560, 718.8560, 607.1928, 185.2157, 386.1448, 376, 1241),
    (3, 3, 721.5377, 721.5377, 609.5593, 172.854, 387.5744, 376, 1241),
    (4, 12, 707.0912, 707.0912, 601.8873, 183.1104, 379.8145, 370, 1226),
]


def stereo_calibrations(spark: SparkSession, scale: float = 1.0) -> DataFrame:
    rows = [(lo, hi, *(x * scale for x in rest), int(h * scale), int(w * scale)) for lo, hi, *rest, h, w in RIGS]
    return spark.createDataFrame(rows, "lo int, hi int, fx double, fy double, cx double, cy double, baseline_px double, h int, w int")
