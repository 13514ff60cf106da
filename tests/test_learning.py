from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators.learning import HistogramClassifier, minimise


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(4)
    rows = [(name, (rng.normal(0, 0.4, 3) + centre).tolist()) for name, centre in (("a", [0, 0, 3]), ("b", [3, 0, 0]), ("c", [0, 3, 0])) for _ in range(60)]
    return spark.createDataFrame(rows, "y string, x array<double>").coalesce(2).cache()


@pytest.mark.parametrize("kind", ["svm", "sgd"])
def test_classifier(blobs, kind):
    got = HistogramClassifier(["a", "b", "c"], kind).fit(blobs, "x", "y").predict(blobs, "x")
    assert got.agg(F.avg((F.col("y") == F.col("predicted")).cast("double"))).first()[0] > 0.95
    row = got.first()
    assert abs(sum(row["probability"]) - 1) < 1e-6 and np.allclose(np.exp(row["log_probability"]), row["probability"])


def test_partial_fit(blobs):
    c = HistogramClassifier(["a", "b", "c"], "sgd")
    for _ in range(8):
        c.partial_fit(blobs, "x", "y", 1.0)
    best = F.array_position("decision", F.array_max("decision")) - 1
    got = c.decision(blobs, "x").select("y", F.get(F.array(F.lit("a"), F.lit("b"), F.lit("c")), best.cast("int")).alias("p"))
    assert got.where("y = p").count() > 0.95 * blobs.count()


def test_save_and_load(blobs, tmp_path):
    c = HistogramClassifier(["a", "b", "c"], "sgd").fit(blobs, "x", "y").partial_fit(blobs, "x", "y", 1.0)
    c.save(f"{tmp_path}/c")
    back = HistogramClassifier.load(f"{tmp_path}/c")
    assert back.classes == c.classes and (back.steps == c.steps).all()
    assert back.predict(blobs, "x").select("predicted").collect() == c.predict(blobs, "x").select("predicted").collect()
    assert {r["label"]: r["support"] for r in back.report(blobs, "x", "y").collect()}[None] == 180


def test_minimise(spark):
    got = minimise(lambda p: float((p**2).sum()), lambda p: 2 * p, list(range(1, 11)))
    assert got["success"] and np.allclose(got["x"], 0, atol=1e-6)
    df = spark.range(10).select(F.col("id").cast("double").alias("v"))
    mean = minimise(lambda p: df.agg(F.avg((F.col("v") - float(p[0])) ** 2)).first()[0], lambda p: np.array([df.agg(F.avg(-2 * (F.col("v") - float(p[0])))).first()[0]]), [0.0])
    assert np.isclose(mean["x"][0], 4.5)
    assert minimise(lambda p: None, lambda p: p, [1.0])["status"] == 2
