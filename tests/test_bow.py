"""Codebooks: exact nearest words through the tree, histograms, residuals, hard negatives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from orrery.operators import bow


def test_nearest_is_exact():
    rng = np.random.default_rng(0)
    for words in (rng.normal(size=(60, 8)), rng.integers(0, 2, (50, 3)).astype(float), np.zeros((3, 2)), rng.normal(size=(1, 4))):
        book = bow.Codebook.of(words)
        x = np.concatenate([rng.normal(size=(300, words.shape[1])), words, rng.integers(0, 2, (40, words.shape[1]))])
        d = np.sqrt(((x[:, None] - words[None]) ** 2).sum(2))
        word, best = book.nearest(x)
        assert (word == d.argmin(1)).all() and np.allclose(best, d.min(1))
    assert book.nearest(np.empty((0, 4)))[0].shape == (0,)
    with pytest.raises(ValueError, match="bound"):
        bow.Codebook(np.broadcast_to(0.0, (bow.MOST, 2)), np.zeros(bow.MOST, int))


def test_lloyd():
    rng = np.random.default_rng(1)
    centres = np.array([[0, 0], [10, 0], [0, 10], [9, 9.0]])
    x = np.repeat(centres, 50, 0) + rng.normal(size=(200, 2)) * 0.3
    got = bow.lloyd(x, 4, 2)
    assert np.sqrt(((got[:, None] - centres) ** 2).sum(2)).min(0).max() < 0.3
    assert len(bow.lloyd(np.ones((5, 2)), 3)) == 1


def test_fit_assign_histograms(spark):
    rng = np.random.default_rng(3)
    kinds = rng.normal(size=(6, 5)) * 8
    rows = [(int(i % 7) if i % 50 else None, i, (kinds[i % 6] + rng.normal(size=5)).tolist()) for i in range(900)]
    df = spark.createDataFrame([*rows, (1, 1000, None)], "image int, i int, v array<double>")
    book = bow.fit(df.where("v IS NOT NULL"), "v", branches=3, words=4, sample=500)
    assert 6 <= len(book.words) <= 12
    same = bow.fit(df.where("v IS NOT NULL").repartition(5), "v", branches=3, words=4, sample=500)
    assert np.allclose(sorted(map(tuple, book.words)), sorted(map(tuple, same.words))) or len(same.words) >= 6
    got = bow.assign(df, "v", book, distance="far")
    by = {r["i"]: (r["word"], r["far"]) for r in got.collect()}
    assert by.pop(1000) == (None, None)
    x = np.array([r[2] for r in rows])
    d = np.sqrt(((x[:, None] - book.words) ** 2).sum(2))
    assert [by[i][0] for i in range(900)] == d.argmin(1).tolist()
    hist = bow.histograms(got, ["image"]).collect()
    for image in (None, 0, 3):
        mine = [r for r in hist if r["image"] == image]
        want = [by[i][0] for k, i, _ in rows if k == image]
        assert {r["word"]: r["n"] for r in mine} == {w: want.count(w) for w in want} and abs(sum(r["share"] for r in mine) - 1) < 1e-12
    sums = {(r["image"], r["word"]): r["sums"] for r in bow.residuals(got, "v", book, ["image"]).collect()}
    for image, w in ((0, by[0 + 7][0]), (3, by[3][0]), (None, by[0][0])):
        mine = x[[i for k, i, _ in rows if k == image and by[i][0] == w]]
        assert np.allclose(sums[image, w], (mine - book.words[w]).sum(0))
    with pytest.raises(Exception, match="numbers"):
        bow.assign(df.select(F.array(F.lit(1.0)).alias("v")), "v", book).collect()


def test_hard_negatives(spark):
    """The negatives that lie by the positives are few; rounds find them."""
    rows = [(i, float(i), 0.0) for i in range(2000)] + [(5000 + i, 2500.0 + i, 0.0) for i in range(12)]
    negatives = spark.createDataFrame(rows, "k int, x double, y double")
    positives = spark.createDataFrame([(9000 + i, 3000.0 + i, 0.0) for i in range(20)], "k int, x double, y double")
    cut = lambda rows: rows.groupBy().agg(((F.max(F.when(F.col("label") == 0, F.col("x"))) + F.min(F.when(F.col("label") == 1, F.col("x")))) / 2).alias("c")).first()["c"]
    fitted = lambda rows: cut(rows)
    score = lambda c, df: df.withColumn("score", F.col("x") - c)
    model, chosen = bow.mine_hard(fitted, score, positives, negatives, "k", rounds=4, first=30, more=5)
    assert max(chosen) == 5011 and 2700 < model < 3000 and len(chosen) == len(set(chosen))
