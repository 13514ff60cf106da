"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum_i w_i + sum_{i<j} <v_i, v_j>) over the distinct terms of a text: linear weights, and a weight
for each pair of terms from their factors, so that pairs count that no additive weight has. Terms are the
lower-cased words and their first 4, 5 and 6 letters (inflected forms share these), hashed to buckets. The model is fitted on the driver from a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows
from orrery.llm.hashing import CACHE, HELD_OUT, Buckets, fold, sample_by_class, sigmoid

BUCKETS, FACTORS = 1 << 18, 4
PREFIXES = (4, 5, 6)
#: Most training rows of each class, and most terms of all of them together (4 bytes each on the driver).
SAMPLE, SAMPLE_TERMS = 4000, 16_000_000
#: Likelihood ratio at which a term's evidence counts half; texts at which a term's place in pairs has half its reach.
EVIDENCE, PAIR_TEXTS, PAIR_REACH = 10.0, 300.0, 0.6
THRESHOLD = 0.3

_WORD = re.compile(r"\w+")


class Terms(Buckets):
    """word -> the buckets of its terms."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= CACHE:
            self.clear()
        names = {word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)}
        b = self[word] = tuple(zlib.crc32(x.encode("utf-8", "surrogatepass")) % self.size for x in names)
        return b


def terms(text: str | None, buckets: Terms) -> np.ndarray:
    """The distinct buckets of a whole text's terms, sorted."""
    found = set()
    for w in set(_WORD.findall((text or "").lower())):
        found.update(buckets[w])
    return np.fromiter(sorted(found), np.int32, len(found))


class FactorizationMachine:
    """Weights over buckets; `keep` maps a bucket to its row, -1 if it isn't in the model."""

    def __init__(self, keep: np.ndarray, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.keep, self.bias, self.linear, self.factors = keep, bias, linear, factors

    def margin(self, buckets: np.ndarray) -> float:
        at = self.keep[buckets]
        at = at[at >= 0]
        v = self.factors[at]
        return self.bias + self.linear[at].sum() + 0.5 * float((v.sum(0) ** 2 - (v**2).sum(0)).sum())

    def score(self, buckets: np.ndarray) -> float:
        return float(sigmoid(np.array([self.margin(buckets)]))[0])


def _evidence(texts: list[np.ndarray], y: np.ndarray, texts_with: np.ndarray) -> np.ndarray:
    """How much each bucket tells of the classes: log-likelihood ratio of presence."""
    toxic_with = np.zeros(BUCKETS, np.int32)
    for t, label in zip(texts, y, strict=True):
        if label > 0:
            toxic_with[t] += 1
    n, n1 = max(1, len(y)), float((y > 0).sum())
    a, b = toxic_with.astype(float), (texts_with - toxic_with).astype(float)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) / np.maximum(expected, 1e-9)), 0.0)

    gain = part(a, texts_with * n1 / n) + part(b, texts_with * (n - n1) / n) + part(n1 - a, (n - texts_with) * n1 / n) + part(n - n1 - b, (n - texts_with) * (n - n1) / n)
    return np.maximum(gain, 0)


def fit(texts: list[np.ndarray], toxic: Iterable[int], weights: tuple[float, float] = (1.0, 1.0), rounds: int = 25, rate: float = 0.1, decay: float = 2e-3, seed: int = 7) -> FactorizationMachine:
    """Adagrad on the logistic loss in small batches, in a fixed order. weights: of the classes 0 and 1. Without rows of
    both classes the share of class 1 is all that the model says. Every term of the texts is in the model. It is scaled
    by its evidence, so that decay and steps hold the many terms of few texts back; in pairs also by its texts, as a
    term may tell nothing alone."""
    y = np.array(list(toxic), np.float64)
    texts_with = np.zeros(BUCKETS, np.int32)
    for t in texts:
        texts_with[t] += 1
    used = np.flatnonzero(texts_with)
    gain = _evidence(texts, y, texts_with)[used]
    alone = (gain / (gain + EVIDENCE)) ** 2
    paired = np.maximum(alone, PAIR_REACH * texts_with[used] / (texts_with[used] + PAIR_TEXTS))
    keep = np.full(BUCKETS, -1, np.int32)
    keep[used] = np.arange(len(used))
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(used)), rng.normal(0, 0.05, (len(used), FACTORS))
    share = float(np.average(y, weights=np.where(y > 0, weights[1], weights[0]))) if len(y) else 0.0
    b = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    gw, gv, gb = np.full(len(used), 1e-6), np.full((len(used), FACTORS), 1e-6), 1e-6
    if not len(y) or y.min() == y.max():
        return FactorizationMachine(keep, b, w, v)
    rows = [x[x >= 0] for x in (keep[t] for t in texts)]
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), 32):
            batch = order[start : start + 32]
            size = np.array([len(rows[i]) for i in batch])
            idx, owner = np.concatenate([rows[i] for i in batch]), np.repeat(np.arange(len(batch)), size)
            own, pair = alone[idx], paired[idx]
            vi = v[idx] * pair[:, None]
            sums = np.stack([np.bincount(owner, vi[:, f], len(batch)) for f in range(FACTORS)], 1)
            squares = np.bincount(owner, (vi**2).sum(1), len(batch))
            z = b + np.bincount(owner, w[idx] * own, len(batch)) + 0.5 * ((sums**2).sum(1) - squares)
            slope = (sigmoid(z) - y[batch]) * np.where(y[batch] > 0, weights[1], weights[0])
            gb += float(slope.sum()) ** 2
            b -= rate * float(slope.sum()) / gb**0.5
            uniq, inv = np.unique(idx, return_inverse=True)
            dw = np.bincount(inv, slope[owner] * own) + decay * w[uniq] * len(batch)
            dv = np.stack([np.bincount(inv, slope[owner] * pair * (sums[owner, f] - vi[:, f])) for f in range(FACTORS)], 1) + decay * v[uniq] * len(batch)
            gw[uniq] += dw**2
            w[uniq] -= rate * dw / np.sqrt(gw[uniq])
            dv = np.clip(dv, -1, 1)
            gv[uniq] += dv**2
            v[uniq] -= rate * dv / np.sqrt(gv[uniq])
    return FactorizationMachine(keep, b, w * alone, v * paired[:, None])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> FactorizationMachine:
    """Learns from labels.toxic (null: no label; several of one doc_id: the greatest) of rows that aren't held out.

    About `sample` rows of each class at most are used (see hashing.sample_by_class), fewer if their texts are so long
    that they would have more than SAMPLE_TERMS terms; classes are weighted back to their share. The picked
    ids, about twice the sample, are broadcast, so texts are read in place. Empty labels or documents give a
    model that says one share for all.
    """
    train_rows = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    whole = {0: 0, 1: 0} | {r["toxic"]: r["n"] for r in train_rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = sample_by_class(train_rows, "toxic", "doc_id", sample).select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))

    def make():
        buckets = Terms(BUCKETS)

        def fn(cols):
            got = [terms(t, buckets) for t in cols[2]]
            yield [cols[0], cols[1], [len(t) for t in got], [t.tobytes() for t in got]]

        return fn

    ws = Workspace(docs.sparkSession)
    table = ws.save(map_rows(rows.select("doc_id", "_toxic", "text"), make, "doc_id bigint, toxic int, n int, terms binary"), "terms")
    share = SAMPLE_TERMS / max(1, table.agg(F.sum("n")).first()[0] or 0)
    got = sorted((r["doc_id"], r["toxic"], bytes(r["terms"])) for r in table.where(F.pmod(F.xxhash64("doc_id", F.lit("terms")), F.lit(1 << 20)) < share * (1 << 20)).toLocalIterator())
    ws.drop(table)
    n = {k: sum(1 for r in got if r[1] == k) for k in (0, 1)}
    # rarer class up to even odds by half, in the logarithm: scores stay near the shares, and toxic texts are not missed
    weight = [whole[k] / max(1, n[k]) for k in (0, 1)]
    boost = (whole[0] / max(1, whole[1])) ** 0.5 if whole[1] else 1.0
    mean = (weight[0] + weight[1] * boost) / 2 or 1.0
    return fit([np.frombuffer(r[2], np.int32) for r in got], [r[1] for r in got], (weight[0] / mean, weight[1] * boost / mean))


def score(docs: DataFrame, model: FactorizationMachine, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text, others ignored) -> (doc_id, held_out, score, predicted), a row per row; null text is empty
    and scores as a text without terms."""
    sent = docs.sparkSession.sparkContext.broadcast((model.keep, model.bias, model.linear, model.factors))

    def make():
        buckets, fm = Terms(BUCKETS), FactorizationMachine(*sent.value)

        def fn(cols):
            s = [fm.score(terms(t, buckets)) for t in cols[2]]
            yield [cols[0], cols[1], s, [int(x >= threshold) for x in s]]

        return fn

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id bigint, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The query's columns: trained on the labels and scored for all documents. Nulls, ties, repeated rows and empty tables
    as in train and score."""
    return score(docs, train(docs, labels))
