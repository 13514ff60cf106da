"""Descriptors as words: a codebook in two levels, each descriptor's nearest word, histograms and residual sums by image, and
rounds of hard negatives.

The codebook is fitted on a sample of stated size by k-means, first into branches and then, in each branch, into words. The nearest
word of a descriptor is exact whatever the tree: a word of a branch is no nearer than the distance to the branch's centre less
the branch's reach, so branches that can't hold a nearer word are left out.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Descriptors that a codebook is fitted on, about; numbers of a codebook (words times width) at most, as tasks hold it whole.
SAMPLE, MOST = 200_000, 8_000_000


def lloyd(x: np.ndarray, k: int, seed: int = 0, rounds: int = 50) -> np.ndarray:
    """At most k centres of the rows: seeded by falling distance to the centres so far (drawn by its square), then means of the
    nearest rows until nothing changes. Fewer where fewer rows differ."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x))][None]
    near = ((x - centres[0]) ** 2).sum(1)
    while len(centres) < k and near.max(initial=0) > 1e-12:
        centres = np.concatenate([centres, x[rng.choice(len(x), p=near / near.sum())][None]])
        near = np.minimum(near, ((x - centres[-1]) ** 2).sum(1))
    owner = None
    for _ in range(rounds):
        new = distances(x, centres).argmin(1)
        if owner is not None and (new == owner).all():
            break
        owner = new
        count = np.bincount(owner, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, x)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres, by differences (no cancellation), some rows at a time."""
    step = max(1, 4_000_000 // max(1, c.size))
    return np.concatenate([((x[i : i + step, None] - c[None]) ** 2).sum(2) for i in range(0, len(x), step)]) if len(x) else np.empty((0, len(c)))


@dataclass
class Codebook:
    """Words in order of their numbers, and the branch of each."""

    words: np.ndarray
    branch: np.ndarray

    def __post_init__(self):
        if self.words.size > MOST:
            raise ValueError(f"a codebook of {self.words.size} numbers is over the bound of {MOST}")
        self.parts = [np.flatnonzero(self.branch == b) for b in np.unique(self.branch)]
        self.centres = np.stack([self.words[p].mean(0) for p in self.parts])
        self.reach = np.array([np.sqrt(distances(self.words[p], c[None]).max()) for p, c in zip(self.parts, self.centres, strict=True)])

    @classmethod
    def of(cls, words: np.ndarray, branches: int | None = None, seed: int = 0) -> Codebook:
        """A codebook of given words, put into branches of about as many words each."""
        words = np.asarray(words, float)
        centres = lloyd(words, branches or max(1, round(len(words) ** 0.5)), seed)
        return cls(words, distances(words, centres).argmin(1))

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word, distance) of each row; of equally near words the first."""
        if not len(x):
            return np.empty(0, np.int64), np.empty(0)
        to = np.sqrt(distances(x, self.centres))
        word, best = np.full(len(x), len(self.words)), np.full(len(x), np.inf)
        order = to.argsort(1)
        for k in range(len(self.parts)):
            for b in np.unique(order[:, k]):
                rows = np.flatnonzero((order[:, k] == b) & (to[:, b] - self.reach[b] <= best * (1 + 1e-12)))
                if not len(rows):
                    continue
                d = np.sqrt(distances(x[rows], self.words[self.parts[b]]))
                at = d.argmin(1)
                mine, w = d[np.arange(len(rows)), at], self.parts[b][at]
                better = (mine < best[rows]) | ((mine == best[rows]) & (w < word[rows]))
                best[rows[better]], word[rows[better]] = mine[better], w[better]
        return word, best


def fit(df: DataFrame, vector: str, branches: int = 16, words: int = 16, key: Column | None = None, sample: int = SAMPLE, seed: int = 0) -> Codebook:
    """A codebook of about branches x words words. Descriptors are sampled by a hash of key (of the descriptor itself by
    default), about `sample` of them; each branch's words are found in a task of their own."""
    n = df.count()
    place = F.pmod(F.xxhash64(F.lit(seed), key if key is not None else F.to_json(F.struct(vector))), F.lit(1 << 30)).cast("double") / (1 << 30)
    picked = df.where(place * n < sample).select(F.transform(vector, lambda v: v.cast("double")).alias("v"))
    rows = np.array([r[0] for r in picked.limit(2 * sample).collect()], float)  # some `sample` rows, twice that at most
    if not len(rows):
        raise ValueError("no descriptors to fit a codebook on")
    centres = lloyd(rows, branches, seed)
    owned = pd.DataFrame({"branch": distances(rows, centres).argmin(1), "v": rows.tolist()})

    def split(pdf: pd.DataFrame) -> pd.DataFrame:
        got = lloyd(np.array(pdf["v"].tolist()), words, seed)
        return pd.DataFrame({"branch": int(pdf["branch"].iloc[0]), "v": got.tolist()})

    found = df.sparkSession.createDataFrame(owned, "branch int, v array<double>").groupBy("branch").applyInPandas(split, "branch int, v array<double>").collect()
    found = sorted((r["branch"], r["v"]) for r in found)
    return Codebook(np.array([v for _, v in found]), np.array([b for b, _ in found]))


def assign(df: DataFrame, vector: str, book: Codebook, word: str = "word", distance: str | None = None) -> DataFrame:
    """Adds each descriptor's nearest word (and its distance). Null descriptors have none; others of another width are errors."""
    fields = "struct<word: bigint, distance: double>"

    @F.pandas_udf(fields)
    def run(v: pd.Series) -> pd.DataFrame:
        known = v.notna().to_numpy()
        x = np.array([list(r) for r in v[known]], float).reshape(int(known.sum()), -1)
        if len(x) and x.shape[1] != book.words.shape[1]:
            raise ValueError(f"descriptors have {x.shape[1]} numbers, words {book.words.shape[1]}")
        w, d = book.nearest(x)
        out = pd.DataFrame({"word": pd.array([pd.NA] * len(v), "Int64"), "distance": np.nan})
        out.loc[known, "word"], out.loc[known, "distance"] = w, d
        return out

    got = df.withColumn("_word", run(vector))
    got = got.withColumn(word, F.col("_word.word"))
    return (got.withColumn(distance, F.col("_word.distance")) if distance else got).drop("_word")


def histograms(assigned: DataFrame, by: Sequence[str], word: str = "word") -> DataFrame:
    """(by, word, n, share): counts of each image's words and their share of the image's descriptors; words that an image lacks
    have no row."""
    counts = assigned.where(F.col(word).isNotNull()).groupBy(*by, word).agg(F.count("*").alias("n"))
    whole = counts.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.sum("n").alias("_all"))
    same = [counts[c].eqNullSafe(whole[f"_{c}"]) for c in by]
    return counts.join(whole, same).select(*by, word, "n", (F.col("n") / F.col("_all")).alias("share"))


def residuals(assigned: DataFrame, vector: str, book: Codebook, by: Sequence[str], word: str = "word") -> DataFrame:
    """(by, word, sums): for each image and word the sum of its descriptors' differences from the word. Tasks add up their own rows
    before anything is sent."""
    rows = assigned.where(F.col(word).isNotNull()).select(*by, word, F.col(vector).alias("_v"))
    key = [*by, word]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)

    def part(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.array([list(v) for v in pdf["_v"]], float) - book.words[pdf[word].to_numpy(np.int64)]
            group = pdf.groupby(key, dropna=False, sort=False).ngroup().to_numpy()
            sums = np.zeros((group.max() + 1, x.shape[1]))
            np.add.at(sums, group, x)
            first = pdf[key].iloc[np.unique(group, return_index=True)[1]].reset_index(drop=True)
            yield first.assign(sums=sums.tolist())

    added = rows.mapInPandas(part, f"{fields}, sums array<double>")
    width = book.words.shape[1]
    return added.groupBy(*key).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))


def mine_hard(fit_one, score, positives: DataFrame, negatives: DataFrame, key: str, rounds: int = 3, first: int = 100, more: int = 100):
    """Rounds of hard negatives: a model is fitted on the positives and some negatives (those of least hash first), all other
    negatives are scored, and the `more` that it takes most for positives (ties: smaller key) join for the next round; it ends
    early when none scores above 0. fit_one(rows with label 1 and 0) gives a model, score(model, rows) adds `score`.
    Gives the last model and the keys of its negatives."""
    chosen = [r[0] for r in negatives.select(key).orderBy(F.xxhash64(key), key).limit(first).collect()]
    spark, kind = negatives.sparkSession, negatives.schema[key].dataType
    model = None
    for k in range(rounds):
        keys = spark.createDataFrame([(c,) for c in chosen], f"`{key}` {kind.simpleString()}")
        mine = negatives.join(keys, key, "left_semi")
        model = fit_one(positives.withColumn("label", F.lit(1)).unionByName(mine.withColumn("label", F.lit(0))))
        if k + 1 == rounds:
            break
        rest = score(model, negatives.join(keys, key, "left_anti")).where("score > 0")
        hard = [r[0] for r in rest.select(key, "score").orderBy(F.desc("score"), key).limit(more).collect()]
        if not hard:
            break
        chosen += hard
    return model, chosen
