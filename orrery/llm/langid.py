"""Language identification in two steps: the family, then one-versus-one linear support vector machines within it.

Features are hashed counts of the 1- to 3-grams of a text's letters (lower-cased, other characters become one
space), scaled to logarithms and unit length. The family is chosen by linear machines one against the rest, the
language by votes of the machines for each pair of languages of that family; ties go to the larger sum of margins.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows
from orrery.llm.hashing import HELD_OUT, fold, sample_place

BUCKETS = 1 << 12
#: Most training rows of each language, and of all languages together.
SAMPLE, SAMPLE_ALL = 600, 12_000
#: More languages than this are an error: a machine for each is trained and sent to every worker.
MOST_LANGUAGES = 1000
#: Characters that are counted at once.
SLICE = 1 << 18
#: Families of languages by code (fixed values); a code that isn't here is a family of its own.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "turkic": ["tr", "az", "kk", "uz", "ky"],
    "uralic": ["fi", "et", "hu"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa", "ne"],
}
_FAMILY = {lang: f for f, langs in FAMILIES.items() for lang in langs}
#: What is no letter. Superscripts, fractions and number letters are none.
_OTHER = regex.compile(r"\P{L}+")


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0], lang)


def features(text: str | None) -> np.ndarray | None:
    """Float32 features of a whole text; None if it has no letter."""
    letters = _OTHER.sub(" ", (text or "").lower()).strip()
    if not letters:
        return None
    total = np.zeros(BUCKETS)
    for at in range(0, len(letters), SLICE):
        # two characters more on the left, so that no gram is lost between slices
        c = np.frombuffer((" " * (at == 0) + letters[max(0, at - 2) : at + SLICE] + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        one = c * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ (c[1:] + np.uint64(7))) * np.uint64(0xBF58476D1CE4E5B9)
        three = (two[:-1] ^ (c[2:] + np.uint64(11))) * np.uint64(0x94D049BB133111EB)
        for g in (one, two, three):
            total += np.bincount((g >> np.uint64(52)).astype(np.int64), minlength=BUCKETS)
    x = np.log1p(total)
    return (x / np.linalg.norm(x)).astype(np.float32)


def linear_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Weights and bias (last) that minimise |w|^2 / 2 + c * mean squared hinge loss, by Newton steps in conjugate
    gradients. y is -1 or 1; classes weigh the same."""
    a = np.concatenate([x, np.ones((len(x), 1), x.dtype)], 1)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())) * c * 100
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        margin = 1 - y * (a @ w)
        on = margin > 0
        g = w - a[on].T @ (share[on] * y[on] * margin[on])
        if np.linalg.norm(g) < 1e-4 * max(1.0, np.linalg.norm(w)):
            break
        step, r = np.zeros_like(w), -g
        p, rr = r.copy(), r @ r
        for _ in range(50):
            hp = p + a[on].T @ (share[on] * (a[on] @ p))
            alpha = rr / (p @ hp)
            step += alpha * p
            r -= alpha * hp
            new = r @ r
            if new < 1e-8 * (g @ g):
                break
            p, rr = r + (new / rr) * p, new
        w = w + step
    return w


class Model:
    """families and, for each, its languages; one row of weights a machine."""

    def __init__(self, families: list[tuple[str, list[str]]], first: np.ndarray, pairs: dict[tuple[str, str], np.ndarray]):
        self.families, self.first, self.pairs = families, first, pairs

    def predict(self, x: np.ndarray) -> tuple[str, float]:
        """The language and a score from 0 to 1: the chance of the family by its margin's lead, times that of the
        language by its least margin over another."""
        squash = lambda z: float(1 / (1 + np.exp(-np.clip(4 * z, -30, 30))))
        score, at = 1.0, 0
        if len(self.families) > 1:
            z = self.first[:, :-1] @ x + self.first[:, -1]
            at = int(z.argmax())
            score = squash(float(z[at] - np.delete(z, at).max()) / 2)
        langs = self.families[at][1]
        votes, sums, least = dict.fromkeys(langs, 0), dict.fromkeys(langs, 0.0), dict.fromkeys(langs, np.inf)
        for a, b in combinations(langs, 2):
            w = self.pairs[a, b]
            m = float(w[:-1] @ x + w[-1])
            votes[a if m >= 0 else b] += 1
            for lang, z in ((a, m), (b, -m)):
                sums[lang] += z
                least[lang] = min(least[lang], z)
        best = max(langs, key=lambda lang: (votes[lang], sums[lang], lang))
        return best, score * (squash(least[best]) if len(langs) > 1 else 1.0)


def fit(x: np.ndarray, langs: list[str]) -> Model | None:
    """Trains all machines here. None without rows."""
    known = sorted(set(langs))
    if not known:
        return None
    lang = np.array(langs)
    families = _families(known)
    of = np.array([family(v) for v in langs])
    first = np.stack([linear_svm(x, np.where(of == f, 1.0, -1.0)) for f, _ in families])
    pairs = {}
    for _, members in families:
        for a, b in combinations(members, 2):
            on = (lang == a) | (lang == b)
            pairs[a, b] = linear_svm(x[on], np.where(lang[on] == a, 1.0, -1.0))
    return Model(families, first.astype(np.float32), {k: w.astype(np.float32) for k, w in pairs.items()})


def _families(known: list[str]) -> list[tuple[str, list[str]]]:
    return [(f, [v for v in known if family(v) == f]) for f in sorted({family(v) for v in known})]


def train(docs: DataFrame, sample: int = SAMPLE) -> Model | None:
    """Learns from text and non-null lang of rows that aren't held out; None if there are none with a letter.

    About `sample` rows of each language at most, and about SAMPLE_ALL of all together (the share of a language is taken
    by a hash of doc_id; the counts cover all rows), are written as features of a fixed size. A family's machine
    is trained in one task from all of them (about 200 MB), a pair's from its two languages' rows; the driver
    holds weights only. More than MOST_LANGUAGES languages are an error.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "lang", "text").where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id")) != HELD_OUT)
    counts = rows.groupBy("lang").agg(F.count("*").alias("n"))
    sizes = {r["lang"]: r["n"] for r in counts.limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang: codes of languages are expected")
    if not sizes:
        return None
    most = min(sample, SAMPLE_ALL // len(sizes))
    share = F.create_map(*[F.lit(v) for lang, n in sizes.items() for v in (lang, min(1.0, most / n))])
    picked = rows.where(sample_place("doc_id") < F.element_at(share, F.col("lang")))

    def make():
        def fn(cols):
            got = [(i, lang, f.tobytes()) for i, lang, t in zip(*cols, strict=True) if (f := features(t)) is not None]
            yield [list(c) for c in zip(*got, strict=True)] if got else [[], [], []]

        return fn

    ws = Workspace(spark)
    table = ws.save(map_rows(picked, make, "doc_id bigint, lang string, f binary"), "features")
    known = sorted(r["lang"] for r in table.select("lang").distinct().collect())
    families = _families(known)
    # a machine: its name, the languages that it tells from others, and these others
    tasks = [(f"family {k}", members, [v for v in known if v not in members]) for k, (_, members) in enumerate(families) if len(families) > 1]
    pairs = [pair for _, members in families for pair in combinations(members, 2)]
    tasks += [(f"pair {k}", [a], [b]) for k, (a, b) in enumerate(pairs)]
    weights = {}
    if tasks:
        roles = spark.createDataFrame([(m, lang, y) for m, yes, no in tasks for y, langs in ((1, yes), (-1, no)) for lang in langs], "machine string, lang string, y int")

        def solve(group: pa.Table) -> pa.Table:
            got = sorted(zip(group.column("lang").to_pylist(), group.column("doc_id").to_pylist(), group.column("f").to_pylist(), group.column("y").to_pylist(), strict=True), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2]))
            x = np.stack([np.frombuffer(r[2], np.float32) for r in got])
            w = linear_svm(x, np.array([r[3] for r in got], float)).astype(np.float32)
            return pa.table({"machine": [group.column("machine")[0].as_py()], "w": pa.array([w.tobytes()], pa.binary())})

        solved = table.join(roles, "lang").select("machine", "lang", "doc_id", "f", "y").groupBy("machine").applyInArrow(solve, "machine string, w binary")
        weights = {r["machine"]: np.frombuffer(r["w"], np.float32) for r in solved.collect()}
    ws.drop(table)
    if not known:
        return None
    none = np.zeros(BUCKETS + 1, np.float32)
    first = np.stack([weights.get(f"family {k}", none) for k in range(len(families))])
    return Model(families, first, {pair: weights[f"pair {k}"] for k, pair in enumerate(pairs)})


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text, others ignored) -> (doc_id, held_out, lang_pred, score), a row per row. Null text, and text
    without a letter (or no model), is `und` with score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = sent.value

        def fn(cols):
            langs, scores = [], []
            for t in cols[2]:
                x = features(t) if m is not None else None
                lang, s = m.predict(x) if x is not None else ("und", 0.0)
                langs.append(lang)
                scores.append(s)
            yield [cols[0], cols[1], langs, scores]

        return fn

    rows = docs.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "text")
    return map_rows(rows, make, "doc_id bigint, held_out boolean, lang_pred string, score double")


def digest(docs: DataFrame) -> DataFrame:
    """The query's columns: trained on docs and predicted for all of them. Nulls, ties, repeated rows and empty tables as
    in train and predict."""
    return predict(docs, train(docs))
