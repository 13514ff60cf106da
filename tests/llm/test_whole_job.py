"""Cases that bounds and gates inside the training-data operators once lost, and methods that must decide."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orrery.llm import decontam, quality, toxicity


def _made_items(rng, lengths):
    vectors = np.concatenate([rng.normal(size=(decontam.BUCKETS, 64)), np.zeros((1, 64))]).astype(np.float32)
    idf = np.ones(decontam.BUCKETS, np.float32)
    return vectors, [decontam.make_item(k, rng.permutation(np.arange(200 * k, 200 * k + n)).astype(np.uint32), idf) for k, n in enumerate(lengths)]


def test_items_of_all_lengths_are_near_their_windows():
    """Windows of the items' own sizes find items of any length in long texts, wherever they begin, as trying every passage does;
    with half of the words changed too, if the order check lets them pass."""
    rng = np.random.default_rng(4)
    vectors, items = _made_items(rng, (5, 8, 9, 16, 17, 25, 33, 48, 64))
    bench, changed_ones = decontam.Benchmark(items, vectors), 0
    for n in (0, 20, 64, 200, 500):
        for item in items:
            for changed in (0, 0.2, 0.4):
                words = np.array([w if rng.random() >= changed else rng.integers(3000, 30000) for w in item.tokens], np.uint32)
                around = rng.integers(3000, 30000, n).astype(np.uint32)
                at = int(rng.integers(0, n + 1))
                t = np.concatenate([around[:at], words, around[at:]])
                want = {}
                for x in items:
                    windows = [decontam._window(t, p, len(x.tokens)) for p in decontam.passages(len(t)).tolist()]
                    shares = [decontam.overlap(x, w) for w in windows if len(x.answer & set(w)) >= decontam.ANSWER * len(x.answer)]
                    if shares and max(shares) >= decontam.LCS:
                        want[x.item_id] = max(shares)
                got = decontam.match_document(t, bench, decontam.COSINE, decontam.LCS, decontam.ANSWER)
                assert {k: v[0] for k, v in got.items()} == want
                assert changed or got[item.item_id][0] == 1
                changed_ones += bool(changed and want)
    assert changed_ones > 40


def test_the_vectors_decide(spark):
    """Without latent vectors nothing is retrieved; with those of other terms, other things are; a higher bound finds less."""
    rng = np.random.default_rng(5)
    vectors, items = _made_items(rng, (20, 40))
    t = np.concatenate([rng.integers(3000, 30000, 90), items[0].tokens, rng.integers(3000, 30000, 90), items[1].tokens]).astype(np.uint32)
    found = lambda v, c=decontam.COSINE: set(decontam.match_document(t, decontam.Benchmark(items, v), c, decontam.LCS, decontam.ANSWER))
    assert found(vectors) == {0, 1}
    assert found(np.zeros_like(vectors)) == found(np.zeros_like(vectors), -1.0) == set()
    half = vectors.copy()
    half[items[1].tokens] = 0
    assert found(half) == {0} and found(vectors, 1.01) == set()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    counts = [decontam.contaminated(docs, bench, cosine=c).count() for c in (decontam.COSINE, 1.01)]
    assert counts[0] > counts[1] == 0


def test_stretches_of_long_items():
    """One rule for all lengths: an item longer than a passage is held where one of its stretches is."""
    n = decontam.PASSAGE
    for size in (1, n - 1, n, n + 1, 8 * n, 8 * n + 1):
        parts = decontam.pieces(np.arange(size, dtype=np.uint32))
        assert [len(p) for p in parts] == [min(n, size)] * len(parts) and set(np.concatenate(parts).tolist()) == set(range(size))
        assert all(b[0] - a[0] <= decontam.STRIDE for a, b in zip(parts, parts[1:]))


def test_quality_rules_of_a_rare_language(spark):
    """A language with labels enough gets its rules, however many labels the others have."""
    rare = 1300
    for others in (20_000, 1_400_000):
        rows = spark.range(rare + others).select(F.col("id").alias("_id"), F.when(F.col("id") < rare, "xx").otherwise("en").alias("_stratum"), (F.col("id") % 20 == 0).alias("bad"))
        symbols = F.when(F.col("bad"), 600).otherwise(0).cast("bigint")
        table = rows.select("_id", "_stratum", symbols.alias("_n_symbols"), *[F.lit(x).cast("bigint").alias(f"_{c}") for c, x in (("word_chars", 1000), ("n_words", 200), ("n_repeat_words", 0), ("n_capitals", 0), ("n_lines", 9), ("n_dup_lines", 0))], F.lit(False).alias("_base_failed"))
        labels = rows.select(F.col("_id").alias("doc_id"), (~F.col("bad")).cast("int").alias("quality"))
        got = {r["stratum"]: r["cutoffs"] for r in quality.cutoffs(table, labels).collect()}
        assert got == {"xx": {"symbols": 500}, "en": {"symbols": 500}}


def test_toxic_terms_of_few_texts_and_pairs():
    """Words of four texts each are learned, and a pair beside more than a thousand other terms."""
    rng = np.random.default_rng(2)
    fill = lambda: rng.integers(1000, 2500, 12).tolist()
    texts = [[j, *fill()] for j in range(100, 175) for _ in range(4)] + [fill() for _ in range(1200)]
    fm = toxicity.fit([np.unique(t).astype(np.int32) for t in texts], [1] * 300 + [0] * 1200)
    clean = [fm.margin(np.unique(fill())) for _ in range(75)]
    found = [fm.margin(np.unique([j, *fill()])) for j in range(100, 175)]
    assert np.mean([x > y for x in found for y in clean]) > 0.8
    pairs = [(int(rng.random() < 0.5), int(rng.random() < 0.5)) for _ in range(1600)]
    fm = toxicity.fit([np.unique([1] * a + [2] * b + fill()).astype(np.int32) for a, b in pairs], [a & b for a, b in pairs])
    one, two, both, none = (fm.margin(np.array(t, np.int32)) for t in ([1], [2], [1, 2], []))
    assert both - one - two + none > 0.5 and both > max(one, two)
