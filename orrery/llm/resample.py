"""Importance resampling towards a target distribution of hashed word runs.

The sparse matrix of documents by buckets is written once, as blocks of compressed rows (CSR): a table row is a block with
its documents, the places where each document's entries begin, and the buckets and counts of the entries. Sums over its
columns give the distribution of the corpus, those of the target's matrix the target's; the gains of the buckets come from
both, and the product of the matrix with the vector of gains gives each document's weight. Gumbel noise by a hash of doc_id
makes the highest scores a draw without replacement.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, map_rows, small_batches

#: Buckets of features. The vectors of counts and gains have so many entries: the bound of what is broadcast.
BUCKETS = 10_000
#: Documents with fewer words are never drawn; share that is drawn, in hundredths; the draw's seed.
LEAST_WORDS, PERCENT, SEED = 20, 25, 7
#: Entries after which a block ends; a document is never cut.
BLOCK = 1 << 14
MATRIX = "docs array<bigint>, n_words array<bigint>, starts array<bigint>, buckets array<int>, counts array<bigint>"
#: Readers and writers hold whole row groups, so these are small: their memory doesn't grow with the corpus. Groups are
#: measured after this many rows.
ROW_GROUP = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "10", "parquet.page.size.row.check.max": "50", "parquet.block.row.count.limit": "100"}

#: A-Z to a-z; ASCII other than letters and digits to blanks. Bytes over 127 belong to words.
_WORDS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_WORDS).split()


def features(found: list[bytes], buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of all words and of all pairs of neighbours: crc32 of a pair goes on from its first word's."""
    one = list(map(zlib.crc32, found))
    two = [zlib.crc32(b" " + w, c) for c, w in zip(one, found[1:])]
    return np.array(one + two, np.uint32) % np.uint32(buckets)


def _block(docs: list, sizes: list[int], parts: list[np.ndarray], buckets: int) -> list:
    rows = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    cells, counts = np.unique(rows * buckets + np.concatenate(parts), return_counts=True)
    starts = np.searchsorted(cells, np.arange(len(parts) + 1) * buckets)
    return [[docs], [sizes], [starts], [(cells % buckets).astype(np.int32)], [counts]]


def matrix(docs: DataFrame, doc_id: Column, buckets: int = BUCKETS) -> DataFrame:
    """Blocks of the matrix of all rows of docs, with the whole `text` of each; null text has no entries."""

    def make():
        def fn(cols):
            ids, sizes, parts, n = [], [], [], 0
            for i, t in zip(*cols, strict=True):
                found = words(t)
                ids.append(i)
                sizes.append(len(found))
                parts.append(features(found, buckets))
                n += len(parts[-1])
                if n >= BLOCK:
                    yield _block(ids, sizes, parts, buckets)
                    ids, sizes, parts, n = [], [], [], 0
            if ids:
                yield _block(ids, sizes, parts, buckets)

        return fn

    return map_rows(docs.select(doc_id.cast("bigint").alias("_doc"), "text"), make, MATRIX)


def column_sums(blocks: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): the matrix's sums by column. Each task adds up its blocks and sends one vector."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (c.flatten().to_numpy() for c in b.columns)
            np.add.at(total, at, n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["bucket", "n"])

    sums = blocks.select("buckets", "counts").mapInArrow(run, "bucket int, n bigint")
    return sums.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """A thousandth's logarithm of how much likelier the target has each bucket, one added to each count."""
    s, t = F.coalesce("s", F.lit(0)).cast("double"), F.coalesce("t", F.lit(0)).cast("double")
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    both = both.join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
    sums = both.agg(F.coalesce(F.sum("s"), F.lit(0)).cast("double").alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).cast("double").alias("all_t"))
    ratio = (t + 1) * (F.col("all_s") + buckets) / ((s + 1) * (F.col("all_t") + buckets))
    rows = both.join(sums).select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect()  # as many as buckets
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["gain"]
    return out


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc, n_words, n_features, weight): the matrix times the gains, divided by the features; none weigh 0."""
    small_batches(blocks.sparkSession)

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            # a block's entries stay numbers in Arrow's own memory
            ids, *numbers = b.columns
            for docs, sizes, starts, at, n in zip((x.values for x in ids), *([x.values.to_numpy() for x in c] for c in numbers), strict=True):
                total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[starts])  # noqa: E731, B023
                size, gained = total(n), total(n * gain[at])
                yield pa.RecordBatch.from_arrays([docs, pa.array(sizes), pa.array(size), pa.array(gained // np.maximum(size, 1))], ["doc", "n_words", "n_features", "weight"])

    return blocks.select("docs", "n_words", "starts", "buckets", "counts").mapInArrow(run, "doc bigint, n_words bigint, n_features bigint, weight bigint")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, by sha256 of seed and doc_id (null counts as empty)."""
    h = F.conv(F.substring(F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """Adds rank: 1, 2, ... from the highest score (ties: smaller doc, null last) among the percent drawn of the eligible
    rows; null for others. scored must be a written table. Scores are thousandths of logarithms, so their histogram has
    some hundred thousand rows at most, whatever the corpus: it places the scores, and rows are numbered within each."""
    rows = scored.withColumn("_in", eligible)
    # logarithms of counts below 2^63 and the noise of 32 bits bound the histogram
    histogram = rows.where("_in").groupBy("score").agg(F.count("*").alias("_n"))
    down, every = Window.orderBy(F.desc("score")), Window.partitionBy()
    before = F.coalesce(F.sum("_n").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = histogram.select(F.col("score").alias("_score"), before.alias("_before"), F.floor(F.sum("_n").over(every) * percent / 100).alias("_drawn")).where("_before < _drawn")
    placed = rows.join(places, rows["_in"] & (rows["score"] == F.col("_score")), "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_in", "score").orderBy(F.col("doc").asc_nulls_last(), "n_features", "weight"))
    return placed.withColumn("rank", place.cast("bigint")).withColumn("rank", F.when(F.col("_in") & (F.col("rank") <= F.col("_drawn")), F.col("rank"))).select(*scored.columns, "rank")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """docs(doc_id, text) and target(text) -> doc_id, n_features, weight, score, rank, a row for each row of docs.

    Null and empty texts have no features and weigh 0. Rows with one doc_id are ranked each by itself (they share the
    noise, so copies score alike and get neighbouring ranks); a row without doc_id takes the noise of the empty id
    and comes last among equal scores. Other columns are ignored. Empty documents give no rows; an empty target leaves
    the gains to the corpus alone. All rows count in the sums, also those too short to be drawn.
    """
    ws = Workspace(docs.sparkSession)
    corpus, aim = ws.save(matrix(docs, F.col("doc_id")), "matrix", options=ROW_GROUP), ws.save(matrix(target, F.lit(None)), "target", options=ROW_GROUP)
    gain = gains(column_sums(corpus), column_sums(aim))
    scored = ws.save(weights(corpus, gain).withColumn("score", F.col("weight") + noise(F.col("doc"), seed)), "scores")
    ws.drop(corpus, aim)
    out = ranked(scored, F.col("n_words") >= least_words, percent)
    return out.select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")
