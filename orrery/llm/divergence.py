"""How far the sources of a language lie apart in their terms.

Every group (a source within a language) gives each term that the language keeps a smoothed probability; the distance of
two probabilities is their triangular discrimination, in whole billionths. Two parts come out:

* `pair`: each source against each other source of the language, summed over all kept terms. Postings of a block of terms
  meet the sources that they can touch, a tile of sources against a tile; absent terms are the constant that the whole
  vocabulary would give, so that only postings are worked on.
* `term`: the group's terms that stand out most against the whole language, by an upper-bound search. A group's terms fall
  into buckets by count. The greatest probability in a bucket and the least that the language gives any of its terms bound
  what the bucket can hold; buckets are evaluated best first, until the bounds of all unseen ones are strictly below the
  tenth value found.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, blank, small_batches

#: Documents of a language that a kept term is in at least; terms listed for a group.
LEAST_DOCS, TOP = 10, 10
#: Whole probability, in the unit of p and q.
UNIT = 1_000_000_000
#: Entries of a task's counts before they are sent on; sources of a tile and terms of a block, about.
HELD, TILE, TERMS = 400_000, 128, 512
#: Counts below this have a bucket each; above, eight buckets share a doubling.
EXACT = 32

#: A-Z to a-z, all other ASCII to blanks. Bytes over 127 belong to terms.
_TERMS = bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalpha() else b if b >= 128 else 32 for b in range(256))


def terms(text: str) -> list[bytes]:
    return text.encode().translate(_TERMS).split()


def _counted(batches) -> Iterator:
    """Adds up a task's documents before anything is sent: (lang, source, term, n, docs). A row without term tells that the
    group occurs."""
    import pyarrow as pa

    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def flush():
        for group, found in n.items():
            inside = docs[group]
            keys = list(found)
            yield pa.RecordBatch.from_arrays(
                [pa.array([group[0]] * (len(keys) + 1)), pa.array([group[1]] * (len(keys) + 1)), pa.array([*(k.decode() for k in keys), None], pa.string()), pa.array([*found.values(), 0], pa.int64()), pa.array([*(inside[k] for k in keys), 0], pa.int64())],
                ["lang", "source", "term", "n", "docs"],
            )
        n.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found = terms(text)
            n[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, n.values())) > HELD:
            yield from flush()
    yield from flush()


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term in each group; one row with a null term says
    that the group occurs. Null text, lang and source are empty."""
    small_batches(docs.sparkSession)
    rows = docs.select(blank(F.col("lang")).alias("lang"), blank(F.col("source")).alias("source"), blank(F.col("text")).alias("text"))
    parts = rows.mapInArrow(_counted, "lang string, source string, term string, n bigint, docs bigint")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(UNIT * (n + 2) / (total + 2 * kept)), exact: decimals hold what a long can't."""
    wide = lambda c: c.cast("decimal(20,0)")
    return F.call_function("div", F.lit(UNIT).cast("decimal(10,0)") * wide(n + 2), wide(total + 2 * kept)) + 1


def distance(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); squares of billionths fit a long."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def bucket(n: Column) -> Column:
    """The count's bucket: small counts exactly, others by eighths of a doubling. Any cut gives the same result."""
    return F.when(n < EXACT, n).otherwise(EXACT + F.floor(8 * F.log2(n / EXACT))).cast("int")


class Audit:
    """The written tables of one audit: kept terms by language, groups with their totals, and postings."""

    def __init__(self, docs: DataFrame, least_docs: int = LEAST_DOCS):
        self.ws = ws = Workspace(docs.sparkSession)
        found = ws.save(counts(docs), "counts")
        kept = found.where("term IS NOT NULL").groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs).drop("docs")
        kept = ws.save(kept, "kept")
        post = ws.save(found.where("term IS NOT NULL").select("lang", "source", "term", "n").join(kept, ["lang", "term"]), "kept_counts")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint")).alias(c)
        langs = kept.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
        totals = post.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = found.where("term IS NULL").select("lang", "source").join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
        groups = groups.select("lang", "source", zero("total"), zero("kept"), zero("lang_total"))
        # p of a term that the group lacks; without kept terms there is none
        self.groups = ws.save(groups.withColumn("p0", F.when(F.col("kept") > 0, probability(F.lit(0), F.col("total"), F.col("kept")))), "groups")
        with_totals = post.join(self.groups, ["lang", "source"])
        p, q = probability(F.col("n"), F.col("total"), F.col("kept")), probability(F.col("lang_n"), F.col("lang_total"), F.col("kept"))
        self.postings = ws.save(with_totals.select("lang", "source", "term", p.alias("p"), q.alias("q"), bucket(F.col("n")).alias("bucket")), "postings")
        ws.drop(found, kept, post)


def standing_out(audit: Audit, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): of each group's terms with p > q the `top` of the greatest distance to the
    language, ties by the term's UTF-8.

    Distance grows with p and falls with q while p > q, so (greatest p, least q) bounds a bucket. The first round
    evaluates the best buckets that hold `top` terms together; each later one twice as many as the last, of the groups
    whose next bound may still enter.
    """
    ws, key = audit.ws, ["lang", "source"]
    ends = audit.postings.groupBy(*key, "bucket").agg(F.max("p").alias("p"), F.min("q").alias("q"), F.count_if(F.col("p") > F.col("q")).alias("n"))
    order = Window.partitionBy(*key).orderBy(F.desc("bound"), "bucket")  # a group has some five hundred buckets at most
    bounds = ends.where("p > q").withColumn("bound", distance(F.col("p"), F.col("q")))
    bounds = bounds.withColumn("place", F.row_number().over(order)).withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    bounds = ws.save(bounds.select(*key, "bucket", "bound", "place", F.coalesce("before", F.lit(0)).alias("before")), "bounds")
    best = Window.partitionBy(*key).orderBy(F.desc("value"), "item")
    found, todo, step = None, bounds.where(F.col("before") < top), 0
    while True:
        fresh = audit.postings.where("p > q").join(todo.select(*key, "bucket"), [*key, "bucket"]).select(*key, F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
        pool = fresh if found is None else found.drop("rank").union(fresh)
        new = ws.save(pool.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top), "found")
        seen = todo.groupBy(*key).agg(F.max("place").alias("upto"))
        old, state = (None, seen) if step == 0 else (state, state.withColumnRenamed("upto", "was").join(seen, key, "left").select(*key, F.coalesce("upto", "was").alias("upto")))
        state = ws.save(state, "state")
        # groups go on whose next bound is not strictly below the last value of a full list
        worst = new.groupBy(*key).agg(F.max("rank").alias("n"), F.min("value").alias("kth"))
        open_ = bounds.join(state, key).join(worst, key).where((F.col("place") > F.col("upto")) & ((F.col("n") < top) | (F.col("bound") >= F.col("kth"))))
        ws.drop(found, old, todo if step else None)
        found, step = new, step + 1
        todo = ws.save(open_.where(F.col("place") <= F.col("upto") + (1 << step)).select(*bounds.columns), "todo")
        if todo.isEmpty():
            ws.drop(bounds, todo, state)
            return found


def _tile_sums(key: tuple, postings: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
    """Distances of all pairs of sources of two tiles over one block of terms, less what the pair would give if it lacked
    them all; that constant times the vocabulary is added once."""
    _, i, j, block = key
    sources = sources.sort_values(["tile", "source"], ignore_index=True)
    names, p0 = sources["source"].tolist(), sources["p0"].fillna(1).to_numpy(np.int64)
    left, right = (np.flatnonzero(sources["tile"] == t) for t in (i, j))
    apart = lambda p, q: (p - q) ** 2 // (p + q)
    base = apart(p0[:, None], p0[None, :])
    sums = np.zeros_like(base)  # of what each source's own postings add
    if len(postings):
        rows, inverse = np.unique(postings["term"].to_numpy(), return_inverse=True)
        at = postings["source"].map({s: k for k, s in enumerate(names)}).to_numpy()
        table, there = np.tile(p0, (len(rows), 1)), np.zeros((len(rows), len(names)), bool)
        table[inverse, at], there[inverse, at] = postings["p"], True
        for a in range(len(names)):
            mine = np.flatnonzero(there[:, a])
            more = apart(table[mine, a][:, None], table[mine]) - base[a]
            more[:, :a][there[mine, :a]] = 0  # the other source has added it
            sums[a] += more.sum(0)
    whole = sums + sums.T
    if block == 0:
        whole += base * int(sources["kept"].iloc[0])
    a, b = np.meshgrid(left, right, indexing="ij")
    a, b = (x[a < b] for x in (a, b))
    text = lambda x: pd.Series(x, dtype=object)
    return pd.DataFrame({"lang": text([key[0]] * len(a)), "a": text([names[k] for k in a]), "b": text([names[k] for k in b]), "value": whole[a, b]})


def apart(audit: Audit) -> DataFrame:
    """(lang, source, item, value): each source against each other of its language, over all kept terms.

    Sources fall into tiles by hash, terms into blocks; a task works on the postings of one block and two tiles, some
    hundred thousand at most. The result has a row a pair by itself, and sends one number a pair and block.
    """
    tile = lambda n: F.pmod(F.xxhash64("source"), F.ceil(F.col(n) / TILE)).cast("int")
    sizes = audit.groups.groupBy("lang").agg(F.count("*").alias("sources"), F.ceil(F.max("kept") / TERMS).alias("blocks"))
    sizes = sizes.withColumn("blocks", F.greatest("blocks", F.lit(1))).where("sources > 1")
    tiles = F.ceil(F.col("sources") / TILE).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("tiles") - 1), lambda x: F.struct(F.least(x, F.col("tile")).alias("i"), F.greatest(x, F.col("tile")).alias("j")))
    spread = lambda df: df.join(sizes, "lang").withColumn("tile", tile("sources")).withColumn("tiles", tiles).withColumn("ij", F.explode(pairs)).select("*", "ij.i", "ij.j")
    heads = spread(audit.groups.select("lang", "source", "kept", "p0")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1))).select("lang", "i", "j", "block", "tile", "source", "kept", "p0")
    rows = spread(audit.postings.select("lang", "source", "term", "p")).select("lang", "i", "j", F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"), "source", "term", "p")
    key = ["lang", "i", "j", "block"]
    sums = rows.groupBy(*key).cogroup(heads.groupBy(*key)).applyInPandas(_tile_sums, "lang string, a string, b string, value bigint")
    total = sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return total.select("lang", "value", both.alias("_p")).select("lang", "_p.source", "_p.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """docs(text, lang, source) -> lang, source, part, item, value, rank.

    Null text, lang and source are empty strings. Each row counts as a document, repeated ones too. A source that is
    alone in its language has no `pair` rows, a group without a kept term above the language's no `term` rows; pairs of
    a language that keeps no term are 0 apart. Equal values are ranked by item in UTF-8 order. Other columns are
    ignored, and an empty table gives an empty result.
    """
    a = Audit(docs, least_docs)
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = apart(a).withColumn("rank", place).select("lang", "source", F.lit("pair").alias("part"), "item", "value", "rank")
    return pairs.union(standing_out(a, top).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
