"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Documents are measured once. For each stratum (language) and rule, cutoffs on a fixed grid are tried from the most
lenient one on. Labelled documents are halved by a hash of doc_id. On the holdout half, a cutoff is certified if the
exact binomial test rejects "it rejects more than the allowed share of good documents": P(Bin(n, share) <= k) is
at most the level. Levels are corrected for all strata and rules (Bonferroni), and the grid of one rule is tested in
fixed sequence, up to its first failure, which costs no level. So with probability 1 - delta, no stratum loses more
than `alpha` of its good documents, of those that pass the base rules, to the rules together. Among certified cutoffs, the tuning half picks the one
that gains most: rejected bad documents less `weight` times rejected good ones, the more lenient in a tie; a rule
without gain isn't applied.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import Workspace, blank

SPACE = "[ \\t\\n\\x0B\\f\\r]+"

#: Per mille of the measure above which a rule rejects, lenient to strict.
GRIDS: dict[str, list[int]] = {
    "symbols": [500, 400, 300, 250, 200, 150, 100, 80, 60, 40],
    "duplicate_lines": [950, 900, 800, 700, 600, 500, 400, 300],
    "repeated_words": [950, 900, 800, 700, 600, 500, 400, 300],
    "word_length": [20000, 15000, 12000, 10000, 9000, 8000, 7000, 6500],
    "capitals": [900, 800, 700, 600, 500, 400, 300],
}


@dataclass(frozen=True)
class Policy:
    """alpha: share of good documents (of those that the base rules pass) that a stratum may lose. delta: chance of missing
    that. weight: bad documents that outweigh one good one. Strata whose own holdout can certify no cutoff at all
    (least_held) aren't tried."""

    alpha: float = 0.05
    delta: float = 0.1
    weight: int = 20
    grids: dict[str, list[int]] = field(default_factory=lambda: GRIDS)

    @property
    def least_held(self) -> int:
        """Good holdout rows that certify a cutoff which rejects none of them, with one stratum in all."""
        rules = len(self.grids)
        return math.ceil(math.log(self.delta / rules) / math.log1p(-self.alpha / rules))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash comes twice or more: sorts (hash, place), keeps those with an equal neighbour."""

    def of_sorted(s: Column) -> Column:
        twin = F.filter(s, lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"]))
        return F.size(F.array_distinct(F.flatten(F.transform(twin, lambda e: F.array(e["p"], e["p"] + 1, e["p"] + 2)))))

    placed = F.array_sort(F.transform(hashes, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), bind(placed, of_sorted)).otherwise(0)


def measures(text: Column) -> Column:
    """A struct of counts over the whole text; null text is empty.

    n_words, word_chars (code points in words), n_symbols (of #*$%&|<>), n_lines (with a word), n_dup_lines (of these,
    equal to an earlier one), n_repeat_words (in 3-word windows found twice or more), n_capitals.
    """
    text = blank(text)

    def of_words(w: Column) -> Column:
        joined = F.array_join(w, "")
        hashed = F.transform(w, lambda x: F.xxhash64(x))

        def windows(h: Column) -> Column:
            return F.when(F.size(h) >= 3, bind(F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))), _repeated)).otherwise(0)

        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(joined).cast("bigint").alias("word_chars"),
            F.length(F.regexp_replace(joined, "[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            F.length(F.regexp_replace(joined, "[^A-Z]+", "")).cast("bigint").alias("n_capitals"),
            bind(hashed, windows).cast("bigint").alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).cast("bigint").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = bind(F.array_remove(F.split(text, SPACE), ""), of_words)
    lines = bind(F.filter(F.split(text, "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")), of_lines)
    return F.struct(words.alias("w"), lines.alias("l"))


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """docs (doc_id, text, lang) -> doc_id, stratum, the counts and base_failed; and the columns in keep."""
    m = docs.select(*keep, F.col("doc_id").alias("_id"), F.coalesce("lang", F.lit("")).alias("_lang"), measures(F.col("text")).alias("_m"))
    m = m.select(*keep, F.col("_id"), F.col("_lang").alias("_stratum"), *[F.col(f"_m.w.{c}").alias(f"_{c}") for c in ("n_words", "word_chars", "n_symbols", "n_repeat_words", "n_capitals")], *[F.col(f"_m.l.{c}").alias(f"_{c}") for c in ("n_lines", "n_dup_lines")])
    failed = (F.col("_n_words") < 50) | (100 * F.col("_n_repeat_words") > 50 * F.col("_n_words"))
    return m.withColumn("_base_failed", failed)


def _rate(top: str, bottom: str) -> Column:
    """Whole per mille, 0 where there is nothing to divide by."""
    return F.when(F.col(bottom) > 0, F.expr(f"{top} * 1000 div {bottom}")).otherwise(F.lit(0).cast("bigint"))


def rates() -> dict[str, Column]:
    return {
        "symbols": _rate("_n_symbols", "_word_chars"),
        "duplicate_lines": _rate("_n_dup_lines", "_n_lines"),
        "repeated_words": _rate("_n_repeat_words", "_n_words"),
        "word_length": _rate("_word_chars", "_n_words"),
        "capitals": _rate("_n_capitals", "_word_chars"),
    }


def log_binomial_tail(n: Column, k: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), summed term by term in logarithms; for k < n."""
    odds, start = math.log(p / (1 - p)), n.cast("double") * math.log1p(-p)

    def add(acc: Column, i: Column) -> Column:
        term = acc["t"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(odds)
        top, low = F.greatest(acc["s"], term), F.least(acc["s"], term)
        return F.struct(term.alias("t"), (top + F.log1p(F.exp(low - top))).alias("s"))

    init = F.struct(start.alias("t"), start.alias("s"))
    terms = F.when(k >= 1, F.sequence(F.lit(1).cast("bigint"), F.greatest(k, F.lit(1)).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(terms, init, add, lambda acc: acc["s"])


def cutoffs(table: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """measured rows and labels (doc_id, quality) -> (stratum, cutoffs: map of rule to per mille). A label of 1 is good, of 0 bad, null none; a doc_id with several labels has the least."""
    share = policy.alpha / len(policy.grids)
    lab = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_lab")).agg(F.min("quality").alias("quality"))
    known = table.where("NOT _base_failed").join(lab, F.col("_id") == F.col("_lab"))
    steps = [F.struct(F.lit(r).alias("rule"), F.lit(len(g)).alias("grid"), sum((value > F.lit(c)).cast("int") for c in g).alias("over")) for r, g in policy.grids.items() for value in [rates()[r]]]
    half = F.when(F.substring(F.md5(F.col("_id").cast("string")), 1, 1) < "8", "tune").otherwise("hold")
    long = known.select("_stratum", half.alias("half"), (F.col("quality") > 0).alias("good"), F.explode(F.array(*steps)).alias("s"))
    n = long.groupBy("_stratum", "s.rule", "s.grid", "half", "good", "s.over").agg(F.count("*").alias("n"))
    # every row is counted once a rule
    own = F.sum(F.when((F.col("half") == "hold") & F.col("good"), F.col("n")).otherwise(0)) / len(policy.grids)
    listed = n.groupBy("_stratum").agg(own.alias("own")).where(F.col("own") >= policy.least_held).select(F.col("_stratum").alias("stratum"))
    n = n.join(listed, n["_stratum"] == listed["stratum"]).select("stratum", "rule", "grid", "half", "good", "over", "n")
    is_hold, is_good = F.col("half") == "hold", F.col("good")
    every = n.groupBy("stratum", "rule").agg(F.sum(F.when(is_hold & is_good, F.col("n")).otherwise(0)).alias("held"))
    tests = every.agg(F.count("*").alias("tests"))
    at = n.where("over > 0").select("stratum", "rule", "half", "good", "n", F.explode(F.sequence(F.col("grid") - F.col("over"), F.col("grid") - 1)).alias("at"))
    hits = at.groupBy("stratum", "rule", "at").agg(
        F.sum(F.when(is_hold & is_good, F.col("n")).otherwise(0)).alias("k"),
        F.sum(F.when(~is_hold & ~is_good, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(~is_hold & is_good, F.col("n")).otherwise(0)).alias("good"),
    )
    tried = every.crossJoin(F.broadcast(tests)).select("stratum", "rule", "held", "tests", F.explode(_grid_places(policy)).alias("g")).where("g.rule = rule").select("stratum", "rule", "held", "tests", F.col("g.at").alias("at"), F.col("g.cut").alias("cut"))
    tried = tried.withColumnRenamed("stratum", "_s2").withColumnRenamed("rule", "_r2").withColumnRenamed("at", "_a2")
    joined = tried.join(hits, (F.col("_s2") == F.col("stratum")) & (F.col("_r2") == F.col("rule")) & (F.col("_a2") == F.col("at")), "left")
    k = F.coalesce("k", F.lit(0)).cast("bigint")
    safe = (F.col("held") > 0) & (k < F.col("held") * share) & (log_binomial_tail(F.col("held"), F.when(k < F.col("held") * share, k).otherwise(0), share) <= F.lit(math.log(policy.delta)) - F.log(F.col("tests").cast("double")))
    judged = joined.select(F.col("_s2").alias("stratum"), F.col("_r2").alias("rule"), F.col("_a2").alias("at"), "cut", safe.alias("safe"), (F.coalesce("bad", F.lit(0)) - policy.weight * F.coalesce("good", F.lit(0))).alias("gain"))
    # the grid of a rule is short, so its rows may meet
    rows = judged.groupBy("stratum", "rule").agg(F.array_sort(F.collect_list(F.struct("at", "cut", "safe", "gain"))).alias("g"))
    stop = F.coalesce(F.array_position(F.transform("g", lambda e: e["safe"]), F.lit(False)), F.lit(0))
    certified = F.when(stop > 0, F.slice("g", F.lit(1), (stop - 1).cast("int"))).otherwise(F.col("g"))
    best = F.array_max(F.transform(certified, lambda e: F.struct(e["gain"].alias("gain"), (-e["at"]).alias("at"), e["cut"].alias("cut"))))
    chosen = rows.select("stratum", "rule", best.alias("best")).where("best.gain > 0")
    return chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "best.cut"))).alias("cutoffs"))


def _grid_places(policy: Policy) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(i).alias("at"), F.lit(c).alias("cut")) for r, g in policy.grids.items() for i, c in enumerate(g)])


def verdicts(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """measured rows with _kept: not failed, and no rule of the stratum above its cutoff. cuts has a row
    for each stratum with rules; whether it is broadcast is left to its written size."""
    own = cuts.select(F.col("stratum").alias("_s"), F.col("cutoffs").alias("_cuts"))
    hit = F.lit(False)
    for rule, value in rates().items():
        hit = hit | F.coalesce(value > F.element_at(F.col("_cuts"), rule), F.lit(False))
    joined = table.join(own, F.col("_stratum") == F.col("_s"), "left")
    return joined.withColumn("_kept", ~F.col("_base_failed") & ~hit).drop("_s", "_cuts")


def judge(docs: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """docs (doc_id, text, lang), labels (doc_id, quality) -> a row per row of docs: doc_id, the counts, base_failed, kept.

    Null text is empty (it fails the base), null lang is a stratum of its own, empty labels certify nothing: then only
    the base rejects. Strata too small for labels of their own have no rules. Other columns are ignored.
    """
    ws = Workspace(docs.sparkSession)
    table = ws.save(measured(docs), "measures")
    cuts = ws.save(cutoffs(table, labels, policy), "cutoffs")
    out = verdicts(table, cuts)
    return out.select(F.col("_id").alias("doc_id"), *[F.col(f"_{c}").alias(c) for c in COUNTS], F.col("_base_failed").alias("base_failed"), F.col("_kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names. Each row is written once with
    its measures: the cutoffs read the measures alone, and the filter reads the rows again without measuring or
    shuffling texts. Repeated rows are judged each; an empty table gives an empty one. Nulls as in judge.
    """
    ws = Workspace(docs.sparkSession)
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns])
    table = ws.save(measured(docs.withColumn("_row", row), "_row"), "measured")
    cuts = ws.save(cutoffs(table, labels, policy), "cutoffs")
    return verdicts(table, cuts).where("_kept").select("_row.*")
