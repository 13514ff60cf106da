"""Evaluation of classifiers and rankings, as aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def confusion(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.groupBy(F.col(y).alias("y"), F.col(p).alias("p")).agg(F.count("*").alias("n"))


def confusion_rates(df: DataFrame, y: str, p: str) -> DataFrame:
    """Counts with each row's share of its true class."""
    c = confusion(df, y, p)
    return c.withColumn("share", F.try_divide(F.col("n"), F.sum("n").over(Window.partitionBy("y"))))


def top_confusions(df: DataFrame, y: str, p: str, most: int = 20, drop_diagonal_first: bool = True) -> DataFrame:
    """The commonest mistakes. drop_diagonal_first=False takes the top cells first and then drops right answers."""
    c = confusion(df, y, p)
    order = [F.col("n").desc(), F.col("y"), F.col("p")]
    if drop_diagonal_first:
        return c.where("y <> p").orderBy(*order).limit(most)
    return c.orderBy(*order).limit(most).where("y <> p")


def accuracy(df: DataFrame, y: str, p: str) -> DataFrame:
    return df.agg(F.avg((F.col(y) == F.col(p)).cast("double")).alias("accuracy"))


def report(df: DataFrame, y: str, p: str, background=None) -> DataFrame:
    """(label, precision, recall, f1, support) per label, 0 where undefined, and a row without label: their averages by
    support. background leaves out rows of that true label, and the label."""
    if background is not None:
        df = df.where(F.col(y) != F.lit(background))
    c = confusion(df, y, p)
    truth = c.groupBy(F.col("y").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0)).alias("hit"))
    said = c.groupBy(F.col("p").alias("label")).agg(F.sum("n").alias("said"))
    both = truth.join(said, "label", "full").fillna(0, ["support", "hit", "said"])
    if background is not None:
        both = both.where(F.col("label") != F.lit(background))
    pr = F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0))
    rc = F.coalesce(F.try_divide(F.col("hit"), F.col("support")), F.lit(0.0))
    per = both.select("label", pr.alias("precision"), rc.alias("recall"), "support").withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    weigh = lambda v: F.coalesce(F.try_divide(F.sum(F.col(v) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(v)
    kind = per.schema["label"].dataType
    total = per.agg(weigh("precision"), weigh("recall"), weigh("f1"), F.sum("support").alias("support")).withColumn("label", F.lit(None).cast(kind))
    return per.select("label", "precision", "recall", "f1", "support").unionByName(total.select("label", "precision", "recall", "f1", "support"))


#: Blocks of scores that a curve is cut into.
CUTS = 256


def _by_score(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives at each distinct score (p, q), and running (tp, fp) from the top. Ties are counted together first.
    Scores are cut into blocks at approximate quantiles; running counts are those of the block and of the blocks above it,
    so no task holds all of a curve's scores."""
    ties = df.groupBy(*by, F.col(score).alias("score")).agg(F.count_if(positive).alias("p"), F.count_if(~positive).alias("q"))
    key = F.col("score").cast("double")
    shares = [(i + 1) / CUTS for i in range(CUTS - 1)]
    marks = sorted(set(df.agg(F.percentile_approx(F.col(score).cast("double"), shares, 10_000)).first()[0] or []))
    block = F.size(F.filter(F.array(*[F.lit(m) for m in marks]).cast("array<double>"), lambda m: m < key)) if marks else F.lit(0)
    cut = ties.withColumn("_block", F.when(key.isNull(), -1).otherwise(block))
    # at most CUTS + 1 rows a curve
    sums = cut.groupBy(*by, "_block").agg(F.sum("p").alias("p"), F.sum("q").alias("q"))
    above = Window.partitionBy(*by).orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    before = [F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"_{c}") for c in "pq"]
    sums = sums.select(*by, "_block", *before, F.sum("p").over(whole).alias("_P_all"), F.sum("q").over(whole).alias("_N_all"))
    inner = Window.partitionBy(*by, "_block").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    run = cut.select(*by, "_block", "score", "p", "q", F.sum("p").over(inner).alias("_tp"), F.sum("q").over(inner).alias("_fp"))
    on = F.lit(True)
    for c in [*by, "_block"]:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    joined = run.alias("r").join(sums.alias("s"), on)
    return joined.select(*[F.col(f"r.{c}") for c in by], "score", "r.p", "r.q", (F.col("_tp") + F.col("_p")).alias("tp"), (F.col("_fp") + F.col("_q")).alias("fp"), F.col("_P_all").alias("pos"), F.col("_N_all").alias("neg"))


def pr_curve(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """(score, precision, recall) at each distinct score."""
    c = _by_score(df, by, score, positive)
    return c.select(*by, "score", (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.coalesce(F.try_divide(F.col("tp"), F.col("pos")), F.lit(0.0)).alias("recall"))


def average_precision(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Sum of recall steps times precision."""
    c = _by_score(df, by, score, positive)
    step = F.coalesce(F.try_divide(F.col("p"), F.col("pos")), F.lit(0.0))
    return c.groupBy(*by).agg(F.sum(step * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("ap"))


def roc_curve(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    c = _by_score(df, by, score, positive)
    return c.select(*by, "score", F.try_divide("fp", "neg").alias("fpr"), F.try_divide("tp", "pos").alias("tpr"))


def roc_auc(df: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Trapezoids under the curve; null without both classes."""
    c = _by_score(df, by, score, positive)
    # a step is as wide as its negatives' share, as high as the true positives before and with it in the mean
    area = F.try_divide(F.col("q"), F.col("neg")) * F.try_divide(2 * F.col("tp") - F.col("p"), 2 * F.col("pos"))
    return c.groupBy(*by).agg(F.sum(area).alias("auc"))


def one_against_rest(df: DataFrame, y: str, scores: str, classes: Sequence) -> DataFrame:
    """Scores (an array in the order of classes) as rows (class, score, positive)."""
    ids = F.array(*[F.lit(c) for c in classes])
    each = F.explode(F.zip_with(ids, F.col(scores), lambda c, s: F.struct(c.alias("class"), s.alias("score"))))
    return df.select(F.col(y).alias("_y"), each.alias("e")).select("e.class", "e.score", (F.col("_y") == F.col("e.class")).alias("positive"))


def micro_macro(rows: DataFrame) -> DataFrame:
    """rows (class, score, positive) -> (class, ap) for each class with a positive, and rows 'micro' and 'macro'."""
    present = rows.groupBy("class").agg(F.count_if("positive").alias("n")).where("n > 0").select("class")
    rows = rows.join(present, "class")
    per = average_precision(rows, ["class"], "score", F.col("positive")).select(F.col("class").cast("string").alias("class"), "ap")
    micro = average_precision(rows.withColumn("_all", F.lit(0)), ["_all"], "score", F.col("positive")).select(F.lit("micro").alias("class"), "ap")
    macro = per.agg(F.avg("ap").alias("ap")).select(F.lit("macro").alias("class"), "ap")
    return per.unionByName(micro).unionByName(macro)


# losses


def contrastive_loss(same: Column, d: Column, margin: float = 10.0) -> Column:
    far = F.greatest(F.lit(margin) - d, F.lit(0.0))
    return F.avg(same * d * d + (1 - same) * far * far)


def triplet_loss(dp: Column, dn: Column, margin: float = 100.0) -> Column:
    return F.avg(F.greatest(F.lit(0.0), dp - dn + margin))


def identity_loss(predicted: Column) -> Column:
    """The mean of what the model gives, whatever the truth: for models that compute their loss themselves."""
    return F.avg(predicted)


def bpr(up: Column, un: Column) -> Column:
    """1 - sigmoid(u.p - u.n)."""
    return 1 - 1 / (1 + F.exp(-(up - un)))


def histogram(df: DataFrame, column: str, lo: float, hi: float, bins: int) -> DataFrame:
    """(bin, n) with equal widths; values outside go to the end bins; empty bins are there with 0."""
    b = F.least(F.greatest(F.floor((F.col(column) - lo) / ((hi - lo) / bins)), F.lit(0)), F.lit(bins - 1)).cast("bigint")
    counts = df.where(F.col(column).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def timing(df: DataFrame, name: str, seconds: str) -> DataFrame:
    """Calls, mean milliseconds and rate of named sections."""
    return df.groupBy(name).agg(F.count("*").alias("calls"), (F.avg(seconds) * 1000).alias("ms"), F.try_divide(F.lit(1.0), F.avg(seconds)).alias("hz"))
