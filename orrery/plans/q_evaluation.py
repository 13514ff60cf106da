"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions import vec
from orrery.operators import metrics as M
from orrery.operators import zips as Z
from orrery.plans.fixtures import RANKED, r, ranked, rs, table
from orrery.plans.registry import query


def _confused(spark, sf):
    """Line statuses as two classifiers' labels: y from the flag, p from the part."""
    l_ = table(spark, sf, "lineitem")
    p = F.when(F.col("l_partkey") % 3 == 0, "A").when(F.col("l_partkey") % 3 == 1, "N").otherwise("R")
    return l_.select(F.col("l_returnflag").alias("y"), p.alias("p"))


CONFUSED = "c AS (SELECT l_returnflag AS y, CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS p FROM lineitem)"


@query("confusion_matrix", f"WITH {CONFUSED} SELECT y, p, count(*) AS n, {rs('count(*) / sum(count(*)) OVER (PARTITION BY y)')} AS share FROM c GROUP BY y, p")
def confusion_matrix(spark, sf):
    return M.confusion_rates(_confused(spark, sf), "y", "p").select("y", "p", "n", r(F.col("share")).alias("share"))


@query("confusion_topk", f"WITH {CONFUSED} SELECT y, p, count(*) AS n FROM c WHERE y <> p GROUP BY y, p ORDER BY n DESC, y, p LIMIT 5")
def confusion_topk(spark, sf):
    return M.top_confusions(_confused(spark, sf), "y", "p", 5)


_REPORT = """t AS (SELECT y AS label, count(*) AS support, count(*) FILTER (WHERE y = p) AS hit FROM c GROUP BY y), s AS (SELECT p AS label, count(*) AS said FROM c GROUP BY p),
j AS (SELECT coalesce(t.label, s.label) AS label, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM t FULL JOIN s ON t.label = s.label),
m AS (SELECT label, CASE WHEN said > 0 THEN hit / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS rc, support FROM j),
f AS (SELECT *, CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END AS f1 FROM m)"""


def _report_rows(where: str = "") -> str:
    return f"""SELECT label, {rs('pr')} AS precision, {rs('rc')} AS recall, {rs('f1')} AS f1, CAST(support AS BIGINT) AS support FROM f {where}
UNION ALL SELECT NULL, {rs('sum(pr * support) / sum(support)')}, {rs('sum(rc * support) / sum(support)')}, {rs('sum(f1 * support) / sum(support)')}, CAST(sum(support) AS BIGINT) FROM f {where}"""


_NOT_BACKGROUND = "WHERE label <> 'N'"


def _rounded(df):
    return df.select("label", *[r(F.col(c)).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("class_report", f"WITH {CONFUSED}, {_REPORT} {_report_rows()}")
def class_report(spark, sf):
    return _rounded(M.report(_confused(spark, sf), "y", "p"))


@query("class_report_background", f"WITH c0 AS (SELECT l_returnflag AS y, CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS p FROM lineitem), c AS (SELECT * FROM c0 WHERE y <> 'N'), {_REPORT} {_report_rows(_NOT_BACKGROUND)}")
def class_report_background(spark, sf):
    return _rounded(M.report(_confused(spark, sf), "y", "p", background="N"))


@query("accuracy", f"WITH {CONFUSED} SELECT {rs('avg(CASE WHEN y = p THEN 1 ELSE 0 END)')} AS accuracy FROM c")
def accuracy(spark, sf):
    return M.accuracy(_confused(spark, sf), "y", "p").select(r(F.col("accuracy")).alias("accuracy"))


_CURVE = f"""WITH {RANKED}, g AS (SELECT score, count(*) FILTER (WHERE y = 1) AS p, count(*) FILTER (WHERE y <> 1) AS q FROM ranked GROUP BY score),
c AS (SELECT score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS np, sum(q) OVER () AS nn FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("pr_curve", f"{_CURVE} SELECT score, {rs('tp / (tp + fp)')} AS precision, {rs('tp / np')} AS recall FROM c")
def pr_curve(spark, sf):
    return M.pr_curve(ranked(spark, sf), [], "score", F.col("y") == 1).select("score", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"))


@query("pr_curve_ap", f"{_CURVE} SELECT {rs('sum((tp / np - coalesce(ltp / np, 0)) * tp / (tp + fp))')} AS ap FROM (SELECT *, lag(tp) OVER (ORDER BY score DESC) AS ltp FROM c)")
def pr_curve_ap(spark, sf):
    return M.average_precision(ranked(spark, sf), [], "score", F.col("y") == 1).select(r(F.col("ap")).alias("ap"))


@query("roc_curve", f"{_CURVE} SELECT score, {rs('fp / nn')} AS fpr, {rs('tp / np')} AS tpr FROM c")
def roc_curve(spark, sf):
    return M.roc_curve(ranked(spark, sf), [], "score", F.col("y") == 1).select("score", r(F.col("fpr")).alias("fpr"), r(F.col("tpr")).alias("tpr"))


@query("roc_auc", f"{_CURVE} SELECT {rs('sum((fp / nn - coalesce(lf / nn, 0)) * (tp / np + coalesce(lt / np, 0)) / 2)')} AS auc FROM (SELECT *, lag(tp) OVER (ORDER BY score DESC) AS lt, lag(fp) OVER (ORDER BY score DESC) AS lf FROM c)")
def roc_auc(spark, sf):
    return M.roc_auc(ranked(spark, sf), [], "score", F.col("y") == 1).select(r(F.col("auc")).alias("auc"))


_SCORES = "s AS (SELECT label AS y, label % 3 AS class_true, [abs(embedding[1]), abs(embedding[2]), abs(embedding[3])] AS scores FROM embeddings), e AS (SELECT class_true AS y, unnest([0, 1, 2]) AS class, unnest(scores) AS score FROM s)"


@query(
    "micro_macro_ap",
    f"""WITH {_SCORES}, p AS (SELECT class, CAST(score AS DOUBLE) AS score, y = class AS pos FROM e),
u AS (SELECT CAST(class AS VARCHAR) AS class, score, pos FROM p UNION ALL SELECT 'micro', score, pos FROM p),
g AS (SELECT class, score, count(*) FILTER (WHERE pos) AS p, count(*) FILTER (WHERE NOT pos) AS q FROM u GROUP BY ALL),
c AS (SELECT class, score, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS np FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC)),
a AS (SELECT class, sum((tp - coalesce(ltp, 0)) / np * tp / (tp + fp)) AS ap FROM (SELECT *, lag(tp) OVER (PARTITION BY class ORDER BY score DESC) AS ltp FROM c) GROUP BY class)
SELECT class, {rs("ap", 5)} AS ap FROM a UNION ALL SELECT 'macro', {rs("avg(ap)", 5)} FROM a WHERE class <> 'micro'""",
)
def micro_macro_ap(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = M.one_against_rest(e.select((F.col("label") % 3).alias("y"), F.array(*[F.abs(F.col("embedding")[i]).cast("double") for i in range(3)]).alias("s")), "y", "s", [0, 1, 2])
    return M.micro_macro(rows).select("class", r(F.col("ap"), 5).alias("ap"))


def _emb(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


E_SQL = "e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


@query("root_sift", f"WITH {E_SQL}, a AS (SELECT vec_id, list_transform(v, lambda x: abs(x)) AS v FROM e) SELECT vec_id, {rs('list_sum(list_transform(v, lambda x: sqrt(x / (list_sum(v) + 1e-7))))', 5)} AS total FROM a")
def root_sift(spark, sf):
    s = _emb(spark, sf).select("vec_id", vec.root_sift(F.transform("v", F.abs)).alias("s")).where(vec.is_finite(F.col("s")))
    return s.select("vec_id", r(F.aggregate("s", F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("embedding_cosine", f"WITH {E_SQL} SELECT a.vec_id, {rs('list_dot_product(a.v, b.v) / sqrt(list_dot_product(a.v, a.v) * list_dot_product(b.v, b.v))', 5)} AS cosine, {rs('list_distance(a.v, b.v)', 5)} AS distance FROM e a JOIN e b ON b.vec_id = a.vec_id + 1")
def embedding_cosine(spark, sf):
    e = _emb(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return e.join(b, "vec_id").select("vec_id", r(vec.cosine(F.col("v"), F.col("w")), 5).alias("cosine"), r(vec.array_distance(F.col("v"), F.col("w")), 5).alias("distance"))


_NEXT = f"WITH {E_SQL}, p AS (SELECT a.vec_id, CAST(a.label = b.label AS DOUBLE) AS same, list_distance(a.v, b.v) AS d, list_distance(a.v, c.v) AS d2, list_dot_product(a.v, b.v) AS ub, list_dot_product(a.v, c.v) AS uc FROM e a JOIN e b ON b.vec_id = a.vec_id + 1 JOIN e c ON c.vec_id = a.vec_id + 2)"


def _neighbours(spark, sf):
    e = _emb(spark, sf)
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("b"), F.col("label").alias("lb"))
    c = e.select((F.col("vec_id") - 2).alias("vec_id"), F.col("v").alias("c"))
    j = e.join(b, "vec_id").join(c, "vec_id")
    return j.select("vec_id", (F.col("label") == F.col("lb")).cast("double").alias("same"), vec.array_distance(F.col("v"), F.col("b")).alias("d"), vec.array_distance(F.col("v"), F.col("c")).alias("d2"), vec.array_dot(F.col("v"), F.col("b")).alias("ub"), vec.array_dot(F.col("v"), F.col("c")).alias("uc"))


@query("contrastive_loss", f"{_NEXT} SELECT {rs('avg(same * d * d + (1 - same) * greatest(10 - d, 0) * greatest(10 - d, 0))', 4)} AS loss FROM p")
def contrastive_loss(spark, sf):
    return _neighbours(spark, sf).agg(r(M.contrastive_loss(F.col("same"), F.col("d")), 4).alias("loss"))


@query("triplet_loss", f"{_NEXT} SELECT {rs('avg(greatest(0, d - d2 + 100))', 4)} AS loss, {rs('avg(1 - 1 / (1 + exp(-(ub - uc))))', 5)} AS bpr FROM p")
def triplet_loss(spark, sf):
    return _neighbours(spark, sf).agg(r(M.triplet_loss(F.col("d"), F.col("d2")), 4).alias("loss"), r(F.avg(M.bpr(F.col("ub"), F.col("uc"))), 5).alias("bpr"))


@query(
    "nearest_centroid",
    f"""WITH {E_SQL}, u AS (SELECT vec_id, label, unnest(v) AS x, unnest(range(64)) AS i FROM e), m AS (SELECT label, i, avg(x) AS x FROM u GROUP BY ALL),
c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label), d AS (SELECT e.vec_id, e.label AS y, c.label AS p, round(list_distance(e.v, c.c), 9) AS d FROM e, c)
SELECT vec_id, y, arg_min(p, (d, p)) AS p FROM d GROUP BY vec_id, y""",
)
def nearest_centroid(spark, sf):
    e = _emb(spark, sf)
    parts = e.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = parts.groupBy(F.col("label").alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("r")).select("p", F.transform("r", lambda t: t["x"]).alias("c"))
    # one centroid a label
    d = Z.with_all(e, c).withColumn("d", F.round(vec.array_distance(F.col("v"), F.col("c")), 9))
    return d.groupBy("vec_id", F.col("label").alias("y")).agg(F.min(F.struct("d", "p")).alias("m")).select("vec_id", "y", F.col("m.p").alias("p"))


@query("histogram", "SELECT i AS bin, count(e.value) AS n FROM range(20) t(i) LEFT JOIN events e ON least(greatest(floor(e.value / 25), 0), 19) = i GROUP BY i")
def histogram(spark, sf):
    return M.histogram(table(spark, sf, "events"), "value", 0.0, 500.0, 20)


@query("timing_report", f"SELECT event_type, count(*) AS calls, {rs('avg(value) * 1000', 4)} AS ms, {rs('1 / avg(value)', 6)} AS hz FROM events GROUP BY event_type")
def timing_report(spark, sf):
    t = M.timing(table(spark, sf, "events"), "event_type", "value")
    return t.select("event_type", "calls", r(F.col("ms"), 4).alias("ms"), r(F.col("hz")).alias("hz"))


#: Every seventh embedding is a word; images are the remainders of vec_id.
_WORDS = f"{E_SQL}, b AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS word, v AS c FROM e WHERE vec_id % 7 = 0 AND vec_id < 700), d AS (SELECT e.vec_id, b.word, e.v, b.c, list_distance(e.v, b.c) AS d FROM e, b), a AS (SELECT vec_id, arg_min(word, (d, word)) AS word, min(d) AS far FROM d GROUP BY vec_id)"


def _assigned(spark, sf):
    from orrery.operators import bow

    e = _emb(spark, sf)
    words = e.where("vec_id % 7 = 0 AND vec_id < 700").orderBy("vec_id").select("v").collect()  # a hundred at most
    book = bow.Codebook.of([list(r["v"]) for r in words])
    return bow.assign(e, "v", book, distance="far"), book


@query("bow_words", f"WITH {_WORDS} SELECT vec_id, CAST(word AS BIGINT) AS word, {rs('far', 6)} AS far FROM a")
def bow_words(spark, sf):
    """Each embedding's nearest of some given words, through the tree."""
    return _assigned(spark, sf)[0].select("vec_id", "word", r(F.col("far"), 6).alias("far"))


@query("bow_histograms", f"WITH {_WORDS}, h AS (SELECT vec_id % 20 AS image, CAST(word AS BIGINT) AS word, count(*) AS n FROM a GROUP BY ALL) SELECT image, word, n, {rs('n / CAST(sum(n) OVER (PARTITION BY image) AS DOUBLE)')} AS share FROM h")
def bow_histograms(spark, sf):
    from orrery.operators import bow

    got = bow.histograms(_assigned(spark, sf)[0].withColumn("image", F.col("vec_id") % 20), ["image"])
    return got.select("image", "word", "n", r(F.col("share")).alias("share"))


@query("bow_residuals", f"WITH {_WORDS}, u AS (SELECT d.vec_id % 20 AS image, d.word, unnest(range(3)) AS i, unnest([d.v[1] - d.c[1], d.v[2] - d.c[2], d.v[3] - d.c[3]]) AS x FROM d JOIN a ON a.vec_id = d.vec_id AND a.word = d.word) SELECT image, CAST(word AS BIGINT) AS word, CAST(i AS BIGINT) AS i, {rs('sum(x)', 5)} AS x FROM u GROUP BY ALL")
def bow_residuals(spark, sf):
    """Sums of differences from the words, the first three numbers of each."""
    from orrery.operators import bow

    got, book = _assigned(spark, sf)
    sums = bow.residuals(got.withColumn("image", F.col("vec_id") % 20), "v", book, ["image"])
    return sums.select("image", "word", F.posexplode(F.slice("sums", 1, 3)).alias("i", "x")).select("image", "word", F.col("i").cast("bigint").alias("i"), r(F.col("x"), 5).alias("x"))
