"""Classifiers over feature arrays on pyspark.ml, incremental logistic steps, and a minimiser whose cost is a Spark aggregate."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, MultilayerPerceptronClassifier, OneVsRest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import ParamGridBuilder, TrainValidationSplit
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.operators import metrics

#: Penalties tried for margins, as C of a support vector machine (fixed values).
GRID = [0.01, 0.1, 1.0, 10.0, 100.0]


class HistogramClassifier:
    """kind: svm (one against the rest, calibrated by a logistic fit on margins), sgd (logistic) or mlp (two hidden layers of
    256). Labels are any values: their ids are their places in `classes`."""

    def __init__(self, classes: Sequence, kind: str = "svm", seed: int = 0):
        if kind not in ("svm", "sgd", "mlp"):
            raise ValueError(f"unknown classifier {kind!r}")
        self.classes, self.kind, self.seed, self.model, self.steps = list(classes), kind, seed, None, None

    def _ids(self, df: DataFrame, y: str) -> DataFrame:
        place = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(y)) - 1
        return df.withColumn("label", place.cast("double")).where("label >= 0")

    def _features(self, df: DataFrame, x: str) -> DataFrame:
        return df.withColumn("features", array_to_vector(F.transform(x, lambda e: e.cast("double"))))

    def fit(self, df: DataFrame, x: str, y: str, test_size: float = 0.3) -> HistogramClassifier:
        """svm: the penalty is chosen on a split of the training rows, and the logistic calibration is fitted on test_size of all
        rows, which the margins have not seen (on all rows if that part lacks a class). sgd and mlp give probabilities by
        themselves and use all rows."""
        data = self._features(self._ids(df, y), x).select("features", "label")
        if self.kind == "mlp":
            width = len(df.select(x).first()[0])
            self.model = Pipeline(stages=[MultilayerPerceptronClassifier(layers=[width, 256, 256, len(self.classes)], seed=self.seed)]).fit(data)
            return self
        if self.kind == "sgd":
            self.model = Pipeline(stages=[LogisticRegression(maxIter=100, regParam=1e-4)]).fit(data)
            return self
        base = LinearSVC(maxIter=100)
        rest = OneVsRest(classifier=base)
        grid = ParamGridBuilder().addGrid(rest.classifier, [base.copy({base.regParam: 1 / (c * 1000)}) for c in GRID]).build()
        search = TrainValidationSplit(estimator=rest, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="accuracy"), trainRatio=1 - test_size, seed=self.seed)
        train, held = data.randomSplit([1 - test_size, test_size], self.seed)
        kinds = lambda d: {r[0] for r in d.select("label").distinct().collect()}  # noqa: E731  as many as classes
        if not kinds(data) == kinds(train) == kinds(held):
            train = held = data
        best = search.fit(train).bestModel
        margins = best.transform(held).select("rawPrediction", "label")
        self.model = PipelineModel(stages=[best, LogisticRegression(featuresCol="rawPrediction", predictionCol="calibrated", rawPredictionCol="logits").fit(margins)])
        return self

    def predict(self, df: DataFrame, x: str) -> DataFrame:
        """Adds predicted, probability (array in the order of classes) and log_probability."""
        got = self.model.transform(self._features(df, x))
        p = vector_to_array("probability")
        named = F.get(F.array(*[F.lit(c) for c in self.classes]), F.col("calibrated" if self.kind == "svm" else "prediction").cast("int"))
        return got.select(*df.columns, named.alias("predicted"), p.alias("probability"), F.transform(p, lambda v: F.log(F.greatest(v, F.lit(1e-300)))).alias("log_probability"))

    def partial_fit(self, df: DataFrame, x: str, y: str, rate: float = 0.1) -> HistogramClassifier:
        """One logistic step on a batch: the gradient is a sum over rows, of a fixed size. For foreachBatch."""
        data = self._ids(df, y).select(F.transform(x, lambda e: e.cast("double")).alias("x"), F.col("label").cast("int").alias("k"))
        n = data.count()
        if not n:
            return self
        width = len(data.first()["x"])
        w = np.zeros((len(self.classes), width + 1)) if self.steps is None else self.steps

        def part(batches):
            import pandas as pd

            total = np.zeros_like(w)
            for pdf in batches:
                a = np.column_stack([np.stack(pdf["x"]), np.ones(len(pdf))])
                z = a @ w.T
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(a)), pdf["k"].to_numpy()] -= 1
                total += p.T @ a
            yield pd.DataFrame({"i": np.arange(w.size), "g": total.ravel()})

        sums = data.mapInPandas(part, "i int, g double").groupBy("i").agg(F.sum("g").alias("g")).limit(w.size).collect()
        g = np.zeros(w.size)
        for r in sums:
            g[r["i"]] = r["g"]
        self.steps = w - rate * g.reshape(w.shape) / n
        return self

    def decision(self, df: DataFrame, x: str) -> DataFrame:
        """Scores of the incremental weights, in the order of classes."""
        w = self.steps.tolist()
        v = F.concat(F.transform(x, lambda e: e.cast("double")), F.array(F.lit(1.0)))
        scores = [F.aggregate(F.zip_with(v, F.array(*[F.lit(c) for c in row]), lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e) for row in w]
        return df.withColumn("decision", F.array(*scores))

    def report(self, df: DataFrame, x: str, y: str) -> DataFrame:
        """Precision, recall, F1 and support of the predictions for df (see metrics.report)."""
        return metrics.report(self.predict(df, x), y, "predicted")

    def save(self, path: str) -> None:
        """The fitted model, the incremental weights, classes and kind; overwrites."""
        from pyspark.sql import SparkSession

        if self.model is not None:
            self.model.write().overwrite().save(f"{path}/model")
        notes = {"classes": self.classes, "kind": self.kind, "seed": self.seed, "fitted": self.model is not None, "steps": None if self.steps is None else self.steps.tolist()}
        SparkSession.active().createDataFrame([(json.dumps(notes),)], "value string").write.mode("overwrite").parquet(f"{path}/notes")

    @classmethod
    def load(cls, path: str) -> HistogramClassifier:
        """What save wrote: it predicts, and goes on learning, as the saved one."""
        from pyspark.sql import SparkSession

        notes = json.loads(SparkSession.active().read.parquet(f"{path}/notes").first()["value"])
        out = cls(notes["classes"], notes["kind"], notes["seed"])
        out.model = PipelineModel.load(f"{path}/model") if notes["fitted"] else None
        out.steps = None if notes["steps"] is None else np.array(notes["steps"])
        return out


def minimise(cost: Callable[[np.ndarray], float | None], slope: Callable[[np.ndarray], np.ndarray], start: Sequence[float], rounds: int = 200, tol: float = 1e-10, memory: int = 8) -> dict:
    """Limited-memory quasi-Newton descent with a halving line search. cost and slope may run Spark aggregates; a cost of None
    is not feasible. -> x, success, status, message, fun, nfev, ngev."""
    x = np.array(start, float)
    f, g, nf, ng, past = cost(x), slope(x), 1, 1, []
    if f is None:
        return {"x": x, "success": False, "status": 2, "message": "the start is not feasible", "fun": None, "nfev": 1, "ngev": 1}
    for _ in range(rounds):
        if np.abs(g).max(initial=0) < tol:
            return {"x": x, "success": True, "status": 0, "message": "converged", "fun": f, "nfev": nf, "ngev": ng}
        d, kept = -g.copy(), []
        for s, y in reversed(past):
            a = (s @ d) / (s @ y)
            kept.append(a)
            d -= a * y
        if past:
            s, y = past[-1]
            d *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept), strict=True):
            d += s * (a - (y @ d) / (s @ y))
        step = 1.0
        while True:
            new = x + step * d
            fn, nf = cost(new), nf + 1
            if fn is not None and fn <= f + 1e-4 * step * (g @ d):
                break
            step /= 2
            if step < 1e-12:
                return {"x": x, "success": bool(np.abs(g).max() < 1e-5), "status": 1, "message": "no step helps", "fun": f, "nfev": nf, "ngev": ng}
        gn, ng = slope(new), ng + 1
        if (new - x) @ (gn - g) > 1e-12:
            past = [*past, (new - x, gn - g)][-memory:]
        x, f, g = new, fn, gn
    return {"x": x, "success": False, "status": 3, "message": "out of rounds", "fun": f, "nfev": nf, "ngev": ng}
