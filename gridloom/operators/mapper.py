"""Supervised mapping: out-of-fold stacking of classifiers, prediction with uncertainty (spark.ml)."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.rows import contiguous_folds
from .bandmath import to_wide
from .catalog import min_samples
from .metrics import impute, label_encode


def default_estimators(seed: int = 42) -> list:
    return [RandomForestClassifier(numTrees=20, maxDepth=5, seed=seed, labelCol="code"), LogisticRegression(maxIter=30, regParam=0.01, labelCol="code")]


def neural_network(n_features: int, n_classes: int, hidden: tuple[int, ...] = (64, 64), seed: int = 42, iterations: int = 100) -> MultilayerPerceptronClassifier:
    """A dense net with the given hidden layers, as a member for train."""
    return MultilayerPerceptronClassifier(layers=[n_features, *hidden, n_classes], seed=seed, maxIter=iterations, labelCol="code")


def balanced_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """Adds a weight that gives all classes the same sum: rows / (classes * rows of the class)."""
    counts = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("_n"))
    totals = counts.agg(F.sum("_n").alias("_rows"), F.count("*").alias("_k"))
    weights = counts.crossJoin(F.broadcast(totals)).select(target, (F.col("_rows") / (F.col("_k") * F.col("_n"))).alias(name))
    return df.join(weights, target, "left")


def folds(df: DataFrame, n: int, key: str, group: str | None = None) -> DataFrame:
    """Adds ``fold``: by hash of the group, or of the key, so that it needs no order."""
    return df.withColumn("fold", F.pmod(F.xxhash64(group or key), F.lit(n)).cast("int"))


@dataclass
class StackedModel:
    members: list
    meta: object
    features: list[str]
    n_classes: int
    factor: float

    def predict(self, df: DataFrame, arrays: bool = False, calc: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Adds class (from 1 on), prob (times 100) and uncertainty (spread of the members for that class, times the correction factor).

        arrays: also probs and uncertainties of all classes (times 100). calc derives
        features of the rows first. Rows with a missing feature have nulls.
        """
        df = df.transform(calc) if calc else df
        whole = F.lit(True)
        for c in self.features:
            whole = whole & F.col(c).isNotNull()
        out = _assemble(df.withColumn("_whole", whole).fillna(0, self.features), self.features)
        for i, m in enumerate(self.members):
            out = _probabilities(m, out, f"p{i}")
        names = [f"p{i}" for i in range(len(self.members))]
        out = _meta_vector(out.drop("features"), names, self.n_classes)
        out = _probabilities(self.meta, out, "proba")
        top = F.array_position("proba", F.array_max("proba")).cast("int")

        def spread(own):  # noqa: ANN001, ANN202
            mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / len(names)
            return F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(names)) * self.factor

        out = out.withColumn("class", top).withColumn("prob", F.array_max("proba") * 100).withColumn("uncertainty", spread(F.array(*[F.element_at(n, F.col("class")) for n in names])))
        results = ["class", "prob", "uncertainty"]
        if arrays:
            out = out.withColumn("probs", F.transform("proba", lambda x: x * 100))
            out = out.withColumn("uncertainties", F.array(*[spread(F.array(*[F.get(n, F.lit(j)) for n in names])) * 100 for j in range(self.n_classes)]))
            results += ["probs", "uncertainties"]
        return out.select(*df.columns, *[F.when(F.col("_whole"), F.col(c)).alias(c) for c in results])

    def predict_dates(self, cube: DataFrame, static: DataFrame | None = None, calc: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """Predicts every date of a cube at once: groups are features (with static ones by px); px, start_date, end_date and the results with arrays."""
        moving = [c for c in self.features if static is None or c not in static.columns]
        have = to_wide(cube, moving)
        have = have if static is None else have.join(static, "px", "left")
        out = self.predict(have, arrays=True, calc=calc)
        return out.select("px", "start_date", "end_date", "class", "prob", "uncertainty", "probs", "uncertainties")

    def save(self, path: str) -> None:
        """Writes the members, the meta-estimator and the figures to a folder; training data isn't kept."""
        PipelineModel([*self.members, self.meta]).write().overwrite().save(f"{path}/models")
        spark = SparkSession.active()
        about = json.dumps({"features": self.features, "n_classes": self.n_classes, "factor": self.factor})
        spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, path: str) -> StackedModel:
        *members, meta = PipelineModel.load(f"{path}/models").stages
        about = json.loads(SparkSession.active().read.text(f"{path}/about").first()[0])
        return cls(members, meta, about["features"], about["n_classes"], about["factor"])


def prediction_layers(predicted: DataFrame, base: str, n_classes: int, hard: bool = True) -> DataFrame:
    """Predictions with arrays as layers in long form, rounded to whole numbers: per class {base}_b1, ... and {base}_b1_uncertainty, ...; if hard {base}_hcl and {base}_hcl_prob."""
    parts = [F.struct(F.lit(f"{base}_b{j + 1}").alias("grp"), F.rint(F.get("probs", F.lit(j))).alias("value")) for j in range(n_classes)]
    parts += [F.struct(F.lit(f"{base}_b{j + 1}_uncertainty").alias("grp"), F.rint(F.get("uncertainties", F.lit(j))).alias("value")) for j in range(n_classes)]
    if hard:
        parts += [F.struct(F.lit(f"{base}_hcl").alias("grp"), F.col("class").cast("double").alias("value")), F.struct(F.lit(f"{base}_hcl_prob").alias("grp"), F.rint("prob").alias("value"))]
    return predicted.select("px", "start_date", "end_date", F.explode(F.array(*parts)).alias("x")).select("px", "x.grp", "start_date", "end_date", "x.value")


def _assemble(df: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(df)


def _probabilities(model, df: DataFrame, out: str) -> DataFrame:  # noqa: ANN001
    got = model.transform(df).withColumn(out, vector_to_array("probability"))
    return got.drop("rawPrediction", "probability", "prediction")


def _meta_vector(df: DataFrame, names: list[str], k: int) -> DataFrame:
    cols = {f"_{n}_{j}": F.get(n, F.lit(j)) for n in names for j in range(k)}
    return _assemble(df.withColumns(cols).fillna(0.0, list(cols)), list(cols)).drop(*cols)


def search(estimator, grid: dict[str, list], rows: DataFrame, n_folds: int = 3):  # noqa: ANN001, ANN201
    """The estimator with the best parameters of a grid by cross-validation, and these."""
    builder = ParamGridBuilder()
    for name, values in grid.items():
        builder = builder.addGrid(estimator.getParam(name), values)
    found = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=MulticlassClassificationEvaluator(labelCol="code", metricName="logLoss"), numFolds=n_folds, foldCol="").fit(rows)
    best = found.getEstimatorParamMaps()[min(range(len(found.avgMetrics)), key=lambda i: found.avgMetrics[i])]
    return estimator.copy(best), {p.name: v for p, v in best.items()}


def train(points: DataFrame, key: str, target: str, features: list[str], estimators: list | None = None, n_folds: int = 5, group: str | None = None, min_share: float = 0.0, weight: str | None = None, contiguous: bool = False) -> tuple[StackedModel, DataFrame]:
    """Fits members and, on their out-of-fold probabilities, a logistic meta-estimator. Also returns the out-of-fold table (key, code, p0, p1, ...).

    weight: a column of sample weights, given to every estimator that takes some.
    contiguous: folds are blocks of neighbouring rows in order of the key, else they go
    by a hash of the group or the key.
    """
    rows = min_samples(points, target, min_share) if min_share else points.where(F.col(target).isNotNull())
    rows = label_encode(impute(rows, features), target).withColumn("code", F.col("code").cast("double"))
    rows = contiguous_folds(rows, n_folds, [key]) if contiguous else folds(rows, n_folds, key, group)
    rows = _assemble(rows, features).select(key, "code", "fold", "features", (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")).cache()
    k = rows.select("code").distinct().count()
    estimators = [e.copy({e.getParam("weightCol"): "_w"}) if weight and e.hasParam("weightCol") else e for e in estimators or default_estimators()]
    out = rows
    for i, e in enumerate(estimators):
        parts = [_probabilities(e.fit(rows.where(F.col("fold") != f)), rows.where(F.col("fold") == f), f"p{i}").select(key, f"p{i}") for f in range(n_folds)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        out = out.join(every, key)
    names = [f"p{i}" for i in range(len(estimators))]
    meta_rows = _meta_vector(out.drop("features"), names, k).cache()
    meta = LogisticRegression(maxIter=50, regParam=0.01, labelCol="code", **({"weightCol": "_w"} if weight else {})).fit(meta_rows)
    own = F.array(*[F.coalesce(F.get(n, F.col("code").cast("int")), F.lit(0.0)) for n in names])
    mean = F.aggregate(own, F.lit(0.0), lambda a, x: a + x) / len(names)
    spread = F.sqrt(F.aggregate(own, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / len(names))
    r = meta_rows.agg(F.sqrt(F.avg((1 - mean) ** 2)).alias("e"), F.avg(spread).alias("s")).first()
    factor = r.e / r.s if r.s else 1.0
    members = [e.fit(rows) for e in estimators]
    return StackedModel(members, meta, features, k, factor), meta_rows.select(key, "code", *names)
