"""Pair classifiers on Spark ML.

Gradient-boosted trees stand where users know another boosting library; scores aren't the
same numbers, so what holds is behaviour: order, range and invariants.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import ACCURACY, BASE
from .pairs import class_weights


def weighted(labelled: DataFrame) -> DataFrame:
    """labelled with a weight column that balances the classes; the weights are two rows."""
    return labelled.join(F.broadcast(class_weights(labelled).select("label", "weight")), "label")


def _fit(classifier, labelled: DataFrame, names: list[str]) -> PipelineModel:
    assembler = VectorAssembler(inputCols=names, outputCol="features")
    ready = assembler.transform(weighted(labelled).withColumn("label", F.col("label").cast("double")))
    return PipelineModel([assembler, classifier.fit(ready)])


def fit_base(labelled: DataFrame, validation: str | None = None, iterations: int = 30, depth: int = 5, step: float = 0.1) -> PipelineModel:
    """Trees over the baseline features; with a boolean column `validation`, boosting stops once its rows no longer gain."""
    gbt = GBTClassifier(maxIter=iterations, maxDepth=depth, stepSize=step, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20, seed=42, weightCol="weight")
    if validation:
        gbt = gbt.setValidationIndicatorCol(validation)
    return _fit(gbt, labelled, BASE)


def fit_reranker(labelled: DataFrame, kind: str = "trees") -> PipelineModel:
    """Small trees, or logistic regression, over the accuracy features."""
    if kind == "trees":
        classifier = GBTClassifier(maxIter=25, maxDepth=4, stepSize=0.1, minInstancesPerNode=5, seed=42, weightCol="weight")
    else:
        classifier = LogisticRegression(maxIter=100, weightCol="weight")
    return _fit(classifier, labelled, ACCURACY)


def predict(model: PipelineModel, features: DataFrame, name: str = "score") -> DataFrame:
    """features with the chance of a match; no rows give no rows."""
    out = model.transform(features)
    return out.withColumn(name, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def importance(model: PipelineModel, top: int = 20) -> list[tuple[str, float]]:
    """The top features by gain."""
    names = model.stages[0].getInputCols()
    values = getattr(model.stages[-1], "featureImportances", None)
    values = values if values is not None else model.stages[-1].coefficients
    return sorted(((n, float(v)) for n, v in zip(names, values.toArray(), strict=True)), key=lambda x: (-x[1], x[0]))[:top]


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
