"""Models over feature tables with MLlib; training runs on the executors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42


def _fit(rows: DataFrame, features: Sequence[str], learner) -> PipelineModel:
    return Pipeline(stages=[VectorAssembler(inputCols=list(features), outputCol="_x"), learner]).fit(rows)


def boosted_regression(rows: DataFrame, features: Sequence[str], label: str, rounds: int = 20, valid: str | None = None) -> PipelineModel:
    """valid: a boolean column of the rows on which boosting stops early."""
    learner = GBTRegressor(featuresCol="_x", labelCol=label, predictionCol="p", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=SEED)
    return _fit(rows, features, learner.setValidationIndicatorCol(valid) if valid else learner)


def boosted_binary(rows: DataFrame, features: Sequence[str], label: str, rounds: int = 20) -> PipelineModel:
    return _fit(rows, features, GBTClassifier(featuresCol="_x", labelCol=label, predictionCol="p", maxIter=rounds, maxDepth=4, stepSize=0.1, seed=SEED))


def forest(rows: DataFrame, features: Sequence[str], label: str, trees: int = 20) -> PipelineModel:
    """Classes 0, 1, 2: boosting in MLlib is for two classes, so these take a forest."""
    return _fit(rows, features, RandomForestClassifier(featuresCol="_x", labelCol=label, predictionCol="p", numTrees=trees, maxDepth=6, seed=SEED))


def logistic(rows: DataFrame, features: Sequence[str], label: str, c: float = 0.1) -> PipelineModel:
    """L2 with inverse strength c on features that are scaled already."""
    n = max(rows.count(), 1)
    return _fit(rows, features, LogisticRegression(featuresCol="_x", labelCol=label, predictionCol="p", regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=100))


def predicted(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Rows with p, and with probabilities where the model has them."""
    out = model.transform(rows)
    keep = [*rows.columns, F.col("p").cast("double").alias("p")]
    return out.select(*keep, vector_to_array("probability").alias("probabilities")) if "probability" in out.columns else out.select(*keep)


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
