"""Applying and fitting risk models."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from tidewatch.functions.expressions import dot, double_array, sigmoid, unit_hash


def linear_logit(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    return dot(vector, double_array(weights)) + F.lit(float(bias))


def linear_score(vector: Column, weights: Sequence[float], bias: float = 0.0) -> Column:
    return sigmoid(linear_logit(vector, weights, bias))


def batch_score(
    df: DataFrame,
    vector: str,
    make_predict: Callable[[], Callable],
    width: int,
    name: str = "p",
    batch_size: int = 32,
) -> DataFrame:
    """Score vectors with any model; it is loaded once per Python worker.

    ``make_predict`` returns a function from a ``[batch, width]`` matrix to
    ``[batch]`` scores.
    """
    udf = predict_batch_udf(
        make_predict,
        return_type=DoubleType(),
        batch_size=batch_size,
        input_tensor_shapes=[[width]],
    )
    return df.withColumn(name, udf(F.col(vector)))


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, batch_size: int = 32
) -> DataFrame:
    """Any function over pandas batches of at most ``batch_size`` rows, streamed per task."""

    def run(frames: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch_size):
                yield fn(frame.iloc[start : start + batch_size])

    return df.mapInPandas(run, schema)


def labelled_vectors(
    df: DataFrame, vector: str, label: str, weights: DataFrame | None = None,
    instance: str | None = None, folds: int = 3, seed: int = 42,
) -> DataFrame:
    """``(features, label, weight)`` for MLlib; weights come per class.

    With ``instance`` there is a ``fold`` from a hash of that id, the same however the rows
    are partitioned.
    """
    fold = [] if instance is None else [
        F.floor(unit_hash(seed, F.col(instance)) * folds).cast("int").alias("fold")
    ]
    rows = df.select(
        array_to_vector(F.col(vector).cast("array<double>")).alias("features"),
        F.col(label).cast("double").alias("label"),
        *fold,
    )
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    per_class = weights.select(F.col("class").cast("double").alias("label"), "weight")
    return rows.join(F.broadcast(per_class), "label")  # one row per class


def fit_risk_model(rows: DataFrame, kind: str = "logistic", **params):
    """Class-weighted MLlib classifier on ``labelled_vectors``."""
    if kind == "logistic":
        learner = LogisticRegression(weightCol="weight", **params)
    elif kind == "trees":
        learner = GBTClassifier(weightCol="weight", **params)
    else:
        raise ValueError(f"unknown model: {kind}")
    return learner.fit(rows)


def model_scores(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(
        "label", vector_to_array("probability")[1].alias("p")
    )


def tune_risk_model(
    rows: DataFrame, reg_params: Sequence[float], mixes: Sequence[float], folds: int = 3,
    seed: int = 42, max_iter: int = 20, parallelism: int = 4,
) -> DataFrame:
    """Mean cross-validated AUROC per setting of a logistic model; rows name their ``fold``."""
    learner = LogisticRegression(weightCol="weight", maxIter=max_iter)
    grid = (
        ParamGridBuilder()
        .addGrid(learner.regParam, list(reg_params))
        .addGrid(learner.elasticNetParam, list(mixes))
        .build()
    )
    fitted = CrossValidator(
        estimator=learner,
        estimatorParamMaps=grid,
        evaluator=BinaryClassificationEvaluator(metricName="areaUnderROC"),
        numFolds=folds,
        foldCol="fold",
        seed=seed,
        parallelism=parallelism,
    ).fit(rows)
    table = [
        (float(g[learner.regParam]), float(g[learner.elasticNetParam]), float(m))
        for g, m in zip(grid, fitted.avgMetrics)
    ]
    return rows.sparkSession.createDataFrame(
        table, "reg_param double, elastic_net double, auroc double"
    )
