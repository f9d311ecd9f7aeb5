"""Fingerprint models, checked by the driver for rows only."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import models as M
from foldwise.operators.classification import classification_summary
from foldwise.operators.regression import regression_summary
from foldwise.plans.registry import query
from foldwise.plans.similarity_queries import vectors
from foldwise.sources.tables import load


def _sides(spark, folder, target, task):
    labels = load(spark, folder, "embeddings").select("vec_id", "label")
    rows = vectors(spark, folder).join(labels, "vec_id").withColumn("target", target)
    ready = M.featurize(rows, "target", task)
    return ready.where(F.col("split") != "test"), ready.where(F.col("split") == "test")


@query("gbt_classification")
def gbt_classification(spark, folder):
    train, test = _sides(spark, folder, (F.col("label") < 5).cast("int"), "classification")
    return classification_summary(M.predict_classification(train, test), ["dataset"], "y_true", "y_score")


@query("gbt_regression")
def gbt_regression(spark, folder):
    train, test = _sides(spark, folder, F.col("label").cast("double"), "regression")
    return regression_summary(M.predict_regression(train, test), ["dataset"], "y_true", "y_pred")
