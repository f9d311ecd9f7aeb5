"""Fingerprint models on Spark ML: boosted trees and a feed-forward network.

Spark's boosted trees replace the native booster; settings carry over, numbers
do not.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from foldwise.functions.bits import WORD, on_bits

# Booster settings.
STEP, DEPTH, SHARE, ROUNDS, SEED = 0.05, 3, 0.9, 80, 42


def bit_vectors(df: DataFrame, words: str = "words", name: str = "features") -> DataFrame:
    """Packed words as sparse 0/1 ML vectors of the positions that are set."""
    size = df.agg(F.max(F.size(words))).first()[0] or 1
    places = [str(b) for b in range(size * WORD)]
    coder = CountVectorizerModel.from_vocabulary(places, inputCol="_on", outputCol=name)
    return coder.setBinary(True).transform(df.withColumn("_on", F.transform(on_bits(words), lambda b: b.cast("string")))).drop("_on")


def featurize(df: DataFrame, target: str, task: str, words: str = "words") -> DataFrame:
    """Rows with a readable fingerprint and a usable label, as (.., features, y_true)."""
    y = F.col(target).try_cast("double")
    usable = df.withColumn("y_true", y).where(F.col("y_true").isNotNull() & F.col(words).isNotNull())
    if task == "classification":
        usable = usable.withColumn("y_true", F.col("y_true").cast("int").cast("double")).where(F.col("y_true").isin(0.0, 1.0))
    return bit_vectors(usable, words)


def predict_regression(train: DataFrame, test: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Boosted trees on the standardised target; predictions on the original scale."""
    stats = train.agg(F.avg("y_true").alias("m"), F.stddev_pop("y_true").alias("s")).first()
    if stats["m"] is None:
        raise ValueError("no usable training rows")
    centre, scale = stats["m"], stats["s"] or 1.0
    scaled = train.withColumn("_y", (F.col("y_true") - centre) / scale)
    booster = GBTRegressor(
        labelCol="_y", predictionCol="_p", maxDepth=DEPTH, stepSize=STEP, subsamplingRate=SHARE,
        featureSubsetStrategy=str(SHARE), maxIter=rounds, seed=seed,
    )
    out = booster.fit(scaled).transform(test)
    return out.withColumn("y_pred", F.col("_p") * scale + centre).drop("_p", "features")


def predict_classification(train: DataFrame, test: DataFrame, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """Boosted trees with positives weighted by the class ratio."""
    counts = train.agg(F.sum((F.col("y_true") == 1).cast("long")).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positives, negatives = counts["p"] or 0, counts["n"] - (counts["p"] or 0)
    if not positives or not negatives:
        raise ValueError("the training set has a single class")
    weighted = train.withColumn("_w", F.when(F.col("y_true") == 1, negatives / positives).otherwise(1.0))
    booster = GBTClassifier(
        labelCol="y_true", weightCol="_w", maxDepth=DEPTH, stepSize=STEP, subsamplingRate=SHARE,
        featureSubsetStrategy=str(SHARE), maxIter=rounds, seed=seed,
    )
    return _scored(booster.fit(weighted).transform(test))


def predict_network(train: DataFrame, test: DataFrame, inputs: int, rounds: int = 100, seed: int = SEED) -> DataFrame:
    """Feed-forward classifier with hidden layers of 512, 256 and 30 units."""
    network = MultilayerPerceptronClassifier(
        labelCol="y_true", layers=[inputs, 512, 256, 30, 2], maxIter=rounds, seed=seed
    )
    return _scored(network.fit(train).transform(test))


def _scored(out: DataFrame) -> DataFrame:
    score = vector_to_array("probability")[1]
    return (
        out.withColumn("y_score", score)
        .withColumn("y_pred", (F.col("y_score") >= 0.5).cast("int"))
        .drop("rawPrediction", "probability", "prediction", "features")
    )


def named_predictions(predicted: DataFrame, target: str, column: str, task: str, keys: list[str]) -> DataFrame:
    """Prediction file layout: keys plus ``pred_<target>`` or ``prob_<target>``."""
    prefix = "pred" if task == "regression" else "prob"
    return predicted.select(*keys, F.col(column).alias(f"{prefix}_{target}"))
