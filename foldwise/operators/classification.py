"""Tie-aware ranking metrics and threshold metrics for binary labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalars import finite, to_number
from foldwise.operators.ranking import running_totals

# Labels needed on each side before a subset is evaluated.
MIN_POSITIVES = 10
MIN_NEGATIVES = 10


def label_coding(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Which label coding the values of each key follow: unit, signed, probability or none."""
    v = F.col(value)
    codes = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.bool_and(v.isin(0, 1)).alias("_unit"),
        F.bool_and(v.isin(-1, 0, 1)).alias("_signed"),
        ((F.min(v) >= 0) & (F.max(v) <= 1)).alias("_probability"),
    )
    coding = (
        F.when(F.col("_unit"), "unit").when(F.col("_signed"), "signed").when(F.col("_probability"), "probability")
    )
    return codes.select(*keys, coding.alias("coding"))


def recoded_label(value: Column, coding: Column, strict: bool = False) -> Column:
    """Label as 0/1.  Unless strict, a missing label of a recoded key counts as 0."""
    missing = F.lit(None).cast("double") if strict else F.lit(0.0)
    return (
        F.when(coding == "unit", value)
        .when(coding == "signed", F.when(value.isNull(), missing).otherwise((value > 0).cast("double")))
        .when(coding == "probability", F.when(value.isNull(), missing).otherwise((value >= 0.5).cast("double")))
    )


def binary_labels(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "label", strict: bool = False
) -> DataFrame:
    """Add a 0/1 label; how values are read depends on the value set of their key."""
    numbers = df.withColumn("_value", to_number(value))
    distinct = numbers.select(*keys, "_value").distinct()
    coded = numbers.join(label_coding(distinct, keys, "_value"), list(keys), "left")
    return coded.withColumn(name, recoded_label(F.col("_value"), F.col("coding"), strict)).drop("_value", "coding")


def eligible(positives: Column, negatives: Column) -> Column:
    return (positives >= MIN_POSITIVES) & (negatives >= MIN_NEGATIVES)


def ranking_metrics(scored: DataFrame, keys: Sequence[str], sample_of: DataFrame | None = None) -> DataFrame:
    """AP, ROC AUC and normalised AP from one row per (keys, score) with pos / neg counts.

    A single running total from the top score serves all three: the ties of a
    threshold enter together, and the tie-averaged rank needed by the AUC is the
    total count minus what lies above.
    """
    counted = scored.withColumn("_n", F.col("pos") + F.col("neg"))
    run = running_totals(
        counted, keys, "score", {"_tp": "pos", "_upto": "_n"}, descending=True, sample_of=sample_of
    )
    sums = run.groupBy(*keys).agg(
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_m"),
        F.sum(F.col("pos") * F.try_divide("_tp", "_upto")).alias("_precision"),
        F.sum(F.col("pos") * ((F.col("_n") + 1) / 2.0 - F.col("_upto"))).alias("_rank"),
    )
    p, m = F.col("_p"), F.col("_m")
    both = (p > 0) & (m > 0)
    ap = F.try_divide("_precision", "_p")
    auc = F.try_divide(F.col("_rank") + p * (p + m) - p * (p + 1) / 2.0, p * m)
    rate = F.try_divide(p, p + m)
    return sums.select(
        *keys,
        F.when(both, ap).alias("average_precision"),
        F.when(both, auc).alias("roc_auc"),
        F.when(both, F.try_divide(ap - rate, 1 - rate)).alias("normPR"),
    )


def score_counts(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", predicted: str | None = None
) -> DataFrame:
    """Finite (label, score) pairs merged to one row per score."""
    pairs = df.select(
        *keys,
        finite(y).alias("_y"),
        finite(score).alias("score"),
        (F.col(score) >= 0.5 if predicted is None else F.col(predicted) == 1).alias("_hit"),
    ).where(F.col("_y").isNotNull() & F.col("score").isNotNull())
    one = F.col("_y") == 1
    zero = F.col("_y") == 0

    def count(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    return pairs.groupBy(*keys, "score").agg(
        count(one).alias("pos"),
        count(zero).alias("neg"),
        count(one & F.col("_hit")).alias("hit_pos"),
        count(zero & F.col("_hit")).alias("hit_neg"),
    )


def threshold_metrics(scored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Accuracy, balanced accuracy, F1 and MCC from the per-score counts."""
    sums = scored.groupBy(*keys).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"),
        F.sum("pos").alias("_p"),
        F.sum("neg").alias("_m"),
        F.sum("hit_pos").alias("_tp"),
        F.sum("hit_neg").alias("_fp"),
    )
    tp, fp = F.col("_tp").cast("double"), F.col("_fp").cast("double")
    fn, tn = F.col("_p") - tp, F.col("_m") - fp
    tpr, tnr = F.try_divide(tp, tp + fn), F.try_divide(tn, tn + fp)
    spread = (tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)
    return sums.select(
        *keys,
        "n",
        F.try_divide("_p", "n").alias("positive_rate"),
        F.try_divide(tp + tn, F.col("n")).alias("accuracy"),
        F.coalesce((tpr + tnr) / 2, tpr, tnr).alias("balanced_accuracy"),
        F.try_divide(2 * tp, 2 * tp + fp + fn).alias("f1"),
        F.try_divide(tp * tn - fp * fn, F.sqrt(F.when(spread > 0, spread))).alias("mcc"),
    )


def classification_summary(
    df: DataFrame, keys: Sequence[str], y: str = "y", score: str = "score", predicted: str | None = None
) -> DataFrame:
    scored = score_counts(df, keys, y, score, predicted)
    sample = df.select(finite(score).alias("score"))
    return threshold_metrics(scored, keys).join(
        ranking_metrics(scored.select(*keys, "score", "pos", "neg"), keys, sample), list(keys), "left"
    )
