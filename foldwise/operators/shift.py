"""Distribution-shift measures between the empty group and the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from foldwise.functions.scalars import bernoulli_jsd, hedges_g, known, to_number
from foldwise.operators.classification import binary_labels
from foldwise.operators.ranking import average_ranks, running_totals

# Fixed value: members needed on each side of a label-shift comparison.
MIN_SIDE = 6


def gini(df: DataFrame, keys: Sequence[str], value: str, name: str = "gini") -> DataFrame:
    """Gini coefficient per key; negative values shift the key up by its minimum.

    sum(rank * x) over tie-averaged ranks is all the Lorenz curve needs.
    """
    keys = list(keys)
    clean = df.select(*keys, known(F.col(value).cast("double")).alias("_x"), *(["n"] if "n" in df.columns else []))
    clean = clean.where(F.col("_x").isNotNull())
    ranked = average_ranks(clean, keys, "_x", "_rank")
    sums = ranked.groupBy(*keys).agg(
        F.sum("n").alias("_n"),
        F.sum(F.col("n") * F.col("_x")).alias("_sum"),
        F.sum(F.col("n") * F.col("_x") * F.col("_rank")).alias("_weighted"),
        F.min("_x").alias("_min"),
        F.max(F.abs("_x")).alias("_size"),
    )
    n = F.col("_n")
    shift = F.least(F.col("_min"), F.lit(0.0))
    total = F.col("_sum") - n * shift
    weighted = F.col("_weighted") - shift * n * (n + 1) / 2.0
    value_ = F.try_divide(F.try_divide(2 * weighted, total) - (n + 1), n)
    return sums.select(*keys, F.when(F.col("_size") <= 1e-8, F.lit(0.0)).otherwise(value_).alias(name))


def ks_statistic(
    df: DataFrame, keys: Sequence[str], value: str, in_first: str, name: str = "KS_Statistic"
) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic between flagged and unflagged rows."""
    keys = list(keys)
    clean = df.select(*keys, known(F.col(value).cast("double")).alias("_v"), F.col(in_first).alias("_first"))
    clean = clean.where(F.col("_v").isNotNull() & F.col("_first").isNotNull())
    merged = clean.groupBy(*keys, "_v").agg(
        F.sum(F.col("_first").cast("long")).alias("_x"), F.sum((~F.col("_first")).cast("long")).alias("_y")
    )
    run = running_totals(merged, keys, "_v", {"_cx": "_x", "_cy": "_y"}, sample_of=clean)
    sizes = merged.groupBy(*keys).agg(F.sum("_x").alias("_nx"), F.sum("_y").alias("_ny"))
    gap = F.abs(F.try_divide("_cx", "_nx") - F.try_divide("_cy", "_ny"))
    return run.join(sizes, keys).groupBy(*keys).agg(F.max(gap).alias(name))


def side_moments(df: DataFrame, keys: Sequence[str], value: str, in_first: str) -> DataFrame:
    """Count, mean and sample variance of both sides in one pass."""
    v = known(F.col(value).cast("double"))
    x, y = F.when(F.col(in_first), v), F.when(~F.col(in_first), v)
    return df.groupBy(*keys).agg(
        F.count(x).alias("n_x"),
        F.avg(x).alias("mean_x"),
        F.var_samp(x).alias("var_x"),
        F.count(y).alias("n_y"),
        F.avg(y).alias("mean_y"),
        F.var_samp(y).alias("var_y"),
    )


def regression_label_shift(df: DataFrame, keys: Sequence[str], value: str = "y", is_empty: str = "is_empty") -> DataFrame:
    """Mean, spread, |Hedges g| and KS of a target between empty-group and other rows."""
    numbers = df.withColumn("_y", to_number(value))
    sides = side_moments(numbers, keys, "_y", is_empty).where((F.col("n_x") >= MIN_SIDE) & (F.col("n_y") >= MIN_SIDE))
    effect = F.abs(hedges_g("n_x", "mean_x", "var_x", "n_y", "mean_y", "var_y"))
    out = sides.join(ks_statistic(numbers, keys, "_y", is_empty), list(keys))
    return out.select(
        *keys,
        F.col("n_x").alias("N_NoScaffold"),
        F.col("n_y").alias("N_HasScaffold"),
        F.col("mean_x").alias("No_Mean"),
        F.col("mean_y").alias("Has_Mean"),
        F.sqrt("var_x").alias("No_SD"),
        F.sqrt("var_y").alias("Has_SD"),
        (F.col("mean_x") - F.col("mean_y")).alias("Mean_Diff_NoMinusHas"),
        effect.alias("Abs_StandardizedMeanDiff"),
        "KS_Statistic",
    )


def classification_label_shift(
    df: DataFrame, keys: Sequence[str], value: str = "y", is_empty: str = "is_empty"
) -> DataFrame:
    """Positive rates, their difference and the Bernoulli divergence."""
    present = df.withColumn("_y", to_number(value)).where(F.col(value).isNotNull())
    labelled = binary_labels(present, keys, "_y", "_label").where(F.col("_label").isNotNull())
    sides = side_moments(labelled, keys, "_label", is_empty)
    sides = sides.where((F.col("n_x") >= MIN_SIDE) & (F.col("n_y") >= MIN_SIDE))
    diff = F.col("mean_x") - F.col("mean_y")
    return sides.select(
        *keys,
        F.col("n_x").alias("N_NoScaffold"),
        F.col("n_y").alias("N_HasScaffold"),
        F.col("mean_x").alias("No_PositiveRate"),
        F.col("mean_y").alias("Has_PositiveRate"),
        diff.alias("PositiveRate_Diff_NoMinusHas"),
        F.abs(diff).alias("Abs_PositiveRate_Diff"),
        bernoulli_jsd("mean_x", "mean_y").alias("Bernoulli_JSD"),
    )
