"""Group and split summaries: counts, empty-group shares, recovery and sink ratios.

All of them first count rows per (keys, group).  That shuffle carries one row per
group and map task however large a group is, and it makes the distinct-group
count of the second, much smaller aggregation a plain count.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from foldwise.functions.scalars import SPLITS, count_if, fold_count, slot_text


def _group_counts(df: DataFrame, keys: Sequence[str], group: str, is_empty: str) -> DataFrame:
    return df.groupBy(*keys, F.col(group).alias("_group"), F.col(is_empty).alias("_empty")).agg(
        F.count(F.lit(1)).alias("_n")
    )


def _totals():
    empty = F.coalesce(F.sum(F.when(F.col("_empty"), F.col("_n"))), F.lit(0))
    distinct = F.count(F.when(~F.col("_empty"), F.col("_group")))
    return F.sum("_n"), empty, distinct


def group_summary(df: DataFrame, keys: Sequence[str], group: str = "group_key", is_empty: str = "is_empty") -> DataFrame:
    """Members, empty-group members, their share, and distinct non-empty groups."""
    total, empty, distinct = _totals()
    return (
        _group_counts(df, keys, group, is_empty)
        .groupBy(*keys)
        .agg(total.alias("n_molecules"), empty.alias("n_no_scaffold"), distinct.alias("n_unique_nonempty_scaffolds"))
        .withColumn("no_scaffold_proportion", F.try_divide("n_no_scaffold", "n_molecules"))
    )


def split_summary(
    df: DataFrame, keys: Sequence[str], split: str = "split", group: str = "group_key", is_empty: str = "is_empty"
) -> DataFrame:
    """``group_summary`` per split plus the overall share and the recovery against it."""
    per_split = group_summary(df, [*keys, split], group, is_empty)
    whole = Window.partitionBy(*keys)
    overall = F.try_divide(F.sum("n_no_scaffold").over(whole), F.sum("n_molecules").over(whole))
    return per_split.withColumn("overall_no_scaffold_proportion", overall).withColumn(
        "support_recovery_vs_overall",
        F.try_divide(F.col("no_scaffold_proportion"), F.col("overall_no_scaffold_proportion")),
    )


def part_statistics(
    df: DataFrame, keys: Sequence[str], group: str = "group_key", is_empty: str = "is_empty"
) -> DataFrame:
    """The six counts and shares of a part, fold or dataset."""
    total, empty, distinct = _totals()
    share = F.coalesce(F.try_divide("no_scaffold_count", "molecule_count"), F.lit(0.0))
    return (
        _group_counts(df, keys, group, is_empty)
        .groupBy(*keys)
        .agg(
            total.alias("molecule_count"),
            (total - empty).alias("scaffold_bearing_count"),
            empty.alias("no_scaffold_count"),
            distinct.alias("scaffold_group_count"),
        )
        .withColumn("no_scaffold_proportion", share)
        .withColumn("no_scaffold_percentage", 100.0 * F.col("no_scaffold_proportion"))
    )


STATISTICS = (
    "molecule_count",
    "scaffold_bearing_count",
    "no_scaffold_count",
    "no_scaffold_proportion",
    "no_scaffold_percentage",
    "scaffold_group_count",
)


def fold_allocation(
    df: DataFrame, keys: Sequence[str], fold: str = "fold", is_empty: str = "is_empty", label: str | None = None
) -> DataFrame:
    """Members and empty-group members per fold, optionally with positive labels."""
    extra = [] if label is None else [count_if(F.col(label) == 1).alias("n_positive")]
    return (
        df.groupBy(*keys, fold)
        .agg(F.count(F.lit(1)).alias("n_total"), count_if(F.col(is_empty)).alias("n_no_scaffold"), *extra)
        .withColumn("no_scaffold_proportion", F.try_divide("n_no_scaffold", "n_total"))
    )


def empty_group_fold(df: DataFrame, keys: Sequence[str], fold: str = "fold", is_empty: str = "is_empty") -> DataFrame:
    """The fold with most empty-group members; the first one wins a tie."""
    allocation = fold_allocation(df, keys, fold, is_empty)
    rank = F.struct(-F.col("n_no_scaffold"), F.col(fold))
    picked = [F.min_by(fold, rank).alias("no_scaffold_fold"), F.max("n_no_scaffold").alias("n_no_scaffold")]
    return allocation.groupBy(*keys).agg(*picked) if keys else allocation.agg(*picked)


def branch_summary(
    df: DataFrame, keys: Sequence[str], folds: int, part: str = "fold", is_empty: str = "is_empty"
) -> DataFrame:
    """Train / valid / test make-up when every fold in turn is the test fold.

    The parts are counted once; only the per-part counts are fanned out.
    """
    parts = fold_allocation(df, keys, part, is_empty)
    fanned = parts.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    branch = branch_of(F.col(part), F.col("eval_fold"), F.lit(folds))
    return (
        fanned.withColumn("branch", branch)
        .groupBy(*keys, "eval_fold", "branch")
        .agg(
            F.array_join(F.sort_array(F.collect_set(part)), ",").alias("folds"),
            F.sum("n_total").alias("n_total"),
            F.sum("n_no_scaffold").alias("n_no_scaffold"),
        )
        .withColumn("no_scaffold_proportion", F.try_divide("n_no_scaffold", "n_total"))
    )


def branch_of(part, fold, folds):
    """Sliding window over parts: the fold itself tests, the next one validates."""
    return (
        F.when(part == fold, F.lit("test"))
        .when(part == F.pmod(fold + 1, folds), F.lit("valid"))
        .otherwise(F.lit("train"))
    )


def fold_statistics_long(
    df: DataFrame, keys: Sequence[str], part: str, folds: str, group: str = "group_key", is_empty: str = "is_empty"
) -> DataFrame:
    """Statistics of every (fold, split); groups never straddle parts, so parts add up."""
    parts = part_statistics(df, [*keys, part, folds], group, is_empty)
    fanned = parts.withColumn("fold", F.explode(F.sequence(F.lit(0), F.col(folds) - 1)))
    counts = (
        fanned.withColumn("split", branch_of(F.col(part), F.col("fold"), F.col(folds)))
        .groupBy(*keys, "fold", "split")
        .agg(*[F.sum(c).alias(c) for c in STATISTICS if c.endswith("count")])
    )
    share = F.coalesce(F.try_divide("no_scaffold_count", "molecule_count"), F.lit(0.0))
    return (
        counts.withColumn("no_scaffold_proportion", share)
        .withColumn("no_scaffold_percentage", 100.0 * F.col("no_scaffold_proportion"))
        .withColumn("fold", F.col("fold") + 1)
        .select(*keys, "fold", "split", *STATISTICS)
    )


def fold_statistics_wide(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per fold with the statistics of each split side by side."""
    pivoted = (
        long.groupBy(*keys, "fold").pivot("split", list(SPLITS)).agg(*[F.first(c).alias(c) for c in STATISTICS])
    )
    return pivoted


def dataset_statistics(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "molecules",
    group: str = "group_key",
    is_empty: str = "is_empty",
    is_valid: str = "is_valid",
) -> DataFrame:
    """Raw, non-null and effective row counts with the fold rule, in one pass over the rows."""
    counted = df.groupBy(
        *keys,
        F.col(text).isNotNull().alias("_present"),
        (F.col(text).isNotNull() & F.col(is_valid)).alias("_valid"),
        F.col(group).alias("_group"),
        F.col(is_empty).alias("_empty"),
    ).agg(F.count(F.lit(1)).alias("_n"))
    valid_empty = F.col("_valid") & F.col("_empty")
    valid_group = F.col("_valid") & ~F.col("_empty")

    def total(condition):
        return F.coalesce(F.sum(F.when(condition, F.col("_n"))), F.lit(0))

    out = counted.groupBy(*keys).agg(
        F.sum("_n").alias("raw_total_count"),
        total(F.col("_present")).alias("after_dropna_count"),
        total(F.col("_valid")).alias("effective_total_count"),
        total(valid_empty).alias("no_scaffold_count"),
        F.count(F.when(valid_group, F.col("_group"))).alias("scaffold_group_count"),
    )
    n = F.col("effective_total_count")
    return (
        out.withColumn("removed_invalid_or_empty_smiles_count", F.col("raw_total_count") - n)
        .withColumn("scaffold_bearing_count", n - F.col("no_scaffold_count"))
        .withColumn("no_scaffold_proportion", F.coalesce(F.try_divide("no_scaffold_count", n), F.lit(0.0)))
        .withColumn("kfolds", fold_count(n))
        .withColumn("weight_splits", slot_text(n))
        .withColumn("status", F.when(n > 0, F.lit("success")).otherwise(F.lit("failed")))
    )


def inventory(df: DataFrame, keys: Sequence[str], is_empty: str = "is_empty", threshold: float = 0.08) -> DataFrame:
    """Per-dataset inventory with the minimum-share flag (a missing share is False)."""
    return (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("Total_Molecules"), count_if(F.col(is_empty)).alias("No_Scaffold_Molecules"))
        .withColumn("Has_Scaffold_Molecules", F.col("Total_Molecules") - F.col("No_Scaffold_Molecules"))
        .withColumn("No_Scaffold_Proportion", F.try_divide("No_Scaffold_Molecules", "Total_Molecules"))
        .withColumn("Threshold_OK_ge_0p08", F.coalesce(F.col("No_Scaffold_Proportion") >= threshold, F.lit(False)))
    )


def support_audit(df: DataFrame, keys: Sequence[str], split: str = "split", is_empty: str = "is_empty") -> DataFrame:
    """Share of empty-group members per split, support recovery and sink ratio."""
    counts = [
        f(F.col(split) == s).alias(f"{s}_{name}")
        for s in SPLITS
        for name, f in (
            ("n", count_if),
            ("no_scaffold", lambda c: count_if(c & F.col(is_empty))),
        )
    ]
    out = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"), count_if(F.col(is_empty)).alias("n_no_scaffold"), *counts)
    out = out.withColumn("overall_proportion", F.try_divide("n_no_scaffold", "n_total"))
    for s in SPLITS:
        out = out.withColumn(f"{s}_proportion", F.try_divide(f"{s}_no_scaffold", f"{s}_n"))
    return out.withColumn("support_recovery", F.try_divide("train_proportion", "overall_proportion")).withColumn(
        "sink_ratio", F.try_divide(F.greatest("valid_proportion", "test_proportion"), F.col("train_proportion"))
    )
