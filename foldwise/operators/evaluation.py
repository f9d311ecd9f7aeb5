"""Per-subset evaluation tables, reference comparisons and report summaries.

The nested loops over dataset, fold, model, target and subset are one grouped
query.  Predictions are merged to one row per (keys, status, label, score) before
the subset fan-out, so the fan-out doubles merged rows and not the input.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.functions.scalars import count_if, finite, group_status, known, open_ratio, share, to_number
from foldwise.operators.classification import eligible, label_coding, ranking_metrics, recoded_label
from foldwise.operators.regression import numbered, paired_metrics, pearson, small_side, spearman
from foldwise.operators.ranking import average_ranks
from foldwise.session import cut_lineage

SUBSETS = ("all_test", "no_scaffold", "scaffold_bearing")
POINT = ("Benchmark", "Dataset", "Target", "Model", "Fold")
SERIES = ("Benchmark", "Dataset", "Target", "Model")

# Report thresholds.
NEAR_BASELINE = (0.05, 0.02)
INFLATION_TAILS = (2.0, 3.0)
MIN_TEST_ROWS = 5


def with_subsets(df: DataFrame, is_empty: str = "is_empty") -> DataFrame:
    """Each row once for the whole test set and once for its own status."""
    return df.withColumn("Subset", F.explode(F.array(F.lit("all_test"), group_status(is_empty))))


def fold_sizes(test: DataFrame, keys: Sequence[str] = ("Benchmark", "Dataset", "Fold"), is_empty: str = "is_empty") -> DataFrame:
    return (
        test.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("Test_Size"), count_if(F.col(is_empty)).alias("NoScaffold_Test_N"))
        .withColumn("NoScaffold_Test_Fraction", F.try_divide("NoScaffold_Test_N", "Test_Size"))
    )


def evaluate_classification(
    df: DataFrame, keys: Sequence[str] = POINT, y: str = "y", score: str = "score", is_empty: str = "is_empty"
) -> DataFrame:
    """Counts, AP, ROC AUC and normPR per point and subset, all over the rows with a label and a finite
    score; ineligible subsets are left out."""
    keys = list(keys)
    rows = df.select(*keys, F.coalesce(F.col(is_empty), F.lit(False)).alias("_empty"), to_number(y).alias("_y"), finite(score).alias("score"))
    points, rows = numbered(rows, keys)
    subset = ["_point", "Subset"]
    merged = cut_lineage(rows.groupBy("_point", "_empty", "_y", "score").agg(F.count(F.lit(1)).alias("_rows")))
    fanned = with_subsets(merged, "_empty")
    labelled = fanned.join(label_coding(fanned, subset, "_y"), subset)
    label = recoded_label(F.col("_y"), F.col("coding"))
    usable = labelled.withColumn("_label", label).where(F.col("_label").isNotNull() & F.col("score").isNotNull())
    positive = F.sum(F.when(F.col("_label") == 1, F.col("_rows")).otherwise(0))
    negative = F.sum(F.when(F.col("_label") == 0, F.col("_rows")).otherwise(0))
    scored = cut_lineage(usable.groupBy(*subset, "score").agg(positive.alias("pos"), negative.alias("neg")))
    counts = scored.groupBy(*subset).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("N"),
        F.sum("pos").alias("N_Positive"),
        F.sum("neg").alias("N_Negative"),
    ).where(eligible(F.col("N_Positive"), F.col("N_Negative")))
    ranked = ranking_metrics(scored, subset, merged)
    out = counts.join(ranked, subset, "left").join(small_side(points.select("_point", *keys)), "_point")
    return out.select(
        *keys,
        "Subset",
        "N",
        "N_Positive",
        "N_Negative",
        F.try_divide("N_Positive", "N").alias("Positive_Rate"),
        F.col("average_precision").alias("AP"),
        F.col("roc_auc").alias("ROC_AUC"),
        "normPR",
    )


def evaluate_regression(
    df: DataFrame, keys: Sequence[str] = POINT, y: str = "y", pred: str = "pred", is_empty: str = "is_empty"
) -> DataFrame:
    """Error, association and spread metrics per point and subset with at least five rows,
    all over the same finite pairs."""
    keys = list(keys)
    pairs = df.select(*keys, is_empty, finite(to_number(y)).alias("y"), finite(to_number(pred)).alias("pred"))
    pairs = pairs.where(F.col("y").isNotNull() & F.col("pred").isNotNull())
    subsets = ("all_test", "scaffold_bearing", "no_scaffold")
    return paired_metrics(pairs, keys, "score", is_empty, subsets).where(F.col("n") >= MIN_TEST_ROWS).select(
        *keys,
        "Subset",
        F.col("n").alias("N"),
        F.col("target_scale_mean_abs").alias("Target_Scale"),
        "MAE",
        "RMSE",
        "relMAE",
        "R2",
        "Pearson_r",
        "Spearman_rho",
        "Prediction_SD",
        "Target_SD",
    )


def materialize_points(points: DataFrame) -> DataFrame:
    """Write the evaluation table once; every report below reads it several times.

    It has one row per dataset, target, model, fold and subset - metadata next to
    the predictions it summarises - so plain windows over a series are enough.
    """
    return cut_lineage(points)


def mark_primary_fold(points: DataFrame) -> DataFrame:
    """Flag the fold with the largest empty-group test count; names break ties as text."""
    per_dataset = Window.partitionBy("Benchmark", "Dataset")
    candidate = F.when(F.col("NoScaffold_Test_N") > 0, F.struct(-F.col("NoScaffold_Test_N"), F.col("Fold")))
    primary = F.min(candidate).over(per_dataset)["Fold"]
    return points.withColumn("Is_NoScaffold_Fold", F.coalesce(F.col("Fold") == primary, F.lit(False))).withColumn(
        "Is_Primary_NoScaffold_Subset", (F.col("Subset") == "no_scaffold") & F.col("Is_NoScaffold_Fold")
    )


def within_fold(points: DataFrame, value: str) -> DataFrame:
    """One row per point with the value of each subset as a column."""
    return points.groupBy(*POINT).pivot("Subset", list(SUBSETS)).agg(F.first(value, ignorenulls=True))


def _with_references(points: DataFrame, medians: dict[str, str]) -> DataFrame:
    """Medians over the ordinary folds of each series, and how many folds they rest on."""
    marked = mark_primary_fold(points).withColumn("Reference_Type", F.lit("ordinary_folds_excluding_no_scaffold_fold"))
    series = Window.partitionBy(*SERIES)
    ordinary = (F.col("Subset") == "all_test") & ~F.col("Is_NoScaffold_Fold")
    folds = F.size(F.collect_set(F.when(ordinary, F.col("Fold"))).over(series)).cast("long")
    return marked.select(
        "*",
        *[F.median(F.when(ordinary, known(v))).over(series).alias(f"Ordinary_Median_{n}") for v, n in medians.items()],
        F.when(folds > 0, folds).alias("Ordinary_Reference_N_Folds"),
    )


def _of_subset(value: str, subset: str) -> Column:
    """The value of one subset, seen from every row of its point."""
    return F.first(F.when(F.col("Subset") == subset, F.col(value)), ignorenulls=True).over(Window.partitionBy(*POINT))


def classification_references(points: DataFrame) -> DataFrame:
    """Add the ordinary-fold reference, the change against it and the within-fold change."""
    inside = _of_subset("normPR", "no_scaffold") - _of_subset("normPR", "scaffold_bearing")
    return (
        _with_references(points, {"normPR": "normPR"})
        .withColumn("Delta_normPR_vs_Ordinary", F.col("normPR") - F.col("Ordinary_Median_normPR"))
        .withColumn("NoMinusScaffoldBearing_normPR", inside)
    )


def regression_references(points: DataFrame) -> DataFrame:
    inside = open_ratio(_of_subset("relMAE", "no_scaffold"), _of_subset("relMAE", "scaffold_bearing"))
    out = _with_references(points, {"relMAE": "relMAE", "MAE": "MAE", "Target_Scale": "TargetScale"})
    return (
        out.withColumn("relMAE_Inflation", open_ratio(F.col("relMAE"), F.col("Ordinary_Median_relMAE")))
        .withColumn("MAE_Ratio", open_ratio(F.col("MAE"), F.col("Ordinary_Median_MAE")))
        .withColumn("TargetScale_Ratio", open_ratio(F.col("Target_Scale"), F.col("Ordinary_Median_TargetScale")))
        .withColumn("NoVsScaffoldBearing_relMAE_Ratio", inside)
    )


def _medians(*names: str) -> list[Column]:
    return [F.median(known(n)).alias(f"Median_{n}") for n in names]


def classification_tables(points: DataFrame) -> DataFrame:
    """Subset medians with near-baseline shares, and the change summary per benchmark."""
    subsets = points.groupBy(F.lit("subset_metric_summary").alias("Table"), F.col("Subset").alias("Group")).agg(
        F.count(F.lit(1)).alias("N_EvaluationPoints"),
        *_medians("AP", "ROC_AUC", "normPR"),
        *[share(F.col("normPR") <= t).alias(f"NearBaseline_normPR_le_{_label(t)}") for t in NEAR_BASELINE],
    )
    delta, inside = F.col("Delta_normPR_vs_Ordinary"), F.col("NoMinusScaffoldBearing_normPR")
    changes = (
        points.where("Is_Primary_NoScaffold_Subset")
        .groupBy(F.lit("no_scaffold_delta_summary").alias("Table"), F.col("Benchmark").alias("Group"))
        .agg(
            F.count(F.lit(1)).alias("N_EvaluationPoints"),
            F.median(delta).alias("Median_Delta_normPR_vs_Ordinary"),
            share(delta < 0).alias("Fraction_Below_Ordinary"),
            F.median(inside).alias("Median_WithinFold_NoMinusScaffoldBearing"),
            share(inside < 0).alias("Fraction_Below_ScaffoldBearing"),
        )
    )
    return subsets.unionByName(changes, allowMissingColumns=True)


def regression_tables(points: DataFrame) -> DataFrame:
    subsets = points.groupBy(F.lit("subset_metric_summary").alias("Table"), F.col("Subset").alias("Group")).agg(
        F.count(F.lit(1)).alias("N_EvaluationPoints"),
        *_medians("MAE", "RMSE", "relMAE", "R2", "Pearson_r", "Spearman_rho"),
    )
    inflation = F.col("relMAE_Inflation")
    changes = (
        points.where("Is_Primary_NoScaffold_Subset")
        .groupBy(F.lit("no_scaffold_inflation_summary").alias("Table"), F.col("Benchmark").alias("Group"))
        .agg(
            F.count(F.lit(1)).alias("N_EvaluationPoints"),
            *_medians("relMAE_Inflation"),
            share(inflation >= 2).alias("Fraction_relMAE_Inflation_ge_2x"),
            share(inflation >= 3).alias("Fraction_relMAE_Inflation_ge_3x"),
            *_medians("MAE_Ratio", "TargetScale_Ratio"),
        )
    )
    return subsets.unionByName(changes, allowMissingColumns=True)


def _label(threshold: float) -> str:
    return str(threshold).replace(".", "p")


def near_baseline(points: DataFrame) -> DataFrame:
    """Median metrics and the share of points near the prevalence baseline, per subset."""
    return points.groupBy("Subset").agg(
        F.count(F.lit(1)).alias("N"),
        *_medians("AP", "ROC_AUC", "normPR", "Positive_Rate"),
        *[share(F.col("normPR") <= t).alias(f"normPR_le_{_label(t)}") for t in NEAR_BASELINE],
        share(F.col("ROC_AUC") > 0.55).alias("ROC_AUC_gt_0p55"),
    )


def tail_enrichment(points: DataFrame) -> DataFrame:
    """P(inflation >= t) per benchmark and pooled, from one grouping-sets pass."""
    tails = points.where(F.col("Subset") == "no_scaffold").select(
        "Benchmark",
        "relMAE_Inflation",
        F.explode(F.array(*[F.lit(t) for t in INFLATION_TAILS])).alias("t"),
    )
    sets = tails.groupingSets([["Benchmark", "t"], ["t"]], "Benchmark", "t").agg(
        share(F.col("relMAE_Inflation") >= F.col("t")).alias("NoScaffold_Tail_Probability"),
        F.count(F.lit(1)).alias("N_EvaluationPoints"),
        F.grouping("Benchmark").alias("_pooled"),
    )
    return sets.select(
        F.when(F.col("_pooled") == 1, F.lit("pooled")).otherwise(F.col("Benchmark")).alias("Benchmark"),
        F.lit("relMAE").alias("Metric"),
        F.concat(F.lit(">="), F.col("t").cast("int").cast("string"), F.lit("x")).alias("Tail_Criterion"),
        "NoScaffold_Tail_Probability",
        "N_EvaluationPoints",
    )


def direction_agreement(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Aggregate: share of rows, both known, that lie on the same side of the threshold."""
    return F.avg(F.when(a.isNotNull() & b.isNotNull(), ((a > threshold) == (b > threshold)).cast("int")))


def _pooled_spearman(pairs: DataFrame, keys: Sequence[str], x: str, y: str, name: str) -> DataFrame:
    """Rank correlation per key; needs three rows and two distinct values on each side."""
    keys = list(keys)
    both = pairs.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    rx = average_ranks(both.select(*keys, x), keys, x, "_rx").drop("n")
    ry = average_ranks(both.select(*keys, y), keys, y, "_ry").drop("n")
    ranked = both.join(rx, [*keys, x]).join(ry, [*keys, y])
    rho = F.when(F.count(F.lit(1)) >= 3, pearson("_rx", "_ry"))
    return ranked.groupBy(*keys).agg(rho.alias(name))


def _metric_long(points: DataFrame, metrics: Sequence[str], extra: Sequence[str]) -> DataFrame:
    return points.select("Subset", *POINT, *extra, *metrics).unpivot(
        ["Subset", *POINT, *extra], list(metrics), "Metric", "Value"
    )


def classification_metric_summary(points: DataFrame) -> DataFrame:
    """Per metric: pooled medians, their change, degradation rate and agreement with normPR.

    The reference here is the median over all folds, the primary fold included.
    """
    long = _metric_long(points, ["AP", "ROC_AUC", "normPR"], ["Delta_normPR_vs_Ordinary"])
    long = long.withColumn("Value", known("Value"))
    ordinary, empty = long.where(F.col("Subset") == "all_test"), long.where(F.col("Subset") == "no_scaffold")
    reference = ordinary.groupBy("Metric", *SERIES).agg(F.median("Value").alias("_reference"))
    base, delta = F.col("Metric") == "normPR", F.col("Delta_normPR_vs_Ordinary")
    compared = empty.join(reference, ["Metric", *SERIES], "left")
    compared = compared.withColumn(
        "_change", F.when(base, delta).otherwise(F.col("Value") - F.col("_reference"))
    ).withColumn("_loss", F.when(~base, -F.col("_change"))).withColumn("_base_loss", F.when(~base, -delta))
    rates = compared.groupBy("Metric").agg(
        F.median("Value").alias("NoScaffold_Median"),
        share(F.col("_change") < 0).alias("Degradation_Rate"),
        direction_agreement(F.col("_loss"), F.col("_base_loss")).alias("Direction_Agreement_With_normPR_Degradation"),
    )
    rho = _pooled_spearman(compared, ["Metric"], "_loss", "_base_loss", "Spearman_With_normPR_Degradation")
    pooled = ordinary.groupBy("Metric").agg(F.median("Value").alias("Ordinary_Median"))
    return (
        pooled.join(rates, "Metric", "left")
        .join(rho, "Metric", "left")
        .withColumn("Median_Change_NoMinusOrdinary", F.col("NoScaffold_Median") - F.col("Ordinary_Median"))
    )


def regression_metric_summary(points: DataFrame) -> DataFrame:
    """Ratios of error metrics and drops of association metrics against all-fold medians."""
    errors, associations = ["MAE", "RMSE", "relMAE"], ["R2", "Pearson_r", "Spearman_rho"]
    long = _metric_long(points, errors + associations, ["relMAE_Inflation"]).withColumn("Value", known("Value"))
    ordinary, empty = long.where(F.col("Subset") == "all_test"), long.where(F.col("Subset") == "no_scaffold")
    reference = ordinary.groupBy("Metric", *SERIES).agg(F.median("Value").alias("_reference"))
    is_error, inflation = F.col("Metric").isin(errors), F.col("relMAE_Inflation")
    effect = F.when(is_error, open_ratio(F.col("Value"), F.col("_reference"))).otherwise(
        F.col("_reference") - F.col("Value")
    )
    compared = empty.join(reference, ["Metric", *SERIES], "left").withColumn("_effect", effect)
    worse = F.when(is_error, F.col("_effect") > 1).otherwise(F.col("_effect") > 0)
    agreement = F.avg(
        F.when(
            F.col("_effect").isNotNull() & inflation.isNotNull(), (worse == (inflation > 1)).cast("int")
        )
    )
    rates = compared.groupBy("Metric").agg(
        F.median("Value").alias("NoScaffold_Median"),
        F.median("_effect").alias("Median_ModelTask_Ratio_or_Drop"),
        share(worse).alias("Degradation_Rate"),
        agreement.alias("Direction_Agreement_With_relMAE_Inflation"),
    )
    rho = _pooled_spearman(compared, ["Metric"], "_effect", "relMAE_Inflation", "Spearman_With_relMAE_Inflation")
    pooled = ordinary.groupBy("Metric").agg(F.median("Value").alias("Ordinary_Median"))
    ratio = F.when(is_error, F.try_divide("NoScaffold_Median", "Ordinary_Median"))
    return (
        pooled.join(rates, "Metric", "left")
        .join(rho, "Metric", "left")
        .withColumn("Metric_Type", F.when(is_error, "error").otherwise("association"))
        .withColumn("Pooled_NoScaffold_to_Ordinary_Ratio", ratio)
    )


def _cases(sub: DataFrame, rules: Sequence[tuple], n_cases: int, columns: Sequence[str]) -> DataFrame:
    """Top lists in order, each point kept where it first appears, cut to n_cases.

    Every list is a top-k (each task keeps k rows), so the window that numbers a
    list sees at most n_cases rows.  Ties beyond the named columns follow the point.
    """
    merged = None
    for place, (name, size, order, keep) in enumerate(rules):
        chosen = sub if keep is None else sub.where(keep)
        order = [*order, *[F.col(k).asc() for k in POINT]]
        top = chosen.orderBy(*order).limit(size).withColumn("Case_Type", F.lit(name)).withColumn("_list", F.lit(place))
        top = top.withColumn("_position", F.row_number().over(Window.partitionBy("_list").orderBy(*order)))
        merged = top if merged is None else merged.unionByName(top)
    first = merged.groupBy(*POINT).agg(
        F.min_by(F.struct("Case_Type", "_list", "_position", *columns), F.struct("_list", "_position")).alias("_c")
    )
    kept = first.select(*POINT, "_c.*").orderBy("_list", "_position").limit(n_cases)
    return kept.select("Case_Type", *POINT, *columns)


def classification_cases(points: DataFrame, n_cases: int = 20) -> DataFrame:
    """Points where the metrics disagree about a model on the empty group."""
    sub = points.where(F.col("Subset") == "no_scaffold").withColumn("_near", F.abs("normPR"))
    rate, ap, auc, near = (F.col(c) for c in ("Positive_Rate", "AP", "ROC_AUC", "_near"))
    down, up = Column.desc_nulls_last, Column.asc_nulls_last
    quarter, half = n_cases // 4, n_cases // 2
    rules = [
        ("high_AP_high_prior_low_normPR", quarter, [down(rate), down(ap), up(near)], None),
        ("nonzero_AP_near_prior_normPR", quarter, [up(near), down(ap)], None),
        ("ROC_AUC_above_random_near_prior_normPR", half, [up(near), down(auc)], auc > 0.55),
    ]
    columns = [
        "N", "N_Positive", "N_Negative", "Positive_Rate", "AP", "ROC_AUC", "normPR",
        "Delta_normPR_vs_Ordinary", "NoMinusScaffoldBearing_normPR",
    ]
    return _cases(sub, rules, n_cases, columns)


def regression_cases(points: DataFrame, n_cases: int = 20) -> DataFrame:
    sub = points.where(F.col("Subset") == "no_scaffold").withColumn(
        "_tail", open_ratio(F.col("RMSE"), F.col("MAE"))
    )
    inflation, mae_ratio, r2, r, tail = (
        F.col(c) for c in ("relMAE_Inflation", "MAE_Ratio", "R2", "Pearson_r", "_tail")
    )
    down, up = Column.desc_nulls_last, Column.asc_nulls_last
    quarter = n_cases // 4
    rules = [
        ("high_relMAE_from_target_scale", quarter, [down(inflation), up(mae_ratio)], None),
        ("high_relMAE_high_R2", quarter, [down(inflation), down(r2)], None),
        ("high_relMAE_high_Pearson", quarter, [down(inflation), down(r)], None),
        ("RMSE_tail_sensitivity", quarter, [down(tail), down(inflation)], None),
    ]
    columns = [
        "N", "MAE", "RMSE", "relMAE", "MAE_Ratio", "TargetScale_Ratio",
        "relMAE_Inflation", "R2", "Pearson_r", "Spearman_rho",
    ]
    return _cases(sub, rules, n_cases, columns)


def top_list(df: DataFrame, first: str, second: str | None, label: str, n: int = 5) -> DataFrame:
    """Labels of the n rows with the largest sum of two measures, missing counted as zero."""
    total = F.coalesce(F.col(first), F.lit(0.0)) + (F.coalesce(F.col(second), F.lit(0.0)) if second else F.lit(0.0))
    return df.select(label, total.alias("score")).orderBy(F.col("score").desc(), label).limit(n)


def reference_comparison(points: DataFrame, values: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Ordinary-fold medians next to the primary-fold value of each series."""
    ordinary = points.where(~F.col("Is_NoScaffold_Fold") & (F.col("Subset") == "all_test"))
    medians = ordinary.groupBy(*keys).agg(
        F.sum("N").alias("Ordinary_N"), *[F.median(known(v)).alias(f"Ordinary_{v}") for v in values]
    )
    primary = points.where("Is_Primary_NoScaffold_Subset").select(
        *keys, F.col("N").alias("NoScaffold_N"), *[F.col(v).alias(f"NoScaffold_{v}") for v in values]
    )
    return medians.join(primary, list(keys), "left")


def comparison_effects(compared: DataFrame, errors: Sequence[str], associations: Sequence[str]) -> DataFrame:
    """Ratio of error metrics and drop of association metrics, primary fold against ordinary folds."""
    ratios = [
        open_ratio(F.col(f"NoScaffold_{m}"), F.col(f"Ordinary_{m}")).alias(f"{m}_Ratio") for m in errors
    ]
    drops = [(F.col(f"Ordinary_{m}") - F.col(f"NoScaffold_{m}")).alias(f"{m}_Drop") for m in associations]
    return compared.select("*", *ratios, *drops)


# Report names of the structural medians and the effect sizes that are counted.
STRUCTURE_MEDIANS = {
    "median_no_pairwise": "No_PairwiseMean",
    "median_hasmixed_pairwise": "HasMixed_PairwiseMean",
    "median_true_scaffold_pairwise": "TrueScaffoldClass_PairwiseMean",
    "median_no_gini": "No_CohesionGini",
    "median_hasmixed_gini": "HasMixed_CohesionGini",
    "median_true_scaffold_gini": "TrueScaffoldClass_CohesionGini",
    "median_same_scaffold_nn": "SameScaffold_NNMean",
    "median_cross_scaffold_nn": "CrossScaffold_NNMean",
    "median_no_to_scaffold_nn": "NoToScaffold_NNMean",
}


def reference_deltas(points: DataFrame, values: Sequence[str], counts: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Per series the primary fold's empty-group subset against the ordinary folds: its counts, and for every
    metric the ordinary median, its own value and the difference; series without such a subset are left out."""
    keys = list(keys)
    primary = F.col("Is_Primary_NoScaffold_Subset")
    ordinary = ~F.col("Is_NoScaffold_Fold") & (F.col("Subset") == "all_test")

    def own(c: str) -> Column:
        return F.max(F.when(primary, F.col(c)))

    out = points.groupBy(*keys).agg(
        F.max(primary.cast("int")).alias("_has"),
        *[own(c).alias(f"NoScaffold_{c}") for c in (*counts, *values)],
        *[F.median(F.when(ordinary, known(v))).alias(f"Ordinary_Median_{v}") for v in values],
    )
    deltas = [(F.col(f"NoScaffold_{v}") - F.col(f"Ordinary_Median_{v}")).alias(f"Delta_{v}") for v in values]
    return out.where("_has = 1").select("*", *deltas).drop("_has")


def summary_values(
    structure: DataFrame, regression: DataFrame, classification: DataFrame, n: int = 5, inventory: DataFrame | None = None, benchmarks: Sequence[str] = ("moleculenet", "admet")
) -> DataFrame:
    """One row of report figures from the per-dataset tables.

    ``inventory`` (Benchmark and TaskGroup per dataset) adds the datasets of each benchmark and task group.

    ``regression`` and ``classification`` are label-shift tables with a ``Label``.
    The top lists come from top-k sorts, so only n rows reach the list aggregate.
    """

    def listed(shift: DataFrame, first: str, second: str, name: str) -> DataFrame:
        top = top_list(shift, first, second, "Label", n)
        entries = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "Label")))
        return top.agg(F.transform(entries, lambda e: e["Label"]).alias(name))

    g, rate = F.col("Abs_StandardizedMeanDiff"), F.col("Abs_PositiveRate_Diff")
    parts = [
        structure.agg(
            F.count(F.lit(1)).alias("n_datasets_total"),
            *[F.median(known(c)).alias(k) for k, c in STRUCTURE_MEDIANS.items()],
        ),
        regression.agg(
            F.count(F.lit(1)).alias("n_regression_targets"),
            count_if(g >= 0.5).alias("n_regression_abs_g_ge_0p5"),
            count_if(g >= 0.8).alias("n_regression_abs_g_ge_0p8"),
        ),
        classification.agg(
            F.count(F.lit(1)).alias("n_classification_targets"),
            count_if(rate >= 0.10).alias("n_classification_prevdiff_ge_0p10"),
            count_if(rate >= 0.20).alias("n_classification_prevdiff_ge_0p20"),
        ),
        listed(regression, "Abs_StandardizedMeanDiff", "KS_Statistic", "top_regression_shift_targets"),
        listed(classification, "Abs_PositiveRate_Diff", "Bernoulli_JSD", "top_classification_shift_targets"),
    ]
    if inventory is not None:
        sides = {**{b: F.col("Benchmark") == b for b in benchmarks}, **{t: F.col("TaskGroup") == t for t in ("classification", "regression")}}
        parts.append(inventory.agg(*[count_if(c).alias(f"n_datasets_{k}") for k, c in sides.items()]))
    out = parts[0].withColumn("_row", F.lit(1))
    for part in parts[1:]:  # every part is a single row
        out = out.join(part.withColumn("_row", F.lit(1)), "_row")
    return out.drop("_row")
