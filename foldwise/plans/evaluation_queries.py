"""Evaluation tables, reference comparisons, report summaries and row alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.operators import alignment as A
from foldwise.operators import evaluation as E
from foldwise.operators.classification import score_counts, threshold_metrics
from foldwise.operators.shift import regression_label_shift
from foldwise.plans.registry import query
from foldwise.plans.roles import CLASSIFIED, ENTITIES, LINES, REGRESSED, classified, entities, regressed, test_rows
from foldwise.sources.tables import load

_POINT = '"Benchmark", "Dataset", "Target", "Model", "Fold"'
_SERIES = '"Benchmark", "Dataset", "Target", "Model"'
_FAN = "LATERAL (VALUES ('all_test'), (CASE WHEN is_empty THEN 'no_scaffold' ELSE 'scaffold_bearing' END)) s(\"Subset\")"

_SIZES = """sz AS (SELECT "Benchmark", "Dataset", "Fold", count(*) AS "Test_Size",
    count(*) FILTER (is_empty) AS "NoScaffold_Test_N",
    count(*) FILTER (is_empty) / count(*)::DOUBLE AS "NoScaffold_Test_Fraction" FROM lines GROUP BY ALL)"""

_CLS_POINTS = f"""{CLASSIFIED}, {_SIZES},
  fan AS (SELECT {_POINT}, "Subset", score, CASE WHEN y > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM cls, {_FAN}),
  thr AS (SELECT {_POINT}, "Subset", score, sum(y) AS pos, count(*) AS c FROM fan GROUP BY ALL),
  cum AS (SELECT *, sum(pos) OVER w AS hits, sum(c) OVER w AS upto FROM thr
    WINDOW w AS (PARTITION BY {_POINT}, "Subset" ORDER BY score DESC)),
  tot AS (SELECT {_POINT}, "Subset", sum(pos) AS p, sum(c) - sum(pos) AS m, sum(pos * (hits / upto)) AS aps,
    sum(pos * ((c + 1) / 2.0::DOUBLE - upto)) AS ranks FROM cum GROUP BY ALL),
  met AS (SELECT {_POINT}, "Subset", (p + m)::BIGINT AS "N", p::BIGINT AS "N_Positive", m::BIGINT AS "N_Negative",
    p / (p + m) AS "Positive_Rate", aps / p AS "AP",
    (ranks + p * (p + m) - p * (p + 1) / 2.0::DOUBLE) / (p * m) AS "ROC_AUC",
    (aps / p - p / (p + m)) / (1 - p / (p + m)) AS "normPR" FROM tot WHERE p >= 10 AND m >= 10),
  points AS (SELECT * FROM met JOIN sz USING ("Benchmark", "Dataset", "Fold"))"""

_REG_POINTS = f"""{REGRESSED}, {_SIZES}, fan AS (SELECT {_POINT}, "Subset", y, pred FROM reg, {_FAN}),
  rk AS (SELECT *, rank() OVER (PARTITION BY {_POINT}, "Subset" ORDER BY y)
      + (count(*) OVER (PARTITION BY {_POINT}, "Subset", y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY {_POINT}, "Subset" ORDER BY pred)
      + (count(*) OVER (PARTITION BY {_POINT}, "Subset", pred) - 1) / 2.0::DOUBLE AS rp FROM fan),
  met AS (SELECT {_POINT}, "Subset", count(*) AS "N", avg(abs(y)) AS "Target_Scale", avg(abs(y - pred)) AS "MAE",
    sqrt(avg((y - pred) * (y - pred))) AS "RMSE", avg(abs(y - pred)) / avg(abs(y)) AS "relMAE",
    1 - avg((y - pred) * (y - pred)) / var_pop(y) AS "R2", corr(y, pred) AS "Pearson_r", corr(ry, rp) AS "Spearman_rho",
    stddev_samp(pred) AS "Prediction_SD", stddev_samp(y) AS "Target_SD" FROM rk GROUP BY ALL HAVING count(*) >= 5),
  points AS (SELECT * FROM met JOIN sz USING ("Benchmark", "Dataset", "Fold"))"""

_MARKED = """prim AS (SELECT "Benchmark", "Dataset", "Fold" AS prim_fold FROM
    (SELECT DISTINCT "Benchmark", "Dataset", "Fold", "NoScaffold_Test_N" FROM points WHERE "NoScaffold_Test_N" > 0)
    QUALIFY row_number() OVER (PARTITION BY "Benchmark", "Dataset" ORDER BY "NoScaffold_Test_N" DESC, "Fold") = 1),
  marked AS (SELECT points.*, coalesce("Fold" = prim_fold, false) AS "Is_NoScaffold_Fold",
    "Subset" = 'no_scaffold' AND coalesce("Fold" = prim_fold, false) AS "Is_Primary_NoScaffold_Subset",
    'ordinary_folds_excluding_no_scaffold_fold' AS "Reference_Type"
    FROM points LEFT JOIN prim USING ("Benchmark", "Dataset"))"""

_CLS_REFS = f"""{_CLS_POINTS}, {_MARKED},
  ord AS (SELECT {_SERIES}, median("normPR") AS "Ordinary_Median_normPR",
    count(DISTINCT "Fold") AS "Ordinary_Reference_N_Folds" FROM marked
    WHERE "Subset" = 'all_test' AND NOT "Is_NoScaffold_Fold" GROUP BY ALL),
  ins AS (SELECT {_POINT}, max("normPR") FILTER ("Subset" = 'no_scaffold')
    - max("normPR") FILTER ("Subset" = 'scaffold_bearing') AS "NoMinusScaffoldBearing_normPR" FROM marked GROUP BY ALL),
  refs AS (SELECT *, "normPR" - "Ordinary_Median_normPR" AS "Delta_normPR_vs_Ordinary"
    FROM marked LEFT JOIN ord USING ({_SERIES}) LEFT JOIN ins USING ({_POINT}))"""

_REG_REFS = f"""{_REG_POINTS}, {_MARKED},
  ord AS (SELECT {_SERIES}, median("relMAE") AS "Ordinary_Median_relMAE", median("MAE") AS "Ordinary_Median_MAE",
    median("Target_Scale") AS "Ordinary_Median_TargetScale", count(DISTINCT "Fold") AS "Ordinary_Reference_N_Folds"
    FROM marked WHERE "Subset" = 'all_test' AND NOT "Is_NoScaffold_Fold" GROUP BY ALL),
  ins AS (SELECT {_POINT}, max("relMAE") FILTER ("Subset" = 'no_scaffold')
    / max("relMAE") FILTER ("Subset" = 'scaffold_bearing') AS "NoVsScaffoldBearing_relMAE_Ratio" FROM marked GROUP BY ALL),
  refs AS (SELECT *, "relMAE" / "Ordinary_Median_relMAE" AS "relMAE_Inflation", "MAE" / "Ordinary_Median_MAE" AS "MAE_Ratio",
    "Target_Scale" / "Ordinary_Median_TargetScale" AS "TargetScale_Ratio"
    FROM marked LEFT JOIN ord USING ({_SERIES}) LEFT JOIN ins USING ({_POINT}))"""

_CLS_DOUBLES = "NoScaffold_Test_Fraction Positive_Rate AP ROC_AUC normPR"
_CLS_REF_DOUBLES = _CLS_DOUBLES + " Ordinary_Median_normPR NoMinusScaffoldBearing_normPR Delta_normPR_vs_Ordinary"
_REG_DOUBLES = (
    "NoScaffold_Test_Fraction Target_Scale MAE RMSE relMAE R2 Pearson_r Spearman_rho Prediction_SD Target_SD"
)
_REG_REF_DOUBLES = _REG_DOUBLES + (
    " Ordinary_Median_relMAE Ordinary_Median_MAE Ordinary_Median_TargetScale NoVsScaffoldBearing_relMAE_Ratio"
    " relMAE_Inflation MAE_Ratio TargetScale_Ratio"
)


def classification_points(spark, folder) -> DataFrame:
    points = E.evaluate_classification(classified(spark, folder))
    return points.join(E.fold_sizes(test_rows(spark, folder)), ["Benchmark", "Dataset", "Fold"])


def regression_points(spark, folder) -> DataFrame:
    points = E.evaluate_regression(regressed(spark, folder))
    return points.join(E.fold_sizes(test_rows(spark, folder)), ["Benchmark", "Dataset", "Fold"])


def classification_refs(spark, folder) -> DataFrame:
    return E.classification_references(E.materialize_points(classification_points(spark, folder)))


def regression_refs(spark, folder) -> DataFrame:
    return E.regression_references(E.materialize_points(regression_points(spark, folder)))


query("evaluate_classification", f"WITH {_CLS_POINTS} SELECT * FROM points", _CLS_DOUBLES)(classification_points)
query("evaluate_regression", f"WITH {_REG_POINTS} SELECT * FROM points", _REG_DOUBLES)(regression_points)
query("ordinary_reference_delta", f"WITH {_CLS_REFS} SELECT * FROM refs", _CLS_REF_DOUBLES)(classification_refs)
query("inflation_ratio", f"WITH {_REG_REFS} SELECT * FROM refs", _REG_REF_DOUBLES)(regression_refs)


@query("fold_sizes", f"WITH {LINES}, {_SIZES} SELECT * FROM sz", "NoScaffold_Test_Fraction")
def fold_sizes(spark, folder):
    return E.fold_sizes(test_rows(spark, folder))


@query(
    "mark_primary_fold",
    f"""WITH {LINES}, {_SIZES}, points AS (SELECT sz.*, s."Subset" FROM sz,
      LATERAL (VALUES ('all_test'), ('no_scaffold')) s("Subset")), {_MARKED}
      SELECT "Benchmark", "Dataset", "Fold", "Subset", "NoScaffold_Test_N", "Is_NoScaffold_Fold",
        "Is_Primary_NoScaffold_Subset" FROM marked""",
)
def mark_primary_fold(spark, folder):
    sizes = E.fold_sizes(test_rows(spark, folder))
    points = sizes.withColumn("Subset", F.explode(F.array(F.lit("all_test"), F.lit("no_scaffold"))))
    return E.mark_primary_fold(points).select(
        "Benchmark", "Dataset", "Fold", "Subset", "NoScaffold_Test_N", "Is_NoScaffold_Fold", "Is_Primary_NoScaffold_Subset"
    )


_WITHIN = ", ".join(f"max(\"normPR\") FILTER (\"Subset\" = '{s}') AS {s}" for s in E.SUBSETS)


@query("within_fold_pivot", f"WITH {_CLS_POINTS} SELECT {_POINT}, {_WITHIN} FROM points GROUP BY ALL", " ".join(E.SUBSETS))
def within_fold_pivot(spark, folder):
    return E.within_fold(classification_points(spark, folder), "normPR")


def _median_list(*names):
    return ", ".join(f'median("{n}") AS "Median_{n}"' for n in names)


_CLS_TABLES = """SELECT 'subset_metric_summary' AS "Table", "Subset" AS "Group", count(*) AS "N_EvaluationPoints", """ + (
    _median_list("AP", "ROC_AUC", "normPR")
) + """, avg(coalesce("normPR" <= 0.05::DOUBLE, false)::INT) AS "NearBaseline_normPR_le_0p05",
    avg(coalesce("normPR" <= 0.02::DOUBLE, false)::INT) AS "NearBaseline_normPR_le_0p02" FROM refs GROUP BY ALL
  UNION ALL BY NAME
  SELECT 'no_scaffold_delta_summary' AS "Table", "Benchmark" AS "Group", count(*) AS "N_EvaluationPoints",
    median("Delta_normPR_vs_Ordinary") AS "Median_Delta_normPR_vs_Ordinary",
    avg(coalesce("Delta_normPR_vs_Ordinary" < 0, false)::INT) AS "Fraction_Below_Ordinary",
    median("NoMinusScaffoldBearing_normPR") AS "Median_WithinFold_NoMinusScaffoldBearing",
    avg(coalesce("NoMinusScaffoldBearing_normPR" < 0, false)::INT) AS "Fraction_Below_ScaffoldBearing"
    FROM refs WHERE "Is_Primary_NoScaffold_Subset" GROUP BY ALL"""


@query(
    "classification_tables",
    f"WITH {_CLS_REFS} {_CLS_TABLES}",
    "Median_AP Median_ROC_AUC Median_normPR NearBaseline_normPR_le_0p05 NearBaseline_normPR_le_0p02"
    " Median_Delta_normPR_vs_Ordinary Fraction_Below_Ordinary Median_WithinFold_NoMinusScaffoldBearing"
    " Fraction_Below_ScaffoldBearing",
)
def classification_tables(spark, folder):
    return E.classification_tables(classification_refs(spark, folder))


_REG_TABLES = """SELECT 'subset_metric_summary' AS "Table", "Subset" AS "Group", count(*) AS "N_EvaluationPoints", """ + (
    _median_list("MAE", "RMSE", "relMAE", "R2", "Pearson_r", "Spearman_rho")
) + """ FROM refs GROUP BY ALL
  UNION ALL BY NAME
  SELECT 'no_scaffold_inflation_summary' AS "Table", "Benchmark" AS "Group", count(*) AS "N_EvaluationPoints",
    median("relMAE_Inflation") AS "Median_relMAE_Inflation",
    avg(coalesce("relMAE_Inflation" >= 2, false)::INT) AS "Fraction_relMAE_Inflation_ge_2x",
    avg(coalesce("relMAE_Inflation" >= 3, false)::INT) AS "Fraction_relMAE_Inflation_ge_3x",
    median("MAE_Ratio") AS "Median_MAE_Ratio", median("TargetScale_Ratio") AS "Median_TargetScale_Ratio"
    FROM refs WHERE "Is_Primary_NoScaffold_Subset" GROUP BY ALL"""


@query(
    "regression_tables",
    f"WITH {_REG_REFS} {_REG_TABLES}",
    "Median_MAE Median_RMSE Median_relMAE Median_R2 Median_Pearson_r Median_Spearman_rho Median_relMAE_Inflation"
    " Fraction_relMAE_Inflation_ge_2x Fraction_relMAE_Inflation_ge_3x Median_MAE_Ratio Median_TargetScale_Ratio",
)
def regression_tables(spark, folder):
    return E.regression_tables(regression_refs(spark, folder))


@query(
    "near_baseline_fraction",
    f"""WITH {_CLS_POINTS} SELECT "Subset", count(*) AS "N", {_median_list("AP", "ROC_AUC", "normPR", "Positive_Rate")},
      avg(coalesce("normPR" <= 0.05::DOUBLE, false)::INT) AS "normPR_le_0p05",
      avg(coalesce("normPR" <= 0.02::DOUBLE, false)::INT) AS "normPR_le_0p02",
      avg(coalesce("ROC_AUC" > 0.55::DOUBLE, false)::INT) AS "ROC_AUC_gt_0p55" FROM points GROUP BY ALL""",
    "Median_AP Median_ROC_AUC Median_normPR Median_Positive_Rate normPR_le_0p05 normPR_le_0p02 ROC_AUC_gt_0p55",
)
def near_baseline_fraction(spark, folder):
    return E.near_baseline(classification_points(spark, folder))


@query(
    "tail_enrichment_grouping_sets",
    f"""WITH {_REG_REFS}, t AS (SELECT "Benchmark", "relMAE_Inflation" AS v, x.t FROM refs, (VALUES (2), (3)) x(t)
        WHERE "Subset" = 'no_scaffold')
      SELECT coalesce("Benchmark", 'pooled') AS "Benchmark", 'relMAE' AS "Metric", '>=' || t || 'x' AS "Tail_Criterion",
        avg(coalesce(v >= t, false)::INT) AS "NoScaffold_Tail_Probability", count(*) AS "N_EvaluationPoints"
      FROM t GROUP BY GROUPING SETS (("Benchmark", t), (t))""",
    "NoScaffold_Tail_Probability",
)
def tail_enrichment(spark, folder):
    return E.tail_enrichment(regression_refs(spark, folder))


def _rho(cte: str, x: str, y: str) -> str:
    """Rank correlation per metric of two columns of a CTE."""
    return f"""rr AS (SELECT "Metric", rank() OVER (PARTITION BY "Metric" ORDER BY {x})
        + (count(*) OVER (PARTITION BY "Metric", {x}) - 1) / 2.0::DOUBLE AS a,
        rank() OVER (PARTITION BY "Metric" ORDER BY {y})
        + (count(*) OVER (PARTITION BY "Metric", {y}) - 1) / 2.0::DOUBLE AS b
        FROM {cte} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
      rho AS (SELECT "Metric", CASE WHEN count(*) >= 3 THEN corr(a, b) END AS rho FROM rr GROUP BY 1)"""


def _long_sql(metrics, extra):
    rows = ", ".join(f"('{m}', \"{m}\")" for m in metrics)
    return f"""lg AS (SELECT {_POINT}, "Subset", {extra}, m."Metric", m.v FROM refs, LATERAL (VALUES {rows}) m("Metric", v)),
      rf AS (SELECT {_SERIES}, "Metric", median(v) AS r FROM lg WHERE "Subset" = 'all_test' GROUP BY ALL)"""


@query(
    "classification_metric_summary",
    f"""WITH {_CLS_REFS}, {_long_sql(("AP", "ROC_AUC", "normPR"), '"Delta_normPR_vs_Ordinary" AS d')},
      cp AS (SELECT *, CASE WHEN "Metric" = 'normPR' THEN d ELSE v - r END AS ch,
        CASE WHEN "Metric" <> 'normPR' THEN -(v - r) END AS loss, CASE WHEN "Metric" <> 'normPR' THEN -d END AS base
        FROM lg LEFT JOIN rf USING ({_SERIES}, "Metric") WHERE "Subset" = 'no_scaffold'),
      {_rho("cp", "loss", "base")},
      po AS (SELECT "Metric", median(v) AS "Ordinary_Median" FROM lg WHERE "Subset" = 'all_test' GROUP BY 1),
      rt AS (SELECT "Metric", median(v) AS "NoScaffold_Median", avg(coalesce(ch < 0, false)::INT) AS "Degradation_Rate",
        avg(((loss > 0) = (base > 0))::INT) AS "Direction_Agreement_With_normPR_Degradation" FROM cp GROUP BY 1)
      SELECT po.*, rt.* EXCLUDE ("Metric"), rho AS "Spearman_With_normPR_Degradation",
        "NoScaffold_Median" - "Ordinary_Median" AS "Median_Change_NoMinusOrdinary"
      FROM po LEFT JOIN rt USING ("Metric") LEFT JOIN rho USING ("Metric")""",
    "Ordinary_Median NoScaffold_Median Degradation_Rate Direction_Agreement_With_normPR_Degradation"
    " Spearman_With_normPR_Degradation Median_Change_NoMinusOrdinary",
)
def classification_metric_summary(spark, folder):
    return E.classification_metric_summary(classification_refs(spark, folder))


@query(
    "regression_metric_summary",
    f"""WITH {_REG_REFS},
      {_long_sql(("MAE", "RMSE", "relMAE", "R2", "Pearson_r", "Spearman_rho"), '"relMAE_Inflation" AS infl')},
      cp AS (SELECT *, "Metric" IN ('MAE', 'RMSE', 'relMAE') AS err,
        CASE WHEN "Metric" IN ('MAE', 'RMSE', 'relMAE') THEN v / r ELSE r - v END AS eff
        FROM lg LEFT JOIN rf USING ({_SERIES}, "Metric") WHERE "Subset" = 'no_scaffold'),
      {_rho("cp", "eff", "infl")},
      po AS (SELECT "Metric", median(v) AS "Ordinary_Median" FROM lg WHERE "Subset" = 'all_test' GROUP BY 1),
      rt AS (SELECT "Metric", median(v) AS "NoScaffold_Median", median(eff) AS "Median_ModelTask_Ratio_or_Drop",
        avg(coalesce(CASE WHEN err THEN eff > 1 ELSE eff > 0 END, false)::INT) AS "Degradation_Rate",
        avg((CASE WHEN err THEN eff > 1 ELSE eff > 0 END = (infl > 1))::INT) AS "Direction_Agreement_With_relMAE_Inflation"
        FROM cp GROUP BY 1)
      SELECT po.*, rt.* EXCLUDE ("Metric"), rho AS "Spearman_With_relMAE_Inflation",
        CASE WHEN "Metric" IN ('MAE', 'RMSE', 'relMAE') THEN 'error' ELSE 'association' END AS "Metric_Type",
        CASE WHEN "Metric" IN ('MAE', 'RMSE', 'relMAE') THEN "NoScaffold_Median" / "Ordinary_Median" END
          AS "Pooled_NoScaffold_to_Ordinary_Ratio"
      FROM po LEFT JOIN rt USING ("Metric") LEFT JOIN rho USING ("Metric")""",
    "Ordinary_Median NoScaffold_Median Median_ModelTask_Ratio_or_Drop Degradation_Rate"
    " Direction_Agreement_With_relMAE_Inflation Spearman_With_relMAE_Inflation Pooled_NoScaffold_to_Ordinary_Ratio",
)
def regression_metric_summary(spark, folder):
    return E.regression_metric_summary(regression_refs(spark, folder))


def _case_sql(rules, columns):
    tops = []
    for place, (name, size, order, keep) in enumerate(rules):
        by = f"{order}, {_POINT}"
        tops.append(
            f"""(SELECT '{name}' AS "Case_Type", {place} AS li, row_number() OVER (ORDER BY {by}) AS po, * FROM sub
                 WHERE {keep} ORDER BY {by} LIMIT {size})"""
        )
    cols = ", ".join(f'"{c}"' for c in columns)
    return f"""al AS ({" UNION ALL ".join(tops)}),
      un AS (SELECT * FROM al QUALIFY row_number() OVER (PARTITION BY {_POINT} ORDER BY li, po) = 1)
      SELECT "Case_Type", {_POINT}, {cols} FROM un ORDER BY li, po LIMIT 20"""


_CLS_CASES = _case_sql(
    [
        ("high_AP_high_prior_low_normPR", 5, '"Positive_Rate" DESC NULLS LAST, "AP" DESC NULLS LAST, near', "true"),
        ("nonzero_AP_near_prior_normPR", 5, 'near, "AP" DESC NULLS LAST', "true"),
        ("ROC_AUC_above_random_near_prior_normPR", 10, 'near, "ROC_AUC" DESC NULLS LAST', '"ROC_AUC" > 0.55::DOUBLE'),
    ],
    ("N", "N_Positive", "N_Negative", "Positive_Rate", "AP", "ROC_AUC", "normPR", "Delta_normPR_vs_Ordinary",
     "NoMinusScaffoldBearing_normPR"),
)


@query(
    "discordance_topk_classification",
    f"""WITH {_CLS_REFS}, sub AS (SELECT *, abs("normPR") AS near FROM refs WHERE "Subset" = 'no_scaffold'), {_CLS_CASES}""",
    "Positive_Rate AP ROC_AUC normPR Delta_normPR_vs_Ordinary NoMinusScaffoldBearing_normPR",
)
def classification_cases(spark, folder):
    return E.classification_cases(classification_refs(spark, folder))


_REG_CASES = _case_sql(
    [
        ("high_relMAE_from_target_scale", 5, '"relMAE_Inflation" DESC NULLS LAST, "MAE_Ratio"', "true"),
        ("high_relMAE_high_R2", 5, '"relMAE_Inflation" DESC NULLS LAST, "R2" DESC NULLS LAST', "true"),
        ("high_relMAE_high_Pearson", 5, '"relMAE_Inflation" DESC NULLS LAST, "Pearson_r" DESC NULLS LAST', "true"),
        ("RMSE_tail_sensitivity", 5, '"RMSE" / "MAE" DESC NULLS LAST, "relMAE_Inflation" DESC NULLS LAST', "true"),
    ],
    ("N", "MAE", "RMSE", "relMAE", "MAE_Ratio", "TargetScale_Ratio", "relMAE_Inflation", "R2", "Pearson_r", "Spearman_rho"),
)


@query(
    "discordance_topk_regression",
    f"""WITH {_REG_REFS}, sub AS (SELECT * FROM refs WHERE "Subset" = 'no_scaffold'), {_REG_CASES}""",
    "MAE RMSE relMAE MAE_Ratio TargetScale_Ratio relMAE_Inflation R2 Pearson_r Spearman_rho",
)
def regression_cases(spark, folder):
    return E.regression_cases(regression_refs(spark, folder))


_COMPARED = ("MAE", "RMSE", "R2", "Pearson_r", "Spearman_rho", "Target_Scale", "relMAE")
_COMPARED_DOUBLES = " ".join(f"{side}_{m}" for side in ("Ordinary", "NoScaffold") for m in _COMPARED)


@query(
    "reference_comparison",
    f"""WITH {_REG_REFS}, md AS (SELECT {_SERIES}, sum("N")::BIGINT AS "Ordinary_N", {", ".join(f'median("{m}") AS "Ordinary_{m}"' for m in _COMPARED)}
        FROM refs WHERE NOT "Is_NoScaffold_Fold" AND "Subset" = 'all_test' GROUP BY ALL),
      pr AS (SELECT {_SERIES}, "N" AS "NoScaffold_N", {", ".join(f'"{m}" AS "NoScaffold_{m}"' for m in _COMPARED)} FROM refs
        WHERE "Is_Primary_NoScaffold_Subset")
      SELECT * FROM md LEFT JOIN pr USING ({_SERIES})""",
    _COMPARED_DOUBLES,
)
def reference_comparison(spark, folder):
    return E.reference_comparison(regression_refs(spark, folder), list(_COMPARED), E.SERIES)


_CLS_COMPARED = ("positive_rate", "average_precision", "roc_auc", "normPR", "accuracy", "balanced_accuracy", "f1", "mcc")


@query(
    "classification_comparison",
    f"""WITH {_CLS_POINTS}, {_MARKED},
      hit AS (SELECT {_POINT}, "Subset", sum(y) FILTER (score >= 0.5) AS tp, sum(1 - y) FILTER (score >= 0.5) AS fp, sum(y) AS p, sum(1 - y) AS m FROM fan GROUP BY ALL),
      four AS (SELECT {_POINT}, "Subset", coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, p - coalesce(tp, 0) AS fn, m - coalesce(fp, 0) AS tn FROM hit),
      thr8 AS (SELECT {_POINT}, "Subset", (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 AS balanced_accuracy,
        2 * tp / nullif(2 * tp + fp + fn, 0) AS f1, (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM four),
      eight AS (SELECT marked.*, "Positive_Rate" AS positive_rate, "AP" AS average_precision, "ROC_AUC" AS roc_auc, thr8.accuracy, balanced_accuracy, f1, mcc
        FROM marked JOIN thr8 USING ({_POINT}, "Subset")),
      md AS (SELECT {_SERIES}, {", ".join(f'median("{m}") AS "Ordinary_Median_{m}"' for m in _CLS_COMPARED)} FROM eight
        WHERE NOT "Is_NoScaffold_Fold" AND "Subset" = 'all_test' GROUP BY ALL)
      SELECT {_SERIES}, "N" AS "NoScaffold_N", "N_Positive" AS "NoScaffold_N_Positive", "N_Negative" AS "NoScaffold_N_Negative",
        {", ".join(f'"{m}" AS "NoScaffold_{m}", "Ordinary_Median_{m}", "{m}" - "Ordinary_Median_{m}" AS "Delta_{m}"' for m in _CLS_COMPARED)}
      FROM eight LEFT JOIN md USING ({_SERIES}) WHERE ("Is_Primary_NoScaffold_Subset")""",
    " ".join(f"{side}_{m}" for side in ("NoScaffold", "Ordinary_Median", "Delta") for m in _CLS_COMPARED),
)
def classification_comparison(spark, folder):
    """The eight metrics of the primary fold's empty-group subset against the medians of the ordinary folds."""
    rows = classified(spark, folder)
    points = E.materialize_points(E.mark_primary_fold(classification_points(spark, folder)))
    labelled = rows.withColumn("y", (F.col("y") > 0).cast("double"))
    cuts = threshold_metrics(score_counts(E.with_subsets(labelled), [*E.POINT, "Subset"]), [*E.POINT, "Subset"])
    joined = points.join(cuts.drop("n", "positive_rate"), [*E.POINT, "Subset"]).withColumnsRenamed({"Positive_Rate": "positive_rate", "AP": "average_precision", "ROC_AUC": "roc_auc"})
    return E.reference_deltas(joined, _CLS_COMPARED, ("N", "N_Positive", "N_Negative"), E.SERIES)


@query(
    "top_shift_list",
    f"""WITH {REGRESSED}, v AS (SELECT "Dataset" || ':' || "Target" AS "Label", is_empty, y FROM reg WHERE "Model" = 'linear'),
      c AS (SELECT "Label", y, count(*) FILTER (is_empty) AS a, count(*) FILTER (NOT is_empty) AS b FROM v GROUP BY ALL),
      k AS (SELECT "Label", abs(sum(a) OVER w / sum(a) OVER p::DOUBLE - sum(b) OVER w / sum(b) OVER p::DOUBLE) AS d
        FROM c WINDOW w AS (PARTITION BY "Label" ORDER BY y), p AS (PARTITION BY "Label")),
      ks AS (SELECT "Label", max(d) AS ks FROM k GROUP BY 1),
      sd AS (SELECT "Label", count(*) FILTER (is_empty) AS n, avg(y) FILTER (is_empty) AS m, var_samp(y) FILTER (is_empty) AS s,
        count(*) FILTER (NOT is_empty) AS n2, avg(y) FILTER (NOT is_empty) AS m2, var_samp(y) FILTER (NOT is_empty) AS s2
        FROM v GROUP BY 1)
      SELECT "Label", abs((m - m2) / sqrt(((n - 1) * s + (n2 - 1) * s2) / (n + n2 - 2))
        * (1 - 3.0::DOUBLE / (4 * (n + n2) - 9))) + ks AS score FROM sd JOIN ks USING ("Label")
      ORDER BY score DESC, "Label" LIMIT 5""",
    "score",
)
def top_shift_list(spark, folder):
    rows = regressed(spark, folder).where(F.col("Model") == "linear")
    shift = regression_label_shift(rows, ["Dataset", "Target"])
    labelled = shift.withColumn("Label", F.concat_ws(":", "Dataset", "Target"))
    return E.top_list(labelled, "Abs_StandardizedMeanDiff", "KS_Statistic", "Label")


@query(
    "align_with_ordinal",
    """WITH t AS (SELECT o_custkey % 100 AS molecules, o_orderkey, o_totalprice AS value,
        row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_orderkey) AS i FROM orders),
      p AS (SELECT user_id AS molecules, value AS value_predfile, event_type,
        row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events)
      SELECT molecules, o_orderkey AS row_order, value, value_predfile, event_type FROM t LEFT JOIN p USING (molecules, i)""",
    "value value_predfile",
)
def align_with_ordinal(spark, folder):
    test = load(spark, folder, "orders").select(
        (F.col("o_custkey") % 100).alias("molecules"), F.col("o_orderkey").alias("row_order"), F.col("o_totalprice").alias("value")
    )
    predictions = load(spark, folder, "events").select(
        F.col("user_id").alias("molecules"), F.col("event_id").alias("row_order"), "value", "event_type"
    )
    return A.align_predictions(test, predictions, ["molecules"])


@query(
    "positional_join",
    """WITH t AS (SELECT o_orderkey AS row_order, o_totalprice AS y, row_number() OVER (ORDER BY o_orderkey) AS i FROM orders),
      p AS (SELECT o_custkey AS pred, o_totalprice AS y_predfile,
        row_number() OVER (ORDER BY (o_orderkey * 7919) % 1000003, o_orderkey) AS i FROM orders)
      SELECT row_order, y, pred, y_predfile FROM t JOIN p USING (i)""",
    "y y_predfile",
)
def positional_join(spark, folder):
    orders = load(spark, folder, "orders")
    test = orders.select(F.col("o_orderkey").alias("row_order"), F.col("o_totalprice").alias("y"))
    order = F.col("o_orderkey") * 7919 % 1000003 * 10000000000 + F.col("o_orderkey")
    predictions = orders.select(order.alias("row_order"), F.col("o_custkey").alias("pred"), F.col("o_totalprice").alias("y"))
    return A.align_by_position(test, predictions)


@query(
    "match_split_rows",
    f"""WITH {ENTITIES}, f AS (SELECT group_key AS molecules, doc_id AS row_id,
        row_number() OVER (PARTITION BY group_key ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY group_key) AS have
        FROM ent),
      s AS (SELECT group_key AS molecules, split, row_number() OVER (PARTITION BY group_key
        ORDER BY CASE split WHEN 'train' THEN 0 WHEN 'valid' THEN 1 ELSE 2 END, doc_id, again) - 1 AS want
        FROM ent, (VALUES (0), (1)) twice(again))
      SELECT DISTINCT molecules, s.split, f.row_id FROM s JOIN f USING (molecules)
      WHERE f.i = CASE WHEN s.want < f.have THEN s.want ELSE 0 END""",
)
def match_split_rows(spark, folder):
    ents = entities(spark, folder)
    full = ents.select(F.col("group_key").alias("molecules"), F.col("doc_id").alias("row_id"))
    # every row twice, so that keys run out of duplicates
    order = F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1))
    split = ents.select(F.col("group_key").alias("molecules"), "split", order.alias("row_order"))
    return A.match_split_rows(full, split, ["molecules"])
