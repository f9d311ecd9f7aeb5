"""Report figures that combine several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import evaluation as E
from foldwise.plans import evaluation_queries, metric_queries, similarity_queries
from foldwise.plans.registry import UNROUNDED, query

_MEDIANS = ", ".join(f'median("{c}") AS {k}' for k, c in E.STRUCTURE_MEDIANS.items())


def _top(table: str, first: str, second: str) -> str:
    return f"""(SELECT string_agg(l, ', ' ORDER BY v DESC, l) FROM (SELECT "Dataset" || ':' || "Target" AS l, "{first}" + "{second}" AS v
      FROM {table} ORDER BY v DESC, l LIMIT 5))"""


@query(
    "summary_values",
    f"""WITH st AS ({UNROUNDED["structural_metrics"]}), lr AS ({UNROUNDED["label_shift_regression"]}),
      lc AS ({UNROUNDED["label_shift_classification"]})
      SELECT count(*) AS n_datasets_total, {_MEDIANS},
        (SELECT count(*) FROM lr) AS n_regression_targets,
        (SELECT count(*) FROM lr WHERE "Abs_StandardizedMeanDiff" >= 0.5::DOUBLE) AS n_regression_abs_g_ge_0p5,
        (SELECT count(*) FROM lr WHERE "Abs_StandardizedMeanDiff" >= 0.8::DOUBLE) AS n_regression_abs_g_ge_0p8,
        (SELECT count(*) FROM lc) AS n_classification_targets,
        (SELECT count(*) FROM lc WHERE "Abs_PositiveRate_Diff" >= 0.1::DOUBLE) AS n_classification_prevdiff_ge_0p10,
        (SELECT count(*) FROM lc WHERE "Abs_PositiveRate_Diff" >= 0.2::DOUBLE) AS n_classification_prevdiff_ge_0p20,
        {_top("lr", "Abs_StandardizedMeanDiff", "KS_Statistic")} AS top_regression_shift_targets,
        {_top("lc", "Abs_PositiveRate_Diff", "Bernoulli_JSD")} AS top_classification_shift_targets,
        count(*) FILTER (dataset = 'set_0') AS n_datasets_moleculenet, count(*) FILTER (dataset <> 'set_0') AS n_datasets_admet,
        count(*) FILTER (dataset = 'set_1') AS n_datasets_classification, count(*) FILTER (dataset <> 'set_1') AS n_datasets_regression FROM st""",
    " ".join(E.STRUCTURE_MEDIANS),
)
def summary_values(spark, folder):
    label = F.concat_ws(":", "Dataset", "Target")
    structure = similarity_queries.structural_metrics(spark, folder)
    inventory = similarity_queries.vectors(spark, folder).groupBy("dataset").agg(
        F.when(F.first("dataset") == "set_0", "moleculenet").otherwise("admet").alias("Benchmark"),
        F.when(F.first("dataset") == "set_1", "classification").otherwise("regression").alias("TaskGroup"),
    )
    values = E.summary_values(
        structure,
        metric_queries.label_shift_regression(spark, folder).withColumn("Label", label),
        metric_queries.label_shift_classification(spark, folder).withColumn("Label", label),
        inventory=inventory,
    )
    lists = ("top_regression_shift_targets", "top_classification_shift_targets")
    return values.withColumns({c: F.array_join(c, ", ") for c in lists})


@query(
    "ratio_and_drop",
    f"""WITH c AS ({UNROUNDED["reference_comparison"]}) SELECT *, "NoScaffold_MAE" / "Ordinary_MAE" AS "MAE_Ratio",
      "Ordinary_R2" - "NoScaffold_R2" AS "R2_Drop" FROM c""",
    f"{evaluation_queries._COMPARED_DOUBLES} MAE_Ratio R2_Drop",
)
def ratio_and_drop(spark, folder):
    return E.comparison_effects(evaluation_queries.reference_comparison(spark, folder), ["MAE"], ["R2"])
