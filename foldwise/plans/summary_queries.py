"""Group, split, fold and dataset summaries over the document entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions import scalars as S
from foldwise.operators import summaries as M
from foldwise.plans.registry import query
from foldwise.plans.roles import ENTITIES, LABELLED, entities, labelled
from foldwise.sources.tables import load

WITH = f"WITH {ENTITIES}"


@query(
    "group_empty_summary",
    f"""{WITH} SELECT dataset, count(*) AS n_molecules, count(*) FILTER (is_empty) AS n_no_scaffold,
      count(DISTINCT group_key) FILTER (NOT is_empty) AS n_unique_nonempty_scaffolds,
      count(*) FILTER (is_empty) / count(*)::DOUBLE AS no_scaffold_proportion FROM ent GROUP BY dataset""",
    "no_scaffold_proportion",
)
def group_empty_summary(spark, folder):
    return M.group_summary(entities(spark, folder), ["dataset"])


@query(
    "split_summary_recovery",
    f"""{WITH}, s AS (SELECT dataset, split, count(*) AS n_molecules, count(*) FILTER (is_empty) AS n_no_scaffold,
        count(DISTINCT group_key) FILTER (NOT is_empty) AS n_unique_nonempty_scaffolds,
        count(*) FILTER (is_empty) / count(*)::DOUBLE AS no_scaffold_proportion FROM ent GROUP BY dataset, split),
      o AS (SELECT *, sum(n_no_scaffold) OVER (PARTITION BY dataset)::DOUBLE
                      / sum(n_molecules) OVER (PARTITION BY dataset) AS overall_no_scaffold_proportion FROM s)
      SELECT *, no_scaffold_proportion / nullif(overall_no_scaffold_proportion, 0) AS support_recovery_vs_overall
      FROM o""",
    "no_scaffold_proportion overall_no_scaffold_proportion support_recovery_vs_overall",
)
def split_summary_recovery(spark, folder):
    return M.split_summary(entities(spark, folder), ["dataset"])


STATS = """count(*) AS molecule_count, count(*) FILTER (NOT is_empty) AS scaffold_bearing_count,
  count(*) FILTER (is_empty) AS no_scaffold_count,
  count(DISTINCT group_key) FILTER (NOT is_empty) AS scaffold_group_count,
  count(*) FILTER (is_empty) / count(*)::DOUBLE AS no_scaffold_proportion,
  100.0::DOUBLE * count(*) FILTER (is_empty) / count(*) AS no_scaffold_percentage"""


@query(
    "part_statistics",
    f"{WITH} SELECT dataset, fold, {STATS} FROM ent GROUP BY dataset, fold",
    "no_scaffold_proportion no_scaffold_percentage",
)
def part_statistics(spark, folder):
    return M.part_statistics(entities(spark, folder), ["dataset", "fold"])


@query(
    "fold_alloc_summary",
    f"""WITH {LABELLED} SELECT dataset, fold, count(*) AS n_total, count(*) FILTER (is_empty) AS n_no_scaffold,
      count(*) FILTER (toxic = 1) AS n_positive,
      count(*) FILTER (is_empty) / count(*)::DOUBLE AS no_scaffold_proportion FROM lab GROUP BY dataset, fold""",
    "no_scaffold_proportion",
)
def fold_alloc_summary(spark, folder):
    return M.fold_allocation(labelled(spark, folder), ["dataset"], label="toxic")


@query(
    "no_group_fold_argmax",
    f"""{WITH}, c AS (SELECT dataset, fold, count(*) FILTER (is_empty) AS n_no_scaffold FROM ent GROUP BY ALL)
      SELECT dataset, fold AS no_scaffold_fold, n_no_scaffold FROM c
      QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY n_no_scaffold DESC, fold) = 1""",
)
def no_group_fold_argmax(spark, folder):
    return M.empty_group_fold(entities(spark, folder), ["dataset"])


BRANCH = "CASE WHEN fold = f THEN 'test' WHEN fold = (f + 1) % 5 THEN 'valid' ELSE 'train' END"


@query(
    "branch_modular_folds",
    f"""{WITH} SELECT dataset, f::INTEGER AS eval_fold, {BRANCH} AS branch,
      array_to_string(list_sort(list(DISTINCT fold)), ',') AS folds, count(*) AS n_total,
      count(*) FILTER (is_empty) AS n_no_scaffold,
      count(*) FILTER (is_empty) / count(*)::DOUBLE AS no_scaffold_proportion
      FROM ent, range(5) r(f) GROUP BY ALL""",
    "no_scaffold_proportion",
)
def branch_modular_folds(spark, folder):
    return M.branch_summary(entities(spark, folder), ["dataset"], 5)


def _grouped_parts(spark, folder):
    part = (F.length("group_key") + F.col("n_groups")) % F.col("kfolds")
    sized = entities(spark, folder).withColumn("kfolds", F.lit(5)).withColumn(
        "n_groups", F.conv(F.substring(F.md5("group_key"), 1, 4), 16, 10).cast("int")
    )
    return sized.withColumn("part", part)


PARTS = f"""{ENTITIES}, pt AS (SELECT *, (length(group_key) + ('0x' || substr(md5(group_key), 1, 4))::INTEGER) % 5 AS part
  FROM ent)"""
LONG = f"""{PARTS}, lg AS (SELECT dataset, (f + 1)::INTEGER AS fold,
    CASE WHEN part = f THEN 'test' WHEN part = (f + 1) % 5 THEN 'valid' ELSE 'train' END AS split, {STATS}
    FROM pt, range(5) r(f) GROUP BY ALL)"""


@query(
    "fold_statistics_long",
    f"WITH {LONG} SELECT * FROM lg",
    "no_scaffold_proportion no_scaffold_percentage",
)
def fold_statistics_long(spark, folder):
    return M.fold_statistics_long(_grouped_parts(spark, folder), ["dataset"], "part", "kfolds")


WIDE = ", ".join(f"max({c}) FILTER (split = '{s}') AS {s}_{c}" for s in S.SPLITS for c in M.STATISTICS)


@query(
    "wide_fold_pivot",
    f"WITH {LONG} SELECT dataset, fold, {WIDE} FROM lg GROUP BY dataset, fold",
    " ".join(f"{s}_{c}" for s in S.SPLITS for c in M.STATISTICS if not c.endswith("count")),
)
def wide_fold_pivot(spark, folder):
    return M.fold_statistics_wide(fold_statistics_long(spark, folder), ["dataset"])


@query(
    "dataset_statistics",
    """WITH d AS (SELECT 'docs_' || (doc_id % 3) AS dataset, nullif(lang, 'de') AS molecules, n_chars < 4000 AS is_valid,
        source AS group_key, lang = 'es' AS is_empty FROM documents),
      a AS (SELECT dataset, count(*) AS raw_total_count, count(molecules) AS after_dropna_count,
        count(*) FILTER (molecules IS NOT NULL AND is_valid) AS effective_total_count,
        count(*) FILTER (molecules IS NOT NULL AND is_valid AND is_empty) AS no_scaffold_count,
        count(DISTINCT group_key) FILTER (molecules IS NOT NULL AND is_valid AND NOT is_empty) AS scaffold_group_count
        FROM d GROUP BY dataset)
      SELECT *, raw_total_count - effective_total_count AS removed_invalid_or_empty_smiles_count,
        effective_total_count - no_scaffold_count AS scaffold_bearing_count,
        no_scaffold_count / effective_total_count::DOUBLE AS no_scaffold_proportion,
        CASE WHEN effective_total_count <= 1000 THEN 5 WHEN effective_total_count <= 3000 THEN 7 ELSE 10 END AS kfolds,
        CASE WHEN effective_total_count <= 1000 THEN '3:1:1' WHEN effective_total_count <= 3000 THEN '5:1:1'
             ELSE '8:1:1' END AS weight_splits, 'success' AS status FROM a""",
    "no_scaffold_proportion",
)
def dataset_statistics(spark, folder):
    docs = load(spark, folder, "documents").select(
        F.concat(F.lit("docs_"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        F.nullif("lang", F.lit("de")).alias("molecules"),
        (F.col("n_chars") < 4000).alias("is_valid"),
        F.col("source").alias("group_key"),
        (F.col("lang") == "es").alias("is_empty"),
    )
    return M.dataset_statistics(docs, ["dataset"])


@query(
    "inventory_threshold",
    """SELECT source AS "Dataset", count(*) AS "Total_Molecules", count(*) FILTER (lang = 'es') AS "No_Scaffold_Molecules",
      count(*) FILTER (lang <> 'es') AS "Has_Scaffold_Molecules",
      count(*) FILTER (lang = 'es') / count(*)::DOUBLE AS "No_Scaffold_Proportion",
      count(*) FILTER (lang = 'es') / count(*)::DOUBLE >= 0.08::DOUBLE AS "Threshold_OK_ge_0p08"
      FROM documents GROUP BY source""",
    "No_Scaffold_Proportion",
)
def inventory_threshold(spark, folder):
    docs = load(spark, folder, "documents").select(F.col("source").alias("Dataset"), (F.col("lang") == "es").alias("is_empty"))
    return M.inventory(docs, ["Dataset"])


_AUDIT = ", ".join(
    f"count(*) FILTER (split = '{s}') AS {s}_n, count(*) FILTER (split = '{s}' AND is_empty) AS {s}_no_scaffold"
    for s in S.SPLITS
)
_PROPORTIONS = ", ".join(f"{s}_no_scaffold / nullif({s}_n, 0)::DOUBLE AS {s}_proportion" for s in S.SPLITS)


@query(
    "support_sink_audit",
    f"""{WITH}, a AS (SELECT dataset, count(*) AS n_total, count(*) FILTER (is_empty) AS n_no_scaffold, {_AUDIT}
        FROM ent GROUP BY dataset),
      p AS (SELECT *, n_no_scaffold / n_total::DOUBLE AS overall_proportion, {_PROPORTIONS} FROM a)
      SELECT *, train_proportion / nullif(overall_proportion, 0) AS support_recovery,
        greatest(valid_proportion, test_proportion) / nullif(train_proportion, 0) AS sink_ratio FROM p""",
    "overall_proportion train_proportion valid_proportion test_proportion support_recovery sink_ratio",
)
def support_sink_audit(spark, folder):
    return M.support_audit(entities(spark, folder), ["dataset"])


SIZED = """sized AS (SELECT o_orderpriority AS dataset, count(*) AS n FROM orders GROUP BY 1 UNION ALL
  SELECT c_mktsegment, count(*) FROM customer GROUP BY 1 UNION ALL
  SELECT l_returnflag || l_linestatus, count(*) FROM lineitem GROUP BY 1 UNION ALL
  SELECT p_type, count(*) FROM part GROUP BY 1)"""


def _sized(spark, folder):
    def counted(table, column):
        return load(spark, folder, table).groupBy(column.alias("dataset")).agg(F.count(F.lit(1)).alias("n"))

    return (
        counted("orders", F.col("o_orderpriority"))
        .unionByName(counted("customer", F.col("c_mktsegment")))
        .unionByName(counted("lineitem", F.concat("l_returnflag", "l_linestatus")))
        .unionByName(counted("part", F.col("p_type")))
    )


@query(
    "kfold_size_rule",
    f"""WITH {SIZED} SELECT dataset, n, CASE WHEN n <= 1000 THEN 5 WHEN n <= 3000 THEN 7 ELSE 10 END AS kfolds,
      CASE WHEN n <= 1000 THEN '3:1:1' WHEN n <= 3000 THEN '5:1:1' ELSE '8:1:1' END AS slots,
      CASE WHEN n <= 1000 THEN 0.6::DOUBLE WHEN n <= 3000 THEN 5 / 7.0::DOUBLE ELSE 0.8::DOUBLE END AS train_ratio
      FROM sized""",
    "train_ratio",
)
def kfold_size_rule(spark, folder):
    return _sized(spark, folder).select(
        "dataset",
        "n",
        S.fold_count("n").alias("kfolds"),
        S.slot_text("n").alias("slots"),
        S.split_ratio("n", "train").alias("train_ratio"),
    )


@query(
    "largest_remainder_counts",
    f"""WITH {SIZED}, w AS (SELECT dataset, n, CASE WHEN n <= 1000 THEN 3 WHEN n <= 3000 THEN 5 ELSE 8 END AS a,
        CASE WHEN n <= 1000 THEN 5 WHEN n <= 3000 THEN 7 ELSE 10 END AS k FROM sized),
      s AS (SELECT dataset, n, i, n * (CASE WHEN i = 0 THEN a ELSE 1 END) // k AS base,
        n * (CASE WHEN i = 0 THEN a ELSE 1 END) % k AS rest FROM w, range(3) r(i)),
      t AS (SELECT *, base + CASE WHEN row_number() OVER (PARTITION BY dataset, n ORDER BY rest DESC, i)
        <= n - sum(base) OVER (PARTITION BY dataset, n) THEN 1 ELSE 0 END AS c FROM s)
      SELECT dataset, n, max(c) FILTER (i = 0)::BIGINT AS train, max(c) FILTER (i = 1)::BIGINT AS valid,
        max(c) FILTER (i = 2)::BIGINT AS test,
        greatest(1, floor(least(max(c) FILTER (i = 0), max(c) FILTER (i = 1), max(c) FILTER (i = 2)) * 0.7::DOUBLE))::BIGINT
          AS max_cluster FROM t GROUP BY dataset, n""",
)
def largest_remainder_counts(spark, folder):
    counts = _sized(spark, folder).withColumn("_t", S.target_counts("n"))
    return counts.select("dataset", "n", "_t.*", S.max_cluster_size(F.col("_t"), 0.7).alias("max_cluster"))


@query(
    "scalar_identifiers",
    """SELECT event_id, ('0x' || substr(sha256('20250328:' || event_type || ':' || user_id), 1, 8))::BIGINT AS seed,
      event_type || '_' || printf('%08d', event_id) AS row_id, 'part_' || (user_id % 5 + 1) AS part_name,
      'fold_' || (user_id % 7 + 1) AS fold_name,
      replace(replace(lower(trim(' ' || event_type || '-Set A ')), ' ', '_'), '-', '_') AS normalized,
      right(props, 6) AS tail, md5('7:' || event_id) AS shuffle_key FROM events""",
)
def scalar_identifiers(spark, folder):
    events = load(spark, folder, "events")
    return events.select(
        "event_id",
        S.stable_seed(F.concat_ws(":", "event_type", "user_id")).alias("seed"),
        S.entity_id("event_type", "event_id").alias("row_id"),
        S.part_name(F.col("user_id") % 5).alias("part_name"),
        S.fold_name(F.col("user_id") % 7).alias("fold_name"),
        S.normalize_name(F.concat(F.lit(" "), "event_type", F.lit("-Set A "))).alias("normalized"),
        S.tail_text("props", 6).alias("tail"),
        S.shuffle_key("event_id", 7).alias("shuffle_key"),
    )


@query(
    "path_to_catalog",
    """SELECT page_id, split_part(url, '/', 3) AS benchmark, split_part(url, '/', 4) AS task_group,
      replace(replace(lower(trim(regexp_extract(url, '([^/]*)$', 1))), ' ', '_'), '-', '_') AS dataset FROM pages""",
)
def path_to_catalog(spark, folder):
    parts = F.split("url", "/")
    return load(spark, folder, "pages").select(
        "page_id",
        F.coalesce(F.get(parts, F.lit(2)), F.lit("")).alias("benchmark"),
        F.coalesce(F.get(parts, F.lit(3)), F.lit("")).alias("task_group"),
        S.normalize_name(F.regexp_extract("url", r"([^/]*)$", 1)).alias("dataset"),
    )
