"""Whole folders of CSV files: splitting every dataset, and repairing archived splits.

All datasets of a folder are one table, keyed by their place in the folder.  A dataset that cannot be
split is a row with a reason, not an exception, so it does not stop the others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.functions.scalars import EMPTY_GROUP, FAILED_GROUP, INVALID_GROUP, SPLITS, acyclic, entity_id, fold_count, is_empty_group, normalize_name, part_name, slot_text
from foldwise.operators.ranking import ordinal_within
from foldwise.operators.repair import repair_split
from foldwise.operators.splits import DEFAULT_SEED, group_parts, relabel_parts, shuffled_key, sliding_folds
from foldwise.operators.summaries import fold_statistics_long, fold_statistics_wide, part_statistics, split_summary
from foldwise.session import cut_lineage
from foldwise.sources.csv_tree import csv_tree, field_of
from foldwise.sources.sinks import write_report_csv, write_shuffled_splits, write_splits, write_table

TEXT, GROUP = "molecules", "Scaffold"
PLACE = ("Benchmark", "TaskGroup", "Dataset")


def _stem(name: str) -> Column:
    return normalize_name(F.regexp_replace(name, r"\.csv$", ""))


def original_columns(files: DataFrame) -> list[str]:
    """The column names of all files, first seen first; names, not rows, reach the driver."""
    named = files.select(F.posexplode("header").alias("_at", "_name")).where("_name <> ''")
    return [r["_name"] for r in named.groupBy("_name").agg(F.min("_at").alias("_at")).orderBy("_at", "_name").collect()]


def with_columns_of(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fields as columns, named as in the files; the row's own columns are behind ``_``."""
    return rows.select(*[F.col(c).alias(f"_{c}") for c in rows.columns], *[field_of("header", "fields", F.lit(c)).alias(c) for c in columns])


def read_folder(spark: SparkSession, root: str, groups: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(members, datasets) of ``<benchmark>/<task group>/<dataset>.csv``.

    members: Benchmark, TaskGroup, Dataset, header, fields, row_order, text, group_key, present, is_valid, is_empty.
    The group key is the column Scaffold where a file has one, else it is looked up by text in ``groups`` (text,
    group_key); a text without rings has none, and what is left is invalid.
    datasets: the place, file and reason why a file cannot be read, NULL if it can.
    """
    rows, files = csv_tree(spark, root, ["Benchmark", "TaskGroup", "File"])
    named = files.where(F.col("File").endswith(".csv")).withColumn("Dataset", _stem("File"))
    no_text = ~F.array_contains("header", TEXT)
    datasets = cut_lineage(named.select(*PLACE, "path", "header", F.when(no_text, F.concat(F.lit("missing column "), F.lit(TEXT))).alias("reason")))
    good = datasets.where("reason IS NULL").drop("reason")
    read = rows.join(good, "path").withColumn("text", F.nullif(field_of("header", "fields", F.lit(TEXT)), F.lit("")))
    group = F.nullif(field_of("header", "fields", F.lit(GROUP)), F.lit(""))
    if groups is not None:
        known = groups.select("text", F.col("group_key").alias("_known")).dropDuplicates(["text"])
        read = read.join(known, "text", "left")
        group = F.coalesce(group, F.col("_known"))
    group = F.coalesce(group, F.when(F.col("text").isNotNull() & acyclic("text"), EMPTY_GROUP), F.lit(INVALID_GROUP))
    read = read.withColumn("group_key", group).withColumn("present", F.col("text").isNotNull())
    valid = F.col("present") & ~F.col("group_key").isin(INVALID_GROUP, FAILED_GROUP)
    members = read.withColumn("is_valid", valid).withColumn("is_empty", is_empty_group("group_key", "splitter"))
    return members.select(*PLACE, "header", "fields", "row_order", "text", "group_key", "present", "is_valid", "is_empty"), datasets


def split_folder(spark: SparkSession, root: str, output: str, groups: DataFrame | None = None, seed: int = DEFAULT_SEED) -> dict[str, DataFrame]:
    """Group-preserving folds of every dataset of a folder, written with summaries; returns the summaries.

    ``output/folds``: the original columns per fold and split, in shuffled order; ``output/assignment``: part of every
    member; CSV reports of datasets, folds (long and wide), parts and failed datasets.
    """
    keys = list(PLACE)
    members, files = read_folder(spark, root, groups)
    members = cut_lineage(members)
    counts = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("raw_total_count"),
        F.sum(F.col("present").cast("long")).alias("after_dropna_count"),
        F.sum(F.col("is_valid").cast("long")).alias("effective_total_count"),
    )
    valid = members.where("is_valid").drop("present", "is_valid")
    numbered = ordinal_within(valid, keys, "row_order", "_i")
    numbered = numbered.withColumn("ROW_ID", entity_id("Dataset", F.col("_i") + 1)).drop("_i", "row_order")
    parts = relabel_parts(group_parts(numbered, keys, "group_key", None, seed, strict=False), keys, seed)
    parts = cut_lineage(parts.select(*keys, "group_key", "kfolds", F.col("part").alias("fold")))
    too_few = parts.where("fold IS NULL").select(*keys).distinct().withColumn("_few", F.lit("fewer groups than parts"))
    status = files.select(*keys, "path", "reason").join(counts, keys, "left").join(too_few, keys, "left")
    nothing = F.when(F.coalesce("effective_total_count", F.lit(0)) == 0, "no valid members")
    status = status.withColumn("reason", F.coalesce("reason", nothing, "_few")).drop("_few")
    status = cut_lineage(status.withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("failed")))
    placed = cut_lineage(numbered.join(parts.where("fold IS NOT NULL"), [*keys, "group_key"]))

    columns = original_columns(files.where("reason IS NULL"))
    folded = sliding_folds(placed).withColumn("key", shuffled_key("ROW_ID", seed)).withColumn("Fold", F.concat(F.lit("fold_"), (F.col("eval_fold") + 1).cast("string")))
    shaped = with_columns_of(folded.select(*keys, "Fold", "split", "key", "header", "fields"), columns)
    at = [f"_{c}" for c in (*keys, "Fold", "split")]
    write_shuffled_splits(shaped, f"{output}/folds", at, columns, "_key")
    write_table(placed.select(*keys, "ROW_ID", "text", "group_key", F.col("fold").alias("part"), part_name("fold").alias("part_name")), f"{output}/assignment")

    n = F.col("effective_total_count")
    whole = part_statistics(placed, keys)
    reports = {
        "dataset_summary": status.where("status = 'success'")
        .select(*keys, "status", "raw_total_count", "after_dropna_count", "effective_total_count",
                (F.col("raw_total_count") - n).alias("removed_count"), fold_count(n).alias("kfolds"), slot_text(n).alias("weight_splits"))
        .join(whole, keys).unionByName(status.where("status = 'failed'").select(*keys, "status"), allowMissingColumns=True),
        "fold_summary_long": fold_statistics_long(placed, keys, "fold", "kfolds"),
        "part_summary": part_statistics(placed, [*keys, "fold", "kfolds"]).withColumn("part_order", F.col("fold") + 1),
        "failed": status.where("status = 'failed'").select(*keys, "path", "reason"),
    }
    reports["fold_summary_wide"] = fold_statistics_wide(reports["fold_summary_long"], keys)
    reports = {name: cut_lineage(table.orderBy(*[c for c in (*keys, "fold", "part_order", "split") if c in table.columns])) for name, table in reports.items()}
    for name, table in reports.items():
        write_report_csv(table, f"{output}/{name}.csv")
    return reports


def read_archived_splits(spark: SparkSession, root: str, levels: Sequence[str] = ("Dataset",)) -> tuple[DataFrame, list[str]]:
    """(members, original columns) of split directories ``<levels...>/{train,valid,test}.csv``.

    members: the levels, RawSplit, ID (dataset and position through train, valid and test), header, fields, text,
    group_key, is_empty.  A directory without one of the three files, or a file without texts, is an error.
    """
    levels = list(levels)
    rows, files = csv_tree(spark, root, [*levels, "File"])
    named = files.where(F.col("File").isin(*[f"{s}.csv" for s in SPLITS])).withColumn("RawSplit", F.regexp_replace("File", r"\.csv$", ""))
    named = cut_lineage(named.drop("File"))
    wrong = named.where(~F.array_contains("header", TEXT)).select("path").first()
    if wrong:
        raise ValueError(f"{wrong['path']} has no column {TEXT}")
    short = named.groupBy(*levels).agg(F.collect_set("RawSplit").alias("_s")).where(F.size("_s") < len(SPLITS)).first()
    if short:
        raise FileNotFoundError(f"{'/'.join(str(short[c]) for c in levels)}: {sorted(set(SPLITS) - set(short['_s']))}")
    text = F.nullif(field_of("header", "fields", F.lit(TEXT)), F.lit(""))
    members = rows.join(named, "path").withColumn("text", text).where("text IS NOT NULL")
    branch = F.element_at(F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(i))]), F.col("RawSplit"))
    order = branch.cast("decimal(1,0)") * F.lit("1" + "0" * 35).cast("decimal(36,0)") + F.col("row_order")
    placed = ordinal_within(members.withColumn("_order", order.cast("decimal(38,0)")), levels, "_order", "_i")
    group = F.coalesce(F.nullif(field_of("header", "fields", F.lit(GROUP)), F.lit("")), F.when(acyclic("text"), EMPTY_GROUP))
    out = placed.withColumn("ID", entity_id(levels[-1], F.col("_i") + 1, 6)).withColumn("group_key", group)
    out = out.withColumn("is_empty", is_empty_group("group_key", "repair"))
    return out.select(*levels, "RawSplit", "ID", "header", "fields", "text", "group_key", "is_empty"), original_columns(named)


def repair_archived_splits(
    spark: SparkSession, root: str, fingerprints: DataFrame, output: str, condition: str = "D_train_support_priority", levels: Sequence[str] = ("Dataset",)
) -> tuple[DataFrame, DataFrame]:
    """Repair archived splits and write the new split files, the audit table and the cluster summary.

    ``fingerprints``: text and words; a text without a row has none.  Returns (audit, summary): per member the
    text identifier, RawSplit, Split, SplitSource and cluster, and per cluster its split and size.
    ``output/splits`` holds the original columns per dataset and new split (drop included).
    """
    levels = list(levels)
    members, columns = read_archived_splits(spark, root, levels)
    words = fingerprints.select("text", "words").dropDuplicates(["text"])
    members = cut_lineage(members.join(words, "text", "left").withColumnRenamed("RawSplit", "split"))
    audit, summary = repair_split(members, levels, "ID", condition)
    audit, summary = cut_lineage(audit), cut_lineage(summary)
    shaped = with_columns_of(audit.select(*levels, "Split", "header", "fields"), columns)
    write_splits(shaped, f"{output}/splits", [f"_{c}" for c in (*levels, "Split")], columns)
    table = audit.select(*levels, "ID", "text", "group_key", "is_empty", "RawSplit", "Split", "SplitSource", "ESA_cluster_id")
    write_table(table, f"{output}/audit")
    write_table(summary, f"{output}/clusters")
    return table, summary


def summarize_split_folder(spark: SparkSession, root: str, levels: Sequence[str] = ("Dataset",)) -> DataFrame:
    """The split summary of archived split directories: members, empty group, share and recovery per split."""
    members, _ = read_archived_splits(spark, root, levels)
    return split_summary(members.withColumnRenamed("RawSplit", "split"), list(levels))
