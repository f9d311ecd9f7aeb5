"""How the shared tables play the engine's roles, as DataFrames and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from foldwise.functions.scalars import EMPTY_GROUP, is_empty_group
from foldwise.sources.tables import load


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as entities: Spanish ones have no group, the others source/language."""
    docs = load(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    group = F.when(F.col("lang") == "es", EMPTY_GROUP).otherwise(F.concat_ws("/", "source", "lang"))
    slot = F.col("doc_id") % 10
    spanish = F.col("lang") == "es"
    split = (
        F.when(F.when(spanish, slot < 2).otherwise(slot < 8), "train")
        .when(F.when(spanish, slot < 6).otherwise(slot == 8), "valid")
        .otherwise("test")
    )
    return docs.select(
        "doc_id",
        "n_chars",
        F.concat(F.lit("docs_"), (F.col("doc_id") % 3).cast("string")).alias("dataset"),
        group.alias("group_key"),
        is_empty_group(group).alias("is_empty"),
        split.alias("split"),
        F.pmod(F.col("doc_id") * 7 + F.length("source"), F.lit(5)).cast("int").alias("fold"),
    )


ENTITIES = """ent AS (
  SELECT doc_id, n_chars, 'docs_' || (doc_id % 3) AS dataset,
    CASE WHEN lang = 'es' THEN 'No_Scaffold' ELSE source || '/' || lang END AS group_key,
    lang = 'es' AS is_empty,
    CASE WHEN CASE WHEN lang = 'es' THEN doc_id % 10 < 2 ELSE doc_id % 10 < 8 END THEN 'train'
         WHEN CASE WHEN lang = 'es' THEN doc_id % 10 < 6 ELSE doc_id % 10 = 8 END THEN 'valid'
         ELSE 'test' END AS split,
    CAST((doc_id * 7 + length(source)) % 5 AS INTEGER) AS fold
  FROM documents)"""


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled documents with a score that ties on purpose."""
    labels = load(spark, folder, "labels")
    return entities(spark, folder).join(labels, "doc_id").withColumn("score", (F.col("n_chars") % 50) / 50.0)


LABELLED = ENTITIES + """, lab AS (
  SELECT ent.*, quality, toxic, (n_chars % 50) / 50.0::DOUBLE AS score FROM ent JOIN labels USING (doc_id))"""


def _lines(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    lines = load(spark, folder, "lineitem")
    supply = F.col("l_suppkey") % 6
    tenth = F.col("l_orderkey") % 10
    empty = ((tenth == 9) & (F.col("l_partkey") % 2 == 0)) | (F.col("l_partkey") % 53 == 0)
    return lines.select(
        F.when(supply < 3, "bench_a").otherwise("bench_b").alias("Benchmark"),
        F.concat(F.lit("supply_"), supply.cast("string")).alias("Dataset"),
        F.concat(F.lit("fold_"), (tenth + 1).cast("string")).alias("Fold"),
        empty.alias("is_empty"),
        *columns,
    )


LINES = """lines AS (
  SELECT CASE WHEN l_suppkey % 6 < 3 THEN 'bench_a' ELSE 'bench_b' END AS "Benchmark",
    'supply_' || (l_suppkey % 6) AS "Dataset", 'fold_' || (l_orderkey % 10 + 1) AS "Fold",
    (l_orderkey % 10 = 9 AND l_partkey % 2 = 0) OR l_partkey % 53 = 0 AS is_empty, *
  FROM lineitem)"""


def _options(name: str, value: str, options: dict[str, Column]) -> Column:
    return F.explode(
        F.array(*[F.struct(F.lit(k).alias(name), v.cast("double").alias(value)) for k, v in options.items()])
    )


def test_rows(spark: SparkSession, folder: str) -> DataFrame:
    return _lines(spark, folder)


def classified(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as test rows: two binary targets (coded 0/1 and -1/1), two models."""
    lines = _lines(spark, folder, "l_returnflag", "l_linestatus", "l_discount", "l_quantity")
    returned, is_open = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    targets = {"returned": F.when(returned, 1).otherwise(0), "open": F.when(is_open, 1).otherwise(-1)}
    models = {
        "discount": F.col("l_discount") * 10,
        "volume": (F.col("l_quantity") + F.when(returned, 10.0).otherwise(0.0)) / 64.0,
    }
    keys = ["Benchmark", "Dataset", "Fold", "is_empty"]
    target = lines.withColumn("_t", _options("Target", "y", targets)).withColumn("_m", _options("Model", "score", models))
    return target.select(*keys, "_t.*", "_m.*")


CLASSIFIED = LINES + """, cls AS (
  SELECT "Benchmark", "Dataset", "Fold", is_empty, t."Target", t.y, m."Model", m.score FROM lines,
    LATERAL (VALUES ('returned', CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END),
                    ('open', CASE WHEN l_linestatus = 'O' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) t("Target", y),
    LATERAL (VALUES ('discount', l_discount * 10),
                    ('volume', (l_quantity + CASE WHEN l_returnflag = 'R' THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END)
                               / 64.0::DOUBLE)) m("Model", score))"""


def regressed(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as test rows of two regression targets and two models."""
    lines = _lines(spark, folder, "l_extendedprice", "l_quantity", "l_discount", "l_tax")
    price, quantity = F.col("l_extendedprice") / 1013.0, F.col("l_quantity")
    targets = {"price": price, "net": price * (1 - F.col("l_discount"))}
    models = {"linear": quantity * 1.5, "damped": 20.0 + quantity * 0.75 + F.col("l_tax")}
    keys = ["Benchmark", "Dataset", "Fold", "is_empty"]
    target = lines.withColumn("_t", _options("Target", "y", targets)).withColumn("_m", _options("Model", "pred", models))
    return target.select(*keys, "_t.*", "_m.*")


REGRESSED = LINES + """, reg AS (
  SELECT "Benchmark", "Dataset", "Fold", is_empty, t."Target", t.y, m."Model", m.pred FROM lines,
    LATERAL (VALUES ('price', l_extendedprice / 1013.0::DOUBLE),
      ('net', l_extendedprice / 1013.0::DOUBLE * (1 - l_discount))) t("Target", y),
    LATERAL (VALUES ('linear', l_quantity * 1.5::DOUBLE),
                    ('damped', 20.0::DOUBLE + l_quantity * 0.75::DOUBLE + l_tax)) m("Model", pred))"""
