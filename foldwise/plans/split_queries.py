"""Group-preserving folds, bin packing and sliding windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import splits as S
from foldwise.plans.registry import query
from foldwise.plans.roles import ENTITIES, entities
from foldwise.sources.tables import load


def _greedy_sql(groups: str, bins: int) -> str:
    """Largest-first packing as a recursion over ordered groups: g(ds, grp, n, rn)."""
    zeros = ", ".join(["0"] * bins)
    return f"""{groups}, r(ds, rn, loads, part) AS (
        SELECT DISTINCT ds, 0::BIGINT, [{zeros}]::BIGINT[], -1::BIGINT FROM g
        UNION ALL SELECT g.ds, g.rn,
          [CASE WHEN i = list_position(loads, list_min(loads)) THEN loads[i] + g.n ELSE loads[i] END
           FOR i IN range(1, {bins + 1})], list_position(loads, list_min(loads)) - 1
        FROM r JOIN g ON g.ds = r.ds AND g.rn = r.rn + 1)"""


_FOLD_GROUPS = f"""{ENTITIES}, g AS (SELECT dataset AS ds, group_key AS grp, count(*) AS n,
    row_number() OVER (PARTITION BY dataset ORDER BY count(*) DESC, md5('10086:' || group_key), group_key) AS rn
    FROM ent GROUP BY dataset, group_key)"""
_FOLDS = "WITH RECURSIVE " + _greedy_sql(_FOLD_GROUPS, 5)


@query(
    "group_parts",
    f"""{_FOLDS} SELECT r.ds AS dataset, grp AS group_key, n AS group_size, 5 AS kfolds, part::INTEGER AS part
      FROM r JOIN g USING (ds, rn)""",
)
def group_parts(spark, folder):
    return S.group_parts(entities(spark, folder), ["dataset"], bins=5)


_ROWS = f"""{_FOLDS}, fo AS (SELECT doc_id, dataset, group_key, is_empty, part::INTEGER AS fold, 5 AS kfolds
    FROM ent JOIN g ON g.ds = dataset AND g.grp = group_key JOIN r ON r.ds = g.ds AND r.rn = g.rn)"""


def _folded(spark, folder):
    ents = entities(spark, folder).drop("fold")
    return S.assign_group_folds(ents, ["dataset"], folds=5).select(
        "doc_id", "dataset", "group_key", "is_empty", "fold", "kfolds"
    )


@query("group_kfold", f"{_ROWS} SELECT * FROM fo")
def group_kfold(spark, folder):
    return _folded(spark, folder)


@query(
    "sliding_window_folds",
    f"""{_ROWS} SELECT doc_id, dataset, fold, f::INTEGER AS eval_fold,
      CASE WHEN fold = f THEN 'test' WHEN fold = (f + 1) % 5 THEN 'valid' ELSE 'train' END AS split
      FROM fo, range(5) t(f)""",
)
def sliding_window_folds(spark, folder):
    return S.sliding_folds(_folded(spark, folder)).select("doc_id", "dataset", "fold", "eval_fold", "split")


@query(
    "train_test_for_fold",
    f"""{_ROWS} SELECT dataset, fold = 2 AS held_out, count(*) AS n, count(*) FILTER (is_empty) AS n_no_scaffold
      FROM fo GROUP BY ALL""",
)
def train_test_for_fold(spark, folder):
    folded = _folded(spark, folder)
    sides = S.fold_members(folded, 2, True).withColumn("held_out", F.lit(True)).unionByName(
        S.fold_members(folded, 2, False).withColumn("held_out", F.lit(False))
    )
    return sides.groupBy("dataset", "held_out").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("is_empty").cast("long")).alias("n_no_scaffold")
    )


_CLUSTERS = """c AS (SELECT l_returnflag AS ds, l_partkey AS grp, count(*) AS n FROM lineitem GROUP BY ALL),
  g AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY n DESC, grp) AS rn FROM c)"""


@query(
    "lpt_bin_packing",
    f"""WITH RECURSIVE {_greedy_sql(_CLUSTERS, 10)}
      SELECT r.ds AS l_returnflag, grp AS cluster, n AS cluster_size, part::INTEGER AS bin FROM r JOIN g USING (ds, rn)""",
)
def lpt_bin_packing(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_returnflag", F.col("l_partkey").alias("cluster"))
    return S.pack_clusters(lines, ["l_returnflag"], "cluster", 10)


@query(
    "window_fold_weights",
    """SELECT f::INTEGER AS eval_fold, CASE WHEN (c_custkey % 7 - f + 7) % 7 < 2 THEN 'test'
        WHEN (c_custkey % 7 - f + 7) % 7 < 4 THEN 'valid' ELSE 'train' END AS split, count(*) AS n,
      sum(c_custkey)::BIGINT AS key_sum FROM customer, range(7) t(f) GROUP BY ALL""",
)
def window_fold_weights(spark, folder):
    customers = load(spark, folder, "customer").select("c_custkey", (F.col("c_custkey") % 7).cast("int").alias("part"))
    folds = S.window_folds(customers, "part", (3, 2, 2))
    return folds.groupBy("eval_fold", "split").agg(F.count(F.lit(1)).alias("n"), F.sum("c_custkey").alias("key_sum"))


@query(
    "size_ruled_fold_count",
    """WITH d AS (SELECT p_type AS dataset, count(*) AS n FROM part GROUP BY 1)
      SELECT dataset, n AS rows_in_folds, CASE WHEN n <= 1000 THEN 5 WHEN n <= 3000 THEN 7 ELSE 10 END AS kfolds,
        CASE WHEN n <= 1000 THEN 5 WHEN n <= 3000 THEN 7 ELSE 10 END::BIGINT AS folds_used FROM d""",
)
def size_ruled_fold_count(spark, folder):
    parts = load(spark, folder, "part").select(F.col("p_type").alias("dataset"), F.col("p_brand").alias("group_key"))
    folded = S.assign_group_folds(parts, ["dataset"], relabel=True)
    return folded.groupBy("dataset", "kfolds").agg(
        F.count(F.lit(1)).alias("rows_in_folds"), F.countDistinct("fold").alias("folds_used")
    )
