"""Connected components of a graph that is spread over the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import drop_finished_shuffles, kept_table


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node that `edges` (a, b: long) lead to.

    Alternates two steps until nothing changes: every node sends its larger neighbours, then its
    smaller ones, to its smallest neighbour.  Both only need a minimum per node, so a node with very many
    neighbours is summed up before the shuffle, and the join with the minima is left to the
    engine's handling of skewed keys.  Loops are dropped; no edges give no rows.
    """
    links = kept_table(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        links = _shortened(links)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())
        drop_finished_shuffles(edges.sparkSession)
        if now == state or not now[0]:
            break
        state = now
    members = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return members.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _shortened(links: DataFrame) -> DataFrame:
    """Both steps of a round; nothing refers to their shuffles once the result is kept."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    large = both.join(near, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    least = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return kept_table(small.select("e.a", "e.b").where("a <> b").distinct())
