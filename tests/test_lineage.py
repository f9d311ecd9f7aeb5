"""Tables between the rounds of an iterative operator."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.session import LARGEST_ESTIMATE, cut_lineage


def _estimate(df):
    return df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()


def test_estimates_do_not_grow_with_the_rounds(spark):
    table = cut_lineage(spark.range(50).select("id", (F.col("id") % 5).alias("k"), F.lit(0).cast("long").alias("seen")))
    assert _estimate(table) < 1 << 20  # small estimates stay as they are
    for _ in range(4):
        sizes = table.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        grid = sizes.select("k").join(sizes, "k").join(table.groupBy("k").agg(F.max("seen").alias("top")), "k")
        table = cut_lineage(table.join(grid, "k").select("id", "k", (F.col("seen") + F.col("n")).alias("seen")))
        assert _estimate(table) <= LARGEST_ESTIMATE
    assert sorted(map(tuple, table.collect())) == [(i, i % 5, 40) for i in range(50)]


def test_a_bounded_table_keeps_how_its_rows_are_dealt(spark):
    wide = spark.range(40).select("id", F.array_repeat("id", 100).alias("w"))
    for _ in range(4):
        wide = wide.join(wide.select("id"), "id")
    dealt = wide.repartition(3, "id")
    table, plain = cut_lineage(dealt), dealt.checkpoint()
    assert _estimate(plain) > _estimate(table) == LARGEST_ESTIMATE
    assert table.schema == dealt.schema
    placing = [d._jdf.queryExecution().logical().outputPartitioning().numPartitions() for d in (table, plain)]
    assert placing[0] == placing[1]
    assert sorted(r["id"] for r in table.collect()) == list(range(40))
