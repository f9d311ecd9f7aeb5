"""Files of finished shuffles go while an operator is still at work, not only when the driver is short of memory."""

import random
import time

from foldwise.llm import graph


def shuffles(spark):
    names = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {name.rsplit("/", 1)[-1].split("_")[1] for name in names if "/shuffle_" in name}


def watch(spark, monkeypatch, module):
    """Numbers of new shuffles with files before each kept table; every table takes as long as a larger one would."""
    known, counts, kept_table = shuffles(spark), [], module.kept_table

    def slow(df):
        time.sleep(1.5)
        counts.append(len(shuffles(spark) - known))
        return kept_table(df)

    monkeypatch.setattr(module, "kept_table", slow)
    return counts


def test_rounds_of_components(spark, monkeypatch):
    nodes = list(range(3000))
    random.Random(5).shuffle(nodes)
    edges = spark.createDataFrame(list(zip(nodes, nodes[1:])), "a long, b long")
    counts = watch(spark, monkeypatch, graph)
    assert {tuple(r) for r in graph.components(edges).collect()} == {(n, 0) for n in nodes}
    assert len(counts) > 5 and max(counts) <= 9, counts

