import json

import pytest
from pyspark.sql import functions as F

from foldwise.operators import alignment, splits
from foldwise.sources import sinks, tables

SCHEMA = "molecules string, y double"


@pytest.fixture
def tree(tmp_path):
    for bench, dataset in (("b1", "My Set"), ("b2", "other-set")):
        folder = tmp_path / "raw" / bench / "regression"
        folder.mkdir(parents=True)
        (folder / f"{dataset}.csv").write_text("﻿molecules,y\nCCO,1\nCC,\n", encoding="utf-8")
    split = tmp_path / "splits" / "d"
    split.mkdir(parents=True)
    for name, rows in (("train", "CCO,1\nCCO,2\n"), ("test", "CC,3\n")):
        (split / f"{name}.csv").write_text("molecules,y\n" + rows)
    return tmp_path


def test_entity_tree(spark, tree):
    got = tables.read_entities(spark, f"{tree}/raw", SCHEMA).collect()
    assert {(r["Benchmark"], r["TaskGroup"], r["Dataset"]) for r in got} == {
        ("b1", "regression", "my_set"),
        ("b2", "regression", "other_set"),
    }
    assert len(got) == 4 and {r["molecules"] for r in got} == {"CCO", "CC"}
    assert tables.missing_folders(spark, f"{tree}/raw", ["b1", "b9"], ["regression"]) == [f"{tree}/raw/b9/regression"]


def test_split_triples(spark, tree):
    listing = tables.file_catalog(spark, f"{tree}/splits")
    assert [r["dir"].endswith("/d") for r in tables.split_dirs(listing).collect()] == [True]
    got = tables.read_split_triple(spark, f"{tree}/splits/d", SCHEMA, allow_missing=True)
    assert got.groupBy("split").count().collect() and got.count() == 3
    with pytest.raises(FileNotFoundError):
        tables.read_split_triple(spark, f"{tree}/splits/d", SCHEMA)


def test_score_column_rules(spark):
    assert tables.score_column(spark.createDataFrame([("a", 1.0, 2.0)], "molecules string, t_score double, z double"), "t") == "t_score"
    assert tables.score_column(spark.createDataFrame([("a", 1.0)], "smiles string, p double"), "t") == "p"
    assert tables.score_column(spark.createDataFrame([("a", 1.0, 2.0)], "smiles string, p double, q double"), "t") is None


def test_alignment_with_duplicates_and_clash(spark):
    test = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 3, 3.0)], "molecules string, row_order bigint, y double")
    pred = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("a", 3, 30.0)], "molecules string, row_order bigint, y double")
    got = {r["row_order"]: r["y_predfile"] for r in alignment.align_predictions(test, pred, ["molecules"]).collect()}
    assert got == {1: 10.0, 2: 20.0, 3: None}
    plain = pred.select("row_order", F.col("y").alias("p"))
    assert {r["y"]: r["p"] for r in alignment.align_by_position(test, plain).collect()} == {1.0: 10.0, 2.0: 20.0, 3.0: 30.0}
    with pytest.raises(Exception, match="differs in length"):
        alignment.align_by_position(test, plain.limit(2)).collect()


def test_fold_errors(spark):
    df = spark.createDataFrame([("d", "g1"), ("d", "g2")], "dataset string, group_key string")
    with pytest.raises(ValueError):
        splits.group_parts(df, ["dataset"], bins=1)
    with pytest.raises(Exception, match="fewer groups"):
        splits.group_parts(df, ["dataset"], bins=3).collect()
    assert {r["part"] for r in splits.group_parts(df, ["dataset"], bins=3, strict=False).collect()} == {None}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train"), ("b", 2, "test")], "molecules string, y int, split string")
    sinks.write_splits(df, f"{tmp_path}/out", ["split"], ["molecules", "y"])
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    sinks.write_report_json(df, f"{tmp_path}/r.json")
    assert len(json.loads((tmp_path / "r.json").read_text())) == 2
    sinks.write_report_csv(spark.range(12_000), f"{tmp_path}/r.csv")
    assert len((tmp_path / "r.csv").read_text(encoding="utf-8-sig").splitlines()) == 12_001
    long = "a" * 31
    sinks.write_sheets({f"{long}1": df, f"{long}2": df.limit(1)}, f"{tmp_path}/long")
    assert len((tmp_path / "long" / f"{long}1.csv").read_text().splitlines()) == 3
    assert len((tmp_path / "long" / f"{long}2.csv").read_text().splitlines()) == 2
    sinks.write_sheets({"full": df, "none": df.limit(0)}, f"{tmp_path}/book")
    assert "No data" in (tmp_path / "book" / "none.csv").read_text(encoding="utf-8-sig")


def test_targets_become_rows(spark):
    df = spark.createDataFrame([("C", "g", "1", "x"), ("CC", "g", None, "2.5")], "molecules string, Scaffold string, `a b` string, c string")
    targets = tables.target_columns(df)
    assert targets == ["a b", "c"]
    got = {(r["molecules"], r["Target"]): r["y"] for r in tables.targets_long(df, targets, ["molecules"]).collect()}
    assert got == {("C", "a b"): 1.0, ("C", "c"): None, ("CC", "a b"): None, ("CC", "c"): 2.5}


def test_union_of_columns_and_existing_columns(spark):
    one, two = spark.createDataFrame([(1, 2)], "a int, b int"), spark.createDataFrame([(3, 4)], "b int, c int")
    both = sinks.union_rows([one, two])
    assert both.columns == ["a", "b", "c"] and {tuple(r) for r in both.collect()} == {(1, 2, None), (None, 3, 4)}
    assert tables.existing_columns(both, ["c", "z", "a"]).columns == ["c", "a"]


def test_first_accepted_prediction_file(spark, tmp_path):
    base = tmp_path / "m" / "b" / "t" / "d" / "fold_1"
    base.mkdir(parents=True)
    (base / "test.csv").write_text("molecules,y_pred\nC,1\n")
    (base / "predictions.csv").write_text("molecules,y_pred\nC,2\n")
    df, path = tables.read_predictions(spark, str(tmp_path), "m", "b", "t", "d", "fold_1")
    assert path.endswith("predictions.csv") and df.first()["y_pred"] == "2"
    assert tables.read_predictions(spark, str(tmp_path), "m", "b", "t", "d", "fold_2") == (None, None)
