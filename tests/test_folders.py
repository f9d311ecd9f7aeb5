"""Folders of datasets: splitting with one broken dataset, repair of archived splits, text identifiers."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from foldwise.functions.scalars import rounded
from foldwise.operators import clusters, folders, ranking, repair, similarity, splits
from foldwise.sources import csv_tree
from tests.test_clusters import make_rows
from tests.test_from_files import write


def read_back(spark, path, levels):
    rows, files = csv_tree.csv_tree(spark, path, levels)
    out = {}
    for r in rows.join(files, "path").orderBy("path", "row_order").collect():
        out.setdefault(tuple(r[c] for c in levels), []).append(dict(zip(r.header, r.fields)))
    return out


@pytest.fixture
def raw(tmp_path):
    rng = random.Random(1)
    for task, dataset, extra in (("regression", "First-Set", ["y"]), ("classification", "second", ["a", "b"])):
        rows = []
        for i in range(60):
            group = rng.choice(["No_Scaffold", "g1", "g2", "g3", "g4", "g5", "g6", "Error"])
            rows.append(["" if i == 7 else f"C{i}", *[i] * len(extra), group])
        write(tmp_path / "raw" / "b" / task / f"{dataset}.csv", ["molecules", *extra, "Scaffold"], rows)
    write(tmp_path / "raw" / "b" / "regression" / "no_text.csv", ["text", "y"], [["C", 1]])
    write(tmp_path / "raw" / "b" / "regression" / "few.csv", ["molecules", "Scaffold"], [[f"C{i}", "one"] for i in range(5)])
    write(tmp_path / "raw" / "b" / "regression" / "invalid.csv", ["molecules", "Scaffold"], [["C1", "Error"]])
    write(tmp_path / "raw" / "b" / "regression" / "blank.csv", ["molecules", "Scaffold"], [["", ""]])
    return tmp_path


def test_one_broken_dataset_does_not_stop_the_others(spark, raw):
    reports = folders.split_folder(spark, f"{raw}/raw", f"{raw}/out")
    failed = {r["Dataset"]: r["reason"] for r in reports["failed"].collect()}
    assert failed == {"no_text": "missing column molecules", "few": "fewer groups than parts", "invalid": "no valid members", "blank": "no valid members"}
    table = {r["Dataset"]: r for r in reports["dataset_summary"].collect()}
    assert len(table) == 6 and {d for d, r in table.items() if r["status"] == "success"} == {"first_set", "second"}
    first = table["first_set"]
    assert (first["raw_total_count"], first["after_dropna_count"], first["kfolds"], first["weight_splits"]) == (60, 59, 5, "3:1:1")
    assert first["raw_total_count"] - first["removed_count"] == first["effective_total_count"] == first["molecule_count"]
    for name in reports:
        text = (raw / "out" / f"{name}.csv").read_text(encoding="utf-8-sig")
        assert len(list(csv.reader(text.splitlines()))) == reports[name].count() + 1

    files = read_back(spark, f"{raw}/out/folds", ["Benchmark", "TaskGroup", "Dataset", "Fold", "Split"])
    source = {r[0]: r for r in csv.reader(open(raw / "raw" / "b" / "classification" / "second.csv"))}
    valid = {m for m, r in source.items() if m not in ("molecules", "") and r[3] != "Error"}
    for k in range(1, 6):
        sides = {s: files["b", "classification", "second", f"fold_{k}", s] for s in ("train", "valid", "test")}
        assert sorted(r["molecules"] for rows in sides.values() for r in rows) == sorted(valid)
        groups = [{source[r["molecules"]][3] for r in rows} for rows in sides.values()]
        assert not (groups[0] & groups[1] or groups[0] & groups[2] or groups[1] & groups[2])
        assert all(r["a"] == source[r["molecules"]][1] for rows in sides.values() for r in rows)
    assert len(files) == 2 * 5 * 3


def test_rows_are_written_in_the_order_of_the_key(spark, raw):
    folders.split_folder(spark, f"{raw}/raw", f"{raw}/out", seed=5)
    files = read_back(spark, f"{raw}/out/folds", ["Benchmark", "TaskGroup", "Dataset", "Fold", "Split"])
    row_id = {(r["Dataset"], r["text"]): r["ROW_ID"] for r in spark.read.parquet(f"{raw}/out/assignment").collect()}
    for (_, _, dataset, fold, split), rows in files.items():
        ids = [row_id[dataset, r["molecules"]] for r in rows]
        keyed = spark.createDataFrame([(i, int(fold[5:]) - 1, split) for i in ids], "id string, eval_fold int, split string")
        want = [r["id"] for r in keyed.orderBy(splits.shuffled_key("id", 5)).collect()]
        assert ids == want and (len(ids) < 5 or ids != sorted(ids))


@pytest.fixture(scope="module")
def noisy():
    return make_rows(seed=5, n=80)


def test_text_numbers_follow_the_texts(spark):
    ids = [f"x{i:04d}" for i in random.Random(3).sample(range(10_000), 500)] + ["", "ü"]
    df = spark.createDataFrame([(i,) for i in [*ids, *ids, None]], "id string")
    got = {r["id"]: r["n"] for r in ranking.text_numbers(df, "id", "n").collect()}
    assert got == {i: k for k, i in enumerate(sorted(ids, key=lambda s: s.encode()))}


def test_text_identifiers_give_what_numbers_give(spark, noisy):
    df = spark.createDataFrame(noisy, "dataset string, node bigint, words array<bigint>").withColumn("limit", F.lit(12))
    texts = df.withColumn("id", F.format_string("m_%05d", "node"))
    keyed = lambda t, c, *v: {(r["dataset"], str(r[c])[-5:].zfill(5)): tuple(r[x] for x in v) for r in t.collect()}
    a = clusters.microclusters(df, ["dataset"], "node", "limit")
    b = clusters.microclusters(ranking.with_number(texts, "id", "n"), ["dataset"], "n", "limit")
    assert keyed(a, "node", "cluster_no") == keyed(b, "node", "cluster_no")
    half = df.where("node % 2 = 0"), df.where("node % 2 = 1")
    t_half = texts.where("node % 2 = 0"), texts.where("node % 2 = 1")
    got = keyed(similarity.max_similarity(*t_half, ["dataset"], "id"), "id", "max_similarity")
    assert got == keyed(similarity.max_similarity(*half, ["dataset"], "node"), "node", "max_similarity")
    leak = [rounded(similarity.leakage_metrics(*side, ["dataset"], c)).orderBy("dataset").collect() for side, c in ((t_half, "id"), (half, "node"))]
    assert leak[0] == leak[1]
    members = texts.withColumn("is_empty", F.col("node") % 2 == 0).withColumn("split", F.when(F.col("node") % 10 < 7, "train").when(F.col("node") % 10 < 9, "valid").otherwise("test"))
    one, _ = repair.repair_split(members.drop("id"), ["dataset"], "node")
    two, _ = repair.repair_split(members, ["dataset"], "id")
    assert keyed(one, "node", "Split", "ESA_cluster_id") == keyed(two, "id", "Split", "ESA_cluster_id")


def test_archived_splits_are_repaired_from_files_to_files(spark, tmp_path, noisy):
    words, table = {}, []
    for dataset in ("a", "b"):
        rows = [r for r in noisy if r[0] == dataset]
        side = {"train": [], "valid": [], "test": []}
        for _, i, w in rows:
            text = f"m{i:03d}"
            words[text + dataset] = w
            side["train" if i % 10 < 7 else "valid" if i % 10 < 9 else "test"].append((text + dataset, i, "" if i == 3 else "No_Scaffold" if i % 2 else "ring"))
        for split, lines in side.items():
            write(tmp_path / "splits" / dataset / f"{split}.csv", ["molecules", "y", "Scaffold"], lines)
        at = 0
        for split, lines in side.items():
            for text, _, group in lines:
                at += 1
                table.append((dataset, at, words[text], group == "No_Scaffold", split, text))
    prints = spark.createDataFrame(list(words.items()), "text string, words array<bigint>")
    audit, summary = folders.repair_archived_splits(spark, f"{tmp_path}/splits", prints, f"{tmp_path}/out")
    # the text without a group has digits, so it counts as having rings
    plain = spark.createDataFrame(table, "Dataset string, node bigint, words array<bigint>, is_empty boolean, split string, text string")
    want, clusters_ = repair.repair_split(plain, ["Dataset"], "node")
    assert {r["text"]: (r["RawSplit"], r["Split"], r["ESA_cluster_id"]) for r in audit.collect()} == {r["text"]: (r["RawSplit"], r["Split"], r["ESA_cluster_id"]) for r in want.collect()}
    assert {r["ID"] for r in audit.where("Dataset = 'a'").collect()} == {f"a_{i:06d}" for i in range(1, 81)}
    assert summary.count() == clusters_.count()
    files = read_back(spark, f"{tmp_path}/out/splits", ["Dataset", "Split"])
    split_of = {r["text"]: r["Split"] for r in audit.collect()}
    assert {row["molecules"]: k[1] for k, rows in files.items() for row in rows} == split_of
    assert spark.read.parquet(f"{tmp_path}/out/audit").count() == 160 == sum(r["n_molecules"] for r in folders.summarize_split_folder(spark, f"{tmp_path}/splits").collect())
    (tmp_path / "splits" / "a" / "valid.csv").unlink()
    with pytest.raises(FileNotFoundError, match="valid"):
        folders.read_archived_splits(spark, f"{tmp_path}/splits")
