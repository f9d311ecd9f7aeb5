"""Evaluation of prediction trees against the same rows given as a table."""

import csv
import random

import pytest
from pyspark.sql import functions as F

from foldwise.operators import evaluation, from_files
from foldwise.sources import csv_tree

POINT = ["Benchmark", "Dataset", "Target", "Model", "Fold"]
DATASETS = {"My Set": ["y", "z"], "other-set": ["logP"], "third": ["a", "b", "c"]}


def write(path, header, rows, bom=False):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", newline="", encoding="utf-8-sig" if bom else "utf-8") as file:
        out = csv.writer(file)
        out.writerow(header)
        out.writerows(rows)


def make_tree(root, value, predicted):
    """3 datasets x 3 folds x 2 models; returns the points that the tree stands for."""
    rng = random.Random(2)
    points = []
    for d, (folder, targets) in enumerate(DATASETS.items()):
        dataset = folder.lower().replace(" ", "_").replace("-", "_")
        for f in range(3):
            fold = f"fold_{f + 1}"
            rows = []
            for i in range(70):
                text = f"C{'C' * rng.randrange(6)}{'1O1' if rng.random() < 0.4 else ''}"  # repeated texts
                rows.append((text, {t: value(rng) for t in targets}))
            with_group = d == 2
            group = lambda text: "No_Scaffold" if len(text) % 2 else "C1CC1"
            header = ["molecules", *targets] + (["Scaffold"] if with_group else [])
            lines = [[text, *[y[t] for t in targets]] + ([group(text)] if with_group else []) for text, y in rows]
            write(root / "splits" / "b1" / "task" / folder / fold / "test.csv", header, lines, bom=f == 1)
            for model in ("m1", "m2"):
                if model == "m2" and (d, f) == (1, 2):
                    continue  # no file
                guess = [{t: predicted(rng, y[t]) for t in targets} for _, y in rows]
                base = root / "predictions" / model / "b1" / "task" / dataset / fold
                if model == "m1" and d == 0:  # keyed by smiles, one column per target, in another order of the keys
                    order = sorted(range(70), key=lambda i: (hash(rows[i][0]) % 5, rows[i][0], i))
                    write(base / "predictions.csv", ["extra, quoted", "smiles", "pred_z", "y_pred"], [['say ""hi"", you', rows[i][0], guess[i]["z"], guess[i]["y"]] for i in order])
                elif model == "m1":  # same names as the targets: known with a suffix
                    write(base / "test_predictions.csv", ["molecules", *targets], [[r[0], *g.values()] for r, g in zip(rows, guess)])
                    write(base / "test.csv", ["molecules", *targets], [[r[0]] + [9] * len(targets) for r in rows])  # not the best name
                else:  # no key: by position, only the first target
                    write(base / "test.csv", [f"{targets[0]}_pred"], [[g[targets[0]]] for g in guess])
                for (text, y), g in zip(rows, guess):
                    empty = (len(text) % 2 == 1) if with_group else "1" not in text
                    for t in targets if model == "m1" else targets[:1]:
                        points.append(("b1", dataset, t, model, fold, str(y[t]), str(g[t]), empty))
    write(root / "splits" / "b1" / "task" / "My Set" / "notes" / "test.csv", ["molecules", "y"], [["C", 1]])
    write(root / "splits" / "b1" / "other" / "My Set" / "fold_1" / "test.csv", ["molecules", "y"], [["C", 1]])
    return points


def keyed(df):
    return {tuple(r[c] for c in [*POINT, "Subset"]): r.asDict() for r in df.collect()}


def same(got, want):
    assert got.keys() == want.keys() and got
    for k, row in want.items():
        assert {c: got[k][c] for c in row} == pytest.approx(row, nan_ok=True), k


def test_regression_tree(spark, tmp_path):
    points = make_tree(tmp_path, lambda r: round(r.gauss(0, 3), 3), lambda r, y: round(y + r.gauss(0, 1), 3))
    table = spark.createDataFrame(points, ", ".join(f"{c} string" for c in [*POINT, "y", "pred"]) + ", is_empty boolean")
    got = keyed(from_files.evaluate_regression_files(spark, f"{tmp_path}/splits", f"{tmp_path}/predictions", "task"))
    same(got, keyed(evaluation.evaluate_regression(table)))
    assert {r["Test_Size"] for r in got.values()} == {70}
    assert {r["Prediction_File"].split("/")[-1] for r in got.values()} == {"predictions.csv", "test_predictions.csv", "test.csv"}
    assert ("b1", "other_set", "logP", "m2", "fold_3", "all_test") not in got


def test_classification_tree(spark, tmp_path):
    points = make_tree(tmp_path, lambda r: r.choice([-1, 1]), lambda r, y: round(min(1, max(0, r.random() * 0.8 + 0.1 * y)), 2))
    table = spark.createDataFrame(points, ", ".join(f"{c} string" for c in [*POINT, "y", "score"]) + ", is_empty boolean")
    # "pred_z" is a name of scores as well, "a_pred" too
    got = keyed(from_files.evaluate_classification_files(spark, f"{tmp_path}/splits", f"{tmp_path}/predictions", "task"))
    same(got, keyed(evaluation.evaluate_classification(table)))


def test_unequal_lengths_and_missing_key_column(spark, tmp_path):
    write(tmp_path / "s" / "b" / "t" / "d" / "fold_1" / "test.csv", ["molecules", "y"], [["C", 1], ["CC", 2]])
    write(tmp_path / "p" / "m" / "b" / "t" / "d" / "fold_1" / "test.csv", ["y_pred"], [[1]])
    with pytest.raises(ValueError, match="m/b/d/fold_1"):
        from_files.evaluate_regression_files(spark, f"{tmp_path}/s", f"{tmp_path}/p", "t")
    write(tmp_path / "s2" / "b" / "t" / "d" / "fold_1" / "test.csv", ["text", "y"], [["C", 1]])
    with pytest.raises(Exception, match="no column molecules"):
        from_files.evaluate_regression_files(spark, f"{tmp_path}/s2", f"{tmp_path}/p", "t").collect()


def test_fields_and_paths(spark):
    lines = ["a,b", "a,", ",", '"x, y",2', '"say ""no""",', "one", 'a "b",c', '"' + "long " * 20000 + '",1']
    got = [r.f for r in spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "i int, s string").orderBy("i").select(csv_tree.csv_fields(F.col("s")).alias("f")).collect()]
    want = list(csv.reader(lines))
    assert [f[: len(w)] for f, w in zip(got, want)] == want and all(set(f[len(w) :]) <= {""} for f, w in zip(got, want))
    paths = spark.createDataFrame([("file:/x/Model=m/a=b/test.csv/part-000-x.csv",), ("file:/x/My%20Set/a+b.csv",)], "p string")
    assert [r[0] for r in paths.select(csv_tree.logical_path(paths.p)).collect()] == ["file:/x/m/b/test.csv", "file:/x/My Set/a+b.csv"]


def test_rows_keep_the_order_of_split_files(spark, tmp_path):
    """A file read in many blocks, and a folder of part files."""
    write(tmp_path / "one.csv", ["i", "t"], [[i, "x" * (i % 50)] for i in range(20_000)])
    write(tmp_path / "two.csv" / "part-00000.csv", ["i"], [[i] for i in range(5)])
    write(tmp_path / "two.csv" / "part-00001.csv", ["i", "extra"], [[i, 0] for i in range(5, 9)])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, files = csv_tree.csv_tree(spark, str(tmp_path), ["Name"])
        got = {}
        for r in rows.collect():
            got.setdefault(r.path.rsplit("/", 1)[1], []).append((r.row_order, int(r.fields[0])))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [i for _, i in sorted(got["one.csv"])] == list(range(20_000)) and [i for _, i in sorted(got["two.csv"])] == list(range(9))
    assert {r.Name: r.header for r in files.collect()} == {"one.csv": ["i", "t"], "two.csv": ["i"]}


def test_headers_are_kept_and_lines_are_not_sorted_for_them(spark, tmp_path):
    """First lines, after blank ones too, come from numbers alone, and reading the rows does not look for them again."""
    (tmp_path / "one").mkdir()
    (tmp_path / "one" / "a.csv").write_text("\n  \nx,y\n1,2\n\n3,4\n")
    (tmp_path / "one" / "b.csv").write_text("z\n5\n")
    (tmp_path / "one" / "none.csv").write_text("\n")
    rows, files = csv_tree.csv_tree(spark, str(tmp_path), ["Folder", "Name"])
    assert sorted((r["Name"], r["header"]) for r in files.collect()) == [("a.csv", ["x", "y"]), ("b.csv", ["z"])]
    assert [[f for f in r["fields"] if f] for r in rows.orderBy("path", "row_order").collect()] == [["1", "2"], ["3", "4"], ["5"]]
    for table in (rows, files):
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan, plan


def test_aligned_rows_are_kept(spark, tmp_path):
    """The evaluation reads its points several times; rows are aligned once."""
    make_tree(tmp_path, lambda rng: rng.random(), lambda rng, y: y + rng.random())
    splits, predictions = str(tmp_path / "splits"), str(tmp_path / "predictions")
    points, _ = from_files.paired_rows(spark, splits, predictions, "task", from_files.PREDICTION_NAMES)
    assert dict(points.dtypes)["y"] == dict(points.dtypes)["score"] == "double"
    plan = points._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Window" not in plan, plan


def test_a_score_that_is_no_number_still_fails_a_classification(spark, tmp_path):
    write(tmp_path / "splits/b/classification/d/fold_1/test.csv", ["molecules", "y"], [["C", 1], ["CC", 0]])
    write(tmp_path / "predictions/m/b/classification/d/fold_1/predictions.csv", ["molecules", "y_pred"], [["C", "high"], ["CC", 0.1]])
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        from_files.evaluate_classification_files(spark, str(tmp_path / "splits"), str(tmp_path / "predictions")).collect()
