"""Edge rows of the metrics against small NumPy re-derivations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.functions import scalars
from foldwise.operators import classification, evaluation, ranking, regression, shift

NAN, INF = float("nan"), float("inf")


def table(spark, groups, names):
    rows = [(k, *[None if v is None else float(v) for v in values]) for k, pairs in groups.items() for values in pairs]
    return spark.createDataFrame(rows, "k string, " + ", ".join(f"{n} double" for n in names))


def by_key(df):
    return {r["k"]: r.asDict() for r in df.collect()}


def test_ties_and_edge_rows(spark):
    groups = {
        "tied": [(0, 0.5), (1, 0.5), (0, 0.5), (1, 0.5)],
        "pairs": [(1, 0.8), (0, 0.8), (1, 0.4), (0, 0.4), (1, 0.2), (0, 0.2)],
        "perfect": [(1, 0.9), (1, 0.8), (0, 0.2)],
        "dirty": [(1, 0.9), (0, 0.1), (1, NAN), (None, 0.5), (0, INF), (NAN, 0.3)],
        "single": [(1, 0.3), (1, 0.7)],
    }
    got = by_key(classification.classification_summary(table(spark, groups, ["y", "score"]), ["k"]))
    assert got["tied"]["normPR"] == pytest.approx(0, abs=1e-12)
    assert got["pairs"]["average_precision"] == pytest.approx(0.5) and got["pairs"]["normPR"] == pytest.approx(0, abs=1e-12)
    assert got["perfect"]["roc_auc"] == 1.0 and got["perfect"]["average_precision"] == pytest.approx(1.0)
    assert got["dirty"]["n"] == 2 and got["dirty"]["roc_auc"] == 1.0
    single = got["single"]
    assert single["roc_auc"] is None and single["average_precision"] is None and single["mcc"] is None
    assert single["accuracy"] == 0.5 and single["balanced_accuracy"] == 0.5


def numpy_ranks(values):
    return np.array([np.sum(values < v) + (np.sum(values == v) + 1) / 2 for v in values])


def test_regression_edges_and_scale(spark):
    rng = np.random.default_rng(5)
    y, p = np.round(rng.normal(size=60), 1), np.round(rng.normal(size=60), 1)
    groups = {
        "plain": list(zip(y.tolist(), p.tolist())),
        "scaled": list(zip((10 * y).tolist(), (10 * p).tolist())),
        "constant": [(2.0, 1.0), (2.0, 3.0), (2.0, 2.0)],
        "one": [(1.0, 1.5)],
        "zero": [(0.0, 1.0), (0.0, 2.0)],
        "dirty": [(1.0, 2.0), (2.0, 3.5), (NAN, 1.0), (1.0, None), (INF, 0.0)],
    }
    df = table(spark, groups, ["y", "pred"])
    got = by_key(regression.regression_summary(df, ["k"]))
    plain = got["plain"]
    assert plain["Pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert plain["Spearman_rho"] == pytest.approx(np.corrcoef(numpy_ranks(y), numpy_ranks(p))[0, 1])
    assert plain["R2"] == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert got["scaled"]["relMAE"] == pytest.approx(plain["relMAE"])
    assert got["constant"]["R2"] is None and got["constant"]["Pearson_r"] is None and got["constant"]["Spearman_rho"] is None
    assert got["one"]["R2"] is None and got["one"]["MAE"] == 0.5 and got["one"]["Target_SD"] is None
    assert got["zero"]["relMAE"] is None and got["dirty"]["n"] == 2
    assert by_key(regression.moments(df, ["k"], constant_r2="score"))["constant"]["R2"] == 0.0


def test_gini_ks_hedges(spark):
    rng = np.random.default_rng(7)
    a, b = np.round(rng.exponential(size=40), 1), np.round(rng.normal(0.4, 1, size=30), 1)
    rows = [("x", v, True) for v in a.tolist()] + [("x", v, False) for v in b.tolist()] + [("x", NAN, True), ("x", None, False)]
    df = spark.createDataFrame(rows, "k string, v double, first boolean")
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= g).mean() - (b <= g).mean()) for g in grid)
    assert by_key(shift.ks_statistic(df, ["k"], "v", "first"))["x"]["KS_Statistic"] == pytest.approx(want)
    groups = {"some": [(float(v),) for v in a], "minus": [(float(v),) for v in b], "zero": [(0.0,), (0.0,)], "same": [(-1.0,), (-1.0,)]}
    got = by_key(shift.gini(table(spark, groups, ["v"]), ["k"], "v"))

    def gini(x):
        x = np.sort(x - min(x.min(), 0))
        return (len(x) + 1 - 2 * np.cumsum(x).sum() / x.sum()) / len(x)

    assert got["some"]["gini"] == pytest.approx(gini(a)) and got["minus"]["gini"] == pytest.approx(gini(b))
    assert got["zero"]["gini"] == 0.0 and got["same"]["gini"] is None


def test_label_codings(spark):
    groups = {
        "unit": [(0.0,), (1.0,), (None,)],
        "signed": [(-1.0,), (1.0,), (0.0,), (None,)],
        "probability": [(0.2,), (0.5,), (None,)],
        "other": [(2.0,), (0.0,)],
    }
    df = table(spark, groups, ["raw"])
    got = {}
    for r in classification.binary_labels(df, ["k"], "raw").collect():
        got.setdefault(r["k"], []).append(r["label"])
    key = lambda v: (v is None, v)
    assert sorted(got["unit"], key=key) == [0.0, 1.0, None]
    assert sorted(got["signed"], key=key) == [0.0, 0.0, 0.0, 1.0]
    assert sorted(got["probability"], key=key) == [0.0, 0.0, 1.0]
    assert got["other"] == [None, None]
    strict = classification.binary_labels(df, ["k"], "raw", strict=True).where("k = 'signed'").collect()
    assert sorted([r["label"] for r in strict], key=key) == [0.0, 0.0, 1.0, None]


def test_hot_key_orders_and_medians(spark):
    """One key holds most rows; positions and medians stay exact."""
    rows = [("hot" if i % 10 else f"k{i}", (i * 7919) % 100003, float(i % 13)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, ord bigint, v double")
    got = ranking.ordinal_within(df, ["k"], "ord").where("k = 'hot'").orderBy("ord").collect()
    assert [r["ordinal"] for r in got] == list(range(len(got)))
    both = ranking.ordinal_by(df, ["k"], "v", "ord", descending=True).where("k = 'hot'").orderBy("ordinal").collect()
    assert [(-r["v"], r["ord"]) for r in both] == sorted((-v, o) for k, o, v in rows if k == "hot")
    medians = by_key(ranking.grouped_median(df, ["k"], "v"))
    assert medians["hot"]["median"] == np.median([v for k, _, v in rows if k == "hot"])


def test_primary_fold_breaks_ties_as_text(spark):
    rows = [("b", "d", f, s, n) for f, n in (("fold_2", 5), ("fold_10", 5), ("fold_3", 1)) for s in ("all_test", "no_scaffold")]
    df = spark.createDataFrame(rows, "Benchmark string, Dataset string, Fold string, Subset string, NoScaffold_Test_N bigint")
    marked = evaluation.mark_primary_fold(df).where("Is_NoScaffold_Fold").collect()
    assert {r["Fold"] for r in marked} == {"fold_10"}


@pytest.mark.parametrize("n,k", [(1000, 5), (1001, 7), (3000, 7), (3001, 10)])
def test_fold_rule(spark, n, k):
    row = spark.range(1).select(scalars.fold_count(F.lit(n)).alias("k"), scalars.target_counts(F.lit(n)).alias("t")).first()
    assert row["k"] == k and sum(row["t"]) == n


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.bernoulli_jsd(F.lit(0.0), F.lit(1.0)).alias("jsd"),
        scalars.open_ratio(F.lit(1.0), F.lit(0.0)).alias("inf"),
        scalars.open_ratio(F.lit(0.0), F.lit(0.0)).alias("none"),
        scalars.pretty_name(F.lit("a_b")).alias("name"),
    ).first()
    assert row["jsd"] == pytest.approx(math.log(2)) and row["inf"] == INF and row["none"] is None and row["name"] == "a b"


def test_infinities_leave_all_metrics_alike(spark):
    from foldwise.operators import evaluation

    rows = [(float(i), float(i) + (i % 3), False) for i in range(8)]
    wild = rows + [(float("inf"), 1.0, False), (2.0, float("-inf"), True)]
    plain, marked = (
        spark.createDataFrame(r, "y double, pred double, is_empty boolean").selectExpr("*", *(f"'x' AS {k}" for k in evaluation.POINT)) for r in (rows, wild)
    )
    one, two = (evaluation.evaluate_regression(t).where("Subset = 'all_test'").first() for t in (plain, marked))
    assert one == two and one["N"] == 8
    scored = [t.withColumn("y", (t.y > 3).cast("double")).withColumnRenamed("pred", "score") for t in (plain, marked.where("not (y = 'Infinity')"))]
    counts = [evaluation.evaluate_classification(t).collect() for t in scored]
    assert counts[0] == counts[1]


def test_identifiers_keep_all_digits(spark):
    from foldwise.functions.scalars import entity_id

    ids = spark.createDataFrame([(100_000_001,), (100_000_012,), (7,)], "n bigint").select(entity_id(F.lit("d"), "n").alias("i")).collect()
    assert [r["i"] for r in ids] == ["d_100000001", "d_100000012", "d_00000007"]


def test_all_pairs_of_a_small_group_are_drawn(spark):
    from foldwise.operators.similarity import sampled_pair_mean

    members = spark.range(100).selectExpr("'d' AS dataset", "id", "array(id * 2654435761) AS words")
    assert sampled_pair_mean(members, ["dataset"], "id").first()["pairs"] == 4950
    assert sampled_pair_mean(members, ["dataset"], "id", pairs=700).first()["pairs"] == 700


def test_pairs_never_become_a_table(spark, monkeypatch):
    """40 x 40 distinct pairs per point and status: what is kept between the steps grows with the distinct values."""
    rows = [("a", float(i * 7 % 40), float(j * j % 41), (i + j) % 3 == 0) for i in range(40) for j in range(40)]
    df = spark.createDataFrame(rows, "k string, y double, pred double, e boolean")
    kept, plain = [], regression.cut_lineage

    def watched(table):
        out = plain(table)
        kept.append(out.count())
        return out

    monkeypatch.setattr(regression, "cut_lineage", watched)
    got = {r["Subset"]: r for r in regression.paired_metrics(df, ["k"], "null", "e", ("all", "without", "with")).collect()}
    for subset, mine in (("all", rows), ("without", [r for r in rows if not r[3]]), ("with", [r for r in rows if r[3]])):
        y, p = np.array([r[1] for r in mine]), np.array([r[2] for r in mine])
        assert got[subset]["n"] == len(mine) and got[subset]["MAE"] == pytest.approx(np.abs(y - p).mean())
        assert got[subset]["Pearson_r"] == pytest.approx(np.corrcoef(y, p)[0, 1])
        assert got[subset]["Spearman_rho"] == pytest.approx(np.corrcoef(numpy_ranks(y), numpy_ranks(p))[0, 1])
    assert max(kept) <= 80
    rho = regression.spearman(df.withColumn("n", F.lit(1)), ["k"]).first()["Spearman_rho"]
    assert rho == pytest.approx(got["all"]["Spearman_rho"]) and max(kept) <= 80


def test_spearman_of_counted_pairs_and_constants(spark):
    rows = [("a", 1.0, 2.0, 3), ("a", 2.0, 1.0, 1), ("a", 3.0, 5.0, 2), ("b", 1.0, 1.0, 2), ("b", 1.0, 2.0, 1), ("c", 1.0, 1.0, 1), (None, 1.0, 2.0, 1)]
    df = spark.createDataFrame(rows, "k string, y double, pred double, n long")
    got = by_key(regression.spearman(df, ["k"]))
    y, p = np.repeat([1.0, 2.0, 3.0], [3, 1, 2]), np.repeat([2.0, 1.0, 5.0], [3, 1, 2])
    assert got["a"]["Spearman_rho"] == pytest.approx(np.corrcoef(numpy_ranks(y), numpy_ranks(p))[0, 1])
    assert set(got) == {"a", "b", "c"} and got["b"]["Spearman_rho"] is None and got["c"]["Spearman_rho"] is None


def test_points_with_one_number_are_numbered_anew(spark, monkeypatch):
    plain = regression._number
    monkeypatch.setattr(regression, "_number", lambda keys, seed: plain(keys, seed) if seed else F.lit(7).cast("long"))
    df = spark.createDataFrame([("a", None, 1.0), ("a", "x", 2.0), (None, "x", 3.0)], "k string, m string, y double")
    points, rows = regression.numbered(df, ["k", "m"], F.avg("y").alias("_cy"))
    assert points.select("_point").distinct().count() == 3 and rows.where("y = _cy").count() == 3
