import numpy as np

from foldwise.llm import embedding_caps as caps


def brute(ids, vectors, cosine=caps.COSINE):
    unit = np.array([v / np.linalg.norm(v) for v in vectors])
    close = unit @ unit.T >= cosine
    label = np.array(ids)
    while True:
        new = np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (new == label).all():
            return {i: (int(c) - 1, int(m)) for i, c, m in zip(ids, close.sum(axis=1), label)}
        label = new


def test_all_links_of_planted_groups_and_chains(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 32))
    near = [base[i % 40] + 0.03 * rng.normal(size=32) for i in range(200)]
    step = base[0] / np.linalg.norm(base[0])
    other = base[1] - (base[1] @ step) * step
    chain = [np.cos(a) * step + np.sin(a) * other / np.linalg.norm(other) for a in np.arange(1, 8) * 0.4]
    vectors = np.vstack([base, near, chain, base[:5]])
    ids = rng.permutation(len(vectors)).tolist()
    table = spark.createDataFrame([(i, v.tolist(), "clash") for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>, node string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.embedding_classes(table).collect()}
    assert got == brute(ids, vectors)


def test_recall_of_single_links(spark):
    """Pairs just above the threshold, each with no other way to be found."""
    rng = np.random.default_rng(4)
    one = rng.normal(size=(1500, 64))
    one /= np.linalg.norm(one, axis=1, keepdims=True)
    two = rng.normal(size=(1500, 64))
    two -= (two * one).sum(axis=1, keepdims=True) * one
    two /= np.linalg.norm(two, axis=1, keepdims=True)
    pairs = 0.905 * one + np.sqrt(1 - 0.905**2) * two
    rows = [(i, v.tolist()) for i, v in enumerate(np.vstack([one, pairs]))]
    got = caps.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("n_links = 1").count()
    assert got / 3000 >= 0.99


def test_large_groups_are_compared_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(5)
    center = rng.normal(size=16)
    vectors = center + 0.12 * rng.normal(size=(300, 16))
    monkeypatch.setattr(caps, "PART", 64)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in caps.embedding_classes(table).collect()}
    assert got == brute(list(range(300)), vectors)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []),
            (9, [1e-200, 0.0]), (10, [1e200, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-1.0, 0.0]), (None, [1.0, 0.0]), (13, [5.0]), (14, [3.0]), (2, [1.0, 0.0])]
    got = caps.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == len(rows)
    by = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got}
    assert by[1] == by[2] == by[9] == by[10] == (3, 1) and by[13] == by[14] == (1, 13)
    assert all(by[i] == (0, i) for i in (3, 4, 5, 6, 7, 8, 11, 12)) and by[None] == (0, None) or by[None][1] is None
    assert caps.embedding_classes(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
