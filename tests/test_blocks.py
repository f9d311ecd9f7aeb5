"""The grid of block groups against plain loops over all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from foldwise.operators import blocks, similarity


def tanimoto(x, y):
    both = sum(bin(a & b).count("1") for a, b in zip(x, y))
    union = sum(bin(a | b).count("1") for a, b in zip(x, y))
    return both / union if union else 1.0


def fingerprints(n, seed=1):
    """Sizes from 0 to 120 on-bits, families of near copies."""
    rng = np.random.default_rng(seed)
    found = []
    for i in range(n):
        if found and rng.random() < 0.5:
            bits = set(found[int(rng.integers(len(found)))])
            for b in rng.integers(0, 128, 4):
                bits ^= {int(b)}
        else:
            bits = set(map(int, rng.integers(0, 128, int(rng.integers(0, 120)))))
        found.append(bits)
    return [[sum(1 << (b - 64 * w) for b in bits if 64 * w <= b < 64 * w + 64) for w in (0, 1)] for bits in found]


def signed(words):
    return [w - (1 << 64) if w >> 63 else w for w in words]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(d, i + 1, signed(w), 1 + i % 3) for d, seed in (("a", 1), ("b", 2)) for i, w in enumerate(fingerprints(70, seed))]
    rows += [("c", 1, signed([5, 0]), 1)]
    return rows, spark.createDataFrame(rows, "dataset string, node bigint, words array<bigint>, weight bigint")


def unsigned(words):
    return [w & ((1 << 64) - 1) for w in words]


def test_self_comparison_on_a_triangular_grid(nodes, monkeypatch):
    rows, df = nodes
    monkeypatch.setattr(blocks, "CELL_BLOCKS", 2)
    got = {(r["dataset"], r["node"]): (r["sum_all"], r["max_all"]) for r in similarity.node_similarity(df, None, ["dataset"], block_rows=5).collect()}
    assert len(got) == len(rows)
    for d, i, w, n in rows:
        others = [(tanimoto(unsigned(w), unsigned(v)), m - (i == j)) for e, j, v, m in rows if e == d]
        best = max((s for s, m in others if m), default=None)
        assert got[d, i][0] == pytest.approx(sum(s * m for s, m in others)) and got[d, i][1] == best, (d, i)


def test_every_pair_of_blocks_is_compared_once(monkeypatch):
    """Four blocks against themselves: ten comparisons, not sixteen."""
    lists = [[[i, i + 9] for i in range(4 * k, 4 * k + 4)] for k in range(4)]
    table = pa.table({
        "dataset": ["a"] * 4, "blk": [0, 1, 2, 3], "side": [0] * 4, "node": [[4 * k + j for j in range(4)] for k in range(4)],
        "weight": [[1] * 4] * 4, "words": [[x for row in part for x in row] for part in lists],
    })
    seen, plain = [], similarity.similarity_matrix
    monkeypatch.setattr(similarity, "similarity_matrix", lambda a, b: seen.append(1) or plain(a, b))
    out = similarity._summarize(True, False, ["dataset"])(table).to_pydict()
    assert len(seen) == 10
    flat = [row for part in lists for row in part]
    sums = {}
    for node, s in zip(out["node"], out["sum_all"]):
        sums[node] = sums.get(node, 0) + s
    assert sums == pytest.approx({i: sum(tanimoto(flat[i], flat[j]) for j in range(16) if j != i) for i in range(16)})


@pytest.mark.parametrize("block_rows,cell_blocks", [(3, 2), (1024, 32)])
def test_best_first_equals_all_pairs(spark, nodes, block_rows, cell_blocks):
    rows, df = nodes
    queries, references = df.where("node % 3 = 0"), df.where("node % 3 <> 0 AND dataset <> 'c'")
    got = {(r["dataset"], r["node"]): (r["best"], r["compared"]) for r in similarity.best_similarity(queries, references, ["dataset"], block_rows, cell_blocks).collect()}
    want = {(d, i): max(tanimoto(unsigned(w), unsigned(v)) for e, j, v, _ in rows if e == d and j % 3) for d, i, w, _ in rows if i % 3 == 0}
    assert {k: v[0] for k, v in got.items()} == want
    if block_rows == 3:
        assert sum(v[1] for v in got.values()) < 0.7 * len(want) * 47


def test_threshold_join_lists_each_pair_once(nodes):
    rows, df = nodes
    got = sorted((r["dataset"], r["node_a"], r["node_b"]) for r in similarity.similar_nodes(df, ["dataset"], 0.5, 4).collect())
    want = sorted((d, i, j) for d, i, w, _ in rows for e, j, v, _ in rows if d == e and i < j and tanimoto(unsigned(w), unsigned(v)) >= 0.5)
    assert got == want and got


def test_a_bound_is_never_too_low():
    rng = np.random.default_rng(3)
    words = rng.integers(0, 1 << 62, (200, 2), dtype=np.uint64) & rng.integers(0, 1 << 62, (200, 2), dtype=np.uint64)
    words[:5] = 0
    bits = np.bitwise_count(words).sum(1, dtype=np.int64)
    sim = blocks.similarity_matrix(words, words)
    for low, high in ((0, 0), (0, 20), (10, 30), (40, 60)):
        inside = (bits >= low) & (bits <= high)
        if inside.any():
            assert (sim[:, inside].max(1) <= blocks.bound(bits, low, high) + 1e-12).all()
