import numpy as np
import pyarrow as pa

from foldwise.operators import clusters, similarity


class Shared:
    def __init__(self, value):
        self.value = value


def test_rows_meet_leaders_a_slice_at_a_time(monkeypatch):
    """A batch of rows times all leaders is never one matrix."""
    rng = np.random.default_rng(1)
    words, leaders = (rng.integers(0, 1 << 62, (n, 2)).astype(np.uint64) for n in (500, 40))
    batch = pa.RecordBatch.from_arrays([pa.array(["a"] * 500), pa.array(range(500)), pa.array(words.view(np.int64).tolist())], ["key", "node", "words"])
    plain, sizes = clusters.similarity_matrix, []
    want = plain(words, leaders).max(1) < 0.4
    monkeypatch.setattr(clusters, "CELLS", 1000, raising=False)
    monkeypatch.setattr(clusters, "similarity_matrix", lambda a, b: sizes.append(len(a) * len(b)) or plain(a, b))
    kept = list(clusters._keep_uncovered(Shared({("a",): leaders}), 0.4, True, ["key"])(iter([batch])))
    assert kept[0].column("node").to_pylist() == np.flatnonzero(want).tolist()
    assert max(sizes) <= 1000


def cell(groups, blocks, rows):
    rng = np.random.default_rng(2)
    out = {n: [] for n in ("key", "side", "blk", "node", "weight", "words", "grp")}
    for side in (0, 1):
        for blk in range(blocks):
            for name, value in (("key", "a"), ("side", side), ("blk", blk), ("node", list(range(rows))), ("weight", [1] * rows), ("words", rng.integers(0, 1 << 62, rows).tolist()), ("grp", [i % groups for i in range(rows)])):
                out[name].append(value)
    return pa.table(out)


def test_sums_of_equal_groups_are_added_inside_a_cell(monkeypatch):
    """A cell gives a row per pair of groups, not one more for every pair of blocks."""
    table = cell(groups=6, blocks=5, rows=24)
    monkeypatch.setattr(similarity, "HELD_SUMS", 50, raising=False)
    got = similarity._group_sums(["key"])(table).to_pylist()
    assert len(got) == 36
    sides = [[(w, g) for s, ws, gs in zip(table["side"].to_pylist(), table["words"].to_pylist(), table["grp"].to_pylist()) if s == side for w, g in zip(ws, gs)] for side in (0, 1)]
    want = dict.fromkeys(((r["q_grp"], r["r_grp"]) for r in got), 0)
    for w, g in sides[0]:
        for v, h in sides[1]:
            want[g, h] += round(1e9 * (w & v).bit_count() / (w | v).bit_count())
    assert {(r["q_grp"], r["r_grp"]): round(r["total"] * 1e9) for r in got} == want


def test_sums_that_a_double_cannot_hold_stay_apart():
    large = float(similarity.EXACT - 2)
    out = similarity.added_sums({"q_grp": [np.array([1, 1, 2, 2])], "r_grp": [np.array([1, 1, 1, 1])], "total": [np.array([large, 5.0, 1.0, 2.0])]})
    assert sorted(zip(*(out[n][0].tolist() for n in ("q_grp", "r_grp", "total")))) == [(1, 1, 5.0), (1, 1, large), (2, 1, 3.0)]


def test_close_pairs_leave_a_cell_in_parts(monkeypatch):
    """Close pairs are given away per pair of blocks, in batches of a fixed size, whatever their number."""
    table = cell(groups=1, blocks=3, rows=20)
    distinct = [[1000 * i + n for n in ns] for i, ns in enumerate(table["node"].to_pylist())]
    table = table.set_column(table.column_names.index("node"), "node", pa.array(distinct))
    monkeypatch.setattr(similarity, "HELD_MATCHES", 50, raising=False)
    found = similarity._match(0.3, ["key"])(iter(table.to_batches(max_chunksize=2)))
    batches, seen = [], []
    plain = similarity.similarity_matrix
    monkeypatch.setattr(similarity, "similarity_matrix", lambda a, b: seen.append(1) or plain(a, b))
    batches.append(next(found))
    assert len(seen) == 1  # the first batch comes before the other pairs of blocks are compared
    batches += found
    assert len(seen) == 9 and max(b.num_rows for b in batches) <= 50
    sides = [[(n, w) for s, ns, ws in zip(table["side"].to_pylist(), table["node"].to_pylist(), table["words"].to_pylist()) if s == side for n, w in zip(ns, ws)] for side in (0, 1)]
    want = sorted((min(n, m), max(n, m)) for n, w in sides[0] for m, v in sides[1] if (w & v).bit_count() / (w | v).bit_count() >= 0.3)
    assert len(want) > 450 and sorted((r["node_a"], r["node_b"]) for b in batches for r in b.to_pylist()) == want
