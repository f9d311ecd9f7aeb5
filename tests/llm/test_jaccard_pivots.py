import collections
import random
import re

import numpy as np
import pyarrow as pa

from foldwise.llm import jaccard_pivots as jac

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows):
    """(doc_id, n_shingles, component_id) by comparing all pairs that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    holders, common = collections.defaultdict(list), collections.Counter()
    for i, (own, (doc_id, _)) in enumerate(zip(sets, rows)):
        for s in own if doc_id is not None else ():
            for j in holders[s]:
                common[j, i] += 1
            holders[s].append(i)
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (a, b), c in common.items():
        if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c):
            a, b = root(a), root(b)
            if a != b:
                small, large = sorted((a, b), key=lambda i: rows[i][0])
                parent[large] = small
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted((str(d), len(s), least.get(root(i)) if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets)))


def compared(table):
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in jac.near_duplicate_classes(table).collect())
    assert got == brute([(r["doc_id"], r["text"]) for r in table.select("doc_id", "text").collect()])
    return got


def test_whole_small_table(spark, small):
    compared(spark.read.parquet(f"{small}/documents.parquet"))


def test_families_around_the_threshold(spark):
    """Variants of variants: chains, copies nearer and further than the threshold, a passage in every text."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    passage = [word() for _ in range(60)]
    texts = []
    for family in range(12):
        base = [word() for _ in range(rng.randrange(40, 160))]
        for copy in range(rng.choice((1, 3, 40))):
            own = list(base if rng.random() < 0.7 or not texts else texts[-1])
            for _ in range(rng.randrange(0, 6)):
                own[rng.randrange(len(own))] = word()
            if family % 3 == 0:
                own[10:10] = passage
            texts.append(own)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = compared(spark.createDataFrame(rows, "doc_id long, text string"))
    assert 12 < len({c for _, _, c in got}) < len(rows)


def test_odd_rows(odd, none):
    compared(odd)
    assert jac.near_duplicate_classes(none).count() == 0 and jac.drop_near_copies(none).count() == 0
    kept = jac.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "10", "11", "3", "4", "5", "6", "8", "9", "9", "None"]


def test_shared_counts_do_not_depend_on_batches():
    rng = np.random.default_rng(7)
    for _ in range(200):
        s = np.sort(rng.integers(0, 6, 30))
        node = rng.integers(0, 4, 30)
        want = collections.Counter()
        for value in set(s.tolist()):
            inside = node[s == value].tolist()
            if len(set(inside)) > 1:
                want.update(inside)
        cuts = [0, *sorted(rng.integers(0, 31, 4).tolist()), 30]
        batches = [pa.RecordBatch.from_arrays([pa.array(s[a:b]), pa.array(node[a:b])], ["s", "node"]) for a, b in zip(cuts, cuts[1:])]
        got = collections.Counter()
        for out in jac._shared_counts(iter(batches)):
            for n, c in zip(out.column("node").to_pylist(), out.column("shared").to_pylist()):
                got[n] += c
        assert +got == want
