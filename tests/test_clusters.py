"""Leader clusters, repair and sweep against plain sequential re-derivations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.operators import clusters, repair, similarity, sweep

DATASETS = ("a", "b")


def tanimoto(x, y):
    union = bin(x | y).count("1")
    return bin(x & y).count("1") / union if union else 1.0


def make_rows(seed=3, n=90):
    """Noisy copies of a few centres, with exact copies, per dataset."""
    rng = np.random.default_rng(seed)
    rows = []
    for dataset in DATASETS:
        centres = [int(rng.integers(0, 1 << 40)) & int(rng.integers(0, 1 << 40)) for _ in range(6)]
        for i in range(n):
            if i % 3 == 0:
                word = centres[0]  # a third of all members are copies
            else:
                word = centres[int(rng.integers(0, 6))] ^ (1 << int(rng.integers(0, 40))) ^ (1 << int(rng.integers(0, 40)))
            rows.append((dataset, i + 1, [word]))
    return rows


@pytest.fixture(scope="module")
def rows():
    return make_rows()


@pytest.fixture(scope="module")
def members(spark, rows):
    return spark.createDataFrame(rows, "dataset string, node bigint, words array<bigint>")


def words_of(rows, dataset):
    return {i: w[0] for d, i, w in rows if d == dataset}


def scan(words, ids, t=0.4):
    leaders = []
    for i in ids:
        if all(tanimoto(words[i], words[k]) < t for k in leaders):
            leaders.append(i)
    return leaders


def nearest(words, ids, leaders):
    return {i: max(leaders, key=lambda k: (tanimoto(words[i], words[k]), -k)) for i in ids}


def regroup(assigned):
    groups = {}
    for i in sorted(assigned):
        groups.setdefault(assigned[i], []).append(i)
    return [groups[k] for k in sorted(groups)]


def chunks(words, ids, size):
    order = sorted(ids, key=lambda i: (-tanimoto(words[i], words[ids[0]]), i))
    return [order[s : s + size] for s in range(0, len(order), size)]


def small_clusters(words, ids, limit):
    out = []
    for cluster in regroup(nearest(words, ids, scan(words, ids))):
        if len(cluster) <= limit:
            out.append(cluster)
            continue
        for sub in regroup(nearest(words, cluster, scan(words, cluster))):
            out.extend([sub] if len(sub) <= limit else chunks(words, sub, limit))
    return sorted(out, key=lambda c: (-len(c), c[0]))


@pytest.mark.parametrize("batch", [4096, 12])
def test_leaders_equal_sequential_scan(monkeypatch, members, rows, batch):
    monkeypatch.setattr(clusters, "LARGEST_BATCH", batch)
    nodes = similarity.merge_copies(members, ["dataset"], "node")
    got = {(r["dataset"], r["node"]) for r in clusters.pick_leaders(nodes, ["dataset"]).collect()}
    want = set()
    for d in DATASETS:
        words = words_of(rows, d)
        want |= {(d, i) for i in scan(words, sorted(words))}
    assert got == want


@pytest.mark.parametrize("limit", [7, 200])
def test_microclusters(members, rows, limit):
    got = clusters.microclusters(members.withColumn("limit", F.lit(limit)), ["dataset"], "node", "limit").collect()
    for d in DATASETS:
        words = words_of(rows, d)
        want = {i: n for n, c in enumerate(small_clusters(words, sorted(words), limit), 1) for i in c}
        assert {r["node"]: r["cluster_no"] for r in got if r["dataset"] == d} == want


def with_capacity(words, ids, limit, t=0.4):
    pool, out = list(ids), []
    while pool:
        taken = [i for i in pool if tanimoto(words[i], words[pool[0]]) >= t][:limit]
        out.append(taken)
        pool = [i for i in pool if i not in taken]
    return out


@pytest.mark.parametrize("batch,limit", [(4096, 5), (8, 5)])
def test_capacity_clusters(monkeypatch, members, rows, batch, limit):
    monkeypatch.setattr(clusters, "LARGEST_BATCH", batch)
    small = members.where(F.col("node") <= 45).withColumn("limit", F.lit(limit).cast("long"))
    got = sweep.capacity_clusters(small, ["dataset"], "limit").collect()
    for d in DATASETS:
        words = {i: w for i, w in words_of(rows, d).items() if i <= 45}
        want = {i: c[0] for c in with_capacity(words, sorted(words), limit) for i in c}
        assert {r["node"]: r["leader"] for r in got if r["dataset"] == d} == want


def mean_sim(words, a, b):
    return float(np.mean([[tanimoto(words[i], words[j]) for j in b] for i in a]))


def brute_repair(words, empty, raw, cond):
    """One long loop over all clusters with the full similarity table."""
    n_all, n = len(raw), len(empty)
    slots = (3, 1, 1) if n_all <= 1000 else (5, 1, 1) if n_all <= 3000 else (8, 1, 1)
    names = ("train", "valid", "test")
    shares = [s / sum(slots) * n for s in slots]
    target = [math.floor(round(x, 9)) for x in shares]
    for i in sorted(range(3), key=lambda i: (-round(shares[i] - target[i], 9), i))[: n - sum(target)]:
        target[i] += 1
    fractions = (cond.lower_train, cond.lower_valid, cond.lower_test)
    lower = [max(1, math.floor(t * f)) if t else 0 for t, f in zip(target, fractions)]
    budget = math.floor(n * cond.drop_budget)
    limit = max(1, math.floor(min(t for t in target if t) * cond.max_cluster_to_smallest_target))
    groups = small_clusters(words, [i for i in empty if words[i] is not None], limit)
    groups += [[i] for i in empty if words[i] is None]
    train = [i for i in raw if i not in empty and raw[i] == "train" and words[i] is not None]
    known = [words[g[0]] is not None for g in groups]
    picked = groups
    const = [
        round(mean_sim(words, p, train) * len(g) * len(train), 9) if ok and train else 0.0
        for g, p, ok in zip(groups, picked, known)
    ]
    pair = [
        [mean_sim(words, p, q) * len(g) * len(h) if a and b else 0.0 for h, q, b in zip(groups, picked, known)]
        for g, p, a in zip(groups, picked, known)
    ]
    order = sorted(range(len(groups)), key=lambda i: (-len(groups[i]), -const[i], i))
    count, dropped, where = [0, 0, 0], 0, {}
    weight = {(0, 1): cond.lambda_internal + cond.lambda_valid, (0, 2): cond.lambda_internal + cond.lambda_test, (1, 2): cond.lambda_internal}
    for at, g in enumerate(order):
        size = len(groups[g])
        rest = sum(len(groups[i]) for i in order[at + 1 :])
        best = None
        options = []
        for o in (0, 1, 2, 3):
            after = [c + (size if i == o else 0) for i, c in enumerate(count)]
            cost = cond.lambda_drop * size if o == 3 else (0, cond.lambda_valid, cond.lambda_test)[o] * const[g]
            for other, s in where.items():
                if o != 3 and s != 3 and s != o:
                    cost += weight[tuple(sorted((o, s)))] * pair[g][other]
            cost += cond.lambda_imbalance * sum(
                3 * max(0, a - t) / max(t, 1) + abs(a - t) / max(t, 1) for a, t in zip(after, target)
            )
            gap = [max(0, lo - a) for lo, a in zip(lower, after)]
            ok = sum(gap) <= rest and dropped + (size if o == 3 else 0) <= budget
            full = cost + 2 * sum(gap) / n + (10 * sum(x > 0 for x in gap) if o == 3 else 0)
            options.append((ok, full, cost))
            if ok and (best is None or full < options[best][1] - 1e-12):
                best = o
            elif ok and o != 3 and abs(full - options[best][1]) <= 1e-12 and count[o] < count[best]:
                best = o
        if best is None:
            best = min(range(4), key=lambda o: options[o][2])
        where[g] = best
        if best == 3:
            dropped += size
        else:
            count[best] += size
    queue = sorted((g for g in order if where[g] == 0), key=lambda g: (len(groups[g]), const[g]))
    for need in (0, 1, 2):
        while count[need] < lower[need] and queue:
            g = queue.pop(0)
            if count[0] - len(groups[g]) >= lower[0]:
                where[g] = need
                count[0] -= len(groups[g])
                count[need] += len(groups[g])
    return {i: (*names, "drop")[where[g]] for g in range(len(groups)) for i in groups[g]}, const


@pytest.mark.parametrize("name,batch", [("A_balanced_baseline", 256), ("D_train_support_priority", 16)])
def test_repair_equals_one_long_loop(spark, monkeypatch, rows, name, batch):
    monkeypatch.setattr(repair, "BATCH", batch)
    table = []
    for d, i, w in rows:
        empty = i % 2 == 1 or i > 80
        raw = "train" if (i % 10 < (2 if empty else 8)) else ("valid" if i % 3 else "test")
        table.append((d, i, None if i in (11, 33) else w, empty, raw))
    df = spark.createDataFrame(table, "dataset string, node bigint, words array<bigint>, is_empty boolean, split string")
    audit, summary = repair.repair_split(df, ["dataset"], "node", name)
    got = audit.collect()
    for d in DATASETS:
        mine = [t for t in table if t[0] == d]
        words = {i: (w[0] if w else None) for _, i, w, _, _ in mine}
        empty = [i for _, i, _, e, _ in mine if e]
        raw = {i: s for _, i, _, _, s in mine}
        want, const = brute_repair(words, empty, raw, repair.CONDITIONS[name])
        assert {r["node"]: r["Split"] for r in got if r["dataset"] == d and r["is_empty"]} == want
        assert all(r["Split"] == r["RawSplit"] for r in got if r["dataset"] == d and not r["is_empty"])
        rows_ = [r for r in summary.collect() if r["dataset"] == d]
        assert sorted(r["const_to_sb_train"] for r in rows_) == pytest.approx(sorted(const), abs=1e-6)
        assert sum(r["is_invalid_fp_group"] for r in rows_) == 2


def test_unknown_condition(members):
    with pytest.raises(ValueError):
        repair.repair_split(members, ["dataset"], "node", "none")


def best_mean(words, query, reference):
    """Mean over all queries of the best similarity to all references, in billionths as the operator counts."""
    best = [max((round(tanimoto(words[i], words[j]) * 1e9) for j in reference), default=0) for i in query]
    return sum(best) / 1e9 / len(best) if best else 0.0


def brute_sweep(words, empty, raw, cond):
    c = dict(zip(sweep.CONDITION_FIELDS, cond))
    names = ("train", "valid", "test")
    n, ids = len(raw), sorted(raw)
    share = dict(zip(names, (0.6, 0.2, 0.2)))
    want = {s: max(1, math.floor(len(empty) * share[s])) for s in names}
    lower = {s: math.floor(want[s] * c[f"{s}_lower"]) for s in names}
    limit = max(1, math.ceil(c["max_cluster_fraction"] * min(want.values())))
    groups = sorted(with_capacity(words, empty, limit), key=len, reverse=True)
    back = [i for i in ids if i not in empty and raw[i] == "train"]
    placed = {s: [] for s in names}
    for g in groups:
        scores = []
        for s in names:
            trial = {b: placed[b] + (g if b == s else []) for b in names}
            total = sum(map(len, trial.values()))
            train = back + trial["train"]
            score = c["w_no_cross"] * best_mean(words, trial["valid"], trial["test"])
            score += c["w_valid_train"] * best_mean(words, trial["valid"], train)
            score += c["w_test_train"] * best_mean(words, trial["test"], train)
            score += c["w_size"] * sum(abs(len(trial[b]) / total - share[b]) for b in names)
            scores.append(round(score - (len(placed[s]) < lower[s]), 9))
        placed[names[scores.index(min(scores))]] += g
    side = {s: sorted([i for i in ids if i not in empty and raw[i] == s] + placed[s]) for s in names}
    full = len(empty) / n
    prop = {s: sum(i in empty for i in side[s]) / len(side[s]) for s in names}
    sims = {s: best_mean(words, [i for i in side[s] if i in empty], side["train"]) for s in names[1:]}
    recovery, sink = prop["train"] / full, max(prop["valid"], prop["test"]) / prop["train"]
    gap = max(abs(p - full) for p in prop.values())
    return len(groups), recovery, sink, gap, abs(recovery - 1) + sink + gap + max(sims.values())


@pytest.mark.parametrize("batch", [8, 3])
def test_condition_sweep(spark, monkeypatch, batch):
    """Two datasets of 200 members under five conditions against one plain loop over all members."""
    monkeypatch.setattr(sweep, "BATCH_CLUSTERS", batch)
    rows = make_rows(seed=7, n=200)
    table = [(d, i, w, i % 2 == 1, "train" if i % 10 < 7 else ("valid" if i % 3 else "test")) for d, i, w in rows]
    df = spark.createDataFrame(table, "dataset string, node bigint, words array<bigint>, is_empty boolean, split string")
    got = {(r["dataset"], r["condition"]): r for r in sweep.condition_sweep(df, ["dataset"], "node").collect()}
    assert len(got) == 10
    for d in DATASETS:
        words = words_of(rows, d)
        empty = [t[1] for t in table if t[0] == d and t[3]]
        raw = {t[1]: t[4] for t in table if t[0] == d}
        for cond in sweep.SWEEP_CONDITIONS:
            r = got[(d, cond[0])]
            want = brute_sweep(words, empty, raw, cond)
            mine = (r["n_microclusters"], r["support_recovery"], r["sink_ratio"], r["distribution_gap"], r["score"])
            assert mine == pytest.approx(want, abs=1e-9)


def test_full_leaders_cost_no_rounds(spark, monkeypatch):
    """Members that full leaders turn away are placed by the round of their batch: checkpoints do not follow the number of leaders tried."""
    same = spark.createDataFrame([("a", i, [255], 2) for i in range(40)], "dataset string, node bigint, words array<bigint>, limit bigint")
    monkeypatch.setattr(clusters, "LARGEST_BATCH", 20)
    cuts, plain = [], sweep.cut_lineage
    monkeypatch.setattr(sweep, "cut_lineage", lambda df: cuts.append(1) or plain(df))
    far = spark.createDataFrame([("a", -1 - i, [1 << (8 + i)], 2) for i in range(19)], same.schema)
    near = spark.createDataFrame([("a", -100 - i, [255 + (1 << (30 + i)) - (1 << i)], 2) for i in range(8)], same.schema)
    table = same.unionByName(far).unionByName(near)
    got = {r["node"]: r["leader"] for r in sweep.capacity_clusters(table, ["dataset"], "limit").collect()}
    words = {r["node"]: r["words"][0] for r in table.collect()}
    assert got == {i: c[0] for c in with_capacity(words, sorted(words), 2) for i in c}
    assert len(cuts) <= 2 + 2 * 4  # 67 members in four batches
