"""Condition sweep: capacity-limited leader clusters, greedy branches, objective metrics."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalars import SPLITS, split_ratio
from foldwise.operators.blocks import block_pairs, flat_rows, on_cells, open_cell, similarity_matrix
from foldwise.operators.clusters import LEADER_THRESHOLD, batch_size, words_matrix
from foldwise.operators.ranking import ordinal_by, ordinal_within, with_number
from foldwise.operators.similarity import best_similarity, merge_copies
from foldwise.session import cut_lineage

# The five published sweep conditions.
CONDITION_FIELDS = (
    "condition", "priority", "max_cluster_fraction", "w_no_cross", "w_valid_train", "w_test_train", "w_size",
    "train_lower", "valid_lower", "test_lower", "drop_budget",
)
SWEEP_CONDITIONS = (
    ("A_balanced_baseline", "balanced_repair", 0.70, 1.0, 1.0, 1.0, 0.05, 0.80, 0.50, 0.50, 0.05),
    ("B_test_leakage_priority", "test_leakage_priority", 0.70, 1.0, 1.0, 2.0, 0.05, 0.80, 0.50, 0.50, 0.05),
    ("C_distribution_uniformity", "distribution_uniformity_priority", 0.60, 1.0, 1.0, 1.0, 0.10, 0.80, 0.60, 0.60, 0.05),
    ("D_train_support_priority", "train_support_priority", 0.80, 0.5, 1.0, 1.5, 0.03, 0.90, 0.40, 0.40, 0.05),
    ("E_strict_low_leakage", "strict_low_leakage", 0.50, 1.0, 2.0, 2.0, 0.05, 0.80, 0.50, 0.50, 0.05),
)
BATCH_CLUSTERS = 8  # placed in one round; 256 subsets
UNIT = 1_000_000_000


def _scan_with_capacity(keys: Sequence[str], limit: str, threshold: float):
    """First-come scan of a batch: join the first close leader with room, else lead.

    Leaders of earlier batches come first; ``options`` and ``rooms`` hold those close to a row, in order.
    """

    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node").reset_index(drop=True)
        words, node, room = words_matrix(rows["words"]), rows["node"].to_numpy(), int(rows[limit].iloc[0])
        leader = np.empty(len(rows), np.int64)
        before: dict[int, int] = {}  # room left with earlier leaders
        left = np.zeros(len(rows), dtype=np.int64)
        lead: list[int] = []  # leaders of this batch that have room
        for i, (options, rooms) in enumerate(zip(rows["options"], rows["rooms"])):
            earlier = () if options is None else zip(options, rooms)
            taken = next((int(o) for o, r in earlier if before.setdefault(int(o), int(r)) > 0), None)
            if taken is not None:
                before[taken] -= 1
                leader[i] = taken
                continue
            close = similarity_matrix(words[i : i + 1], words[lead])[0] >= threshold if lead else np.zeros(0, bool)
            if close.any():
                first = lead[int(close.argmax())]
                leader[i] = node[first]
            else:
                first, left[i], leader[i] = i, room, node[i]
                lead.append(i)
            left[first] -= 1
            if not left[first]:
                lead.remove(first)
        return rows[[*keys, "node", "words", limit]].assign(leader=leader)

    return scan


def _close_leaders(threshold: float, keys: Sequence[str]):
    """Kernel: the pairs of a row and a leader that are close, with the leader's room."""

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, ["room"])
        out: dict[str, list] = {n: [] for n in ("node", "leader", "room")}
        for a, b, _ in block_pairs(left, right, False, threshold):
            row, column = np.nonzero(similarity_matrix(a.words, b.words) >= threshold)
            out["node"].append(a.node[row])
            out["leader"].append(b.node[column])
            out["room"].append(b.extra["room"][column])
        return flat_rows(table, keys, out, {n: pa.int64() for n in out})

    return run


def capacity_clusters(members: DataFrame, keys: Sequence[str], limit: str, threshold: float = LEADER_THRESHOLD) -> DataFrame:
    """Leader clusters that take their first ``limit`` close members; the rest stays in the pool.

    ``members``: keys, node (unique order), words, limit.  Returns (keys, node,
    leader).  Members are placed in order, a batch per round: the batch is compared with the leaders
    that still have room block by block on the cluster, and one small task per key then places it
    as the sequential scan would.  The number of rounds is the largest key's members by the batch size,
    whatever the limit; leaders stay in a table that drops them once they are full.
    """
    keys = list(keys)
    pool = cut_lineage(members.select(*keys, "node", "words", limit))
    types = dict(pool.dtypes)
    given = ", ".join(f"{k} {types[k]}" for k in keys)
    size = batch_size(pool, keys)
    ranked = cut_lineage(ordinal_within(pool, keys, "node", "_at").withColumn("_round", F.floor(F.col("_at") / size)).drop("_at"))
    last = ranked.agg(F.max("_round")).first()[0]
    if last is None:
        return pool.select(*keys, "node", F.col("node").alias("leader"))
    found: DataFrame | None = None
    open_: DataFrame | None = None
    none = F.lit(None).cast("array<bigint>")
    for number in range(last + 1):
        batch = ranked.where(F.col("_round") == number).drop("_round")
        if open_ is None:
            asked = batch.withColumn("options", none).withColumn("rooms", none)
        else:
            queries = batch.select(*keys, "node", "words", F.lit(1).alias("weight"), F.lit(0).cast("bigint").alias("room"))
            close = on_cells(queries, open_.withColumn("weight", F.lit(1)), keys, _close_leaders(threshold, keys), f"{given}, node bigint, leader bigint, room bigint", ["room"], threshold)
            listed = close.groupBy(*keys, "node").agg(F.array_sort(F.collect_set(F.struct("leader", "room"))).alias("_o"))
            listed = listed.select(*keys, "node", F.col("_o.leader").alias("options"), F.col("_o.room").alias("rooms"))
            asked = batch.join(listed, [*keys, "node"], "left")
        schema = f"{given}, node bigint, words array<bigint>, {limit} {types[limit]}, leader bigint"
        scanned = cut_lineage(asked.groupBy(*keys).applyInPandas(_scan_with_capacity(keys, limit, threshold), schema))
        done = scanned.select(*keys, "node", "leader")
        found = done if found is None else found.unionByName(done)
        if number < last:
            joined = scanned.groupBy(*keys, F.col("leader").alias("node")).agg(F.count(F.lit(1)).alias("_n"))
            led = scanned.where("node = leader").dropDuplicates([*keys, "node"])
            fresh = led.select(*keys, "node", "words", F.col(limit).cast("bigint").alias("room"))
            if open_ is not None:  # a repeated row may carry a leader's number: the leader stays as it is
                fresh = open_.unionByName(fresh.join(open_, [*keys, "node"], "left_anti"))
            room = (F.col("room") - F.coalesce("_n", F.lit(0))).alias("room")
            open_ = cut_lineage(fresh.join(joined, [*keys, "node"], "left").select(*keys, "node", "words", room).where("room > 0"))
    return found


def _billionths(similarity: Column) -> Column:
    """Similarities as whole numbers, so that sums do not depend on the order of addition."""
    return F.round(similarity * UNIT).cast("long")


def _slot_maxima(keys: Sequence[str]):
    """Kernel: per query node its best similarity to the members of every cluster of the batch."""

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, ["slot"])
        nodes, rows = [a.node for a in left], []
        for a in left:
            best = np.zeros((len(a.node), BATCH_CLUSTERS), np.int64)
            for b in right:
                sim, slot = similarity_matrix(a.words, b.words), b.extra["slot"]
                for k in np.unique(slot):
                    best[:, k] = np.maximum(best[:, k], np.rint(sim[:, slot == k].max(1) * UNIT))
            rows.append(best)
        out = flat_rows(table, keys, {"node": nodes}, {"node": pa.int64()})
        best = np.concatenate(rows) if rows else np.zeros((0, BATCH_CLUSTERS), np.int64)
        starts = pa.array(np.arange(0, best.size + 1, BATCH_CLUSTERS), pa.int32())
        return out.append_column("best", pa.ListArray.from_arrays(starts, pa.array(best.ravel())))

    return run


def _subset_sums(keys: Sequence[str]):
    """Kernel: sums over members of the best similarity to a split, for every subset of the batch joining it.

    Members are summed up by the split they are in, or by their cluster of the batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = list(zip(*[batch.column(k).to_pylist() for k in [*keys, "side"]]))
            weight = batch.column("weight").to_numpy()
            joined = batch.column("best").flatten().to_numpy().reshape(batch.num_rows, BATCH_CLUSTERS)
            out: dict[str, list] = {n: [] for n in (*keys, "side", "members", "sums_train", "sums_test")}
            for mine in sorted(set(owner)):
                rows = np.fromiter((o == mine for o in owner), bool, len(owner))
                for name, value in zip((*keys, "side"), mine):
                    out[name].append(value)
                out["members"].append(int(weight[rows].sum()))
                for split in ("train", "test"):
                    total = np.zeros(1 << BATCH_CLUSTERS, np.int64)
                    standing = batch.column(f"best_{split}").to_numpy()[rows]
                    for start in range(0, len(standing), 1024):
                        part = slice(start, start + 1024)
                        table = standing[part][None, :]
                        for k in range(BATCH_CLUSTERS):
                            table = np.concatenate([table, np.maximum(table, joined[rows][part][:, k])])
                        total += table @ weight[rows][part]
                    out[f"sums_{split}"].append(total)
            yield pa.RecordBatch.from_pydict({n: pa.array(v) if n in keys or n == "side" else pa.array(v, pa.int64() if n == "members" else pa.list_(pa.int64())) for n, v in out.items()})

    return run


def _decide(keys: Sequence[str]):
    """Place the clusters of one batch, largest first, from the tables of sums."""

    def decide(rows: pd.DataFrame) -> pd.DataFrame:
        info = rows.iloc[0]
        counts = {s: int(info[f"n_{s}"]) for s in SPLITS}
        sums: dict[tuple[str, str], np.ndarray] = {}
        for side, subset, train, test in zip(rows["side"], rows["subset"], rows["sums_train"], rows["sums_test"]):
            for split, value in (("train", train), ("test", test)):
                sums.setdefault((side, split), np.zeros(1 << BATCH_CLUSTERS, np.int64))[int(subset)] = value
        nothing = np.zeros(1 << BATCH_CLUSTERS, np.int64)
        joined = {"train": 0, "test": 0}
        asked = {"valid": ["valid"], "test": ["test"]}
        picked = []

        def mean_best(query: str, reference: str, trial: str, slot: int) -> float:
            sides = asked[query] + ([str(slot)] if trial == query else [])
            subset = joined[reference] | (1 << slot if trial == reference else 0)
            members = counts[query] + (sizes[slot] if trial == query else 0)
            return int(sum(sums.get((g, reference), nothing)[subset] for g in sides)) / UNIT / members if members else 0.0

        sizes = [int(n) for n in info["sizes"]]
        for slot, size in enumerate(sizes):
            total = sum(counts.values()) + size
            scores = []
            for split in SPLITS:
                uneven = sum(abs((counts[s] + size * (s == split)) / total - info[f"target_{s}"]) for s in SPLITS)
                score = (
                    info["w_no_cross"] * mean_best("valid", "test", split, slot)
                    + info["w_valid_train"] * mean_best("valid", "train", split, slot)
                    + info["w_test_train"] * mean_best("test", "train", split, slot)
                    + info["w_size"] * uneven
                    - (1.0 if counts[split] < info[f"lower_{split}"] else 0.0)
                )
                scores.append(round(score, 9))
            split = SPLITS[scores.index(min(scores))]
            counts[split] += size
            if split in joined:
                joined[split] |= 1 << slot
            if split in asked:
                asked[split].append(str(slot))
            picked.append(split)
        out = {k: [info[k]] for k in keys} | {"picked": [picked]} | {f"n_{s}": [counts[s]] for s in SPLITS}
        return pd.DataFrame(out)

    return decide


def place_clusters(clustered: DataFrame, train: DataFrame, plan: DataFrame, keys: Sequence[str], per: str = "condition") -> DataFrame:
    """(keys, per, leader, node, words, weight, pos, branch, best_train, best_test): every cluster's split.

    ``clustered``: keys, per, leader, pos (0, 1, ... in the order of placement), node, words; ``train``: keys, node and words
    of the members that are in train beforehand; ``plan``: keys, per, weights, targets and lower bounds.

    A cluster goes where the weighted mean best similarities of valid to test, valid to train and test to train, and
    the distance of the sizes from their targets, come out least, over all members.  Every member has a standing
    row with its best similarity to train and to test so far, which only rises.  A round compares
    all members that are not in train with the next BATCH_CLUSTERS clusters of each key, block by block, and sums the
    maxima for every subset of them that may join a split (members add up in the tasks).  From these sums,
    at most 2 x 2^BATCH_CLUSTERS for each of BATCH_CLUSTERS + 2 sides, one small task per key places the batch exactly as one by one.
    """
    keys, wide = list(keys), [*keys, per]
    merged = clustered.groupBy(*wide, "leader", "pos", "words").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("weight"))
    nodes = cut_lineage(merged)
    asked = merge_copies(clustered, keys, "node")
    nearest = best_similarity(asked, merge_copies(train, keys, "node"), keys).select(*keys, "node", _billionths(F.col("best")).alias("best_train"))
    nearest = asked.join(nearest, [*keys, "node"]).select(*keys, "words", "best_train")
    standing = nodes.join(nearest, [*keys, "words"], "left").select(
        *wide, "node", "weight", "pos", F.lit(None).cast("string").alias("branch"),
        F.coalesce("best_train", F.lit(0)).alias("best_train"), F.lit(0).cast("long").alias("best_test"),
    )
    standing = cut_lineage(standing)
    counts = cut_lineage(plan.select(*wide, *[F.lit(0).cast("long").alias(f"n_{s}") for s in SPLITS]))
    sizes = nodes.groupBy(*wide, "pos").agg(F.sum("weight").alias("size"))
    last = nodes.agg(F.max("pos")).first()[0]
    types = dict(nodes.dtypes)
    given = ", ".join(f"{k} {types[k]}" for k in wide)
    weights = plan.select(*wide, "w_no_cross", "w_valid_train", "w_test_train", "w_size", *[f"{n}_{s}" for n in ("target", "lower") for s in SPLITS])
    for low in range(0, -1 if last is None else last + 1, BATCH_CLUSTERS):
        slot = F.col("pos") - low
        here = slot.between(0, BATCH_CLUSTERS - 1)
        words = nodes.select(*wide, "node", "words")
        asked = standing.where("branch IS NULL OR branch <> 'train'").select(*wide, "node", "weight", slot.cast("long").alias("slot"))
        queries = asked.join(words, [*wide, "node"])
        batch = nodes.where(here).select(*wide, "node", "weight", slot.cast("long").alias("slot"), "words")
        best = on_cells(queries, batch, wide, _slot_maxima(wide), f"{given}, node bigint, best array<bigint>", ["slot"])
        best = best.groupBy(*wide, "node").agg(F.array(*[F.max(F.get("best", F.lit(k))) for k in range(BATCH_CLUSTERS)]).alias("best"))
        seen = cut_lineage(standing.join(best, [*wide, "node"], "left"))
        side = F.when(here, slot.cast("string")).otherwise(F.when(F.col("branch") != "train", F.col("branch")))
        counted = seen.withColumn("side", side).where("side IS NOT NULL AND best IS NOT NULL")
        partial = counted.select(*wide, "side", "weight", "best", "best_train", "best_test").mapInArrow(
            _subset_sums(wide), f"{given}, side string, members bigint, sums_train array<bigint>, sums_test array<bigint>"
        )
        opened = partial.select(*wide, "side", F.posexplode(F.arrays_zip("sums_train", "sums_test")).alias("subset", "_s"))
        table = opened.groupBy(*wide, "side", "subset").agg(F.sum("_s.sums_train").alias("sums_train"), F.sum("_s.sums_test").alias("sums_test"))
        now = sizes.where(here).groupBy(*wide).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "size"))), lambda e: e["size"]).alias("sizes"))
        info = weights.join(counts, wide).join(now, wide)
        schema = ", ".join([given, "picked array<string>", *(f"n_{s} bigint" for s in SPLITS)])
        picked = cut_lineage(table.join(info, wide).groupBy(*wide).applyInPandas(_decide(wide), schema))
        of_slot = F.when(here, F.get("picked", slot.cast("int")))

        def risen(split: str) -> Column:
            joins = [F.when(F.get("picked", F.lit(k)) == split, F.get("best", F.lit(k))) for k in range(BATCH_CLUSTERS)]
            return F.greatest(f"best_{split}", *joins).alias(f"best_{split}")

        standing = cut_lineage(
            seen.join(picked.select(*wide, "picked"), wide, "left").select(
                *wide, "node", "weight", "pos", F.coalesce("branch", of_slot).alias("branch"), risen("train"), risen("test")
            )
        )
        kept = counts.join(picked.select(*wide), wide, "left_anti")
        counts = cut_lineage(kept.unionByName(picked.select(*counts.columns)))
    return standing.join(nodes.select(*wide, "leader", "node", "words"), [*wide, "node"])


def condition_sweep(members: DataFrame, keys: Sequence[str], order: str, split: str = "split", is_empty: str = "is_empty") -> DataFrame:
    """Objective metrics of every (dataset, condition).

    ``members`` carries the raw split of each member, NULL where the archived
    split does not contain it.  Conditions are rows, so all of them run together.
    """
    keys = list(keys)
    if dict(members.dtypes)[order] == "string":
        members, order = cut_lineage(with_number(members, order, "_number")), "_number"
    wide = [*keys, "condition"]
    spark = members.sparkSession
    sizes = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(is_empty).cast("long")).alias("n_no_scaffold")
    )
    # Five fixed conditions per dataset row.
    plan = sizes.withColumn("_c", F.explode(F.array(*[_condition_struct(c) for c in SWEEP_CONDITIONS]))).select("*", "_c.*").drop("_c")
    for s in SPLITS:
        plan = plan.withColumn(f"target_{s}", split_ratio("_n", s))
        wanted = F.greatest(F.lit(1), F.floor(F.col("n_no_scaffold") * F.col(f"target_{s}")))
        plan = plan.withColumn(f"_want_{s}", wanted).withColumn(f"lower_{s}", F.floor(wanted * F.col(f"{s}_lower")))
    smallest = F.least(*[F.col(f"_want_{s}") for s in SPLITS])
    plan = cut_lineage(plan.withColumn("limit", F.greatest(F.lit(1), F.ceil(F.col("max_cluster_fraction") * smallest)).cast("long")))
    empty = members.where(F.col(is_empty)).select(*keys, F.col(order).alias("node"), "words")
    pool = empty.join(plan.select(*wide, "limit"), keys)
    clustered = cut_lineage(capacity_clusters(pool, wide, "limit").join(pool.drop("limit"), [*wide, "node"]))
    table = clustered.groupBy(*wide, "leader").agg(F.count(F.lit(1)).alias("cluster_size"))
    table = ordinal_by(table, wide, "cluster_size", "leader", descending=True, name="pos")
    bearing = members.where(~F.col(is_empty) & (F.col(split) == "train")).select(*keys, F.col(order).alias("node"), "words")
    placed = cut_lineage(place_clusters(clustered.join(table.select(*wide, "leader", "pos"), [*wide, "leader"]), bearing, plan, keys))
    moved = placed.select(*wide, "branch", F.lit(True).alias("empty"), F.col("weight").alias("n"))
    kept = (
        members.where(~F.col(is_empty) & F.col(split).isNotNull())
        .groupBy(*keys, F.col(split).alias("branch"))
        .agg(F.count(F.lit(1)).alias("n"))
        .join(plan.select(*wide), keys)
        .select(*wide, "branch", F.lit(False).alias("empty"), "n")
    )
    final = moved.unionByName(kept)
    of = [
        F.try_divide(F.sum(F.when((F.col("branch") == s) & c, F.col("n"))), F.sum(F.when(F.col("branch") == s, F.col("n")))).alias(f"{s}_proportion")
        for s in SPLITS
        for c in [F.col("empty")]
    ]
    audit = final.groupBy(*wide).agg(*[F.when(F.sum(F.when(F.col("branch") == s, F.col("n"))) > 0, F.coalesce(c, F.lit(0.0))).alias(f"{s}_proportion") for s, c in zip(SPLITS, of)])
    best = [F.sum(F.when(F.col("branch") == s, F.col("weight") * F.col("best_train"))) / UNIT for s in ("valid", "test")]
    asked = [F.sum(F.when(F.col("branch") == s, F.col("weight"))) for s in ("valid", "test")]
    samples = placed.groupBy(*wide).agg(
        *[F.coalesce(F.try_divide(b, a), F.lit(0.0)).alias(f"{s}_train_similarity") for s, b, a in zip(("valid", "test"), best, asked)]
    )
    out = (
        plan.join(table.groupBy(*wide).agg(F.count(F.lit(1)).alias("n_microclusters")), wide, "left")
        .join(audit, wide, "left")
        .join(samples, wide, "left")
    )
    whole = F.try_divide("n_no_scaffold", "_n")
    any_empty = F.col("n_no_scaffold") > 0
    gaps = F.greatest(*[F.abs(F.col(f"{s}_proportion") - F.col("full_no_scaffold_proportion")) for s in SPLITS])
    out = (
        out.withColumn("full_no_scaffold_proportion", F.when(any_empty, whole))
        .withColumn("support_recovery", F.try_divide("train_proportion", "full_no_scaffold_proportion"))
        .withColumn("sink_ratio", F.try_divide(F.greatest("valid_proportion", "test_proportion"), "train_proportion"))
        .withColumn("max_eval_train_similarity", F.greatest("valid_train_similarity", "test_train_similarity"))
        .withColumn("distribution_gap", gaps)
    )
    score = F.abs(F.col("support_recovery") - 1.0) + F.col("sink_ratio") + F.col("distribution_gap") + F.col("max_eval_train_similarity")
    return out.select(
        *wide,
        "priority",
        "n_no_scaffold",
        "n_microclusters",
        "full_no_scaffold_proportion",
        *[F.col(f"{s}_proportion").alias(f"{s}_no_scaffold_proportion") for s in SPLITS],
        "support_recovery",
        "sink_ratio",
        *[F.when(any_empty, F.col(f"{c}")).alias(c) for c in ("valid_train_similarity", "test_train_similarity", "max_eval_train_similarity")],
        "distribution_gap",
        F.when(any_empty, score).alias("score"),
    )


def _condition_struct(values: tuple):
    return F.struct(*[F.lit(v).alias(n) for n, v in zip(CONDITION_FIELDS, values)])
