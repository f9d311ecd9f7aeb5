"""Re-allocation of empty-group members: coupled greedy assignment of microclusters.

Bearing members keep their split.  Empty-group members are clustered, and the
clusters are assigned, largest first, to train, valid, test or drop.  Each choice
depends on all earlier ones, but only through sums of similarities per split and
through the split sizes.  So clusters are decided in batches: a parallel job sums
the similarities of a batch to everything assigned before it, and a small loop
decides the batch.  The outcome equals that of one long loop.  All similarities are sums
over all members: nothing is sampled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalars import SPLITS, max_cluster_size, split_ratio, target_counts, zero_filled
from foldwise.operators.clusters import microclusters
from foldwise.operators.ranking import ordinal_by, ordinal_within, running_totals, with_number
from foldwise.operators.similarity import group_similarity
from foldwise.session import cut_lineage


@dataclass(frozen=True)
class RepairCondition:
    name: str
    max_cluster_to_smallest_target: float
    lambda_internal: float
    lambda_valid: float
    lambda_test: float
    lambda_imbalance: float
    lambda_drop: float
    lower_train: float
    lower_valid: float
    lower_test: float
    drop_budget: float


# The two published repair conditions.
CONDITIONS = {
    c.name: c
    for c in (
        RepairCondition("A_balanced_baseline", 0.70, 1.0, 1.0, 1.0, 0.05, 2.0, 0.80, 0.50, 0.50, 0.05),
        RepairCondition("D_train_support_priority", 0.80, 0.5, 1.0, 1.5, 0.03, 2.0, 0.90, 0.40, 0.40, 0.05),
    )
}
BATCH = 256
# The choices add up whole billionths, as integers of any size, so the order of addition does not matter.
UNIT = 1_000_000_000


def _lower_bound(target: Column, fraction: float) -> Column:
    return F.when(target > 0, F.greatest(F.lit(1), F.floor(target * fraction))).otherwise(F.lit(0)).cast("long")


def assignment_targets(members: DataFrame, keys: Sequence[str], condition: RepairCondition, is_empty: str = "is_empty") -> DataFrame:
    """Per dataset: target counts, lower bounds, drop budget and the cluster size limit."""
    n = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.sum(F.col(is_empty).cast("long")).alias("n_empty")
    )
    ratios = [split_ratio("_all", s) for s in SPLITS]
    n = n.withColumn("target", target_counts("n_empty", ratios))
    lower = F.struct(*[_lower_bound(F.col("target")[s], getattr(condition, f"lower_{s}")).alias(s) for s in SPLITS])
    return n.select(
        *keys,
        "n_empty",
        "target",
        lower.alias("lower"),
        F.floor(F.col("n_empty") * condition.drop_budget).cast("long").alias("drop_budget"),
        max_cluster_size(F.col("target"), condition.max_cluster_to_smallest_target).alias("limit"),
    )


def train_similarity(clusters: DataFrame, members: DataFrame, train: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Clusters with the sum of their members' similarities to all bearing train members."""
    keys = list(keys)
    asked = members.select(*keys, order, "words", F.col("cluster_no").alias("grp"))
    reference = train.select(*keys, order, "words", F.lit(0).cast("bigint").alias("grp"))
    sums = group_similarity(asked, reference, keys, order).select(*keys, F.col("q_grp").alias("cluster_no"), "total")
    out = clusters.join(sums, [*keys, "cluster_no"], "left")
    return out.withColumn("const_to_sb_train", F.coalesce(F.col("total").cast("double"), F.lit(0.0))).drop("total")


def _decide(condition: Mapping[str, float], keys: Sequence[str]):
    """Sequential choice for one batch of one dataset."""
    c = condition
    couple = {
        frozenset(("train", "valid")): c["lambda_internal"] + c["lambda_valid"],
        frozenset(("train", "test")): c["lambda_internal"] + c["lambda_test"],
        frozenset(("valid", "test")): c["lambda_internal"],
    }
    to_train = {"train": 0.0, "valid": c["lambda_valid"], "test": c["lambda_test"]}

    def decide(batch: pd.DataFrame) -> pd.DataFrame:
        batch = batch.sort_values("pos").reset_index(drop=True)
        head = batch.iloc[0]
        target, lower = ({s: int(head[f"{p}_{s}"]) for s in SPLITS} for p in ("target", "lower"))
        counts = {s: int(head[f"count_{s}"]) for s in SPLITS}
        dropped, budget, n_empty = int(head["count_drop"]), int(head["drop_budget"]), int(head["n_empty"])
        near = {s: [int(x * UNIT) for x in batch[f"near_{s}"]] for s in SPLITS}
        sims = [{} if x is None else {e["r_grp"]: int(e["total"] * UNIT) for e in x} for x in batch["sims"]]
        first = int(head["pos"])
        choices = []
        for i, size in enumerate(batch["cluster_size"].astype(int)):
            rest = int(batch["remaining"].iloc[i])
            scores = {}
            for option in (*SPLITS, "drop"):
                after = dict(counts)
                if option == "drop":
                    cost = c["lambda_drop"] * size
                else:
                    after[option] += size
                    cost = to_train[option] * float(batch["const_to_sb_train"].iloc[i])
                    cost += sum(
                        couple[frozenset((option, s))] * near[s][i] / UNIT for s in SPLITS if s != option
                    )
                gaps = {s: max(0, lower[s] - after[s]) for s in SPLITS}
                for s in SPLITS:
                    scale = max(target[s], 1)
                    over, off = max(0, after[s] - target[s]) / scale, abs(after[s] - target[s]) / scale
                    cost += c["lambda_imbalance"] * (3.0 * over + off)
                gap = sum(gaps.values())
                within = dropped + (size if option == "drop" else 0) <= budget
                unmet = sum(g > 0 for g in gaps.values())
                extra = 2.0 * gap / max(1, n_empty) + (10.0 * unmet if option == "drop" else 0.0)
                scores[option] = (within and gap <= rest, cost + extra, cost)
            feasible = [o for o in scores if scores[o][0]]
            if feasible:
                choice = min(feasible, key=lambda o: (round(scores[o][1], 12), o == "drop", counts.get(o, 0)))
            else:
                choice = min(scores, key=lambda o: scores[o][2])
            choices.append(choice)
            if choice == "drop":
                dropped += size
            else:
                counts[choice] += size
                for other, total in sims[i].items():
                    near[choice][other - first] += total
        batch["choice"] = choices
        return batch[[*keys, "pos", "choice"]]

    return decide


def _backfill(assigned: DataFrame, targets: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Move the smallest train clusters to splits that missed their lower bound.

    Sizes ascend, so the clusters train can spare are a prefix of that order, and
    running sums say which split each of them goes to.
    """
    keys = list(keys)
    counts = assigned.groupBy(*keys).agg(
        *[F.coalesce(F.sum(F.when(F.col("choice") == s, F.col("cluster_size"))), F.lit(0)).alias(f"_{s}") for s in SPLITS]
    )
    state = counts.join(targets.select(*keys, "lower"), keys)
    lack = {s: F.greatest(F.lit(0), F.col("lower")[s] - F.col(f"_{s}")) for s in SPLITS}
    needy = (lack["train"] == 0) & (lack["valid"] + lack["test"] > 0)
    spare = state.where(needy).select(
        *keys, lack["valid"].alias("_lv"), lack["test"].alias("_lt"), (F.col("_train") - F.col("lower")["train"]).alias("_spare")
    )
    if spare.isEmpty():
        return assigned
    train = assigned.where(F.col("choice") == "train").join(spare, keys)
    by_const = ordinal_by(train, keys, "const_to_sb_train", "pos", name="_by_const")
    ranked = ordinal_by(by_const, keys, "cluster_size", "_by_const", name="_rank")
    run = running_totals(ranked, keys, "_rank", {"_upto": "cluster_size"})
    before = F.col("_upto") - F.col("cluster_size")
    movable = run.where(F.col("_upto") <= F.col("_spare"))
    # valid takes clusters until its gap is closed; what it took is the first sum that reaches the gap
    met = movable.where(before < F.col("_lv")).groupBy(*keys).agg(F.max("_upto").alias("_used"))
    moves = movable.join(met, keys, "left")
    for_test = (before >= F.coalesce(F.col("_used"), F.lit(0))) & (
        before - F.coalesce(F.col("_used"), F.lit(0)) < F.col("_lt")
    )
    move = F.when(before < F.col("_lv"), F.lit("valid")).when(for_test, F.lit("test"))
    moves = moves.select(*keys, "pos", move.alias("_move")).where(F.col("_move").isNotNull())
    return assigned.join(moves, [*keys, "pos"], "left").withColumn("choice", F.coalesce("_move", "choice")).drop("_move")


def coupled_assignment(
    clusters: DataFrame, members: DataFrame, targets: DataFrame, keys: Sequence[str], order: str, condition: RepairCondition
) -> DataFrame:
    """Choice per cluster.  ``clusters``: keys, cluster_no, cluster_size, const_to_sb_train;
    ``members``: keys, cluster_no, the member's ``order`` and words."""
    keys = list(keys)
    ranked = ordinal_by(clusters, keys, "const_to_sb_train", "cluster_no", descending=True, name="_by_const")
    ranked = ordinal_by(ranked, keys, "cluster_size", "_by_const", descending=True, name="pos").drop("_by_const")
    ranked = running_totals(cut_lineage(ranked), keys, "pos", {"_upto": "cluster_size"})
    ranked = ranked.join(targets, keys).withColumn("remaining", F.col("n_empty") - F.col("_upto"))
    ranked = cut_lineage(ranked.drop("_upto"))
    placed = cut_lineage(members.join(ranked.select(*keys, "cluster_no", "pos"), [*keys, "cluster_no"]).select(*keys, "pos", order, "words"))
    last = ranked.agg(F.max("pos")).first()[0]
    types = dict(ranked.dtypes)
    zero = F.lit(0).cast("decimal(38,9)")
    sides = [f"near_{s}" for s in SPLITS]
    # what is known of the clusters still to come, and how many members have gone where
    near = ranked.select(*keys, "pos", *[zero.alias(c) for c in sides])
    counts = ranked.select(*keys).distinct().select(*keys, *[F.lit(0).cast("long").alias(f"count_{s}") for s in (*SPLITS, "drop")])
    code = F.element_at(F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(i).cast("bigint"))]), F.col("choice"))
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "pos bigint, choice string"])
    decided: DataFrame | None = None
    for start in range(0, 0 if last is None else last + 1, BATCH):
        inside = (F.col("pos") >= start) & (F.col("pos") < start + BATCH)
        batch = ranked.where(inside)
        own = placed.where(inside).withColumn("grp", F.col("pos")).drop("pos")
        sims = group_similarity(own, own, keys, order).groupBy(*keys, F.col("q_grp").alias("pos")).agg(
            F.collect_list(F.struct("r_grp", "total")).alias("sims")  # BATCH entries at most
        )
        state = batch.join(sims, [*keys, "pos"], "left").join(near, [*keys, "pos"]).join(counts, keys)
        flat = state.select(
            *keys, "pos", "cluster_size", "const_to_sb_train", "remaining", "n_empty", "drop_budget", "sims",
            *[F.col(p)[s].alias(f"{p}_{s}") for p in ("target", "lower") for s in SPLITS],
            *[c for c in state.columns if c.startswith(("near_", "count_"))],
        )
        choice = flat.groupBy(*keys).applyInPandas(_decide(asdict(condition), keys), schema)
        new = cut_lineage(batch.join(choice, [*keys, "pos"]))  # earlier rounds stay where they are written
        decided = new if decided is None else decided.unionByName(new)
        if start + BATCH > last:
            break
        # The batch is compared once, with what is still to come; earlier rounds are not read again.
        gone = placed.where(inside).join(new.where("choice <> 'drop'").select(*keys, "pos", code.alias("grp")), [*keys, "pos"]).drop("pos")
        later = placed.where(F.col("pos") >= start + BATCH).withColumn("grp", F.col("pos")).drop("pos")
        added = group_similarity(later, gone, keys, order).groupBy(*keys, F.col("q_grp").alias("pos")).agg(
            *[F.sum(F.when(F.col("r_grp") == i, F.col("total"))).cast("decimal(38,9)").alias(f"add_{s}") for i, s in enumerate(SPLITS)]
        )
        risen = near.where(F.col("pos") >= start + BATCH).join(added, [*keys, "pos"], "left")
        near = cut_lineage(risen.select(*keys, "pos", *[(F.col(f"near_{s}") + F.coalesce(f"add_{s}", zero)).cast("decimal(38,9)").alias(f"near_{s}") for s in SPLITS]))
        moved = new.groupBy(*keys).agg(*[F.sum(F.when(F.col("choice") == s, F.col("cluster_size"))).alias(f"_{s}") for s in (*SPLITS, "drop")])
        total = [(F.col(f"count_{s}") + F.coalesce(F.col(f"_{s}"), F.lit(0))).alias(f"count_{s}") for s in (*SPLITS, "drop")]
        counts = cut_lineage(counts.join(moved, keys, "left").select(*keys, *total))
    if decided is None:
        return ranked.withColumn("choice", F.lit("drop"))
    return _backfill(decided, targets, keys)


def repair_split(
    members: DataFrame,
    keys: Sequence[str],
    order: str,
    condition: RepairCondition | str = "D_train_support_priority",
    split: str = "split",
    is_empty: str = "is_empty",
) -> tuple[DataFrame, DataFrame]:
    """Repair the split of (keys, order, words, split, is_empty) members.

    Returns the audit table (RawSplit, Split, SplitSource, ESA_cluster_id per
    member) and the cluster summary.  A member without a fingerprint is a cluster
    of its own with no similarity to anything.
    """
    if isinstance(condition, str):
        if condition not in CONDITIONS:
            raise ValueError(f"unknown repair condition: {condition}")
        condition = CONDITIONS[condition]
    keys = list(keys)
    if dict(members.dtypes)[order] == "string":
        numbered = cut_lineage(with_number(members, order, "_number"))
        audit, summary = repair_split(numbered, keys, "_number", condition, split, is_empty)
        return audit.drop("_number"), summary
    targets = cut_lineage(assignment_targets(members, keys, condition, is_empty))
    empty = members.where(F.col(is_empty)).select(*keys, order, "words")
    shaped = empty.where(F.col("words").isNotNull()).join(targets.select(*keys, "limit"), keys)
    clustered = cut_lineage(microclusters(shaped, keys, order, "limit").drop("limit"))
    valid = clustered.groupBy(*keys, "cluster_no", "cluster_size").agg(F.lit(False).alias("is_invalid_fp_group"))
    unparsed = cut_lineage(ordinal_within(empty.where(F.col("words").isNull()), keys, order, "_i"))
    shift = valid.groupBy(*keys).agg(F.max("cluster_no").alias("_last"))
    lone = unparsed.join(shift, keys, "left").withColumn(
        "cluster_no", F.coalesce("_last", F.lit(0)) + F.col("_i") + 1
    )
    lone_clusters = lone.select(
        *keys, "cluster_no", F.lit(1).cast("long").alias("cluster_size"), F.lit(True).alias("is_invalid_fp_group")
    )
    clusters = valid.unionByName(lone_clusters)
    bearing = members.where(~F.col(is_empty) & (F.col(split) == "train") & F.col("words").isNotNull())
    costed = train_similarity(clusters, clustered, bearing, keys, order)
    choices = cut_lineage(coupled_assignment(costed, clustered, targets, keys, order, condition))
    label = F.concat(F.lit("ESA_"), zero_filled("cluster_no", 5))
    summary = choices.select(
        *keys, label.alias("cluster_id"), F.col("choice").alias("split"), "cluster_size", "const_to_sb_train", "is_invalid_fp_group"
    )
    owner = clustered.select(*keys, order, "cluster_no").unionByName(lone.select(*keys, order, "cluster_no"))
    placed = owner.join(choices.select(*keys, "cluster_no", "choice"), [*keys, "cluster_no"]).select(
        *keys, order, "choice", label.alias("ESA_cluster_id")
    )
    audit = members.join(placed, [*keys, order], "left")
    source = F.when(F.col(is_empty), F.lit(f"ESA_{condition.name}")).otherwise(F.lit("DataSAIL_scaffold_backbone"))
    return (
        audit.withColumn("RawSplit", F.col(split))
        .withColumn("Split_", F.when(F.col(is_empty), F.coalesce("choice", F.lit("drop"))).otherwise(F.col(split)))
        .withColumn("SplitSource", source)
        .drop("choice", split)
        .withColumnRenamed("Split_", "Split"),
        summary,
    )
