"""Group-preserving parts and the folds built from them.

Largest-first greedy packing looks sequential, but groups of equal size are
interchangeable.  So the packing runs over the histogram of group sizes - at most
sqrt(2 x rows) entries per dataset - and yields, for each size, a short list of
repeating bin patterns.  Every group then finds its bin from its rank among the
groups of its size, in parallel.  No task ever holds the list of groups.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from foldwise.functions.scalars import SPLITS, fold_count, shuffle_key
from foldwise.operators.ranking import ordinal_within
from foldwise.operators.summaries import branch_of

DEFAULT_SEED = 10086
PHASES = "array<struct<first:bigint,bins:array<int>>>"


def fill_phases(loads: list[int], size: int, count: int) -> list[tuple[int, list[int]]]:
    """Place ``count`` items of one size, each into the first least-loaded bin.

    Returns (first item, cycle of bins) phases and updates ``loads``.  A phase
    lasts until the level reaches the next, still higher, bin; within a phase the
    same bins take turns in a fixed order.
    """
    phases: list[tuple[int, list[int]]] = []
    placed = 0
    while placed < count:
        turn = sorted((load, b) for b, load in enumerate(loads))
        low = turn[0][0]
        cycle = [b for load, b in turn if load < low + size]
        waiting = [(load, b) for load, b in turn if load >= low + size]
        steps = count - placed
        if waiting:
            # Whole turns of the cycle before the lowest waiting bin would be next.
            rounds = max(1, (waiting[0][0] - low) // size)
            steps = min(steps, rounds * len(cycle))
        phases.append((placed, cycle))
        full, extra = divmod(steps, len(cycle))
        for i, b in enumerate(cycle):
            loads[b] += size * (full + (i < extra))
        placed += steps
    return phases


def _plan_dataset(bins: int | None, need_all: bool):
    def plan(key: tuple, histogram: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sizes = pd.concat(list(histogram)).sort_values("_size", ascending=False)
        k = int(bins or sizes["_k"].iloc[0])
        loads = [0] * k
        rows = []
        if not need_all or sizes["_groups"].sum() >= k:
            for size, groups in zip(sizes["_size"], sizes["_groups"]):
                phases = fill_phases(loads, int(size), int(groups))
                rows.append((*key, int(size), k, [{"first": f, "bins": b} for f, b in phases]))
        else:
            rows = [(*key, int(s), k, None) for s in sizes["_size"]]
        yield pd.DataFrame(rows, columns=[*(f"_key{i}" for i in range(len(key))), "_size", "kfolds", "_phases"])

    return plan


def _rank_in_size(groups: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rank of each group among the groups of its size, in tie-key order.

    Tie keys are md5 text, so their leading hex digits are evenly spread buckets:
    bucket counts give the offsets and only a bucket is ever sorted by one task.
    """
    buckets = groups.withColumn("_bucket", F.substring("_tie", 1, 3))
    cells = buckets.groupBy(*keys, "_size", "_bucket").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys, "_size").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cells.select(*keys, "_size", "_bucket", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_size", "_bucket").orderBy("_tie", "_group")
    joined = buckets.join(offsets, [*keys, "_size", "_bucket"])
    return joined.withColumn("_rank", F.row_number().over(inside) - 1 + F.col("_before"))


def group_parts(
    df: DataFrame,
    keys: Sequence[str],
    group: str = "group_key",
    bins: int | None = None,
    seed: int = DEFAULT_SEED,
    strict: bool = True,
    ties: str = "hash",
    need_all: bool = True,
) -> DataFrame:
    """One row per group: its size and the part it goes to.

    ``bins=None`` takes the number of parts from the size rule of each dataset.
    Fewer groups than parts is an error, or a NULL part unless ``strict``.
    Groups of one size are taken in hash order, or by label if labels are numbers.
    """
    if bins is not None and bins < 2:
        raise ValueError("at least two parts are needed")
    keys = list(keys)
    named = [F.col(c).alias(f"_key{i}") for i, c in enumerate(keys)]
    key_names = [f"_key{i}" for i in range(len(keys))]
    sizes = (
        df.select(*named, F.col(group).alias("_group"))
        .groupBy(*key_names, "_group")
        .agg(F.count(F.lit(1)).alias("_size"))
        .withColumn("_tie", shuffle_key("_group", seed))
    )
    histogram = sizes.groupBy(*key_names, "_size").agg(F.count(F.lit(1)).alias("_groups"))
    totals = histogram.groupBy(*key_names).agg(fold_count(F.sum(F.col("_size") * F.col("_groups"))).alias("_k"))
    types = dict(sizes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in key_names), "_size bigint", "kfolds int", f"_phases {PHASES}"])
    plan = histogram.join(totals, key_names).groupBy(*key_names).applyInPandas(_plan_dataset(bins, need_all), schema)
    if ties == "label":
        ordered = ordinal_within(sizes, [*key_names, "_size"], "_group", "_rank")
    else:
        ordered = _rank_in_size(sizes, key_names)
    ranked = ordered.join(plan, [*key_names, "_size"])
    phase = F.element_at(F.filter("_phases", lambda p: p["first"] <= F.col("_rank")), -1)
    slot = F.pmod(F.col("_rank") - phase["first"], F.size(phase["bins"])).cast("int")
    part = F.get(phase["bins"], slot)
    if strict:
        part = F.when(F.col("_phases").isNull(), F.raise_error(F.lit("fewer groups than parts"))).otherwise(part)
    return ranked.select(
        *[F.col(f"_key{i}").alias(c) for i, c in enumerate(keys)],
        F.col("_group").alias(group),
        F.col("_size").alias("group_size"),
        "kfolds",
        part.cast("int").alias("part"),
    )


def relabel_parts(parts: DataFrame, keys: Sequence[str], seed: int = DEFAULT_SEED) -> DataFrame:
    """Permute part numbers by a seeded hash, as the last step of the fold assignment."""
    number = F.sequence(F.lit(0), F.col("kfolds") - 1)
    order = F.array_sort(F.transform(number, lambda p: F.struct(shuffle_key(p, seed).alias("h"), p.alias("p"))))
    new = F.array_position(F.transform(order, lambda e: e["p"]), F.col("part")) - 1
    return parts.withColumn("part", new.cast("int"))


def assign_group_folds(
    df: DataFrame,
    keys: Sequence[str],
    group: str = "group_key",
    folds: int | None = None,
    seed: int = DEFAULT_SEED,
    relabel: bool = False,
    strict: bool = True,
) -> DataFrame:
    """Add ``fold`` (and ``kfolds``) so that no group is divided between folds.

    The join back is on the group; AQE broadcasts the group table while it is
    small and splits the partition of a dominant group when it is not.
    """
    parts = group_parts(df, keys, group, folds, seed, strict)
    if relabel:
        parts = relabel_parts(parts, keys, seed)
    lookup = parts.select(*keys, group, "kfolds", F.col("part").alias("fold"))
    return df.join(lookup, [*keys, group])


def pack_clusters(df: DataFrame, keys: Sequence[str], cluster: str, bins: int) -> DataFrame:
    """Deterministic largest-first packing of numbered clusters; ties follow the label."""
    packed = group_parts(df, keys, cluster, bins, ties="label", strict=False, need_all=False)
    return packed.select(*keys, cluster, F.col("group_size").alias("cluster_size"), F.col("part").alias("bin"))


def sliding_folds(df: DataFrame, part: str = "fold", folds: str = "kfolds") -> DataFrame:
    """Every row once per fold: the fold's own part tests, the next validates, the rest train."""
    fanned = df.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.col(folds) - 1)))
    return fanned.withColumn("split", branch_of(F.col(part), F.col("eval_fold"), F.col(folds)))


def window_folds(df: DataFrame, part: str, weights: Sequence[int]) -> DataFrame:
    """General sliding window with (train, valid, test) slot weights."""
    train, valid, test = weights
    total = train + valid + test
    offset = F.pmod(F.col(part) - F.col("eval_fold"), F.lit(total))
    fanned = df.withColumn("eval_fold", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    split = F.when(offset < test, SPLITS[2]).when(offset < test + valid, SPLITS[1]).otherwise(SPLITS[0])
    return fanned.withColumn("split", split)


def fold_members(df: DataFrame, fold: int, held_out: bool, column: str = "fold") -> DataFrame:
    """Test side (held out) or train side of one fold."""
    return df.where(F.col(column) == fold) if held_out else df.where(F.col(column) != fold)


def shuffled_key(identifier: str, seed: int, fold: str = "eval_fold", split: str = "split"):
    """The key whose order is the seeded row shuffle of a fold's split; the seed depends on split and fold."""
    offset = F.element_at(F.create_map(*[x for i, s in enumerate(SPLITS) for x in (F.lit(s), F.lit(seed + 1000 * (i + 1)))]), F.col(split))
    return F.md5(F.concat_ws(":", (offset + F.col(fold)).cast("string"), F.col(identifier).cast("string")))
