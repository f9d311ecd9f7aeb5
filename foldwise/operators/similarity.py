"""Tanimoto analytics over packed fingerprints.

Means over all pairs need every pair, but no pair is ever a row.  Members with
the same fingerprint are merged first, with a weight, so copies cost nothing.
The distinct fingerprints are compared over a grid of block groups (see ``blocks``), and a
small NumPy kernel turns a cell into one sum and one maximum per member.  Maxima alone
do not need all cells: see ``best_similarity``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.functions.bits import popcount, tanimoto
from foldwise.functions.scalars import shuffle_key
from foldwise.operators.blocks import BLOCK_ROWS, CELL_BLOCKS, Block, block_pairs, bound, flat_rows, grid_of, on_cells, open_cell, packed, placed, similarity_matrix, sizes_of
from foldwise.operators.ranking import ordinal_within, with_number
from foldwise.operators.shift import gini
from foldwise.session import cut_lineage

# Smallest group whose similarity structure is reported, pair sample size.
MIN_MEMBERS = 5
MAX_SAMPLED_PAIRS = 60000
UNIT = 1_000_000_000
HELD_SUMS = 1 << 20  # sums of pairs of groups that a task gathers before it adds up those of equal pairs
HELD_MATCHES = 1 << 16  # close pairs in one batch of a threshold join
EXACT = 1 << 53
STRIDES = (1_000_000_007, 998_244_353)  # primes: pairs drawn one after the other lie far apart


def merge_copies(
    members: DataFrame, keys: Sequence[str], identifier: str, words: str = "words", extra: Sequence[str] = ()
) -> DataFrame:
    """One node per distinct fingerprint (and ``extra`` columns) with its multiplicity.

    A node's number is that of its first identifier; text identifiers are numbered in their order.

    Nodes are written to the checkpoint folder: every similarity operator reads
    them several times, and making fingerprints is the expensive part upstream.
    """
    return cut_lineage(
        with_number(members.where(F.col(words).isNotNull()), identifier, "_number")
        .groupBy(*keys, *extra, F.col(words).alias("words"))
        .agg(F.min("_number").alias("node"), F.count(F.lit(1)).alias("weight"))
    )


SUMMARY_FIELDS = ("sum_all", "max_all", "sum_same", "max_same", "sum_bearing", "max_other_bearing")


def _summarize(same_side: bool, grouped: bool, keys: Sequence[str]):
    """Kernel: per query node, sums and maxima against the references of one cell."""

    def add(totals: dict[str, np.ndarray], a: Block, b: Block, sim: np.ndarray) -> None:
        counted, seen = np.broadcast_to(b.weight, sim.shape), sim
        if same_side and a is b:  # a member is not compared with itself, but with its copies
            counted = counted - np.eye(len(a.node))
            seen = np.where(np.eye(len(a.node), dtype=bool) & (counted < 1), -1.0, sim)
        weighted = sim * counted
        totals["sum_all"] += weighted.sum(1)
        totals["max_all"] = np.maximum(totals["max_all"], seen.max(1))
        if grouped:
            same = a.extra["grp"][:, None] == b.extra["grp"][None, :]
            bearing = b.extra["bearing"].astype(bool)[None, :]
            totals["sum_same"] += (weighted * same).sum(1)
            totals["max_same"] = np.maximum(totals["max_same"], np.where(same, seen, -1.0).max(1))
            totals["sum_bearing"] += (weighted * bearing).sum(1)
            totals["max_other_bearing"] = np.maximum(totals["max_other_bearing"], np.where(bearing & ~same, seen, -1.0).max(1))

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, ["grp", "bearing"] if grouped else [])
        found: dict[int, tuple[Block, dict[str, np.ndarray]]] = {}
        for a, b, both in block_pairs(left, right, same_side):
            sim = similarity_matrix(a.words, b.words)
            for x, y, s in ((a, b, sim), (b, a, sim.T))[: 1 + both]:
                if id(x) not in found:
                    found[id(x)] = (x, {f: np.full(len(x.node), 0.0 if f.startswith("sum") else -1.0) for f in SUMMARY_FIELDS})
                add(found[id(x)][1], x, y, s)
        columns = {"node": [x.node for x, _ in found.values()]} | {f: [t[f] for _, t in found.values()] for f in SUMMARY_FIELDS}
        return flat_rows(table, keys, columns, {"node": pa.int64()} | dict.fromkeys(SUMMARY_FIELDS, pa.float64()))

    return run


def node_similarity(
    queries: DataFrame,
    references: DataFrame | None,
    keys: Sequence[str],
    grouped: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Similarity sums and maxima of each query node to all reference members.

    With ``references=None`` nodes are compared with the other members of the same
    table.  A maximum over nothing is NULL.
    """
    keys = list(keys)
    same_side = references is None
    extra = ["grp", "bearing"] if grouped else []
    types = dict(queries.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node bigint", *(f"{f} double" for f in SUMMARY_FIELDS)])
    kernel = _summarize(same_side, grouped, keys)
    partial = on_cells(queries, references, keys, kernel, schema, extra, None, block_rows)
    sums = [F.sum(f).alias(f) if f.startswith("sum") else F.nullif(F.max(f), F.lit(-1.0)).alias(f) for f in SUMMARY_FIELDS]
    used = sums if grouped else sums[:2]
    return partial.groupBy(*keys, "node").agg(*used)


def added_sums(out: dict[str, list]) -> dict[str, list]:
    """Sums (whole numbers) of equal pairs of groups added up, where the result is still exact in a double."""
    q, r, total = (np.concatenate(out[n]) for n in ("q_grp", "r_grp", "total"))
    order = np.lexsort((r, q))
    q, r, total = q[order], r[order], total[order]
    first = np.ones(len(q), bool)
    first[1:] = (q[1:] != q[:-1]) | (r[1:] != r[:-1])
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(total, starts) if len(starts) else total
    exact = sums < EXACT
    alone = ~exact[np.cumsum(first) - 1] if len(starts) else first
    parts = {"q_grp": (q[starts][exact], q[alone]), "r_grp": (r[starts][exact], r[alone]), "total": (sums[exact], total[alone])}
    return {n: [np.concatenate(v)] for n, v in parts.items()}


def _group_sums(keys: Sequence[str]):
    """Kernel: sums of all similarities between the groups of both sides of a cell.

    Pairs of groups recur in the cell's pairs of blocks; their sums are added up whenever HELD_SUMS more have come.
    """

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, ["grp"])
        out: dict[str, list] = {n: [] for n in ("q_grp", "r_grp", "total")}
        held = 0
        for a, b, _ in block_pairs(left, right, False):
            # whole billionths: their sums are exact, whatever the order of addition
            weighted = np.rint(similarity_matrix(a.words, b.words) * UNIT) * a.weight[:, None] * b.weight[None, :]
            mine, row = np.unique(a.extra["grp"], return_inverse=True)
            theirs, column = np.unique(b.extra["grp"], return_inverse=True)
            tall = np.zeros((len(mine), weighted.shape[1]))
            np.add.at(tall, row, weighted)
            small = np.zeros((len(theirs), len(mine)))
            np.add.at(small, column, tall.T)
            out["q_grp"].append(np.repeat(mine, len(theirs)))
            out["r_grp"].append(np.tile(theirs, len(mine)))
            out["total"].append(small.T.ravel())
            held += small.size
            if held > HELD_SUMS:
                out, held = added_sums(out), 0
        if out["total"]:
            out = added_sums(out)
            out["total"] = [out["total"][0] / UNIT]
        return flat_rows(table, keys, out, {"q_grp": pa.int64(), "r_grp": pa.int64(), "total": pa.float64()})

    return run


def group_similarity(queries: DataFrame, references: DataFrame, keys: Sequence[str], identifier: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(keys, q_grp, r_grp, total): the sum of the similarities of all pairs of members of two groups.

    Members have ``grp`` (BIGINT) and ``words``.  Sums are DECIMAL(38, 9), so neither the order of
    addition nor the size of a group changes them.
    """
    keys = list(keys)
    left, right = (merge_copies(m, keys, identifier, extra=["grp"]) for m in (queries, references))
    types = dict(left.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "q_grp bigint, r_grp bigint, total double"])
    rows = on_cells(left, right, keys, _group_sums(keys), schema, ["grp"], None, block_rows)
    return rows.groupBy(*keys, "q_grp", "r_grp").agg(F.sum(F.col("total").cast("decimal(27,9)")).cast("decimal(38,9)").alias("total"))


def _improve(keys: Sequence[str]):
    """Kernel: best similarities of the queries of a cell, nearest blocks first; a query is compared only with blocks
    whose bound is above its best so far."""

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, ["best"])
        out: dict[str, list] = {n: [] for n in ("node", "best", "compared")}
        for a in left:
            best, compared = a.extra["best"].copy(), np.zeros(len(a.node), np.int64)
            for b in sorted(right, key=lambda b: -float(bound(a.bits, b.low, b.high).max())):
                rows = np.flatnonzero(best < bound(a.bits, b.low, b.high))
                if len(rows):
                    best[rows] = np.maximum(best[rows], similarity_matrix(a.words[rows], b.words).max(1))
                    compared[rows] += len(b.node)
            for name, value in (("node", a.node), ("best", best), ("compared", compared)):
                out[name].append(value)
        return flat_rows(table, keys, out, {"node": pa.int64(), "best": pa.float64(), "compared": pa.int64()})

    return run


def best_similarity(queries: DataFrame, references: DataFrame, keys: Sequence[str], block_rows: int = BLOCK_ROWS, cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """(keys, node, best, compared): the largest similarity of every query node to the reference nodes, and with
    how many of them it was compared.

    Best first: every group of queries meets the group of references that is nearest in the number of on-bits.
    A query goes on to another group only if that group's bound is above what it has found, so most cells
    are left with few queries or none.
    """
    keys = list(keys)
    sizes, others = sizes_of(queries, keys, block_rows), sizes_of(references, keys, block_rows)
    grid = cut_lineage(grid_of(sizes, others, keys, cell_blocks))  # a few numbers per pair of groups
    cell = [*keys, "row", "column"]
    far = F.abs(F.col("_low_row") + F.col("_high_row") - F.col("_low_column") - F.col("_high_column"))
    first = grid.withColumn("_k", F.row_number().over(Window.partitionBy(*keys, "row").orderBy(F.desc("bound"), far, "column"))).where("_k = 1").select(*cell)
    asked = cut_lineage(placed(queries, sizes, keys, cell_blocks)).withColumnRenamed("_grp", "row")
    given = packed(placed(references, others, keys, cell_blocks), [*keys, "_grp"], []).withColumnRenamed("_grp", "column")
    types = dict(queries.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node bigint, best double, compared bigint"])

    def compare(rows: DataFrame) -> DataFrame:
        """Queries with their cell and ``best`` against the references of the cell."""
        left = packed(rows, cell, ["best"]).withColumn("side", F.lit(0))
        right = given.join(rows.select(*cell).distinct(), [*keys, "column"]).withColumn("best", F.array().cast("array<double>")).withColumn("side", F.lit(1))
        return left.unionByName(right.select(left.columns)).groupBy(*cell).applyInArrow(_improve(keys), schema)

    started = cut_lineage(compare(asked.withColumn("best", F.lit(-1.0)).join(first, [*keys, "row"])))
    bits = popcount("words")
    low, high = F.col("_low_column"), F.col("_high_column")
    reach = F.when(bits < low, bits / low).when(bits > high, high / bits).otherwise(1.0)
    others_of = grid.join(first, cell, "left_anti").select(*cell, "_low_column", "_high_column")
    rest = asked.join(started.select(*keys, "node", "best"), [*keys, "node"]).join(others_of, [*keys, "row"]).where(reach > F.col("best"))
    later = compare(rest.drop("_low_column", "_high_column"))
    return started.unionByName(later).groupBy(*keys, "node").agg(F.max("best").alias("best"), F.sum("compared").alias("compared"))


def max_similarity(queries: DataFrame, references: DataFrame, keys: Sequence[str], identifier: str, words: str = "words") -> DataFrame:
    """Largest similarity of every query member to the references of its key."""
    keys = list(keys)
    nodes = merge_copies(queries, keys, identifier, words)
    best = best_similarity(nodes, merge_copies(references, keys, identifier, words), keys)
    by_words = nodes.join(best, [*keys, "node"]).select(*keys, "words", F.col("best").alias("max_similarity"))
    present = queries.where(F.col(words).isNotNull()).withColumnRenamed(words, "words")
    return present.join(by_words, [*keys, "words"]).select(*keys, identifier, "max_similarity")


def leakage_metrics(
    queries: DataFrame,
    references: DataFrame,
    keys: Sequence[str],
    identifier: str,
    threshold: float = 0.4,
    words: str = "words",
) -> DataFrame:
    """Mean maximum similarity, share above the threshold and mean over all pairs."""
    keys = list(keys)
    q = merge_copies(queries, keys, identifier, words)
    r = merge_copies(references, keys, identifier, words)
    exposure = q.join(node_similarity(q, r, keys), [*keys, "node"], "left")
    w = F.col("weight")
    summed = exposure.groupBy(*keys).agg(
        F.sum("weight").alias("n_query"),
        F.sum(w * F.col("max_all")).alias("_max"),
        F.sum(w * (F.col("max_all") > threshold).cast("int")).alias("_leak"),
        F.sum(w * F.col("sum_all")).alias("_sum"),
    )
    sizes = r.groupBy(*keys).agg(F.sum("weight").alias("n_ref"))
    out = summed.join(sizes, keys, "full")
    n_query, n_ref = (F.coalesce(F.col(c), F.lit(0)) for c in ("n_query", "n_ref"))
    return out.select(
        *keys,
        n_query.alias("n_query"),
        n_ref.alias("n_ref"),
        F.try_divide("_max", "n_query").alias("mean_maxsim"),
        F.try_divide(F.col("_leak").cast("double"), F.col("n_query")).alias("leakrate_at_threshold"),
        F.try_divide("_sum", F.col("n_query") * F.col("n_ref")).alias("L_norm"),
    )


def split_leakage(
    members: DataFrame,
    keys: Sequence[str],
    identifier: str,
    threshold: float = 0.4,
    include_valid: bool = False,
    split: str = "split",
    is_empty: str = "is_empty",
    words: str = "words",
) -> DataFrame:
    """Counts per split and the exposure of empty-group test (and valid) members to train."""
    keys = list(keys)
    with_fp = members.where(F.col(words).isNotNull())
    counts = with_fp.groupBy(*keys).agg(
        *[
            F.coalesce(F.sum(F.when((F.col(split) == s) & extra, 1)), F.lit(0)).alias(f"{s}_{name}_fp")
            for name, extra in (("total", F.lit(True)), ("no_scaffold", F.col(is_empty)))
            for s in ("train", "valid", "test")
        ]
    )
    out = counts
    train = with_fp.where(F.col(split) == "train")
    for side in ("test", "valid") if include_valid else ("test",):
        asked = with_fp.where((F.col(split) == side) & F.col(is_empty))
        metrics = leakage_metrics(asked, train, keys, identifier, threshold, words)
        suffix = f"{side}_ns_to_train_all"
        out = out.join(
            metrics.select(
                *keys,
                F.col("mean_maxsim").alias(f"mean_maxsim_{suffix}"),
                F.col("leakrate_at_threshold").alias(f"leakrate_at_{threshold:g}_{suffix}"),
                F.col("L_norm").alias(f"L_norm_{suffix}"),
            ),
            keys,
            "left",
        )
    return out


def member_similarity(members: DataFrame, keys: Sequence[str], identifier: str, group: str = "group_key", is_empty: str = "is_empty") -> DataFrame:
    """Nodes (distinct fingerprint within a group) with their grouped similarity sums."""
    keys = list(keys)
    shaped = members.select(
        *keys, identifier, "words", F.col(group).alias("grp"), (~F.col(is_empty)).alias("bearing")
    )
    nodes = merge_copies(shaped, keys, identifier, "words", ["grp", "bearing"])
    stats = node_similarity(nodes, None, keys, grouped=True)
    return cut_lineage(nodes.drop("words").join(stats, [*keys, "node"]))


def group_cohesion(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group: size, mean pairwise similarity and Gini of the members' cohesion."""
    keys = [*keys, "grp", "bearing"]
    sizes = stats.groupBy(*keys).agg(F.sum("weight").alias("members"), F.sum(F.col("weight") * F.col("sum_same")).alias("_s"))
    sized = stats.join(sizes.drop("_s"), keys)
    scores = sized.select(*keys, F.try_divide("sum_same", F.col("members") - 1).alias("cohesion"), F.col("weight").alias("n"))
    return (
        sizes.join(gini(scores, keys, "cohesion", "cohesion_gini"), keys, "left")
        .withColumn("pairwise_mean", F.try_divide("_s", F.col("members") * (F.col("members") - 1)))
        .drop("_s")
    )


def structural_metrics(members: DataFrame, keys: Sequence[str], identifier: str, group: str = "group_key", is_empty: str = "is_empty") -> DataFrame:
    """Cohesion and nearest-neighbour relations of the empty group and the real groups.

    One similarity pass serves all fields.  Members of the empty group form one
    group; bearing members form their own groups and a mixed pool.
    """
    keys = list(keys)
    stats = member_similarity(members, keys, identifier, group, is_empty)
    groups = group_cohesion(stats, keys)
    w, bearing = F.col("weight"), F.col("bearing")
    large = (F.col("members") >= 2) & bearing
    by_class = groups.groupBy(*keys).agg(
        F.count(F.when(large, 1)).alias("ScaffoldClassCount_ge2"),
        _weighted_mean(F.when(large, F.col("pairwise_mean")), F.col("members")).alias("TrueScaffoldClass_PairwiseMean"),
        _weighted_mean(F.when(large, F.col("cohesion_gini")), F.col("members")).alias("TrueScaffoldClass_CohesionGini"),
        F.max(F.when(~bearing & (F.col("members") >= MIN_MEMBERS), F.col("pairwise_mean"))).alias("No_PairwiseMean"),
        F.max(F.when(~bearing & (F.col("members") >= MIN_MEMBERS), F.col("cohesion_gini"))).alias("No_CohesionGini"),
    )
    pool = stats.where(bearing)
    pool_size = pool.groupBy(*keys).agg(F.sum("weight").alias("_n"), F.sum(w * F.col("sum_bearing")).alias("_s"))
    pool_scores = pool.join(pool_size, keys).select(
        *keys, F.try_divide("sum_bearing", F.col("_n") - 1).alias("cohesion"), F.col("weight").alias("n")
    )
    mixed = pool_size.join(gini(pool_scores, keys, "cohesion", "_g"), keys, "left").select(
        *keys,
        F.when(F.col("_n") >= MIN_MEMBERS, F.try_divide("_s", F.col("_n") * (F.col("_n") - 1))).alias("HasMixed_PairwiseMean"),
        F.when(F.col("_n") >= MIN_MEMBERS, F.col("_g")).alias("HasMixed_CohesionGini"),
    )
    neighbours = stats.groupBy(*keys).agg(
        F.coalesce(F.sum(F.when(~bearing, w)), F.lit(0)).alias("No_Group_N"),
        F.coalesce(F.sum(F.when(bearing, w)), F.lit(0)).alias("Has_Group_N"),
        _weighted_mean(F.when(bearing, F.col("max_same")), w).alias("SameScaffold_NNMean"),
        _weighted_mean(F.when(bearing, F.col("max_other_bearing")), w).alias("CrossScaffold_NNMean"),
        _weighted_mean(F.when(~bearing, F.col("max_other_bearing")), w).alias("NoToScaffold_NNMean"),
        _weighted_mean(F.when(~bearing, F.col("max_same")), w).alias("NoToNo_NNMean"),
    )
    return neighbours.join(by_class, keys, "left").join(mixed, keys, "left")


def _weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)).cast("double"))


def _match(threshold: float, keys: Sequence[str]):
    """Kernel: the pairs of a cell at or above the threshold, lower node first.

    They leave the task after every pair of blocks, HELD_MATCHES at most in a batch: how many pairs of a cell are close does
    not matter to its memory.
    """
    types = {"node_a": pa.int64(), "node_b": pa.int64(), "similarity": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        left, right = open_cell(table, [])
        for a, b, both in block_pairs(left, right, True, threshold):
            sim = similarity_matrix(a.words, b.words)
            rows, columns = np.nonzero(sim >= threshold if both else (sim >= threshold) & (a.node[:, None] < b.node[None, :]))
            for start in range(0, len(rows), HELD_MATCHES):
                i, j = rows[start : start + HELD_MATCHES], columns[start : start + HELD_MATCHES]
                out = {"node_a": [np.minimum(a.node[i], b.node[j])], "node_b": [np.maximum(a.node[i], b.node[j])], "similarity": [sim[i, j]]}
                yield from flat_rows(table, keys, out, types).to_batches()

    return run


def similar_nodes(nodes: DataFrame, keys: Sequence[str], threshold: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Threshold join of distinct fingerprints; only matches leave the kernel."""
    keys = list(keys)
    types = dict(nodes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node_a bigint, node_b bigint, similarity double"])
    return on_cells(nodes, None, keys, _match(threshold, keys), schema, (), threshold, block_rows)


def sampled_pair_mean(
    members: DataFrame, keys: Sequence[str], identifier: str, pairs: int = MAX_SAMPLED_PAIRS, seed: int = 20250328
) -> DataFrame:
    """Mean similarity over a fixed number of distinct pairs, or all pairs if there are fewer.

    The estimator for groups too large for all pairs.  Pairs are numbered from 0, and draw t takes
    the pair (start + t * STRIDE) modulo their number.  The stride is prime and, whenever it divides that
    number, the next one is taken, so every draw is a new pair.
    """
    keys = list(keys)
    present = with_number(members.where(F.col("words").isNotNull()), identifier, "_number")
    numbered = ordinal_within(present, keys, "_number", "_ord")
    sizes = numbered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    total = F.expr("_n * (_n - 1) div 2")
    start = F.pmod(F.conv(F.substring(shuffle_key(F.concat_ws(":", *keys), seed), 1, 12), 16, 10).cast("bigint"), F.col("_all"))
    stride = F.when(F.col("_all") % STRIDES[0] != 0, STRIDES[0]).otherwise(STRIDES[1])
    drawn = (
        sizes.withColumn("_all", total)
        .withColumn("_t", F.explode(F.sequence(F.lit(0).cast("bigint"), F.least(F.lit(pairs).cast("bigint"), F.col("_all")) - 1)))
        .withColumn("_p", F.pmod(start + F.col("_t") * stride, F.col("_all")))
        .withColumn("_j", F.floor((1 + F.sqrt(1 + 8 * F.col("_p").cast("double"))) / 2).cast("bigint"))
        # the square root may be off by one for large numbers
        .withColumn("_j", F.expr("CASE WHEN _j * (_j - 1) div 2 > _p THEN _j - 1 WHEN (_j + 1) * _j div 2 <= _p THEN _j + 1 ELSE _j END"))
        .withColumn("_i", F.expr("_p - _j * (_j - 1) div 2"))
    )
    left = numbered.select(*keys, F.col("_ord").alias("_i"), F.col("words").alias("_a"))
    right = numbered.select(*keys, F.col("_ord").alias("_j"), F.col("words").alias("_b"))
    return (
        drawn.select(*keys, "_i", "_j")
        .join(left, [*keys, "_i"])
        .join(right, [*keys, "_j"])
        .groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("pairs"), F.avg(tanimoto("_a", "_b")).alias("pairwise_mean"))
    )


def hash_sample(df: DataFrame, keys: Sequence[str], identifier: str, cap: int, seed: int | str) -> DataFrame:
    """At most ``cap`` members per key in seeded hash order (the sampling operator).

    The rank filter is applied before the shuffle too (window group limit), so a
    dominant key sends ``cap`` rows per task.
    """
    order = Window.partitionBy(*keys).orderBy(shuffle_key(identifier, seed), identifier)
    return df.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= cap).drop("_k")
