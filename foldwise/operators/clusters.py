"""Leader clustering over fingerprints: picking, nearest leader, refinement.

Leader picking is a sequential scan by definition: a member leads if no earlier
leader is close to it.  It runs in rounds.  Each round one task scans the first
few thousand undecided members of a key, and all members close to the leaders it
found are then dropped in parallel.  The work equals that of the scan, spread over
the cluster, and a dense region disappears with its first leader.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foldwise.functions.bits import tanimoto
from foldwise.operators.blocks import block_pairs, flat_rows, on_cells, open_cell, similarity_matrix
from foldwise.operators.ranking import ordinal_by
from foldwise.operators.similarity import merge_copies
from foldwise.session import cut_lineage

# Fixed value: similarity from which a member belongs to a leader.
LEADER_THRESHOLD = 0.40
BROADCAST_BYTES = 32 << 20
LARGEST_BATCH = 4096
CELLS = 1 << 20


def words_matrix(column: pd.Series) -> np.ndarray:
    """Word arrays of a pandas column as one unsigned matrix."""
    return np.stack([np.asarray(w, dtype=np.int64) for w in column]).view(np.uint64)


def batch_words(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("words").flatten().to_numpy().reshape(batch.num_rows, -1).view(np.uint64)


def batch_size(nodes: DataFrame, keys: Sequence[str]) -> int:
    """Leaders per round and key such that a round's broadcast stays under a fixed size."""
    n_keys = max(1, nodes.select(*keys).distinct().count())
    first = nodes.select(F.size("words").alias("w")).first()
    row_bytes = 8 * (first["w"] if first else 1) + 64
    return max(1, min(LARGEST_BATCH, BROADCAST_BYTES // (n_keys * row_bytes)))


def first_rows(df: DataFrame, keys: Sequence[str], order: str, n: int) -> DataFrame:
    """The first n rows of each key; the limit is applied before the shuffle as well."""
    window = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_k", F.row_number().over(window)).where(F.col("_k") <= n).drop("_k")


def _scan(threshold: float, inclusive: bool, keys: Sequence[str]):
    def scan(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node")
        words = words_matrix(rows["words"])
        open_ = np.ones(len(rows), dtype=bool)
        leaders = []
        for i in range(len(rows)):
            if open_[i]:
                leaders.append(i)
                sim = similarity_matrix(words[i : i + 1], words[i:])[0]
                open_[i:] &= ~(sim >= threshold if inclusive else sim > threshold)
                open_[i] = False
        return rows.iloc[leaders][[*keys, "node", "words"]]

    return scan


def best_of(words: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Largest similarity of every row to the others, a slice of rows at a time: CELLS similarities are in memory at once."""
    step = max(1, CELLS // max(1, len(others)))
    return np.concatenate([similarity_matrix(words[i : i + step], others).max(1) for i in range(0, len(words), step)])


def _keep_uncovered(shared, threshold: float, inclusive: bool, keys: Sequence[str]):
    """Drop the rows of a batch that are close to a leader of their key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            owner = list(zip(*[batch.column(k).to_pylist() for k in keys]))
            words = batch_words(batch)
            keep = np.ones(batch.num_rows, dtype=bool)
            for key in set(owner):
                if key in leaders:
                    mine = np.fromiter((o == key for o in owner), bool, len(owner))
                    best = best_of(words[mine], leaders[key])
                    keep[mine] = ~(best >= threshold if inclusive else best > threshold)
            yield batch.filter(pa.array(keep))

    return run


def by_key(rows: pd.DataFrame, keys: Sequence[str]) -> dict[tuple, pd.DataFrame]:
    return {k if isinstance(k, tuple) else (k,): g for k, g in rows.groupby(list(keys), sort=False)}


def pick_leaders(
    nodes: DataFrame, keys: Sequence[str], threshold: float = LEADER_THRESHOLD, inclusive: bool = True
) -> DataFrame:
    """Sphere-exclusion leaders of (keys, node, words) in ``node`` order."""
    keys = list(keys)
    spark = nodes.sparkSession
    undecided = nodes.select(*keys, "node", "words")
    size = batch_size(undecided, keys)
    found: list[DataFrame] = []
    while True:
        batch = first_rows(undecided, keys, "node", size)
        leaders = cut_lineage(batch.groupBy(*keys).applyInPandas(_scan(threshold, inclusive, keys), undecided.schema))
        rows = leaders.toPandas()  # at most ``size`` rows per key, under BROADCAST_BYTES in all
        if rows.empty:
            break
        found.append(leaders)
        shared = spark.sparkContext.broadcast({k: words_matrix(g["words"]) for k, g in by_key(rows, keys).items()})
        rest = undecided.mapInArrow(_keep_uncovered(shared, threshold, inclusive, keys), undecided.schema)
        undecided = cut_lineage(rest)
        shared.unpersist()
    out = found[0] if found else nodes.select(*keys, "node", "words").limit(0)
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _nearest(keys: Sequence[str]):
    """Kernel: the closest reference of each query node in a cell; of equally close ones the first."""

    def run(table: pa.Table) -> pa.Table:
        left, right = open_cell(table, [])
        out: dict[str, list] = {n: [] for n in ("node", "leader", "similarity")}
        for a, b, _ in block_pairs(left, right, False):
            order = np.argsort(b.node)
            sim = similarity_matrix(a.words, b.words[order])
            best = sim.argmax(1)
            out["node"].append(a.node)
            out["leader"].append(b.node[order][best])
            out["similarity"].append(sim[np.arange(len(a.node)), best])
        return flat_rows(table, keys, out, {"node": pa.int64(), "leader": pa.int64(), "similarity": pa.float64()})

    return run


def nearest_leader(nodes: DataFrame, leaders: DataFrame, keys: Sequence[str], threshold: float | None = None) -> DataFrame:
    """The most similar leader of each node; equal similarities go to the first leader.

    With the threshold the leaders were picked at, blocks that cannot reach it are
    skipped: every node has a leader at or above it.
    """
    keys = list(keys)
    weighted = leaders.withColumn("weight", F.lit(1)) if "weight" not in leaders.columns else leaders
    source = nodes.withColumn("weight", F.lit(1)) if "weight" not in nodes.columns else nodes
    types = dict(nodes.dtypes)
    schema = ", ".join([*(f"{k} {types[k]}" for k in keys), "node bigint, leader bigint, similarity double"])
    partial = on_cells(source, weighted, keys, _nearest(keys), schema, (), threshold)
    best = F.max_by(F.struct("leader", "similarity"), F.struct(F.col("similarity"), -F.col("leader")))
    return partial.groupBy(*keys, "node").agg(best.alias("_b")).select(*keys, "node", "_b.*")


def similarity_chunks(members: DataFrame, keys: Sequence[str], order: str, size: str) -> DataFrame:
    """Cut each key into chunks of ``size`` members by similarity to its first member."""
    keys = list(keys)
    first = members.groupBy(*keys).agg(F.min_by("words", order).alias("_first"))
    scored = members.join(first, keys).withColumn("_sim", tanimoto("words", "_first")).drop("_first")
    ranked = ordinal_by(scored, keys, "_sim", order, descending=True, name="rank")
    return ranked.withColumn("chunk", F.floor(F.col("rank") / F.col(size))).drop("_sim")


def lead_and_assign(members: DataFrame, keys: Sequence[str], order: str, threshold: float = LEADER_THRESHOLD) -> DataFrame:
    """Add the nearest leader (``leader``) to every member of (keys, order, words)."""
    keys = list(keys)
    nodes = merge_copies(members, keys, order)
    leaders = pick_leaders(nodes, keys, threshold)
    assigned = nodes.join(nearest_leader(nodes, leaders, keys, threshold), [*keys, "node"])
    return members.join(assigned.select(*keys, "words", "leader"), [*keys, "words"])


def microclusters(members: DataFrame, keys: Sequence[str], order: str, limit: str, threshold: float = LEADER_THRESHOLD) -> DataFrame:
    """Leader clusters of at most ``limit`` members.

    Clusters above the limit are led once more among their own members, and what
    is still too large is cut by similarity to its first member.  Adds
    ``cluster_no``: clusters are numbered from 1 by size, then first member.
    """
    keys = list(keys)
    coarse = cut_lineage(lead_and_assign(members, keys, order, threshold))
    sizes = coarse.groupBy(*keys, "leader").agg(F.count(F.lit(1)).alias("_n"))
    sized = coarse.join(sizes, [*keys, "leader"])
    small = sized.where(F.col("_n") <= F.col(limit)).withColumn("_sub", F.lit(-1).cast("bigint"))
    large = sized.where(F.col("_n") > F.col(limit)).drop("_n").withColumnRenamed("leader", "_coarse")
    inner = [*keys, "_coarse"]
    relead = cut_lineage(lead_and_assign(large, inner, order, threshold)).withColumnRenamed("leader", "_sub")
    again = relead.groupBy(*inner, "_sub").agg(F.count(F.lit(1)).alias("_n"))
    resized = relead.join(again, [*inner, "_sub"])
    whole = small.withColumnRenamed("leader", "_coarse").unionByName(resized.where(F.col("_n") <= F.col(limit)))
    whole = whole.withColumn("rank", F.col(order)).withColumn("chunk", F.lit(0).cast("bigint"))
    cut = similarity_chunks(resized.where(F.col("_n") > F.col(limit)), [*inner, "_sub"], order, limit)
    placed = cut_lineage(whole.unionByName(cut).drop("_n"))
    label = [*keys, "_coarse", "_sub", "chunk"]
    table = placed.groupBy(*label).agg(F.count(F.lit(1)).alias("cluster_size"), F.min_by(order, "rank").alias("_head"))
    numbered = ordinal_by(table, keys, "cluster_size", "_head", descending=True, name="cluster_no")
    numbered = numbered.withColumn("cluster_no", F.col("cluster_no") + 1)
    return placed.join(numbered.drop("_head"), label).drop("_coarse", "_sub", "chunk", "rank")
