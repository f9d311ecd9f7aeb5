"""Comparison of fingerprints block by block over a grid of cells.

Members are hashed into blocks of about a thousand with similar numbers of on-bits, and
consecutive blocks form groups.  A cell of the grid compares a group of queries with a group of
references in one task, so a block is sent to as many tasks as there are groups on the other side, not once for
every block there.  A table compared with itself has a triangular grid: every unordered pair of
blocks is compared once, and the kernel serves both sides of it.  A task holds two groups.

The Tanimoto of two fingerprints is at most the quotient of their numbers of on-bits, so the
ranges of the groups, a few numbers each, rule out cells before any fingerprint moves.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.functions.bits import popcount

BLOCK_ROWS = 1024
CELL_BLOCKS = 32
BAND = 1.1  # quotient of the numbers of on-bits at the ends of a band


def similarity_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Tanimoto of all rows of two word matrices."""
    shared = np.zeros((len(a), len(b)), dtype=np.int32)
    for w in range(a.shape[1]):
        shared += np.bitwise_count(a[:, w, None] & b[None, :, w])
    union = np.bitwise_count(a).sum(1, dtype=np.int32)[:, None] + np.bitwise_count(b).sum(1, dtype=np.int32)[None, :] - shared
    return np.where(union == 0, 1.0, shared / np.maximum(union, 1))


@dataclass
class Block:
    """Members of one block; texts among the extra columns are numbered within their cell."""

    node: np.ndarray
    weight: np.ndarray
    words: np.ndarray
    extra: dict[str, np.ndarray]

    def __post_init__(self):
        self.bits = np.bitwise_count(self.words).sum(1, dtype=np.int64)
        self.low, self.high = int(self.bits.min()), int(self.bits.max())


def bound(bits: np.ndarray | int, low: int, high: int) -> np.ndarray:
    """Largest Tanimoto that members with so many bits can have with members between two numbers of bits."""
    return np.where(bits < low, bits / max(low, 1), np.where(bits > high, high / np.maximum(bits, 1), 1.0))


def open_cell(table: pa.Table, extra: Sequence[str]) -> tuple[list[Block], list[Block]]:
    """The blocks of both sides, in order; a cell on the diagonal of a triangular grid has one side only."""
    table = table.sort_by([("side", "ascending"), ("blk", "ascending")]).combine_chunks()
    names = ["node", "weight", "words", *extra]
    ends, flat = {}, {}
    for name in names:
        column = table.column(name).chunk(0)
        values = column.values.dictionary_encode().indices if pa.types.is_string(column.type.value_type) else column.values
        ends[name], flat[name] = column.offsets.to_numpy(), values.to_numpy(zero_copy_only=False)
    sides: tuple[list[Block], list[Block]] = ([], [])
    for i, side in enumerate(table.column("side").to_pylist()):
        of = {n: flat[n][ends[n][i] : ends[n][i + 1]] for n in names}
        words = of["words"].reshape(len(of["node"]), -1).view(np.uint64)
        sides[side].append(Block(of["node"], of["weight"].astype(float), words, {n: of[n] for n in extra}))
    return sides


def block_pairs(left: list[Block], right: list[Block], triangular: bool, threshold: float | None = None) -> Iterator[tuple[Block, Block, bool]]:
    """Pairs of blocks that can hold a pair at or above the threshold, and whether a pair stands for both orders."""
    for i, a in enumerate(left):
        for b in right if right or not triangular else left[i:]:
            if not threshold or (a.high >= threshold * b.low and b.high >= threshold * a.low):
                yield a, b, triangular and a is not b


def sizes_of(nodes: DataFrame, keys: Sequence[str], block_rows: int) -> DataFrame:
    """Per key and band of on-bits: how many blocks it takes, and how many come before it."""
    counts = nodes.groupBy(*keys, _band(popcount("words")).alias("_band")).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("_parts"))
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_first", F.coalesce(F.sum("_parts").over(before), F.lit(0)))


def _band(bits: Column) -> Column:
    return F.floor(F.log(BAND, bits + F.lit(1.0))).cast("int")


def _groups(sizes: DataFrame, keys: Sequence[str], name: str, cell_blocks: int) -> DataFrame:
    """Per key and group of blocks: the least and the largest number of on-bits its members may have."""
    covered = F.sequence(F.floor(F.col("_first") / cell_blocks), F.floor((F.col("_first") + F.col("_parts") - 1) / cell_blocks))
    held = sizes.select(*keys, "_band", F.explode(covered).alias(name)).groupBy(*keys, name)
    low, high = F.pow(F.lit(BAND), F.min("_band")) - 1, F.pow(F.lit(BAND), F.max("_band") + 1) - 1
    return held.agg(F.floor(low).alias(f"_low_{name}"), F.ceil(high).alias(f"_high_{name}"))


def grid_of(left: DataFrame, right: DataFrame | None, keys: Sequence[str], cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """(keys, row, column, bound): every cell, from the sizes of the bands of both sides."""
    rows = _groups(left, keys, "row", cell_blocks)
    grid = rows.join(_groups(left if right is None else right, keys, "column", cell_blocks), list(keys))
    if right is None:
        grid = grid.where("row <= column")
    q, r = (F.col("_high_row") / F.greatest(F.col("_low_column"), F.lit(1))), (F.col("_high_column") / F.greatest(F.col("_low_row"), F.lit(1)))
    most = F.when((F.col("_low_column") == 0) & (F.col("_low_row") == 0), F.lit(1.0)).otherwise(F.least(F.lit(1.0), q, r))
    return grid.withColumn("bound", most)


def placed(nodes: DataFrame, sizes: DataFrame, keys: Sequence[str], cell_blocks: int = CELL_BLOCKS) -> DataFrame:
    """Members with their block and group."""
    banded = nodes.withColumn("_band", _band(popcount("words"))).join(sizes, [*keys, "_band"])
    block = F.col("_first") + F.pmod(F.xxhash64("node"), F.col("_parts"))
    return banded.withColumn("blk", block.cast("long")).withColumn("_grp", F.floor(F.col("blk") / cell_blocks)).drop("_band", "_parts", "_first")


def packed(members: DataFrame, keys: Sequence[str], extra: Sequence[str]) -> DataFrame:
    """One row of arrays per block of ``members`` (keys, blk, node, weight, words and the extra columns)."""
    fields = ["node", "weight", *extra]
    rows = members.groupBy(*keys, "blk").agg(F.collect_list(F.struct(*fields, "words")).alias("p"))
    return rows.select(*keys, "blk", *[F.col(f"p.{c}").alias(c) for c in fields], F.flatten("p.words").alias("words"))


def on_cells(
    queries: DataFrame,
    references: DataFrame | None,
    keys: Sequence[str],
    kernel: Callable[[pa.Table], pa.Table] | Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    extra: Sequence[str] = (),
    threshold: float | None = None,
    block_rows: int = BLOCK_ROWS,
    cell_blocks: int = CELL_BLOCKS,
) -> DataFrame:
    """Run a kernel on every cell that can hold a pair at or above the threshold; ``references=None`` is a
    triangular grid of the queries with themselves."""
    keys = list(keys)
    left_sizes = sizes_of(queries, keys, block_rows)
    right_sizes = None if references is None else sizes_of(references, keys, block_rows)
    grid = grid_of(left_sizes, right_sizes, keys, cell_blocks)
    if threshold:
        grid = grid.where(F.col("bound") >= threshold)
    left = packed(placed(queries, left_sizes, keys, cell_blocks), [*keys, "_grp"], extra)
    right = left if references is None else packed(placed(references, right_sizes, keys, cell_blocks), [*keys, "_grp"], extra)
    off = grid.where("row < column") if references is None else grid
    cell = [*keys, "row", "column"]
    asked = left.withColumnRenamed("_grp", "row").join(grid.select(*cell), [*keys, "row"]).withColumn("side", F.lit(0))
    given = right.withColumnRenamed("_grp", "column").join(off.select(*cell), [*keys, "column"]).withColumn("side", F.lit(1))
    return asked.unionByName(given).groupBy(*cell).applyInArrow(kernel, schema)


def flat_rows(table: pa.Table, keys: Sequence[str], columns: dict[str, list[np.ndarray]], types: dict[str, pa.DataType]) -> pa.Table:
    """Rows of a cell: its keys, and the values gathered per block."""
    arrays = {n: pa.array(np.concatenate(v) if v else [], types[n]) for n, v in columns.items()}
    size = len(next(iter(arrays.values())))
    return pa.table({**{k: pa.repeat(table.column(k)[0], size) for k in keys}, **arrays})
