"""Near-duplicate embeddings by spherical-cap filters.

Filter directions are words of a random product code: a rotated vector is cut into blocks,
each block has a code of random unit vectors, and a direction is one code word per
block.  Several rotations have codes of their own, since directions of one code are not independent.  A vector is listed under every direction it exceeds in inner product, which is decoded from the
block scores without trying all directions.  Vectors that meet under a direction are compared
exactly.  Cap height and code size follow from the number of vectors, so that unrelated
vectors per direction and directions per vector stay about constant.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import kept_table, runs
from foldwise.llm.graph import components

COSINE = 0.9
MOST_WORDS = 4096  # per block: few blocks with long codes keep the directions almost independent
ROTATIONS = 8
EXPECTED_MEETINGS = 16.0  # directions shared by two vectors at the threshold, on average
UNRELATED = 32.0  # vectors of random direction per filter
PART = 1024  # rows of one side of a comparison
SEED = 20


def _tail(height: np.ndarray, dim: int) -> np.ndarray:
    """Share of the unit sphere in `dim` dimensions with first coordinate of at least `height`."""
    grid = np.linspace(-1, 1, 20001)
    density = np.maximum(0, 1 - grid**2) ** ((dim - 3) / 2)
    below = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
    return 1 - np.interp(height, grid, below / below[-1])


def _shared(height: float, dim: int, cosine: float) -> float:
    """Share of the directions exceeded by a vector that another vector at `cosine` exceeds too."""
    a = np.linspace(height, 1, 400)[:-1]
    density = (1 - a**2) ** ((dim - 3) / 2)
    other = _tail((height - cosine * a) / (np.sqrt(1 - cosine**2) * np.sqrt(1 - a**2)), dim - 1)
    return float((density * other).sum() / density.sum())


@dataclass(frozen=True)
class CapCode:
    """Filters for vectors of `dim` components; short vectors are padded to eight."""

    dim: int
    height: float
    blocks: int
    words: int

    @classmethod
    def for_table(cls, dim: int, rows: int, cosine: float = COSINE) -> CapCode:
        space = max(8, dim)
        heights = np.linspace(0.2, 0.9, 281)
        height = float(heights[int(np.argmin(np.abs(np.log(np.maximum(_tail(heights, space), 1e-300)) - np.log(UNRELATED / max(rows, 1)))))])
        count = EXPECTED_MEETINGS / ROTATIONS / max(_shared(height, space, cosine) * float(_tail(np.array(height), space)), 1e-15)
        blocks = next(b for b in range(2, 9) if count <= MOST_WORDS**b)
        return cls(dim, height, blocks, max(2, int(np.ceil(count ** (1 / blocks)))))

    def table(self, rotation: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """A rotation and the code of every block."""
        space = max(8, self.dim)
        rng = np.random.default_rng([SEED, rotation])
        turn = np.linalg.qr(rng.normal(size=(space, space)))[0]
        codes = [rng.normal(size=(self.words, len(part))) for part in np.array_split(np.arange(space), self.blocks)]
        return turn, [c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(self.blocks) for c in codes]

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """For each row all filters, of all rotations, whose inner product reaches the height."""
        each = [self._decode(unit, *self.table(r)) for r in range(ROTATIONS)]
        return [np.concatenate([x + r * self.words**self.blocks for r, x in enumerate(row)]) for row in zip(*each)]

    def _decode(self, unit: np.ndarray, turn: np.ndarray, codes: list[np.ndarray]) -> list[np.ndarray]:
        """Code words are chosen block by block; what the blocks to come can still add at most prunes
        the beginnings that cannot reach the height."""
        turned = np.pad(unit, ((0, 0), (0, len(turn) - self.dim))) @ turn
        cuts = np.cumsum([c.shape[1] for c in codes])[:-1]
        scores = [part @ c.T for part, c in zip(np.split(turned, cuts, axis=1), codes)]
        most = [s.max(axis=1) for s in scores]
        found = []
        for i in range(len(unit)):
            number, reached = np.zeros(1, np.int64), np.zeros(1)
            for b, block in enumerate(scores):
                need = self.height - sum(m[i] for m in most[b + 1 :])
                words = np.flatnonzero(block[i] >= need - reached.max(initial=-2.0))
                sums = reached[:, None] + block[i][words][None, :]
                x, y = np.nonzero(sums >= need)
                number, reached = number[x] * self.words + words[y], sums[x, y]
            found.append(number)
        return found


def unit_rows(column: pa.ListArray) -> np.ndarray:
    """Rows of length one, in doubles; rows are scaled first, so that squares neither overflow nor vanish."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(column), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def distinct_vectors(table: DataFrame) -> DataFrame:
    """(node, copies, embedding, dim) of the distinct usable vectors; node is their smallest vec_id."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists("embedding", lambda x: x != 0)
    rows = table.select("vec_id", "embedding").where(F.coalesce(usable, F.lit(False)))
    merged = rows.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count_distinct("vec_id").alias("copies"))
    return merged.select("node", "copies", "embedding", F.size("embedding").alias("dim"))


def _filters(vectors: DataFrame, codes: dict[int, CapCode]) -> DataFrame:
    """(node, dim, filter)"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = batch.filter(pa.array(dims == dim))
                for start in range(0, own.num_rows, 256):
                    part = own.slice(start, 256)
                    found = codes[dim].decode(unit_rows(part.column("embedding")))
                    sizes = [len(x) for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(part.column("node").to_numpy(), sizes)), pa.array(np.full(sum(sizes), dim, np.int32)), pa.array(np.concatenate(found))],
                        ["node", "dim", "filter"],
                    )

    return vectors.select("node", "dim", "embedding").mapInArrow(run, "node long, dim int, filter long")


def _parted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with (p, q, side): a group of more than PART rows is cut into parts, and every two parts
    (p <= q) of a group meet once; side tells which of the two a row is in."""
    large = rows.groupBy(*keys).count().where(F.col("count") > PART).select(*keys, F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    cut = rows.join(large, keys, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = cut.withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = own.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    return met.select(*rows.columns, F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), (F.col("own") > F.col("other")).alias("side"))


def _close(run: pa.RecordBatch, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes, and which of them link."""
    unit = unit_rows(run.column("embedding"))
    close = unit @ unit.T >= cosine
    np.fill_diagonal(close, False)
    return run.column("node").to_numpy(), close


def _compared(rows: DataFrame, vectors: DataFrame, keys: list[str], function, schema: str) -> DataFrame:
    full = _parted(rows, keys).join(vectors.select("node", "copies", "embedding"), "node")
    every = [*keys, "p", "q"]
    return full.repartition(*every).sortWithinPartitions(*every).mapInArrow(function, schema)


def near_duplicate_links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(a, b): links that join all vectors which meet under a filter and link, directly or through others there."""
    sizes = {r["dim"]: r["n"] for r in vectors.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    codes = {dim: CapCode.for_table(dim, n, cosine) for dim, n in sizes.items()}
    keys = ["dim", "filter"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, [*keys, "p", "q"]):
            if group.num_rows < 2:
                continue
            nodes, close = _close(group, cosine)
            label, before = nodes, None
            while before is None or (label != before).any():
                before = label
                label = np.minimum(label, np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1))
            moved = label != nodes
            if moved.any():
                yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["a", "b"])

    rows = kept_table(_filters(vectors, codes))
    return _compared(rows, vectors, keys, run, "a long, b long").distinct()


def link_counts(members: DataFrame, vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(node, others): vectors linked to each member of a component, copies of other nodes included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["component", "p", "q"]):
            nodes, close = _close(group, cosine)
            if group.column("p")[0].as_py() != group.column("q")[0].as_py():
                side = group.column("side").to_numpy(zero_copy_only=False)
                close &= side[:, None] != side[None, :]
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(close @ group.column("copies").to_numpy())], ["node", "others"])

    rows = members.select("component", "node")
    return _compared(rows, vectors, ["component"], run, "node long, others long").groupBy("node").agg(F.sum("others").alias("others"))


def embedding_classes(table: DataFrame, cosine: float = COSINE) -> DataFrame:
    """One row per row of table: vec_id, n_links, component_id, kept.

    Vectors link when their cosine in doubles is at least `cosine`.  Null, empty or zero vectors, and
    those with a null or non-finite component, link with nothing; vectors of different length do
    not link with each other.  Equal vectors are compared once and count as linked.  Every pair inside a
    component is compared, so n_links counts all links of the component.  Rows that repeat a vec_id
    are one vector; a null vec_id links with nothing and is its own component (null).
    """
    vectors = kept_table(distinct_vectors(table))
    members = kept_table(components(near_duplicate_links(vectors, cosine)))
    counts = link_counts(members, vectors, cosine)
    nodes = vectors.join(members, "node", "left").join(counts, "node", "left")
    verdict = nodes.select(
        "embedding", F.coalesce("component", "node").alias("component"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links")
    )
    found = table.select("vec_id", "embedding").join(verdict, "embedding", "left")
    own = F.when(F.col("vec_id").isNull(), None).otherwise(F.coalesce("component", "vec_id"))
    return found.select("vec_id", F.coalesce("links", F.lit(0)).alias("n_links"), own.alias("component_id"), F.col("vec_id").eqNullSafe(own).alias("kept"))
