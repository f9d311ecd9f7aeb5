"""Exact join of documents by the Jaccard similarity of their word shingles, with pivots.

1 - Jaccard is a metric.  Unrelated texts are all at distance one from each other, so pivots
drawn at random tell them nothing; what the join does is therefore:

1. Sieve.  Documents with equal shingle sets become one node.  Two linked nodes must share
   a known number of the smallest shingle hashes of either; nodes without so many shared ones have no link.
2. Voronoi regions.  Among the active nodes those that own most of their rare shingles (no active
   node with a smaller identifier has them) become pivots.  The exact distance of every node to
   every pivot within two radii follows from shared rare shingles.  A node within one
   radius of a pivot is linked to it, and the nearest such pivot is its home.
3. Windows.  A partner of a node within one radius of its home lies within two radii, so boundary nodes
   up to two radii away are replicated into the region.  A region whose nodes are of one component is done;
   in others, blocks of nodes are compared exactly, without listing pairs.
4. Recursion.  Pairs with one end near a pivot are settled by 2 and 3.  Nodes far from all pivots
   elect pivots among themselves and go round again; in the last round all of them are pivots.

No pair of a group is listed beyond its links to pivots.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.llm.common import byte_slices, drop_finished_shuffles, kept_table, mix64, released, runs
from foldwise.llm.graph import components

WORDS = 5
PART = 256  # nodes of one side of a comparison
LINK, NEAR = 80, 60  # least similarity, in hundredths, of links and of nodes in a region (two radii)
MARGIN = 10  # hundredths of a set that the sieve looks at beyond those that partners may lack
ELECTIONS = 3
FACTORS = mix64(np.arange(11, 11 + WORDS)) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text of fewer than WORDS words is one shingle."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])
    bounds = ends[np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    tokens = names[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.uint64)
    n = max(0, len(tokens) - WORDS + 1)
    hashes = mix64(sum((tokens[i : n + i] * FACTORS[i] for i in range(WORDS)), np.zeros(n, np.uint64)))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= WORDS:
            out.append(np.unique(hashes[a : b - WORDS + 1]))
        elif b > a:
            short = np.full(1, b - a, np.uint64)  # the number of words is part of a short text's shingle
            out.append(mix64((tokens[a:b] * FACTORS[: b - a]).sum(keepdims=True) + short * np.uint64(0x9E3779B97F4A7C15)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def lacking(n: np.ndarray | int, least: int = LINK):
    """How many elements of a set of n a partner of that similarity may lack."""
    return n - -(-n * least // 100)


def sieve_share(n):
    """Elements that linked sets of about n elements have in common among the first
    lacking(n) + sieve_share(n) of each."""
    return np.maximum(1, -(-n * MARGIN // 100))


def _map_sets(docs: DataFrame, build, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                yield from build(batch, shingle_sets(batch.column("text")))

    return docs.select("doc_id", "text").mapInArrow(released(run), schema)


def node_of(values: np.ndarray) -> int:
    """Identifier of a set: a 64-bit digest of its sorted hashes."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(values.tobytes())).view(np.int64))


def memberships(docs: DataFrame) -> DataFrame:
    """(doc_id, node, n) per row; node is null for texts without words."""

    def build(batch, sets):
        nodes = [node_of(s) if len(s) else None for s in sets]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(nodes, pa.int64()), pa.array([len(s) for s in sets], pa.int64())], ["doc_id", "node", "n"])

    return _map_sets(docs, build, "doc_id long, node long, n long")


def _window_rows(docs: DataFrame) -> DataFrame:
    """(s, node): the smallest hashes of every set, once per node and slice."""

    def build(batch, sets):
        distinct = {node_of(s): s for s, known in zip(sets, batch.column("doc_id").is_valid().to_pylist()) if len(s) and known}
        first = [s[: lacking(len(s)) + int(sieve_share(len(s)))] for s in distinct.values()]
        if first:
            nodes = np.repeat(np.array(list(distinct), np.int64), [len(s) for s in first])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(first).view(np.int64)), pa.array(nodes)], ["s", "node"])

    return _map_sets(docs, build, "s long, node long")


def _shared_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows sorted by s: (node, shared), summed per batch, of rows whose s another node has too.

    Across batches only the first node of the running s and its own count are carried, however
    many rows an s has."""
    s_last, first, pending, shared_run = None, None, 0, False
    for batch in batches:
        s, node = batch.column("s").to_numpy(), batch.column("node").to_numpy()
        if not len(s):
            continue
        starts = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
        run = np.cumsum(np.concatenate([[True], s[1:] != s[:-1]])) - 1
        head = node[starts].copy()
        goes_on = s_last is not None and s[0] == s_last
        if goes_on:
            head[0] = first
        several = np.bincount(run, node != head[run], len(starts)) > 0
        if goes_on:
            several[0] |= shared_run
        extra_node, extra = (first, pending) if goes_on and several[0] and pending else (None, 0)
        if goes_on and several[0]:
            pending = 0
        found, counts = np.unique(node[several[run]], return_counts=True)
        if extra_node is not None:
            found, counts = np.append(found, extra_node), np.append(counts, extra)
        if len(found):
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts)], ["node", "shared"])
        waiting = 0 if several[-1] else int((run == len(starts) - 1).sum())
        pending = waiting + (pending if goes_on and len(starts) == 1 else 0)
        s_last, first, shared_run = s[-1], head[-1], bool(several[-1])


def sieved_nodes(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(node, n, doc_id) of the nodes that may have a link; doc_id is the smallest with that set."""
    counts = _window_rows(docs).repartition("s").sortWithinPartitions("s").mapInArrow(released(_shared_counts), "node long, shared long").groupBy("node").agg(F.sum("shared").alias("shared"))
    nodes = members.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"))
    # a partner has at least LINK hundredths of n elements, and its own share of the window follows from that
    least = F.greatest(F.lit(1), F.ceil(F.ceil(F.col("n") * LINK / 100) * MARGIN / 100))
    return nodes.join(counts, "node").where(F.col("shared") >= least).select("node", "n", "doc_id")


def shared_sets(docs: DataFrame, sieved: DataFrame) -> DataFrame:
    """(node, n, shared): the shingles that another sieved node has as well, rarest first."""

    def build(batch, sets):
        for s in sets:
            if len(s):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), node_of(s))), pa.array(s.view(np.int64))], ["node", "s"])

    chosen = docs.select("doc_id", "text").join(sieved.select("doc_id"), "doc_id", "left_semi")
    rows = _map_sets(chosen, build, "node long, s long")
    counted = rows.withColumn("df", F.count("*").over(Window.partitionBy("s"))).where("df > 1")
    gathered = counted.groupBy("node").agg(F.array_sort(F.collect_set(F.struct("df", "s"))).alias("pairs"))
    return gathered.join(sieved.select("node", "n"), "node").select("node", "n", F.col("pairs.s").alias("shared"))


def _prefix(least: int) -> Column:
    """The rarest elements of which partners of that similarity share one; those that no other node has are rarest of all."""
    n = F.col("n")
    length = n - F.ceil(n * least / 100) + 1 - (n - F.size("shared"))
    return F.slice("shared", 1, F.greatest(F.lit(0), length).cast("int"))


def _similar(left: DataFrame, right: DataFrame, sets: DataFrame, least: int, once: bool = False) -> DataFrame:
    """(x, y, common, union) of pairs that share a rare shingle and reach the similarity.
    left: (s, x, nx, mx), right: (s, y, ny, my); once: of equal sides, each pair in one order."""
    fits = _possible("x", "y", least) & (F.col("x") < F.col("y") if once else F.col("x") != F.col("y"))
    if "placesx" in left.columns:
        fits &= ~F.coalesce(F.arrays_overlap("placesx", "placesy"), F.lit(False))
    return _verified(left.join(right, "s").where(fits).select("x", "y").distinct(), sets, least)


def _possible(x: str, y: str, least: int) -> Column:
    """Whether sets of these sizes n, with m elements that others have too, can be so similar: they have at most
    the smaller m in common."""
    nx, ny, most = F.col(f"n{x}"), F.col(f"n{y}"), F.least(f"m{x}", f"m{y}")
    return most * 100 >= (nx + ny - most) * least


def _verified(pairs: DataFrame, sets: DataFrame, least: int) -> DataFrame:
    one = sets.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("shared").alias("sx"))
    two = sets.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("shared").alias("sy"))
    sized = pairs.join(one, "x").join(two, "y").select("x", "y", F.size(F.array_intersect("sx", "sy")).cast("long").alias("common"), "nx", "ny")
    return sized.select("x", "y", "common", (F.col("nx") + F.col("ny") - F.col("common")).alias("union")).where(F.col("common") * 100 >= F.col("union") * least)


def _rows(active: DataFrame, least: int, node: str, *more: str) -> DataFrame:
    """(node, n and m of the node, s) for the rarest elements, under the given name."""
    own = [F.col("node").alias(node), F.col("n").alias(f"n{node}"), F.size("shared").cast("long").alias(f"m{node}"), *(F.col(c).alias(f"{c}{node}") for c in more)]
    return active.select(*own, F.explode(_prefix(least)).alias("s"))


def _linked() -> Column:
    return F.col("common") * 100 >= F.col("union") * LINK


def _election(active: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(x, y, common, union) of active nodes near a pivot, the same without those that are pivots, and the nodes that are far from all."""
    met = _rows(active, NEAR, "node").select("node", F.min("node").over(Window.partitionBy("s")).alias("owner"), F.count("*").over(Window.partitionBy("s")).alias("met"))
    votes = met.where("met > 1").groupBy("node").agg((F.sum((F.col("owner") == F.col("node")).cast("long")) * 2 >= F.count("*")).alias("pivot"))
    voted = kept_table(active.join(votes, "node"))  # nodes that meet no other node are settled
    pivots = voted.where("pivot")
    near = kept_table(_similar(_rows(voted, NEAR, "x"), _rows(pivots, NEAR, "y"), sets, NEAR))
    plain = near.join(pivots.select(F.col("node").alias("x")), "x", "left_anti")
    covered = plain.where(_linked()).select(F.col("x").alias("node")).unionByName(pivots.select("node")).distinct()
    return near, plain, kept_table(voted.drop("pivot").join(covered, "node", "left_anti"))


def pivot_links(sets: DataFrame) -> DataFrame:
    """(a, b): links between nodes that connect all linked nodes."""
    active, links, regions = sets, [], []
    for _ in range(ELECTIONS):
        near, plain, active = _election(active, sets)
        links.append(near.where(_linked()).select(F.col("x").alias("a"), F.col("y").alias("b")))
        regions.append(plain.select("x", "y"))
        drop_finished_shuffles(sets.sparkSession)
    every = kept_table(reduce(DataFrame.unionByName, regions))
    places = every.join(active.select(F.col("node").alias("x")), "x", "left_semi").groupBy(F.col("x").alias("node")).agg(F.collect_set("y").alias("places"))
    left = kept_table(active.join(places, "node", "left").withColumn("places", F.coalesce("places", F.expr("array(CAST(NULL AS BIGINT))"))))
    # nodes of one region are compared there
    rest = _similar(_rows(left, LINK, "x", "places"), _rows(left, LINK, "y", "places"), sets, LINK, once=True)
    links.append(rest.select(F.col("x").alias("a"), F.col("y").alias("b")))
    direct = kept_table(reduce(DataFrame.unionByName, links))
    drop_finished_shuffles(sets.sparkSession)
    return direct.unionByName(_region_links(every, direct, sets))


def _region_links(regions: DataFrame, direct: DataFrame, sets: DataFrame) -> DataFrame:
    """Links between nodes of a region whose components differ so far.

    Nodes in the component of their pivot need no comparison among each other; they and the others are cut
    into parts of PART nodes, and every two parts that hold a pair to compare meet once.
    """
    component = kept_table(components(direct))
    named = lambda column, name: component.select(F.col("node").alias(column), F.col("component").alias(name))
    placed = regions.select("x", "y").join(named("x", "cx"), "x", "left").join(named("y", "cy"), "y", "left")
    main = F.coalesce("cx", "x") == F.coalesce("cy", "y")
    members = kept_table(placed.select(F.col("y").alias("pivot"), F.col("x").alias("node"), main.alias("main")))
    counted = members.groupBy("pivot").agg(F.count(F.when(F.col("main"), 1)).alias("inside"), F.count(F.when(~F.col("main"), 1)).alias("outside")).where("outside > 0")
    parts = counted.select("pivot", F.ceil(F.col("inside") / PART).cast("int").alias("k"), F.ceil(F.col("outside") / PART).cast("int").alias("l"))
    digest = F.xxhash64("node")
    own = F.when(F.col("main"), F.pmod(digest, F.greatest(F.col("k"), F.lit(1)))).otherwise(F.col("k") + F.pmod(digest, F.col("l"))).cast("int")
    cut = members.join(parts, "pivot").withColumn("own", own)
    others = F.when(F.col("main"), F.sequence(F.col("k"), F.col("k") + F.col("l") - 1)).otherwise(F.sequence(F.lit(0), F.col("k") + F.col("l") - 1))
    met = cut.select("pivot", "node", "own", F.explode(others).alias("other")).select("pivot", "node", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    full = met.join(sets.select("node", "n", "shared"), "node")
    keys = ["pivot", "p", "q"]
    return full.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(_compare_regions), "a long, b long").distinct()


def _compare_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links that connect the linked nodes of each run of rows with equal (pivot, p, q)."""
    for run in runs(batches, ["pivot", "p", "q"]):
        if run.num_rows < 2:
            continue
        nodes, n = run.column("node").to_numpy(), run.column("n").to_numpy()
        lists = run.column("shared")
        common = intersections(lists.flatten().to_numpy(), np.repeat(np.arange(len(nodes)), lists.value_lengths().to_numpy()), len(nodes))
        close = common * 100 >= (n[:, None] + n[None, :] - common) * LINK
        label, before = nodes, None
        while before is None or (label != before).any():
            before = label
            label = np.minimum(label, np.where(close, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        moved = label != nodes
        if moved.any():
            yield pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(label[moved])], ["a", "b"])


def intersections(values: np.ndarray, owner: np.ndarray, rows: int, columns: int = 2048) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, given as (value, owner); a block of values at a time."""
    _, place, counts = np.unique(values, return_inverse=True, return_counts=True)
    several = counts > 1
    rank = np.cumsum(several) - 1
    used = several[place]
    place, owner = rank[place[used]], owner[used]
    order = np.argsort(place, kind="stable")
    place, owner = place[order], owner[order]
    out = np.zeros((rows, rows), np.float32)
    for start in range(0, int(several.sum()), columns):
        a, b = np.searchsorted(place, (start, start + columns))
        block = np.zeros((rows, columns), np.float32)
        block[owner[a:b], place[a:b] - start] = 1
        out += block @ block.T
    np.fill_diagonal(out, 0)
    return np.rint(out).astype(np.int64)


def near_duplicate_classes(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    component_id is the smallest doc_id that links lead to, the document's own included.  Null,
    empty and blank texts have no shingles and are linked with nothing.  Rows that repeat a text are linked (their sets
    are equal).  A row without doc_id is linked with nothing and has a null component.
    """
    members = kept_table(memberships(docs))
    sieved = kept_table(sieved_nodes(docs, members))
    drop_finished_shuffles(docs.sparkSession)
    sets = kept_table(shared_sets(docs, sieved))
    drop_finished_shuffles(docs.sparkSession)
    classes = components(pivot_links(sets))
    named = members.join(classes, "node", "left").withColumn("class", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "node")))
    named = kept_table(named.select("doc_id", "n", "class"))
    drop_finished_shuffles(docs.sparkSession)
    least = named.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id"))
    found = named.join(least, "class", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the smallest of its class, or of no class; all columns."""
    kept = near_duplicate_classes(docs).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
