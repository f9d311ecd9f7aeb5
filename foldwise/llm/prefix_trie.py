"""Trie of the beginnings of conversations, built from sorted shards around a small skeleton.

A conversation is a path of turn digests.  Paths are range-partitioned and sorted (copies by conv_id, so a
group of copies is dealt over as many shards as it needs).  A node whose members lie in two shards is a
beginning of what the last path before a splitter shares with the first one behind it: the skeleton is the
trie of these shared beginnings and the root, and it is broadcast.  Every shard walks its paths once and
finishes all nodes off the skeleton; for those on it, it gives partial counts, sums and ends, which are
reduced by node.  What remains, adding the skeleton up from its leaves, is as large as the skeleton.

Turns are told apart by 128 bits of SHA-256 over role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from foldwise.llm.common import kept_table

MARK = 32  # hexadecimal digits of a turn
SHARD_TURNS = 1 << 18  # a task holds the nodes of so many turns, about 100 MB
LEAST_SHARD_TURNS = 1 << 12
SKELETON_BYTES = 64 << 20  # of broadcast paths; beyond it fewer shards are made

NO_ENDS = hashlib.sha256(b"").hexdigest()
NUMBERS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")
WALKED = ", ".join(
    ["skeleton int, parent_skeleton int, shard int", *(f"{n} long" for n in NUMBERS), "last_bytes long, ends_sha256 string, ends string"]
)


def conversation_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest and UTF-8 bytes of the text.

    Order is by turn, null first, then by digest.  A null role or text is empty; rows without conv_id belong to no
    conversation and are left out; other columns are not read.  Texts stay where they are: a turn gathered here takes
    about 60 bytes.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    both = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")
    short = rows.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long"),
        F.struct("turn", F.substring(F.sha2(both, 256), 1, MARK).alias("mark"), F.octet_length(text).cast("long").alias("bytes")).alias("t"),
    )
    turns = short.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return turns.select("conv_id", F.transform("t", lambda t: F.struct(t["mark"].alias("mark"), t["bytes"].alias("bytes"))).alias("turns"))


def _shared(a: str, b: str) -> int:
    """Number of turns that two paths begin with."""
    most = min(len(a), len(b))
    if a[:most] == b[:most]:
        return most // MARK
    low, high = 0, most // MARK  # the paths agree on the first `low` turns and not on `high`
    while high - low > 1:
        middle = (low + high) // 2
        if a[low * MARK : middle * MARK] == b[low * MARK : middle * MARK]:
            low = middle
        else:
            high = middle
    return low


def _ends_of_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shard = first = last = None
    for batch in batches:
        if batch.num_rows:
            path = batch.column("path")
            shard, last = batch.column("shard")[0], path[-1].as_py()
            first = path[0].as_py() if first is None else first
    if shard is not None:
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard.as_py()], pa.int32()), "first": [first], "last": [last]})


def _shared_beginnings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(batch.column("before").to_pylist(), batch.column("first").to_pylist())
        yield pa.RecordBatch.from_pydict({"path": pa.array([b[: MARK * _shared(a, b)] for a, b in pairs], pa.string())})


def skeleton_of(paths: list[str]) -> dict[tuple[int, str], int]:
    """(number of the parent, digest of the turn) -> number, parents first; the root is 0."""
    numbers: dict[tuple[int, str], int] = {}
    for path in paths:
        at = 0
        for k in range(0, len(path), MARK):
            at = numbers.setdefault((at, path[k : k + MARK]), len(numbers) + 1)
    return numbers


def _walk(shared):
    """Kernel: the nodes of one sorted shard."""
    names = [f.split(" ")[0] for f in WALKED.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    schema = pa.schema([(f.split(" ")[0], types[f.split(" ")[1]]) for f in WALKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skeleton = shared.value
        least = [None]  # per node, in the order in which nodes are met: smallest member ...
        parent, depth, number, last = [-1], [0], [0], [0]
        convs, children, leaves, saved, ends = [0], [0], [0], [0], [None]

        def close(node: int) -> None:
            up = parent[node]
            if number[node] < 0:
                leaves[node] = leaves[node] or 1
                saved[node] += (convs[node] - 1) * last[node]
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
                ends[node] = ends[node].hexdigest() if ends[node] else NO_ENDS
            convs[up] += convs[node]
            least[up] = least[node] if least[up] is None else min(least[up], least[node])

        open_, before, shard = [0], "", None
        for batch in batches:
            for mine, conv, path, sizes in zip(*[batch.column(c).to_pylist() for c in ("shard", "conv_id", "path", "sizes")]):
                shard = mine
                same = _shared(before, path)
                while len(open_) > same + 1:
                    close(open_.pop())
                for k in range(same, len(sizes)):
                    up = open_[-1]
                    on = number[up]
                    open_.append(len(parent))
                    parent.append(up)
                    depth.append(k + 1)
                    number.append(skeleton.get((on, path[k * MARK : (k + 1) * MARK]), -1) if on >= 0 else -1)
                    last.append(sizes[k])
                    least.append(None)
                    ends.append(None)
                    for column in (convs, children, leaves, saved):
                        column.append(0)
                node = open_[-1]
                convs[node] += 1
                least[node] = conv if least[node] is None else min(least[node], conv)
                if number[node] >= 0:
                    if ends[node] is None:
                        ends[node] = []
                    ends[node].append(str(conv))
                elif ends[node] is None:
                    ends[node] = hashlib.sha256(str(conv).encode())
                else:
                    ends[node].update(b",%d" % conv)
                before = path
        if shard is None:
            return
        while len(open_) > 1:
            close(open_.pop())
        for start in range(0, len(parent), 20_000):
            rows = []
            for n in range(start, min(start + 20_000, len(parent))):
                up, mine = parent[n], number[n]
                above = number[up] if up >= 0 else -1
                rows.append(
                    (
                        mine, above, shard, least[n], depth[n], least[up] if up >= 0 and above < 0 else None,
                        convs[n], children[n], leaves[n], saved[n], last[n],
                        ends[n] if mine < 0 else None, ",".join(ends[n]) if mine >= 0 and ends[n] else None,
                    )
                )
            yield pa.RecordBatch.from_arrays([pa.array(c, schema.field(i).type) for i, c in enumerate(zip(*rows))], schema=schema)

    assert names == schema.names
    return run


def _hash_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Kernel: SHA-256 of each node's ends from its texts in the order of shards; nothing is gathered."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_pydict({"skeleton": pa.array([node], pa.int32()), "ends_sha256": [state.hexdigest()]})

    for batch in batches:
        for mine, text in zip(batch.column("skeleton").to_pylist(), batch.column("ends").to_pylist()):
            if mine != node:
                if state is not None:
                    yield done()
                node, state = mine, hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
    if state is not None:
        yield done()


def _rolled_up(numbers: dict[tuple[int, str], int], partial: dict) -> list[tuple]:
    """Rows of the skeleton's nodes, whose sums lack what lies on the skeleton below them."""
    parents = {n: up for (up, _), n in numbers.items()}
    for n in sorted(partial, reverse=True):
        row = partial[n]
        row["n_leaves"] = row["n_leaves"] or 1
        row["saved_tokens"] += (row["n_convs"] - 1) * row["last_bytes"]
        if n:
            up = partial[parents[n]]
            up["n_children"] += 1
            up["n_leaves"] += row["n_leaves"]
            up["saved_tokens"] += row["saved_tokens"]
    return [
        (n, r["conv_id"], r["depth"], partial[parents[n]]["conv_id"] if n else None, r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"])
        for n, r in partial.items()
    ]


def _sorted_shards(paths: DataFrame, shards: int) -> tuple[DataFrame, list[str]]:
    """Paths in sorted shards, and what the paths on both sides of every splitter share."""
    ranged = paths.repartitionByRange(shards, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    ranged = kept_table(ranged.withColumn("shard", F.spark_partition_id()))
    edges = ranged.select("shard", "path").mapInArrow(_ends_of_shards, "shard int, first string, last string")
    # One row per shard.
    before = edges.select("first", F.lag("last").over(Window.orderBy("shard")).alias("before")).where("before IS NOT NULL")
    shared = kept_table(before.mapInArrow(_shared_beginnings, "path string").distinct())
    size = shared.agg(F.sum(F.length("path"))).first()[0] or 0
    if size > SKELETON_BYTES and shards > 1:
        return _sorted_shards(paths, shards // 2)
    return ranged, sorted(r.path for r in shared.collect())


def trie_nodes(turns: DataFrame, shard_turns: int = SHARD_TURNS, least_shard_turns: int = LEAST_SHARD_TURNS) -> DataFrame:
    """One row per node: the root (depth 0) and every distinct beginning of the conversations (conv_id, turns).

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs (members), n_children, n_leaves
    (childless nodes at or below), saved_tokens (at and below: bytes of the last text for each member but one),
    ends_sha256 (the members that end here: ids in decimal, ascending, joined by commas).  A conversation without turns
    ends at the root; no conversation, no node.  conv_id is unique in `turns`.  A path takes 40 bytes per turn.
    """
    spark = turns.sparkSession
    marks = F.transform("turns", lambda t: t["mark"])
    paths = kept_table(turns.select("conv_id", F.array_join(marks, "").alias("path"), F.transform("turns", lambda t: t["bytes"]).alias("sizes")))
    total = paths.agg(F.sum(F.size("sizes") + 1)).first()[0] or 0
    small = min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // least_shard_turns))
    ranged, beginnings = _sorted_shards(paths, max(1, small, -(-total // shard_turns)))
    numbers = skeleton_of(beginnings)
    # At most SKELETON_BYTES of paths (or the paths between two shards).
    shared = spark.sparkContext.broadcast(numbers)
    walked = kept_table(ranged.mapInArrow(_walk(shared), WALKED))

    on = walked.where("skeleton >= 0")
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    once = [F.max(c).alias(c) for c in ("depth", "last_bytes")]
    reduced = on.groupBy("skeleton").agg(F.min("conv_id").alias("conv_id"), *sums, *once).collect()  # one row per node of the broadcast
    rows = _rolled_up(numbers, {r.skeleton: r.asDict() for r in reduced})
    skeleton = spark.createDataFrame(rows, ", ".join(["skeleton int", *(f"{n} long" for n in NUMBERS)]))
    texts = on.where("ends IS NOT NULL").select("skeleton", "shard", "ends")
    hashes = texts.repartition("skeleton").sortWithinPartitions("skeleton", "shard").mapInArrow(_hash_ends, "skeleton int, ends_sha256 string")
    top = skeleton.join(hashes, "skeleton", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_ENDS)))

    above = skeleton.select(F.col("skeleton").alias("parent_skeleton"), F.col("conv_id").alias("_above"))
    local = walked.where("skeleton < 0").join(above, "parent_skeleton", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_above"))
    columns = [*NUMBERS, "ends_sha256"]
    return local.select(*columns).unionByName(top.select(*columns))
