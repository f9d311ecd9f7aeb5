import hashlib
import random

import pytest
from pyspark.sql import functions as F

from foldwise.llm import prefix_trie, queries

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(conversations):
    """conversations: {conv_id: [(role, text), ...]}."""
    nodes = {}
    for conv, turns in conversations.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(conv)
    rows = []
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        inner = {p[:-1] for p in nodes if p}
        ends = sorted(c for c in members if len(conversations[c]) == len(path))
        rows.append(
            (
                min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), sum(len(p) == len(path) + 1 for p in below),
                sum(p not in inner for p in below), sum((len(nodes[p]) - 1) * len(p[-1][1].encode()) for p in below if p),
                hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest(),
            )
        )
    return sorted(map(repr, rows))


def given(spark, conversations):
    rows = [(c, k, r, t) for c, turns in conversations.items() for k, (r, t) in enumerate(turns)]
    random.Random(4).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def result(nodes):
    return sorted(repr(tuple(r)) for r in nodes.select(*NAMES).collect())


def families(seed, copies):
    rng = random.Random(seed)
    found = {}
    for c in range(120):
        turns = [(rng.choice("ua"), rng.choice(["x", "yé", ""])) for _ in range(rng.randrange(1, 7))]
        base = found.get(rng.randrange(max(c, 1)))
        found[c] = (base[: rng.randrange(len(base) + 1)] + turns) if base and rng.random() < 0.7 else turns
    hot = [("u", "hot"), ("a", "hot answer"), ("u", "again")]
    return found | {1000 + 7 * k: hot + ([("a", str(k % 3))] if k % 4 == 0 else []) for k in range(copies)}


@pytest.mark.parametrize("shard", [3, 40, 100_000])
def test_nodes_equal_brute_force(spark, shard):
    """Small shards cut the hot conversation's copies, and most families, over many shards."""
    conversations = families(shard, 90)
    turns = prefix_trie.conversation_turns(given(spark, conversations))
    assert result(prefix_trie.trie_nodes(turns, shard, shard)) == brute(conversations)


def test_fewer_shards_when_the_skeleton_is_large(spark, monkeypatch):
    conversations = families(9, 60)
    monkeypatch.setattr(prefix_trie, "SKELETON_BYTES", 200)
    turns = prefix_trie.conversation_turns(given(spark, conversations))
    assert result(prefix_trie.trie_nodes(turns, 20, 20)) == brute(conversations)


def test_turnless_conversations_end_at_the_root(spark):
    conversations = {5: [], 3: [], 9: [("u", "x")]}
    turns = spark.createDataFrame(
        [(c, [(hashlib.sha256(repr(t).encode()).hexdigest()[:32], len(t[1])) for t in v]) for c, v in conversations.items()],
        "conv_id long, turns array<struct<mark: string, bytes: long>>",
    )
    assert result(prefix_trie.trie_nodes(turns)) == brute(conversations)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 2, "u", "é"), (1, 2, "u", "é"), (2, None, "", ""), (None, 1, "u", "lost"), (2, 1, "u", "é"), (4, 0, "u", "x" * 100_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("path", F.lit("p")).withColumn("shard", F.lit(9))
    wanted = {1: [("", ""), ("u", "é"), ("u", "é")], 2: [("", ""), ("u", "é")], 4: [("u", "x" * 100_000)]}
    assert result(prefix_trie.trie_nodes(prefix_trie.conversation_turns(frame))) == brute(wanted)
    assert prefix_trie.trie_nodes(prefix_trie.conversation_turns(frame.limit(0))).count() == 0


def test_a_long_conversation(spark):
    long = [("u", f"turn {k}") for k in range(3000)]
    conversations = {1: long, 2: long[:2000] + [("a", "other")], 3: [("u", "z")], 6: long}
    turns = prefix_trie.conversation_turns(given(spark, conversations))
    rows = {(r.conv_id, r.depth): r for r in prefix_trie.trie_nodes(turns, 500, 500).collect()}
    assert len(rows) == 3000 + 1 + 1 + 1
    assert (rows[1, 2000].n_convs, rows[1, 2000].n_children, rows[1, 2000].n_leaves) == (3, 2, 2)
    assert rows[1, 3000].ends_sha256 == hashlib.sha256(b"1,6").hexdigest()
    assert rows[1, 0].saved_tokens == sum(len(t) * (2 if k < 2000 else 1) for k, (_, t) in enumerate(long))


def test_rebuilding(spark):
    turns = spark.createDataFrame([(c, [(f"{c}-{k}", k) for k in range(3)]) for c in (10, 11, 12, 17)], "conv_id long, turns array<struct<mark: string, bytes: long>>")
    import zlib

    for r in queries.rebuilt(turns).collect():
        h = zlib.crc32(str(r.conv_id).encode()) % 9
        base = [f"10-{k}" for k in range(3)] if r.conv_id < 15 else []
        assert [t.mark for t in r.turns] == base[:h] + [f"{r.conv_id}-{k}" for k in range(3)][h:]
