import collections
import math
import re
import zlib

import numpy as np
import pytest

from foldwise.llm import lm_trie
from foldwise.llm.elias_fano import EliasFano, NgramTrie

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.mark.parametrize("n, top", [(0, 10), (1, 1 << 63), (5, 6), (1000, 1 << 64), (3000, 5000), (2000, 1 << 40)])
def test_elias_fano_equals_sorted_search(n, top):
    rng = np.random.default_rng(n)
    values = np.unique(rng.integers(0, top, n, dtype=np.uint64))
    coded = EliasFano.encode(values)
    asked = np.concatenate([values, rng.integers(0, top, 500, dtype=np.uint64), np.array([0, top - 1], np.uint64)])
    assert (coded.successor(asked) == np.searchsorted(values, asked)).all()
    assert (coded.get(np.arange(len(values))) == values).all()
    found = coded.find(asked)
    assert ((found >= 0) == np.isin(asked, values)).all() and (values[found[found >= 0]] == asked[found >= 0]).all()


def test_trie_is_searched_in_its_file(tmp_path):
    rng = np.random.default_rng(2)
    words = np.unique(rng.integers(2, 1 << 63, 400, dtype=np.uint64))
    pairs = np.unique(rng.integers(0, len(words), 3000) << 32 | rng.integers(0, 1 << 32, 3000))
    alone, value = rng.normal(size=len(words)), rng.normal(size=len(pairs))
    trie = NgramTrie.build(words, alone, pairs >> 32, (pairs & 0xFFFFFFFF).astype(np.uint32), value)
    with open(tmp_path / "trie", "wb") as file:
        places = trie.write(file)
    mapped = NgramTrie.mapped(str(tmp_path / "trie"), places)
    got = mapped.score(words[pairs >> 32], (pairs & 0xFFFFFFFF).astype(np.uint32), -9.0, at_once=700)
    assert got == pytest.approx(value, abs=np.ptp(value) / 255)
    assert mapped.score(words[:50], np.full(50, 7, np.uint32), -9.0) == pytest.approx(alone[:50], abs=np.ptp(alone) / 255)
    assert (mapped.score(words[:5] + np.uint64(1), np.zeros(5, np.uint32), -9.0) == -9.0).all()


def brute(rows):
    """Scores of (doc_id, text) rows by plain dictionaries."""
    texts = [(i, re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + [" end"]) for i, t in rows]
    train = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in texts]
    count, pair = collections.Counter(), collections.Counter()
    for (_, words), used in zip(texts, train):
        if used:
            count.update(words)
            pair.update(zip([" begin", *words], words))
    n, v, mu = sum(count.values()), len(count), lm_trie.MU
    before = {**count, " begin": sum(train)}
    out = []
    for (i, words), used in zip(texts, train):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        score = sum(math.log10((pair[a, w] + mu * (count[w] + 1) / (n + v + 1)) / (before.get(a, 0) + mu)) for a, w in zip([" begin", *words], words))
        out.append((str(i), not used, len(words), sum(count[w] > 0 for w in words), n, base, score))
    return sorted(out)


def compared(table):
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    got = sorted((str(r["doc_id"]), *list(r)[1:]) for r in lm_trie.score_documents(table).collect())
    for a, b in zip(got, brute(rows), strict=True):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5]) and a[6] == pytest.approx(b[6], rel=0.01)


def test_documents_equal_plain_counting(spark, tiny):
    compared(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_split_words_and_many_shards(spark, tiny, monkeypatch):
    monkeypatch.setattr(lm_trie, "SHARD_TOKENS", 4000)
    compared(spark.read.parquet(f"{tiny}/documents.parquet"))


def test_odd_rows(odd, none):
    compared(odd)
    assert lm_trie.score_documents(none).count() == 0
