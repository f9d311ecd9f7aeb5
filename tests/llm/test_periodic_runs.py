import hashlib
import random
import re
import time
import zlib

import numpy as np

from foldwise.llm import periodic_runs as runs
from foldwise.llm.queries import QUERIES


def brute(words, least=12):
    """Longest stretches of every period; those of a smaller period are dropped."""
    found = {}
    n = len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.setdefault((i, j + q - i), q)
            i = j
    return sorted((s, length, q) for (s, length), q in found.items() if length >= max(least, 2 * q))


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def samples():
    rng = random.Random(11)
    for size in (1, 2, 3, 30):
        for _ in range(150):
            yield [rng.randrange(size) for _ in range(rng.randrange(160))]
    for _ in range(400):
        words = []
        while len(words) < rng.randrange(10, 300):
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 40))]
            part = unit * rng.randrange(1, 6)
            words += part[: rng.randrange(1, len(part) + 1)]
            if rng.random() < 0.3:
                words += words[-rng.randrange(1, len(words) + 1) :]
        yield words
    yield fibonacci(610)
    yield [bin(i).count("1") % 2 for i in range(512)]
    yield [0] * 700


def test_runs_equal_brute_force():
    for words in samples():
        assert runs.word_runs(np.array(words, np.uint32)) == brute(words), words


def test_runs_without_the_sieve_and_with_other_lengths():
    for k, words in enumerate(samples()):
        least = 5 + k % 9
        catchers = runs.SquareCatchers(least)
        for w in words:
            catchers.append(w)
        assert catchers.finish() == brute(words, least), (least, words)


def test_squares_are_reported_with_their_last_word():
    words = [7, 8, 1, 2, 3, 1, 2, 3, 1, 2, 9]
    catchers, seen = runs.SquareCatchers(6), []
    for w in words:
        catchers.append(w)
        seen.append(catchers.squares())
    assert [s for s in seen if s] == [[(2, 3)], [(3, 3)], [(4, 3)]] and seen[7]


def test_few_catchers_at_a_time():
    catchers = runs.SquareCatchers()
    for i in range(5000):
        catchers.append(i % 17)
        assert all(len(live) <= 6 for *_, live in catchers.levels) and len(catchers.following) <= 12
    assert catchers.finish() == [(0, 5000, 17)]


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def expected(doc_id, text):
    words = [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    number = {}
    found = brute([number.setdefault(w, len(number)) for w in words])
    drop = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = digest("".join(f"{s},{length},{q}\n" for s, length, q in found))
    return (doc_id, len(found), *top, listed, digest(" ".join(w for i, w in enumerate(words) if i not in drop)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(spark, small, tmp_path):
    """Whole short and middling texts of the shared table, and odd ones, through the query itself."""
    given = [tuple(r) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").where("length(text) < 4000 OR text IS NULL").collect()]
    given += [(10**9 + i, t) for i, t in enumerate([None, "", " \t\n", "x " * 30, "a b c " * 9 + "a b", "\x1c \x1c " * 8, "é é " * 7, "a a " * 13])]
    given += [(None, "q r " * 8), (3, "same " * 40), (3, "same " * 40)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = QUERIES["op13_periodic_runs"](spark, str(tmp_path)).select(*NAMES).collect()
    assert sorted(map(repr, map(tuple, rows))) == sorted(repr(expected(*g)) for g in given)
    assert sum(r.n_runs > 0 for r in rows) > 40


def test_odd_rows(spark, odd, none):
    rows = runs.text_runs(odd.withColumnRenamed("row", "runs")).collect()
    assert len(rows) == odd.count() and all(r.collapsed is not None for r in rows)
    long = {r.doc_id: r for r in rows}[6]
    assert [(r.start, r.length, r.period) for r in long.runs] == [(0, 30_000, 9100)]
    assert runs.text_runs(none).count() == 0


def test_a_very_long_text():
    rng = random.Random(1)
    unit = [str(rng.randrange(10**6)) for _ in range(40_000)]
    data = " ".join(unit * 9).encode()
    began = time.time()
    ids, words = runs.numbered_words(data)
    assert len(ids) == 360_000 and runs.word_runs(ids) == [(0, 360_000, 40_000)]
    assert runs.collapsed(ids, words, [(0, 360_000, 40_000)]) == " ".join(unit).encode()
    assert time.time() - began < 30
