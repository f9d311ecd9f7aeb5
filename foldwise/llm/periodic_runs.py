"""Periodic runs of words by online dyadic square catching.

A run is a longest stretch of words with smallest period q that holds at least two periods and `least` words.
Words are appended one by one.  At every level, blocks of B = 2, 4, 8, ... words complete; a completed
block is watched by a catcher for as long as its copy may end q words later, q in [2B, 4B) (1 to 7 for the
pairs).  So a level has at most five catchers at a time, whatever has been read.  The first period of a run
holds a whole block of its level, so some catcher meets the copy before the run's second period
ends.  From there the stretch is followed leftwards once (less than a block) and rightwards by one comparison
for each appended word; the squares it reports are one run.  Multiples of a period that covers block and
copy are not followed: their stretch is the same one.

Before this, an exact sieve on hashed grams: all words of a run lie in grams of least / 2 words that occur
twice in their text.  Only such passages are appended.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldwise.llm.common import byte_slices, mix64

LEAST_WORDS = 12
FIRST_BLOCK, FIRST_PERIODS = 2, 7
BASE, MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
SPACE = re.compile(rb"[\x20\x09-\x0D]")
PART_BYTES = 1 << 20


class SquareCatchers:
    """Runs of a stream of word numbers; `squares()` are those that end with the last word."""

    def __init__(self, least: int = LEAST_WORDS):
        if least < 5:
            raise ValueError("a pair of words is caught in runs of at least 5 words")
        self.least = least
        self.words: list[int] = []
        self.hashes = array("Q", [0])  # of all prefixes; equal hashes are compared word by word
        self.following: dict[int, int] = {}  # period: start of the stretch that reaches the last word
        self.runs: list[tuple[int, int, int]] = []  # start, length, period
        self.levels: list[tuple[int, int, int, int, dict[int, list[int]], list[tuple[int, int]]]] = []

    def append(self, word: int) -> None:
        words, hashes, following = self.words, self.hashes, self.following
        at = len(words)
        words.append(word)
        h = (hashes[at] * BASE + word + 1) & MASK
        hashes.append(h)
        end = at + 1
        if following:
            for period in [p for p in following if words[at - p] != word]:
                self._close(period, at)
        for block, power, low, high, caught, live in self.levels:
            mark = (h - hashes[end - block] * power) & MASK
            starts = caught.get(mark)
            if starts:
                for start in reversed(starts):  # short periods first
                    period = end - block - start
                    if low <= period <= high and period not in following:
                        self._follow(start, block, period)
            if not end % block:
                caught.setdefault(mark, []).append(end - block)
                live.append((end - block, mark))
            if live and live[0][0] + high < end + 1 - block:
                start, mark = live.pop(0)
                caught[mark].remove(start)
                if not caught[mark]:
                    del caught[mark]
        if end >= FIRST_BLOCK and end == 1 << len(self.levels) + 1:
            mark = (h - hashes[0] * pow(BASE, end, 1 << 64)) & MASK
            low, high = (1, FIRST_PERIODS) if end == FIRST_BLOCK else (2 * end, 4 * end - 1)
            self.levels.append((end, pow(BASE, end, 1 << 64), low, high, {mark: [0]}, [(0, mark)]))

    def _follow(self, start: int, block: int, period: int) -> None:
        words = self.words
        if any(period % p == 0 and begun <= start for p, begun in self.following.items()):
            return
        if words[start : start + block] != words[start + period : start + period + block]:
            return
        while start and words[start - 1] == words[start - 1 + period]:
            start -= 1
        self.following[period] = start

    def _close(self, period: int, end: int) -> None:
        start = self.following.pop(period)
        if end - start >= max(self.least, 2 * period):
            self.runs.append((start, end - start, period))

    def squares(self) -> list[tuple[int, int]]:
        """(start, period) of the squares that the last word completed."""
        end = len(self.words)
        return [(end - 2 * p, p) for p, start in self.following.items() if end - start >= 2 * p]

    def finish(self) -> list[tuple[int, int, int]]:
        """All runs as (start, length, period) in order of start and period."""
        for period in list(self.following):
            self._close(period, len(self.words))
        return sorted((s, n, p) for s, n, p in self.runs)


def repeated_passages(ids: np.ndarray, gram: int) -> list[tuple[int, int]]:
    """Stretches [start, stop) of words that lie in grams occurring twice."""
    count = len(ids) - gram + 1
    if count < 2:
        return []
    codes = mix64(ids.astype(np.uint64) + np.uint64(1))
    mark = np.zeros(count, np.uint64)
    for k in range(gram):
        mark = mark * np.uint64(BASE) + codes[k : k + count]
    order = np.argsort(mark, kind="stable")
    same = mark[order[1:]] == mark[order[:-1]]
    if not same.any():
        return []
    step = np.zeros(len(ids) + 1, np.int64)
    hit = np.zeros(count, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    where = np.flatnonzero(hit)
    np.add.at(step, where, 1)
    np.add.at(step, where + gram, -1)
    covered = np.concatenate([[0], np.cumsum(step[:-1]) > 0, [0]]).astype(np.int8)
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def word_runs(ids: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int, int]]:
    """Runs of one text's word numbers, in order of start and period."""
    found = []
    for start, stop in repeated_passages(ids, least // 2):
        if stop - start >= least:
            catchers = SquareCatchers(least)
            for word in ids[start:stop].tolist():
                catchers.append(word)
            found += [(start + s, n, p) for s, n, p in catchers.finish()]
    return found


def numbered_words(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers of a text and its distinct words; long texts are split part by part."""
    numbers: dict[bytes, int] = {}
    parts, at = [], 0
    while at < len(data):
        stop = len(data)
        if stop - at > 2 * PART_BYTES:
            gap = SPACE.search(data, at + PART_BYTES)
            stop = gap.start() if gap else stop
        parts.append(np.array([numbers.setdefault(w, len(numbers)) for w in data[at:stop].split()], np.uint32))
        at = stop
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32), list(numbers)


def collapsed(ids: np.ndarray, words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text without what follows the first period of a run, joined by single spaces."""
    step = np.zeros(len(ids) + 1, np.int64)
    for start, length, period in runs:
        step[start + period] += 1
        step[start + length] -= 1
    kept = ids[np.cumsum(step[:-1]) == 0]
    return b" ".join(b" ".join([words[i] for i in kept[a : a + PART_BYTES].tolist()]) for a in range(0, len(kept), PART_BYTES))


def text_runs(docs: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row, in place.

    `runs`: start, length, period in words, by start, then period.  A null, empty or blank text has no words
    and no runs, and collapses to the empty text.  Rows that repeat an id, or have none, are rows
    of their own; an empty table gives none.  Memory is a few numbers per word of the longest text.  Other columns
    are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                counts, runs, texts = [], [], []
                for text in batch.column("text"):
                    data = (text.as_py() or "").encode()
                    ids, words = numbered_words(data)
                    found = word_runs(ids, least)
                    counts.append(len(ids))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                    texts.append(collapsed(ids, words, found).decode())
                fields = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column("doc_id"),
                        "n_words": pa.array(counts, pa.int64()),
                        "runs": pa.array(runs, pa.list_(fields)),
                        "collapsed": pa.array(texts, pa.string()),
                    }
                )

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
