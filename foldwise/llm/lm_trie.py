"""Bigram language model in sharded Elias-Fano tries.

p(w | v) = (c(v w) + MU p(w)) / (c(v) + MU), p(w) = (c(w) + 1) / (N + V + 1).

The numerator needs what is known of w, the denominator what is known of v, so the logarithm of a text
is a sum of terms that belong to one word each.  Every word occurrence, with the word before it,
is sent once to the shard of its word; the shard counts the training occurrences, builds its trie, maps it
from a file and adds up the terms of all documents.  Only sums per document leave a shard, packed by slice of the input.
Words with a large share of all tokens are split over shards by the word before, their own
counts being known from the table of word counts.
"""

from __future__ import annotations

import math
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import byte_slices, fold_of, kept_table
from foldwise.llm.elias_fano import NgramTrie

FOLDS, HELD_OUT = 7, 2
MU = 64.0
SHARD_TOKENS = 2_000_000
SLICE = 8 << 20  # bytes of text per slice; rows are counted inside it
SLICE_ROWS = 1 << 15  # leaves one bit of a 16-bit row number for the fold
LARGE_WORDS = 1 << 18  # most words that are split, hence most rows that are broadcast
BEGIN, END = 0, 1  # identifiers of the text's begin and end
U64 = np.uint64


def slice_tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words (64-bit identifiers), and the rows of all tokens among them, text by text with one end
    each; tokens per text.  Row 0 is the end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = lists.flatten()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])
    bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    counts = ends[bounds[1:]] - ends[bounds[:-1]] + 1
    coded = flat.filter(pa.array(real)).dictionary_encode()
    names = np.fromiter((max(2, xxhash.xxh3_64_intdigest(w)) for w in coded.dictionary.to_pylist()), U64, len(coded.dictionary))
    tokens = np.zeros(int(counts.sum()), np.int64)
    inner = np.ones(len(tokens), bool)
    inner[np.cumsum(counts) - 1] = False
    tokens[inner] = coded.indices.to_numpy() + 1
    return np.concatenate([[U64(END)], names]), tokens, counts


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in byte_slices(whole, "text", SLICE):
            for start in range(0, part.num_rows, SLICE_ROWS):
                yield part.slice(start, SLICE_ROWS)


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, trained, total): occurrences of every word identifier in training and in all documents.
    docs: text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            names, tokens, counts = slice_tokens(batch.column("text"))
            train = np.repeat(batch.column("train").to_numpy(zero_copy_only=False), counts)
            total, trained = np.bincount(tokens, minlength=len(names)), np.bincount(tokens[train], minlength=len(names))
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(trained), pa.array(total)], ["word", "trained", "total"])

    rows = docs.select("text", "train").mapInArrow(run, "word long, trained long, total long")
    return rows.groupBy("word").agg(F.sum("trained").alias("trained"), F.sum("total").alias("total"))


def spread(values: np.ndarray, salt: np.ndarray | int, parts: np.ndarray | int) -> np.ndarray:
    """A part for each value."""
    mixed = (values ^ np.asarray(salt, U64) * U64(0xD6E8FEB86659FD93)) * U64(0x9E3779B97F4A7C15)
    return ((mixed >> U64(20)) % np.asarray(parts, U64)).astype(np.int64)


class Routing:
    """Which shard an occurrence goes to."""

    def __init__(self, shards: int, large: list[tuple[int, int, int]]):
        """large: (word, trained, total) of the words that are split."""
        order = sorted((np.int64(w).view(U64), t, n) for w, t, n in large)
        self.shards = shards
        self.words = np.array([w for w, _, _ in order], U64)
        self.trained = np.array([t for _, t, _ in order], np.int64)
        self.parts = np.array([-(-8 * n // SHARD_TOKENS) for _, _, n in order], np.int64)

    def large_rows(self, words: np.ndarray) -> np.ndarray:
        """Row of each word among the large ones, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, at, -1)

    def shard(self, names: np.ndarray, tokens: np.ndarray, before: np.ndarray) -> np.ndarray:
        row = self.large_rows(names)
        parts = np.where(row >= 0, self.parts[row] if len(self.parts) else 1, 1)
        own = spread(names, 0, 1 << 40)[tokens]
        salt = np.where(parts[tokens] > 1, spread(before.astype(U64), 7, np.maximum(parts, 1)[tokens]), 0)
        return spread(own.astype(U64), salt, self.shards)


CHUNK = "shard int, slice long, ids binary, null binary, lengths binary, words binary, sizes binary, rows binary, before binary"


def chunks(docs: DataFrame, routing) -> DataFrame:
    """Packed occurrences: per slice of documents and shard one row with the words, how often each occurs, and
    per occurrence the document's number in the slice and the 32-bit identifier of the word before.
    The shard of the slice itself also gets the documents' ids.  docs: doc_id, text, train."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        route, number = routing.value, TaskContext.get().partitionId() << 32
        for batch in _slices(batches):
            names, tokens, counts = slice_tokens(batch.column("text"))
            short = (names >> U64(32)).astype(np.uint32)
            before = np.empty(len(tokens), np.uint32)
            before[1:] = short[tokens[:-1]]
            before[np.concatenate([[0], np.cumsum(counts)[:-1]])] = BEGIN
            train = batch.column("train").to_numpy(zero_copy_only=False)
            rows = np.repeat(np.arange(len(counts), dtype=np.uint16) | train.astype(np.uint16) << 15, counts)
            shard = route.shard(names, tokens, before)
            order = np.argsort(shard * len(names) + tokens, kind="stable")
            shard, tokens, rows, before = shard[order], tokens[order], rows[order], before[order]
            home = number % route.shards
            cuts = np.concatenate([np.flatnonzero(np.diff(shard, prepend=-1)), [len(shard)]])
            out = {name: [] for name in ("shard", "slice", "ids", "null", "lengths", "words", "sizes", "rows", "before")}
            places = list(zip(shard[cuts[:-1]].tolist(), cuts[:-1].tolist(), cuts[1:].tolist()))
            for own, a, b in places if any(p[0] == home for p in places) else [*places, (home, 0, 0)]:
                first = np.flatnonzero(np.diff(tokens[a:b], prepend=-1))
                known = own == home
                ids = batch.column("doc_id")
                out["shard"].append(own)
                out["slice"].append(number)
                out["ids"].append(ids.fill_null(0).to_numpy().tobytes() if known else None)
                out["null"].append(ids.is_null().to_numpy(zero_copy_only=False).tobytes() if known else None)
                out["lengths"].append(counts.tobytes() if known else None)
                out["words"].append(names[tokens[a:b][first]].tobytes())
                out["sizes"].append(np.diff(first, append=b - a).astype(np.uint32).tobytes())
                out["rows"].append(rows[a:b].tobytes())
                out["before"].append(before[a:b].tobytes())
            number += 1
            yield pa.RecordBatch.from_pydict(out, pa.schema([("shard", pa.int32()), ("slice", pa.int64()), *((c, pa.binary()) for c in list(out)[2:])]))

    return docs.select("doc_id", "text", "train").mapInArrow(run, CHUNK)


def score_shard(frame: pd.DataFrame, routing: Routing, tokens: int, vocabulary: int) -> pd.DataFrame:
    """Sums of one shard, one row per slice: count its training occurrences, build the trie, query it."""
    unpack = lambda name, kind: [np.frombuffer(x, kind) for x in frame[name]]
    words, sizes, rows, before = (unpack(n, k) for n, k in (("words", U64), ("sizes", np.uint32), ("rows", np.uint16), ("before", np.uint32)))
    sent = np.array([len(r) for r in rows])
    rows = np.concatenate(rows)
    train, rows = rows >> 15 > 0, (rows & 0x7FFF).astype(np.int64)
    touched, owner = np.unique(np.repeat(np.arange(len(sent)), sent) << 15 | rows, return_inverse=True)
    before = np.concatenate(before)
    names, inverse = np.unique(np.concatenate(words), return_inverse=True)
    word = np.repeat(inverse, np.concatenate(sizes)).astype(np.int64)

    count = np.bincount(word[train], minlength=len(names))
    large = routing.large_rows(names)
    if len(routing.words):
        count = np.where(large >= 0, routing.trained[large], count)
    alone = (count + 1) / (tokens + vocabulary + 1)
    pairs, place = np.unique(word << 32 | before, return_inverse=True)
    pair_count = np.bincount(place[train], minlength=len(pairs))
    seen = pair_count > 0
    top, last = pairs[seen] >> 32, (pairs[seen] & 0xFFFFFFFF).astype(np.uint32)
    known = np.flatnonzero(count > 0)  # rows of the trie
    row = np.full(len(names), -1)
    row[known] = np.arange(len(known))
    trie = NgramTrie.build(names[known], np.log10(MU * alone[known]), row[top], last, np.log10(pair_count[seen] + MU * alone[top]))
    handle, path = tempfile.mkstemp(prefix="trie-")
    try:
        with os.fdopen(handle, "wb") as file:
            places = trie.write(file)
        del trie
        mapped = NgramTrie.mapped(path, places)
        value = mapped.score(names[pairs >> 32], (pairs & 0xFFFFFFFF).astype(np.uint32), math.log10(MU / (tokens + vocabulary + 1)))
        del mapped
    finally:
        os.unlink(path)

    inner = names != END  # the end is no context
    context = np.where(inner, -np.log10(count + MU), 0.0)
    add = lambda per: np.bincount(owner, per, len(touched))
    known, base, score = add((count > 0)[word]).astype(np.int32), add(np.log10(count + 1.0)[word]), add(value[place] + context[word])
    cuts = np.searchsorted(touched >> 15, np.arange(len(sent) + 1))
    packed = lambda array: [array[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
    sums = {"rows": packed((touched & 0x7FFF).astype(np.uint16)), "n_known": packed(known), "base": packed(base), "score": packed(score)}
    return pd.DataFrame({name: frame[name].to_numpy() for name in ("slice", "ids", "null", "lengths")} | sums)


SUMS = "slice long, ids binary, null binary, lengths binary, rows binary, n_known binary, base binary, score binary"


def finish_slice(frame: pd.DataFrame) -> pd.DataFrame:
    """One row per document of a slice, from what its shards say."""
    home = frame[frame["ids"].notna()].iloc[0]
    ids, lengths = np.frombuffer(home["ids"], np.int64), np.frombuffer(home["lengths"], np.int64)
    rows = np.concatenate([np.frombuffer(x, np.uint16) for x in frame["rows"]])
    add = lambda name, kind: np.bincount(rows, np.concatenate([np.frombuffer(x, kind) for x in frame[name]]), len(ids))
    out = pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n_tokens": lengths})
    out.loc[np.frombuffer(home["null"], bool), "doc_id"] = pd.NA
    out["n_known"], out["base"], out["score"] = add("n_known", np.int32).astype(np.int64), add("base", np.float64), add("score", np.float64)
    return out


def score_documents(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Null is the empty text, which has the end as its only token.  Learns from the rows whose id has crc32
    modulo FOLDS other than HELD_OUT; a null id is a training row.  Rows that repeat are rows of
    their own.  An empty table gives an empty table, and without training rows every count is zero.
    """
    held = fold_of(F.col("doc_id"), FOLDS) == HELD_OUT
    named = docs.select("doc_id", "text", (~held).alias("train"))
    counts = kept_table(word_counts(named))
    sums = counts.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v"), F.sum("total").alias("all")).first()
    tokens, vocabulary, everything = sums["n"] or 0, sums["v"] or 0, sums["all"] or 0
    shards = max(1, -(-everything // SHARD_TOKENS))
    limit = max(SHARD_TOKENS // 8, everything // LARGE_WORDS)  # at most LARGE_WORDS words can exceed this
    large = [tuple(r) for r in counts.where(F.col("total") > limit).select("word", "trained", "total").collect()]
    begins = next((t for w, t, _ in counts.where(F.col("word") == END).select("word", "trained", "total").collect()), 0)
    context = docs.sparkSession.sparkContext
    routing = context.broadcast(Routing(shards, large))
    parts = chunks(named, routing)
    summed = parts.groupBy("shard").applyInPandas(lambda frame: score_shard(frame, routing.value, tokens, vocabulary), SUMS)
    whole = summed.groupBy("slice").applyInPandas(finish_slice, "doc_id long, n_tokens long, n_known long, base double, score double")
    return whole.select(
        "doc_id",
        (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * math.log10(tokens + vocabulary + 1)).alias("base_score"),
        (F.col("score") - math.log10(begins + MU)).alias("score"),
    )
