"""Exact duplicates by content-defined chunk recipes.

Texts are cut where a rolling hash of the last bytes has a given form, so equal passages
give equal chunks wherever they stand.  Chunks are deduplicated to identifiers, the
identifiers are verified against the chunk bytes, and documents are compared by their
ordered identifier lists.  A chunk's bytes cross the network once (after the copies within
a task are merged); documents never do.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from foldwise.llm.common import byte_slices, kept_table, mix64, released, text_buffers

WINDOW = 32  # bytes that the rolling hash sees
MASK_BITS = 11  # a cut every 2048 bytes on average
SHORTEST, LONGEST = 256, 16384
GEAR = (mix64(np.arange(1, 257)) >> np.uint64(32)).astype(np.uint32)


def candidate_ends(data: np.ndarray, block: int = 1 << 20) -> np.ndarray:
    """Positions behind which a chunk may end: the hash of the last WINDOW bytes starts with zeros."""
    found = []
    for start in range(0, len(data), block):
        lead = min(start, WINDOW - 1)
        h = GEAR[data[start - lead : start + block]]
        for step in (1, 2, 4, 8, 16):
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
        found.append(np.flatnonzero(h[lead:] >> np.uint32(32 - MASK_BITS) == 0) + start + 1)
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def chunk_ends(offsets: np.ndarray, data: np.ndarray) -> list[list[int]]:
    """Ends of the chunks of every text.  A cut depends only on bytes of its own chunk
    (SHORTEST exceeds WINDOW), so equal texts have equal cuts."""
    first = int(offsets[0])
    ends = candidate_ends(data[first : int(offsets[-1])]) + first
    out = []
    for start, stop in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        cuts, at = [], start
        for end in ends[np.searchsorted(ends, start + SHORTEST) : np.searchsorted(ends, stop)].tolist():
            while end - at > LONGEST:
                at += LONGEST
                cuts.append(at)
            if end - at >= SHORTEST:
                cuts.append(end)
                at = end
        while stop - at > LONGEST:
            at += LONGEST
            cuts.append(at)
        out.append(cuts + [stop] if stop > at else cuts)
    return out


def recipes(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, recipe, n_chunks, text_sha256): recipe joins the 16-byte identifiers of the chunks in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                offsets, data = text_buffers(batch.column("text"))
                lists, counts, digests = [], [], []
                for start, stop, ends in zip(offsets[:-1].tolist(), offsets[1:].tolist(), chunk_ends(offsets, data)):
                    at, ids = start, []
                    for end in ends:
                        ids.append(xxhash.xxh3_128_digest(data[at:end], seed))
                        at = end
                    lists.append(b"".join(ids))
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(data[start:stop]).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(lists, pa.binary()), pa.array(counts, pa.int64()), pa.array(digests, pa.string())],
                    ["doc_id", "recipe", "n_chunks", "text_sha256"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, recipe binary, n_chunks long, text_sha256 string")


def chunk_table(docs: DataFrame, seed: int = 0) -> DataFrame:
    """Distinct chunks (chunk_id, chunk, copies)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                offsets, data = text_buffers(batch.column("text"))
                ends = [end for cuts in chunk_ends(offsets, data) for end in cuts]
                bounds = np.array([int(offsets[0]), *ends], np.int64)  # the texts lie end to end, so chunks do too
                ids = [xxhash.xxh3_128_digest(data[a:b], seed) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                chunks = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), chunks.cast(pa.binary())], ["chunk_id", "chunk"])

    return docs.select("text").mapInArrow(released(run), "chunk_id binary, chunk binary").groupBy("chunk_id", "chunk").agg(F.count("*").alias("copies"))


def clashing_ids(chunks: DataFrame) -> DataFrame:
    """Identifiers that stand for more than one chunk."""
    return chunks.groupBy("chunk_id").count().where("count > 1")


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Rows belong together when their texts are identical; null is the empty text and all empty
    texts are one group.  The row with the largest doc_id stays.  Rows that repeat both id and
    text count in group_size and are marked alike; a null id stays only where its group has no
    other id.  An empty table gives an empty table.  Other columns are not read.

    Should two different chunks ever share an identifier, all identifiers are drawn anew with
    another seed, so equal recipes always mean equal texts.
    """
    seed = 0
    while not clashing_ids(chunk_table(docs, seed)).isEmpty():
        seed += 1
    rows = kept_table(recipes(docs, seed))
    groups = rows.groupBy("recipe").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return rows.join(groups, "recipe").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", "n_chunks"
    )


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows that repeat the kept id with the kept text are the same document: one of them stays.
    """
    key = lambda doc_id, sha: F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), sha)
    staying = exact_groups(docs).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_copy_key")).distinct()
    keyed = docs.select(F.struct("*").alias("row"), key(F.col("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("_copy_key"))
    return keyed.join(staying, "_copy_key", "left_semi").dropDuplicates(["_copy_key"]).select("row.*")
