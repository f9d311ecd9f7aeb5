"""Packing of tokenised texts into sequences of a fixed length by bounded-space online best-fit.

Every text becomes token ids and an end id; only what is longer than a sequence is cut, from the
end, so the first piece may be shorter than the others.  A packer takes pieces one by one and keeps
at most OPEN_BINS sequences open.  A bitset has a bit for every amount of free space that some open
sequence has: the lowest bit at or above a piece's length is the best fit.  When one more sequence
has to be opened than may be, the fullest one (the lowest bit) closes.

Texts never move: tasks write one short row per piece (about 50 bytes).  These rows are dealt into
shards of about SHARD_PIECES by their row number, whatever their ids, and every shard is a
stream of its own; a packer's memory is its open sequences.  Pieces come longest first, which
leaves the short ones to fill what is free (10,000 documents: 4,941 sequences, at least 4,936
are needed; in random order it is 4,990).
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

from foldwise.llm.common import byte_slices, kept_table

# Fixed value: how byte-level vocabularies cut texts into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SEQUENCE_TOKENS = 2048
OPEN_BINS = 4096
SHARD_PIECES = 8192  # at most twice OPEN_BINS, so that few shards ever close a sequence early
END_ID = 0
PART_CHARS = 1 << 20
# Beside such a space no other white space: it starts a token, so texts may be cut in front of it.
SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, then from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_encoding(path: str) -> tiktoken.Encoding | None:
    """The same vocabulary for the faster library, or None where it is not plain byte-level BPE.

    Ranks are the ids; in such a vocabulary ids follow the order of the merges.
    """
    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, before = given["model"], given["pre_tokenizer"] or {}
    plain = model["type"] == "BPE" and not any(model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    whole = before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not given["normalizer"] and not given["post_processor"]
    if not plain or not whole:
        return None
    letters, special = byte_letters(), {t["content"] for t in given["added_tokens"]}
    ranks = {bytes(letters[c] for c in word): number for word, number in model["vocab"].items() if word not in special}
    merged = [model["vocab"]["".join(pair)] for pair in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
    if merged != sorted(merged):
        return None
    return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes; control strings inside a text are ordinary text.

    Byte-level BPE runs in the faster of two libraries, which gives the same ids; other
    vocabularies, and texts that its pattern engine refuses (megabytes of white space), go to the tokenizers library.
    Long texts are encoded in parts of about PART_CHARS, cut where a token starts.
    """

    def __init__(self, path: str):
        self.path = path
        self.fast = rank_encoding(path)
        self.slow: Tokenizer | None = None

    def _plainly(self, part: str) -> bytes:
        if self.slow is None:
            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return np.array(self.slow.encode(part, add_special_tokens=False).ids, "<u4").tobytes()

    def _encode(self, part: str) -> bytes:
        if self.fast is None:
            return self._plainly(part)
        try:
            return self.fast.encode_to_numpy(part, disallowed_special=()).astype("<u4", copy=False).tobytes()
        except ValueError:  # no room for the pattern's backtracking
            return self._plainly(part)

    def __call__(self, text: str) -> bytes:
        if len(text) <= PART_CHARS or self.fast is None:
            return self._encode(text)
        out, at = [], 0
        while at < len(text):
            gap = SAFE_SPACE.search(text, at + PART_CHARS)
            stop = gap.start() if gap else len(text)
            out.append(self._encode(text[at:stop]))
            at = stop
        return b"".join(out)


def tokenised_pieces(docs: DataFrame, path: str, length: int, end_id: int, with_ids: bool) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every row's text, in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = Encoder(path), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                owner, number, start, size, crc, ids = [], [], [], [], [], []
                for row, text in enumerate(batch.column("text")):
                    data = encode(text.as_py() or "") + last
                    at, piece = 0, 0
                    stop = len(data) // 4 % length or length
                    while at < len(data) // 4:
                        part = data[4 * at : 4 * stop]
                        owner.append(row)
                        number.append(piece)
                        start.append(at)
                        size.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(part)
                        at, stop, piece = stop, stop + length, piece + 1
                columns = {
                    "doc_id": batch.column("doc_id").take(pa.array(owner, pa.int64())),
                    "piece": pa.array(number, pa.int32()),
                    "start": pa.array(start, pa.int64()),
                    "length": pa.array(size, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    columns["ids"] = pa.array(ids, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    fields = "piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {fields}")


class OpenSequences:
    """At most `limit` sequences that still have room, found by their free space."""

    def __init__(self, length: int, limit: int):
        self.length, self.limit = length, limit
        self.free = 0  # bit f: some open sequence has f ids free
        self.by_free: dict[int, list[int]] = {}
        self.open = self.made = 0

    def _take(self, free: int) -> int:
        held = self.by_free[free]
        number = held.pop()
        if not held:
            del self.by_free[free]
            self.free &= ~(1 << free)
        self.open -= 1
        return number

    def place(self, size: int) -> tuple[int, int]:
        """Number of the sequence that takes a piece, and the piece's place in it."""
        fits = self.free >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            number = self._take(free)
        else:
            free, number = self.length, self.made
            self.made += 1
        left = free - size
        if left:
            if self.open == self.limit:
                self._take((self.free & -self.free).bit_length() - 1)
            self.by_free.setdefault(left, []).append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.length - free


def _pack(length: int, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, bins = None, None
        for batch in batches:
            numbers, places = [], []
            for mine, size in zip(batch.column("_shard").to_pylist(), batch.column("length").to_pylist()):
                if mine != shard:
                    shard, bins = mine, OpenSequences(length, limit)
                number, place = bins.place(size)
                numbers.append((shard << 32) + number)
                places.append(place)
            rest = batch.drop_columns(["_shard", "_row"])
            yield rest.append_column("sequence_id", pa.array(numbers, pa.int64())).append_column("offset", pa.array(places, pa.int64()))

    return run


def packed_pieces(
    docs: DataFrame,
    path: str | None = None,
    length: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    with_ids: bool = False,
    open_bins: int = OPEN_BINS,
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset), one row per piece of every row.

    `ids` (with_ids) are a piece's ids as little-endian unsigned 32-bit numbers.  A null or empty text is its end
    id alone; rows that repeat an id, or have none, are texts of their own; an empty table has no pieces.  Of a very
    long text a task holds the text and its ids (4 bytes each).  Other columns of `docs` are not read.
    """
    pieces = tokenised_pieces(docs, path or vocabulary_path(), length, end_id, with_ids)
    # Numbers of written rows stay as they are when a task is repeated.
    numbered = kept_table(pieces.withColumn("_row", F.monotonically_increasing_id()))
    shards = max(1, -(-numbered.count() // shard_pieces))
    dealt = numbered.withColumn("_shard", F.pmod(F.xxhash64("_row"), F.lit(shards)))
    streams = dealt.repartition(shards, "_shard").sortWithinPartitions("_shard", F.desc("length"), "_row")
    schema = ", ".join(f"{n} {t}" for n, t in pieces.dtypes)
    return streams.mapInArrow(_pack(length, open_bins), f"{schema}, sequence_id long, offset long")


def token_sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, doc_ids): the packed sequences of `packed_pieces(..., with_ids=True)`.

    A sequence gathers at most its length of ids.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids", "doc_id")))
    return packed.groupBy("sequence_id").agg(parts.alias("_p")).select(
        "sequence_id",
        F.aggregate("_p.length", F.lit(0).cast("long"), lambda a, b: a + b).alias("n_tokens"),
        F.aggregate("_p.ids", F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"),
        F.col("_p.doc_id").alias("doc_ids"),
    )
