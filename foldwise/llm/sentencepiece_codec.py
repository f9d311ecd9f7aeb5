"""SentencePiece encoding and decoding on the tokenizers library.

The model file is parsed from its wire format; normaliser, metaspace marker, piece scores and
byte fallback are rebuilt as a tokenizer.  When no piece has the space marker behind
another character, words can be encoded one by one: a batch then encodes each distinct word
once, in one multithreaded call, and texts are put together by array indexing.  Every
distinct word (or every text, for other models) is also encoded by the original library, which
gives the parity column.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from foldwise.llm.common import byte_slices, released

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Field numbers and enumerations of the public model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
PIECES, TRAINER, NORMALIZER = 1, 2, 3
KNOWN_WORDS = 600_000  # distinct words that a task remembers from batch to batch
LEARNED = 4_096  # words encoded at a time: the libraries' results take about a kilobyte a word
ENCODE_BYTES = 1 << 20  # of text that is encoded at a time; each token takes some ten numbers
THREADS = 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message: varints as integers, all else as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        length = {1: 8, 5: 4}.get(kind) or varint()
        yield key >> 3, data[at : at + length]
        at += length


@dataclass
class PieceModel:
    """What the model file holds; defaults are those of the format."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    whitespace_as_suffix: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True

    @property
    def unk_id(self) -> int:
        return next((i for i, (_, _, kind) in enumerate(self.pieces) if kind == UNKNOWN), 0)

    @property
    def by_word(self) -> bool:
        """Whether a text is encoded word by word: no piece goes on behind the start of a word."""
        return self.escape and not self.whitespace_as_suffix and not any(
            kind == USER_DEFINED or (kind == NORMAL and MARK in piece.lstrip(MARK)) for piece, _, kind in self.pieces
        )


def parse_model(data: bytes) -> PieceModel:
    model = PieceModel()
    for number, value in fields(data):
        if number == PIECES:
            own = dict(fields(value))
            model.pieces.append((own.get(1, b"").decode(), struct.unpack("<f", own.get(2, b"\0" * 4))[0], own.get(3, NORMAL)))
        elif number == TRAINER:
            own = dict(fields(value))
            model.kind, model.byte_fallback, model.whitespace_as_suffix = own.get(3, UNIGRAM), bool(own.get(35)), bool(own.get(24))
        elif number == NORMALIZER:
            own = dict(fields(value))
            model.charsmap = own.get(2, b"")
            model.dummy_prefix, model.squeeze, model.escape = bool(own.get(3, 1)), bool(own.get(4, 1)), bool(own.get(5, 1))
    return model


def pair_merges(model: PieceModel) -> list[tuple[str, str]]:
    """Pairs that join to a piece, best piece first."""
    ids = {piece: i for i, (piece, _, kind) in enumerate(model.pieces) if kind in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = ids.get(piece[:cut]), ids.get(piece[cut:])
            if left is not None and right is not None:
                found.append((-model.pieces[i][1], i, left, right))
    found.sort()
    return [(model.pieces[a][0], model.pieces[b][0]) for _, _, a, b in found]


def build_tokenizer(model: PieceModel):
    """The whole tokenizer: text to ids and back."""
    from tokenizers import AddedToken, Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    if model.kind == UNIGRAM:
        core = models.Unigram([(p, s) for p, s, _ in model.pieces], unk_id=model.unk_id, byte_fallback=model.byte_fallback)
    elif model.kind == BPE:
        vocab = {p: i for i, (p, _, _) in enumerate(model.pieces)}
        core = models.BPE(vocab, pair_merges(model), unk_token=model.pieces[model.unk_id][0], fuse_unk=True, byte_fallback=model.byte_fallback)
    else:
        raise ValueError(f"model type {model.kind} is neither unigram (1) nor BPE (2)")
    tokenizer = Tokenizer(core)
    steps = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.squeeze:
        steps += [normalizers.Replace(Regex(" {2,}"), " "), normalizers.Replace(Regex("^ +| +$"), "")]
    if model.dummy_prefix:
        steps.append(normalizers.Prepend(" "))
    steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    if model.by_word:
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}*[^{MARK}]+|{MARK}+"), "isolated")
    for piece, _, kind in model.pieces:
        if kind == USER_DEFINED:
            tokenizer.add_tokens([AddedToken(piece, normalized=False)])
    back = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(back + ([decoders.Strip(" ", 1, 0)] if model.dummy_prefix else []))
    return tokenizer


class Codec:
    """Encodes and decodes batches inside a task."""

    def __init__(self, model: bytes, parity: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        os.environ.setdefault("RAYON_NUM_THREADS", str(THREADS))
        import sentencepiece
        from tokenizers import Tokenizer

        parsed = parse_model(model)
        self.whole = build_tokenizer(parsed)
        self.by_word, self.prefix = parsed.by_word, parsed.dummy_prefix
        self.plain = not parsed.charsmap and not parsed.squeeze
        self.words = Tokenizer(self.whole.model)
        self.own = sentencepiece.SentencePieceProcessor(model_proto=model) if parity else None
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.string())  # row by row
        self.ids = np.zeros(0, np.int32)  # of all known words, end to end
        self.starts = np.zeros(1, np.int64)
        self.agrees = np.zeros(0, bool)
        self.returns = np.zeros(0, bool)

    def _learn(self, words: pa.Array) -> np.ndarray:
        """Row numbers of distinct words in the table of encoded words; a word has the spaces before it."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        found = pc.index_in(words, value_set=self.known)
        rows, absent = found.fill_null(0).to_numpy().astype(np.int64), found.is_null().to_numpy(zero_copy_only=False)
        new = words.filter(pa.array(absent))
        if len(new):
            rows[absent] = len(self.known) + np.arange(len(new))
            parts = [self._encode_words(new.slice(at, LEARNED).to_pylist()) for at in range(0, len(new), LEARNED)]
            ids, sizes, same, back = (np.concatenate(x) for x in zip(*parts))
            self.known = pa.concat_arrays([self.known, new])
            self.ids = np.concatenate([self.ids, ids])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.agrees = np.concatenate([self.agrees, same])
            self.returns = np.concatenate([self.returns, back])
        return rows

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All ids, ids per word, whether the original library gives the same ones, whether a word is got back from them."""
        marked = [w.replace(" ", MARK) for w in words]
        got = [e.ids for e in self.words.encode_batch_fast(marked, add_special_tokens=False)]
        cut = 1 if self.prefix else 0  # the original library puts the marker of the text's start there itself
        same = [True] * len(words)
        if self.own:
            at_start = [i for i, w in enumerate(words) if len(w) > cut and (not cut or w[0] == " ")]
            for i, ids in zip(at_start, self.own.encode([words[i][cut:] for i in at_start], num_threads=THREADS)):
                same[i] = ids == got[i]
        back = [a == b[cut:] for a, b in zip(self.whole.decode_batch(got, skip_special_tokens=False), words)]
        return np.fromiter(chain.from_iterable(got), np.int32), np.fromiter(map(len, got), np.int64, len(got)), np.array(same, bool), np.array(back, bool)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets into, and all ids of, the texts; whether a text equals the original library's
        encoding; whether it is got back from its ids.  Words are independent of each other in both
        directions, since each starts with the space marker."""
        if not self.by_word or not self.plain:
            got = [e.ids if t else [] for t, e in zip(texts, self.whole.encode_batch_fast(texts, add_special_tokens=False))]
            same = [a == b for a, b in zip(got, self.own.encode(texts, num_threads=THREADS))] if self.own else [True] * len(got)
            back = [a == b for a, b in zip(self.decode(got), texts)]
            return np.cumsum([0, *map(len, got)]), np.array([i for ids in got for i in ids], np.int32), np.array(same, bool), np.array(back, bool)
        counts, coded, lead = self._words(texts)
        words = pc.binary_join_element_wise(pa.scalar(lead), coded.dictionary, "") if lead else coded.dictionary
        rows = self._learn(words)[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        sizes = (self.starts[1:] - self.starts[:-1])[rows]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.ids[np.repeat(self.starts[:-1][rows] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], np.cumsum(counts)])
        none = [np.concatenate([[0], np.cumsum(~flag[rows])])[bounds] for flag in (self.agrees, self.returns)]
        return ends[bounds], ids, none[0][1:] == none[0][:-1], none[1][1:] == none[1][:-1]

    def _words(self, texts: list[str]) -> tuple[np.ndarray, pa.DictionaryArray, str]:
        """Words per text, all words as a dictionary, and what each dictionary word begins with."""
        if self.prefix:
            lists = pc.split_pattern(pa.array([t or None for t in texts], pa.string()), " ")
            flat = lists.flatten()
            runs = pc.any(pc.equal(pc.binary_length(flat), 0)).as_py()
            if not runs:  # no two spaces meet: each piece between spaces is a word
                return lists.value_lengths().fill_null(0).to_numpy().astype(np.int64), flat.dictionary_encode(), " "
        found = [WORDS.findall(" " + t if self.prefix else t) if t else [] for t in texts]
        return np.array([len(x) for x in found], np.int64), pa.array([w for x in found for w in x], pa.string()).dictionary_encode(), ""

    def decode(self, lists: list[list[int]]) -> list[str]:
        return self.whole.decode_batch(lists, skip_special_tokens=False)


WORDS = re.compile(" *[^ ]+| +")


def read_model(path: str = MODEL) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def encode_documents(docs: DataFrame, path: str = MODEL, parity: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, token_ids, round_trip, parity.

    Null and empty texts have no tokens.  round_trip: the decoded ids are the text, letter by
    letter (a text that itself holds the space marker is not, in the original library either).  parity: the
    original library gives the same ids.  The model file is read on the driver and sent along.
    """
    data = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, parity)
        for whole in batches:
            for batch in byte_slices(whole, "text", ENCODE_BYTES):
                texts = [t or "" for t in batch.column("text").to_pylist()]
                offsets, ids, same, back = codec.encode(texts)
                lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(np.diff(offsets).astype(np.int64)), lists, pa.array(back), pa.array(same)],
                    ["doc_id", "n_tokens", "token_ids", "round_trip", "parity"],
                )

    return docs.select("doc_id", "text").mapInArrow(released(run), "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean, parity boolean")


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """encoded (doc_id, token_ids) with the decoded text; null ids give the empty text."""
    data = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(data, parity=False)
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = codec.decode([ids or [] for ids in part.column("token_ids").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(released(run), "doc_id long, text string")
