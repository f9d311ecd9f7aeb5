import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from foldwise.llm import best_fit_packing as packing
from foldwise.llm.queries import QUERIES


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(packing.vocabulary_path())
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ids_equal_whole_texts(plain):
    encode = packing.Encoder(packing.vocabulary_path())
    rng = random.Random(5)
    signs = ["a", "Straße", "don't", " ", "  ", "\n", "\t", "\x1c", " ", " ", "12", "日本", "é", "é", "<|endoftext|>", "!?", "​", "\u0085", "'s"]
    for _ in range(3000):
        text = "".join(rng.choice(signs + [" "] * 8) for _ in range(rng.randrange(30)))
        assert encode(text) == np.array(plain(text), "<u4").tobytes(), repr(text)


def test_ids_equal_on_all_shared_texts(spark, small, plain):
    encode = packing.Encoder(packing.vocabulary_path())
    for r in spark.read.parquet(f"{small}/documents.parquet").collect():
        assert encode(r.text or "") == np.array(plain(r.text), "<u4").tobytes()


def test_long_texts_in_parts(plain, monkeypatch):
    encode = packing.Encoder(packing.vocabulary_path())
    blank = " " * 2_000_000 + "x"
    assert encode(blank) == np.array(plain(blank), "<u4").tobytes()
    monkeypatch.setattr(packing, "PART_CHARS", 50)
    rng = random.Random(8)
    for _ in range(200):
        text = "".join(rng.choice(["word", " ", " ", "\n", "it's", "9", "é", "  "]) for _ in range(400))
        assert encode(text) == np.array(plain(text), "<u4").tobytes()


def test_other_vocabularies_use_their_own_library(tmp_path, plain):
    import json

    with open(packing.vocabulary_path(), encoding="utf-8") as file:
        given = json.load(file)
    given["normalizer"] = {"type": "Lowercase"}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(given), encoding="utf-8")
    encode = packing.Encoder(str(path))
    assert encode.fast is None and encode("HELLO there") == np.array(plain("hello there"), "<u4").tobytes()


def test_best_fit_is_the_plain_one():
    rng = random.Random(3)
    for limit in (1, 2, 7, 50):
        bins, fast, made = [], packing.OpenSequences(64, limit), 0
        for _ in range(600):
            size = rng.randrange(1, 65)
            number, place = fast.place(size)
            fitting = [b for b in bins if b[0] >= size]
            best = min((b[0] for b in fitting), default=None)
            if best is None:
                assert (number, place) == (made, 0)
                made += 1
                free = 64
            else:
                mine = next(b for b in bins if b[1] == number)
                assert mine[0] == best and place == 64 - best
                bins.remove(mine)
                free = best
            if free > size:
                if len(bins) == limit:
                    least = min(b[0] for b in bins)
                    gone = {n for f in fast.by_free.values() for n in f}
                    closed = [b for b in bins if b[1] not in gone]
                    assert len(closed) == 1 and closed[0][0] == least
                    bins.remove(closed[0])
                bins.append((free - size, number))
            assert fast.open == len(bins) <= limit


def check(rows, given, plain, length):
    texts = {}
    for doc_id, text in given:
        texts.setdefault(doc_id, []).append(plain(text) + [0])
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc_id, lists in texts.items():
        wanted = []
        for ids in lists:
            at, stop, k = 0, len(ids) % length or length, 0
            while at < len(ids):
                wanted.append((k, at, stop - at, zlib.crc32(np.array(ids[at:stop], "<u4").tobytes())))
                at, stop, k = stop, stop + length, k + 1
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in pieces.pop(doc_id)) == sorted(wanted)
    assert not pieces
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        at = 0
        for offset, size in sorted(parts):
            assert offset == at
            at += size
        assert at <= length
    return len(used), sum(r.length for r in rows)


def test_odd_rows(spark, odd, none, plain):
    given = [(r.doc_id, r.text) for r in odd.collect()]
    rows = packing.packed_pieces(odd.withColumnRenamed("row", "ids").withColumn("_row", odd.doc_id), length=100, shard_pieces=7, open_bins=3).collect()
    check(rows, given, plain, 100)
    assert packing.packed_pieces(none).count() == 0


def test_query_packs_tightly(spark, small, plain):
    given = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op11_best_fit_packing"](spark, small).collect()
    sequences, tokens = check(rows, given, plain, packing.SEQUENCE_TOKENS)
    assert sequences <= -(-tokens // packing.SEQUENCE_TOKENS) + 2


def test_sequences_hold_their_pieces(spark, odd):
    packed = packing.packed_pieces(odd, length=100, with_ids=True)
    whole = {r.sequence_id: r for r in packing.token_sequences(packed).collect()}
    for r in packed.collect():
        at = 4 * r.offset
        assert bytes(whole[r.sequence_id].ids)[at : at + 4 * r.length] == bytes(r.ids)
    assert sum(r.n_tokens for r in whole.values()) == sum(len(r.ids) // 4 for r in whole.values())
