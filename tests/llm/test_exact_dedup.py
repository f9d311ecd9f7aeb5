import hashlib
import random

import numpy as np

from foldwise.llm import exact_dedup


def brute(rows):
    groups = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(text or "", []).append(doc_id)
    out = []
    for doc_id, text, *_ in rows:
        ids = groups[text or ""]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256((text or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups_of_odd_rows(odd):
    rows = [tuple(r) for r in odd.collect()]
    got = exact_dedup.exact_groups(odd).drop("n_chunks").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_empty_table(none):
    assert exact_dedup.exact_groups(none).count() == 0 and exact_dedup.drop_exact_copies(none).count() == 0


def test_one_row_per_text_stays_with_all_columns(odd):
    kept = exact_dedup.drop_exact_copies(odd)
    assert kept.columns == odd.columns
    texts = [r["text"] or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r["text"] or "" for r in odd.collect()})


def test_equal_texts_have_equal_chunks_anywhere():
    rng = random.Random(5)
    body = bytes(rng.randrange(97, 123) for _ in range(60_000))
    texts = [body, b"x" * 1000, body, b"", b"y" + body]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    ends = exact_dedup.chunk_ends(offsets, data)
    lengths = [np.diff([start, *cut]).tolist() for start, cut in zip(offsets, ends)]
    assert lengths[0] == lengths[2] and sum(lengths[0]) == len(body) and lengths[3] == []
    assert max(lengths[0]) <= exact_dedup.LONGEST
    assert lengths[4][-5:] == lengths[0][-5:]  # an insertion moves only the chunks near it


def test_kernels_give_memory_back_after_their_last_batch(monkeypatch):
    from foldwise.llm import common

    calls = []
    monkeypatch.setattr(common, "release_memory", lambda: calls.append(1))
    out = common.released(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))
    assert next(out) == 2 and not calls
    assert list(out) == [4, 6] and calls == [1]
