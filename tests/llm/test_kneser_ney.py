import collections

import numpy as np
import pytest

from foldwise.llm import kneser_ney as kn


def plain_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries; symbols are letters, '^' is the begin."""
    letters = collections.Counter("".join(texts))
    alphabet = {c: i + 2 for i, (c, _) in enumerate(sorted(letters.items(), key=lambda x: (-x[1], ord(x[0])))[: kn.SYMBOLS - 2])}
    coded = [[1] * (kn.ORDER - 1) + [alphabet.get(c, 0) for c in t] for t in texts]
    counts = {kn.ORDER: collections.Counter(tuple(t[i - kn.ORDER + 1 : i + 1]) for t in coded for i in range(kn.ORDER - 1, len(t)))}
    for order in range(kn.ORDER - 1, 0, -1):
        counts[order] = collections.Counter(g[1:] for g in counts[order + 1])
    tables = {}
    for order, own in counts.items():
        n = [sum(c == i for c in own.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1])
        cut = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0), i) if n[i - 1] else 0.5 for i in (1, 2, 3)]
        total, freed = collections.Counter(), collections.Counter()
        for g, c in own.items():
            total[g[:-1]] += c
            freed[g[:-1]] += cut[min(c, 3) - 1]
        tables[order] = (own, cut, total, freed)

    def p(gram):
        if not gram:
            return 1 / kn.SYMBOLS
        own, cut, total, freed = tables[len(gram)]
        if not total[gram[:-1]]:
            return p(gram[1:])
        c = own[gram]
        return (c - (cut[min(c, 3) - 1] if c else 0) + freed[gram[:-1]] * p(gram[1:])) / total[gram[:-1]]

    return alphabet, p


def test_table_equals_plain_model_and_sums_to_one(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").where("doc_id < 12").select("text")
    texts = [r["text"] for r in docs.collect()]
    alphabet = kn.alphabet_of(docs)
    table = 10.0 ** kn.model_table(docs, alphabet).astype(np.float64)
    letters, p = plain_model(texts)
    assert {chr(c): int(alphabet[c]) for c in np.flatnonzero(alphabet)} == letters
    assert np.allclose(table.reshape(-1, kn.SYMBOLS).sum(axis=1), 1, atol=0.01)
    rng = np.random.default_rng(0)
    grams = [tuple(rng.integers(0, 40, kn.ORDER).tolist()) for _ in range(300)]
    seen = [1] * (kn.ORDER - 1) + [letters.get(c, 0) for c in texts[0]]
    grams += [tuple(seen[i : i + kn.ORDER]) for i in range(300)]
    for g in grams:
        assert table[int(np.ravel_multi_index(g, (kn.SYMBOLS,) * kn.ORDER))] == pytest.approx(p(g), rel=0.01)


def test_good_texts_stay_and_junk_goes(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = kn.quality_verdicts(docs, labels.where("quality = 1 and toxic = 0"))
    share = {r["quality"]: r["s"] for r in rows.join(labels, "doc_id").groupBy("quality").agg({"keep": "count"}).selectExpr("quality", "`count(keep)` s").collect()}
    kept = {r["quality"]: r["n"] for r in rows.where("keep").join(labels, "doc_id").groupBy("quality").count().withColumnRenamed("count", "n").collect()}
    assert kept[1] / share[1] > 0.95 and kept.get(0, 0) / share[0] < 0.35


def test_odd_rows(spark, odd, none):
    trusted = spark.createDataFrame([(1,), (6,), (7,), (None,)], "doc_id long")
    rows = kn.quality_verdicts(odd, trusted).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert (r["perplexity"] is None and not r["keep"]) if r["doc_id"] in (3, 4) else r["perplexity"] > 0
    free = kn.quality_verdicts(odd, trusted.where("doc_id < 0")).collect()
    assert all(r["keep"] == (r["n_symbols"] > 0) for r in free)
    assert kn.quality_verdicts(none, trusted).count() == 0
