import math
import random

import numpy as np
import pytest

from foldwise.llm import kneser_ney as kn
from tests.llm.test_kneser_ney import plain_model


def test_every_letter_counts(spark, monkeypatch):
    """More letters than the table holds: every text has the probability of a model of all letters."""
    rng = random.Random(5)
    letters = [chr(c) for c in (*range(0x61, 0x7B), *range(0x430, 0x450), *range(0x4E00, 0x4E3C))]
    odds = [1 / (i + 3) for i in range(len(letters))]
    texts = ["".join(rng.choices(letters, odds, k=rng.randrange(1, 300))) for _ in range(40)] + ["", None, "aaa", letters[-1] * 3]
    once, twice = ([chr(c) for c in range(a, a + 10)] for a in (0x3041, 0x30A1))  # discounts need letters behind one and two others
    texts[0] += "".join(once + twice) + "a".join(twice)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").selectExpr("doc_id", "'x' AS lang", "text")
    learn = docs.where("doc_id < 30").select("text")
    alphabet = kn.alphabet_of(docs, None)
    assert len(np.flatnonzero(alphabet)) == len(set("".join(t or "" for t in texts))) > kn.SYMBOLS
    levels = kn.probabilities(kn.gram_counts(learn, alphabet), kn.symbols_in(alphabet))
    got = {r["doc_id"]: r["log10_prob"] for r in kn.log_probabilities(docs, levels, alphabet).collect()}
    monkeypatch.setattr(kn, "SYMBOLS", kn.symbols_in(alphabet))
    numbers, p = plain_model(texts[:30])
    for i, text in enumerate(texts):
        # letters that the model has not seen have numbers too
        coded = [1] * (kn.ORDER - 1) + [numbers.setdefault(c, len(numbers) + 2) for c in text or ""]
        want = sum(math.log10(p(tuple(coded[j - kn.ORDER + 1 : j + 1]))) for j in range(kn.ORDER - 1, len(coded)))
        assert got[i] == pytest.approx(want, rel=2e-3)


def test_rare_script_is_told_apart(spark):
    """Good and shuffled texts of a script outside the most frequent letters differ in perplexity."""
    rng = random.Random(6)
    latin = [chr(c) for c in range(0x21, 0x7F)]
    common = [(i, "en", "".join(latin) * 8) for i in range(60)]
    word = "".join(chr(c) for c in range(0x430, 0x43A))
    good = [(100 + i, "ru", word * 10) for i in range(20)]
    junk = [(200 + i, "ru", "".join(rng.sample(word * 10, 100))) for i in range(20)]
    docs = spark.createDataFrame(common + good + junk, "doc_id long, lang string, text string")
    rows = kn.quality_verdicts(docs, docs.where("doc_id < 200").select("doc_id")).collect()
    of = {r["doc_id"]: r["perplexity"] for r in rows}
    assert max(of[100 + i] for i in range(20)) * 1.2 < min(of[200 + i] for i in range(20))
