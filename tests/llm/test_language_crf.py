import numpy as np
import pytest

from foldwise.llm import language_crf as crf


def forward_backward(scores, field):
    move, emit = np.exp(field.transitions), np.exp(scores)
    alpha, beta = np.zeros_like(emit), np.ones_like(emit)
    alpha[0] = np.exp(field.start) * emit[0]
    alpha[0] /= alpha[0].sum()
    for t in range(1, len(emit)):
        alpha[t] = alpha[t - 1] @ move * emit[t]
        alpha[t] /= alpha[t].sum()
    for t in range(len(emit) - 2, -1, -1):
        beta[t] = move @ (emit[t + 1] * beta[t + 1])
        beta[t] /= beta[t].sum()
    both = alpha * beta
    return both / both.sum(axis=1, keepdims=True)


def test_blocked_passes_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    field = crf.Field(["a", "b", "c"], np.zeros((4, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    bounds = np.cumsum([0, 1, 5, 63, 64, 65, 128, 200])
    scores = rng.normal(size=(bounds[-1], 3))
    got = crf.marginals(scores, bounds, field)
    for a, b in zip(bounds, bounds[1:]):
        assert got[a:b] == pytest.approx(forward_backward(scores[a:b], field))


def test_gradient_is_that_of_the_likelihood():
    rng = np.random.default_rng(1)
    scores, gold = rng.normal(size=(1, 6, 2)), rng.integers(0, 2, (1, 6))
    move, start = rng.normal(size=(2, 2)), rng.normal(size=2)

    def likelihood(s, m, b):
        paths = np.array(np.meshgrid(*[[0, 1]] * 6)).reshape(6, -1).T
        value = lambda p: b[p[0]] + s[0][np.arange(6), p].sum() + m[p[:-1], p[1:]].sum()
        return value(gold[0]) - np.log(sum(np.exp(value(p)) for p in paths))

    one, two, three = crf._batch_gradient(scores, gold, move, start)
    for array, gradient, at in ((scores, one, (0, 2, 1)), (move, two, (0, 1)), (start, three, (1,))):
        up, down = array.copy(), array.copy()
        up[at] += 1e-5
        down[at] -= 1e-5
        parts = [[x if x is not array else y for x in (scores, move, start)] for y in (up, down)]
        assert gradient[at] == pytest.approx((likelihood(*parts[0]) - likelihood(*parts[1])) / 2e-5, abs=1e-6)


@pytest.fixture(scope="module")
def field(spark, small):
    return crf.fit_on(spark.read.parquet(f"{small}/documents.parquet"))


def test_held_out_accuracy(spark, small, field):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    held = crf.detect_languages(docs, field).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").where("lang is not null").toPandas()
    assert len(held) > 100 and (held.lang_pred == held.lang).mean() > 0.98 and held.score.between(0, 1).all()


def test_switched_text_has_a_stretch_per_language(spark, small, field):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("n_chars between 300 and 2000 and lang in ('en', 'de')").toPandas()
    en, de = (docs[docs.lang == x].text.iloc[0][:200] for x in ("en", "de"))
    table = spark.createDataFrame([(1, f"{en} {de}")], "doc_id long, text string")
    stretches = crf.detect_languages(table, field).first()["stretches"]
    assert [s["lang"] for s in stretches if s["words"] > 5] == ["en", "de"]


def test_odd_rows(odd, none, field):
    rows = crf.detect_languages(odd, field).collect()
    assert len(rows) == odd.count()
    for r in rows:
        if r["doc_id"] in (3, 4, 5, 10):
            assert (r["lang_pred"], r["score"], r["n_words"], r["stretches"]) == ("und", 0.0, 0, [])
        else:
            assert r["lang_pred"] in field.labels and sum(r["shares"].values()) == pytest.approx(1)
    assert crf.detect_languages(none).count() == 0
    assert {r["lang_pred"] for r in crf.detect_languages(odd.where("lang is null")).collect()} == {"und"}
    assert crf.detect_languages(odd, field, carry=True).select("row.*", "text").columns == [*(c for c in odd.columns if c != "text"), "text"]


def test_sample_has_every_language_behind_a_very_long_row(spark):
    rows = [(i, ("wort satz " if i % 2 else "word line ") * 5, "de" if i % 2 else "en") for i in range(2, 900)] + [(901, "mot rare " * 20, "fr")]
    ids = spark.createDataFrame([(i,) for i in range(2000, 4000)], "doc_id long").selectExpr("doc_id", "xxhash64(doc_id) h")
    first = ids.orderBy("h").first()  # before all other rows in the order of the sample
    assert first["h"] < spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("min(xxhash64(doc_id)) h").first()["h"]
    docs = spark.createDataFrame([*rows, (first["doc_id"], "lang word " * 500_000, "en")], "doc_id long, text string, lang string")
    every = docs["doc_id"].isNotNull()
    sample = crf.training_sample(docs, every, docs_per_language=1000)
    assert len(sample) == docs.count() and {lang for _, lang in sample} == {"de", "en", "fr"}
    assert max(len(text) for text, _ in sample) == crf.SAMPLE_PIECE
    few = crf.training_sample(docs, every, docs_per_language=0)
    assert sorted(lang for _, lang in few) == ["de", "en", "fr"]


def test_languages_have_budgets_of_their_own(spark):
    docs = spark.range(40).selectExpr("id AS doc_id", "repeat('some words ', 50000) AS text", "concat('l', id % 4) AS lang")
    sample = crf.training_sample(docs, docs["doc_id"] >= 0)
    assert len(sample) == 40
