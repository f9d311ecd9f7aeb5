import pytest

from foldwise.llm import mixing


def test_marginals_meet_their_targets(spark, small):
    docs = mixing.with_cells(spark.read.parquet(f"{small}/documents.parquet"))
    cells = docs.groupBy("_source", "_lang", "_topic").agg({"_tokens": "sum"}).withColumnRenamed("sum(_tokens)", "tokens")
    target = spark.createDataFrame([("en", 1.0), ("fr", 1.0), ("de", 1.0), ("es", 1.0)], "value string, share double")
    raked = mixing.raked_cells(cells, {"lang": target}, rounds=25).toPandas()
    shares = raked.groupby("_lang").weight.sum() / raked.weight.sum()
    assert shares.tolist() == pytest.approx([0.25] * 4, abs=1e-3)
    assert raked.weight.sum() == pytest.approx(raked.tokens.sum(), rel=1e-6)


def test_weighted_sample_follows_the_cells(spark, small):
    sample = mixing.mixture_sample(spark.read.parquet(f"{small}/documents.parquet")).toPandas()
    aim = (sample.n_tokens * sample.probability * sample.weight).groupby(sample.lang).sum()
    got = (sample.n_tokens * sample.kept * sample.weight).groupby(sample.lang).sum()
    assert ((aim - got).abs() / aim < 0.25).all() and sample.probability.between(0, 1).all()


def test_odd_rows_and_empty_table(odd, none):
    rows = mixing.mixture_sample(odd).collect()
    assert len(rows) == odd.count()
    assert all(r["kept"] and r["weight"] == 1.0 for r in rows if r["n_tokens"] == 0)
    assert {r["source"] for r in rows} == {"a", "b", "c", mixing.MISSING}
    twins = [(r["kept"], r["probability"]) for r in rows if r["doc_id"] == 9]
    assert twins[0] == twins[1]
    assert mixing.mixture_sample(none).count() == 0
    assert mixing.calibrated(odd).select("row.*").columns == odd.columns


def test_rows_of_the_mixture_meet_the_raked_shares(spark):
    """A hot source: 1,800 rows of one cell and 20 to 100 of the others, ten words each."""
    cells = [("a", "en", "plain words", 1800), ("a", "de", "in 1999", 40), ("b", "en", "a | b", 100), ("b", "de", "plain words", 40), ("c", "en", "in 1999", 20)]
    rows = [(source, lang, text + " x" * (10 - len(text.split()))) for source, lang, text, n in cells for _ in range(n)]
    docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, source string, lang string, text string")
    counted = mixing.with_cells(docs).groupBy("_source", "_lang", "_topic").agg({"_tokens": "sum"}).withColumnRenamed("sum(_tokens)", "tokens")
    raked = mixing.raked_cells(counted).toPandas()
    out = mixing.with_cells(mixing.mixed(docs))
    assert mixing.mixed(docs).columns == docs.columns
    for d in ("_source", "_lang", "_topic"):
        got = out.groupBy(d).agg({"_tokens": "sum"}).toPandas().set_index(d)["sum(_tokens)"]
        want = raked.groupby(d).weight.sum()
        assert (got / got.sum() - want / want.sum()).abs().max() < 0.02, d
    assert abs(got.sum() / raked.tokens.sum() - 1) < 0.05
