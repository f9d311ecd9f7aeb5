import pytest

import corpus_pipeline
from foldwise.llm import language_crf as crf, mixing
from tests.llm.test_jaccard_pivots import brute


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The rows before and after every stage."""
    place = tmp_path_factory.mktemp("stages")
    tables = [spark.read.parquet(f"{small}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], small).write.parquet(f"{place}/{name}")
        tables.append(spark.read.parquet(f"{place}/{name}"))
    return tables


def ids(table):
    return {r["doc_id"] for r in table.select("doc_id").collect()}


def test_columns_stay(stages):
    assert all(t.columns == stages[0].columns for t in stages[1:-1])


def test_language_stage_drops_texts_without_language_only(stages):
    gone = ids(stages[0]) - ids(stages[1])
    assert len(gone) <= 0.01 * stages[0].count()
    given = stages[0].join(stages[1].selectExpr("doc_id", "lang AS after"), "doc_id").where("lang is not null and lang <> after")
    assert given.count() == 0


def test_language_stage_keeps_a_text_in_three_languages(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    given = docs.where("n_chars between 300 and 2000 and lang in ('en', 'de', 'fr')").orderBy("doc_id").toPandas()
    parts = [" ".join(" ".join(given[given.lang == x].text.iloc[:3]).split()[:60]) for x in ("en", "de", "fr")]
    added = spark.createDataFrame([(-5, " ".join(parts))], "doc_id long, text string")
    table = docs.unionByName(added, allowMissingColumns=True)
    row = crf.detect_languages(table, carry=True).where("row.doc_id = -5").first()
    assert row["score"] < corpus_pipeline.LEAST_SCORE < 0.9 < row["certainty"]
    assert corpus_pipeline.keep_known_languages(spark, table, small).where("doc_id = -5").count() == 1


def test_exact_stage_keeps_the_largest_id_of_every_text(stages):
    want = {r["m"] for r in stages[1].groupBy("text").agg({"doc_id": "max"}).withColumnRenamed("max(doc_id)", "m").collect()}
    assert ids(stages[2]) == want


def test_near_stage_keeps_the_smallest_id_of_every_class(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == {component for _, _, component in brute(rows)}


def test_mixing_stage_keeps_the_calibrated_sample(stages):
    sample = mixing.mixture_sample(stages[3])
    assert ids(stages[4]) == ids(sample.where("kept"))


def test_mixing_stage_meets_the_raked_shares(stages):
    counted = mixing.with_cells(stages[3]).groupBy("_source", "_lang", "_topic").agg({"_tokens": "sum"}).withColumnRenamed("sum(_tokens)", "tokens")
    raked = mixing.raked_cells(counted).toPandas()
    out = mixing.with_cells(stages[4])
    for d in ("_source", "_lang", "_topic"):
        got = out.groupBy(d).agg({"_tokens": "sum"}).toPandas().set_index(d)["sum(_tokens)"]
        want = raked.groupby(d).weight.sum()
        print(d, (got / got.sum()).round(3).to_dict(), (want / want.sum()).round(3).to_dict())
        assert (got / got.sum() - want / want.sum()).abs().max() < 0.05, d


def test_all_remaining_texts_are_encoded(stages):
    assert ids(stages[5]) == ids(stages[4]) and stages[5].where("not parity or not round_trip or n_tokens <> size(token_ids)").count() == 0


def test_run_equals_the_stages(spark, small, stages):
    assert sorted(map(str, corpus_pipeline.run(spark, small).collect())) == sorted(map(str, stages[-1].collect()))


def test_odd_rows_pass_all_stages(spark, odd, none, tiny):
    for start in (odd, none):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, docs, tiny)
            assert name == "sentencepiece" or after.columns == start.columns
            docs = spark.createDataFrame(after.collect(), after.schema)
        assert (docs.count() == 0) == (start is none)
