"""Corpus preparation: language, exact copies, near copies, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns the rows it keeps, with the columns of
documents; the last returns the encoded texts.  Between stages rows are written as Parquet.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from foldwise.llm import exact_dedup, jaccard_pivots, language_crf, mixing, sentencepiece_codec
from foldwise.llm.common import drop_finished_shuffles
from foldwise.session import shared_folder

LEAST_SCORE = 0.4  # least mean over the words of the probability of each word's own best language


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found; a missing lang is filled in, a given one stays.

    Texts without a letter, and texts whose words are in doubt (certainty below LEAST_SCORE), go.  A text in
    several languages stays: each of its words is certain.
    """
    found = language_crf.detect_languages(docs, carry=True)
    kept = found.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("certainty") >= LEAST_SCORE))
    taken = {"lang": F.coalesce("row.lang", "lang_pred").alias("lang"), "text": F.col("text")}
    columns = [taken[c] if c in taken else F.col(f"row.`{c}`") for c in docs.columns]
    return kept.select(*columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_pivots.drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: rows of cells below their target repeat, of cells above it are drawn; see mixing.mixed."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, token_ids, round_trip, parity."""
    return sentencepiece_codec.encode_documents(docs)


STAGES = [
    ("language_id", keep_known_languages),
    ("exact_dedup", drop_exact_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode),
]

# The field's training and the codec have no counterpart in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written to the shared folder and read again."""
    place = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        path = f"{place}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        drop_finished_shuffles(spark)
    return docs
