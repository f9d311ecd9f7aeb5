"""Mixing sources to target weights by iterative proportional fitting.

Tokens are counted per cell (source, language, topic).  Cell weights are raked to the target
marginals in turn, and documents are drawn with the calibrated probability of their cell.
Only the table of cells is iterated; the documents are read twice and not shuffled while
the cells fit a broadcast of a checked size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.llm.common import WORD, kept_table

DIMENSIONS = ("source", "lang", "topic")
EXPONENT = 0.7  # default targets: shares of the tokens, raised to this power
ROUNDS = 8
RATE = 1.0  # expected tokens of the sample, as a share of all tokens
BROADCAST_CELLS = 100_000  # about 10 MB
MISSING = "(null)"


def topic_of(text: Column) -> Column:
    """Topic by the form of the text, where the table has no topic of its own."""
    return (
        F.when(F.coalesce(text, F.lit("")) == "", "empty")
        .when(text.rlike(r"\|"), "table")
        .when(text.rlike(r"[%#$&*]{3}"), "markup")
        .when(text.rlike("[0-9]{4}"), "figures")
        .otherwise("prose")
    )


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(doc_id: Column, seed: int = 0) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit(MISSING)), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("double") / float(1 << 48)


def with_cells(docs: DataFrame, topic: Column | None = None) -> DataFrame:
    """(row, _source, _lang, _topic, _tokens): row holds all columns of docs; null is a value of its own."""
    dimensions = [F.coalesce(F.col(d).cast("string"), F.lit(MISSING)).alias(f"_{d}") for d in DIMENSIONS[:2]]
    return docs.select(F.struct("*").alias("row"), *dimensions, (topic if topic is not None else topic_of(F.col("text"))).alias("_topic"), token_count(F.col("text")).alias("_tokens"))


def raked_cells(cells: DataFrame, targets: dict[str, DataFrame] | None = None, exponent: float = EXPONENT, rounds: int = ROUNDS) -> DataFrame:
    """cells (_source, _lang, _topic, tokens) with `weight`: tokens raked to the targets.

    targets[dimension] has (value, share); the shares are scaled to one.  A value without a share
    gets weight 0.  Without a table, shares are the tokens of the value to the power `exponent`.
    Cells without tokens keep weight 0.
    """
    cells = cells.withColumn("weight", F.col("tokens").cast("double"))
    total = float(cells.agg(F.sum("tokens")).first()[0] or 0)
    for d in DIMENSIONS:
        if targets and d in targets:
            given = targets[d].groupBy(F.coalesce(F.col("value").cast("string"), F.lit(MISSING)).alias(f"_{d}")).agg(F.sum("share").cast("double").alias("share"))
            cells = cells.join(given, f"_{d}", "left").withColumn(f"_t{d}", F.coalesce("share", F.lit(0.0))).drop("share")
        else:
            share = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            cells = cells.withColumn(f"_t{d}", F.when(share > 0, F.pow(share, F.lit(exponent))).otherwise(0.0))
    cells = kept_table(cells)
    for d in DIMENSIONS:
        mass = cells.groupBy(f"_{d}").agg(F.max(f"_t{d}").alias("t")).agg(F.sum("t")).first()[0] or 1.0
        cells = cells.withColumn(f"_t{d}", F.col(f"_t{d}") / F.lit(float(mass)) * F.lit(total))
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = F.sum("weight").over(Window.partitionBy(f"_{d}"))
            cells = cells.withColumn("weight", F.when(now > 0, F.col("weight") * F.col(f"_t{d}") / now).otherwise(0.0))
    return kept_table(cells.drop(*(f"_t{d}" for d in DIMENSIONS)))


def calibrated(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rate: float = RATE, seed: int = 0) -> DataFrame:
    """(row, _source, _lang, _topic, _tokens, _probability, _weight, _kept) per row of docs.

    A cell whose weight is w times its tokens has probability min(1, rate * w).  Where that
    is cut at 1, kept documents carry weight rate * w (else 1), so that the expected weighted tokens of
    every cell equal its raked weight times rate.  Documents without tokens are kept with weight 1: they
    move no marginal.  Rows that repeat an id are drawn alike.
    """
    celled = with_cells(docs, topic)
    keys = [f"_{d}" for d in DIMENSIONS]
    cells = raked_cells(celled.groupBy(*keys).agg(F.sum("_tokens").alias("tokens")), targets)
    ratio = cells.select(*keys, F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0).alias("_ratio"))
    if ratio.count() <= BROADCAST_CELLS:
        ratio = F.broadcast(ratio)
    aim = F.when(F.col("_tokens") > 0, F.col("_ratio") * F.lit(float(rate))).otherwise(1.0)
    return celled.join(ratio, keys).withColumns(
        {"_probability": F.least(F.lit(1.0), aim), "_weight": F.greatest(F.lit(1.0), aim), "_kept": uniform(F.col("row.doc_id"), seed) < F.least(F.lit(1.0), aim)}
    )


def mixed(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rate: float = RATE, seed: int = 0) -> DataFrame:
    """The rows of the mixture, with the columns of docs: the expected tokens of every cell are its raked weight times rate.

    A row whose cell has weight w times its tokens is there floor(rate * w) times, and once more with the
    probability of the remainder.  So rows of raised cells repeat, and their ids with them.
    """
    aim = F.col("_probability") * F.col("_weight")  # one of the two is 1
    extra = uniform(F.col("row.doc_id"), seed) < aim - F.floor(aim)
    copies = F.floor(aim).cast("long") + extra.cast("long")
    rows = calibrated(docs, targets, topic, rate, seed).withColumn("_copies", copies).where(F.col("_copies") > 0)
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies")))).select("row.*")


def mixture_sample(docs: DataFrame, targets: dict[str, DataFrame] | None = None, topic: Column | None = None, rate: float = RATE, seed: int = 0) -> DataFrame:
    """One row per document: doc_id, source, lang, topic, n_tokens, probability, weight, kept."""
    rows = calibrated(docs, targets, topic, rate, seed)
    return rows.select(
        "row.doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.col("_probability").alias("probability"), F.col("_weight").alias("weight"), F.col("_kept").alias("kept"),
    )


def raked_sql(source: str, exponent: float = EXPONENT, rounds: int = ROUNDS) -> str:
    """SQL of the raked cells of a relation with _source, _lang, _topic, _tokens."""
    steps = [f"c0 AS (SELECT _source, _lang, _topic, sum(_tokens) AS tokens, sum(_tokens)::DOUBLE AS weight FROM {source} GROUP BY ALL)"]
    shares = ", ".join(f"CASE WHEN sum(weight) OVER (PARTITION BY _{d}) > 0 THEN pow(sum(weight) OVER (PARTITION BY _{d}), {exponent}) ELSE 0 END AS r{d}" for d in DIMENSIONS)
    steps.append(f"c1 AS (SELECT *, {shares} FROM c0)")
    mass = ", ".join(f"r{d} / (SELECT sum(t) FROM (SELECT max(r{d}) AS t FROM c1 GROUP BY _{d})) * (SELECT sum(tokens) FROM c0) AS t{d}" for d in DIMENSIONS)
    steps.append(f"w0 AS (SELECT *, {mass} FROM c1)")
    k = 0
    for _ in range(rounds):
        for d in DIMENSIONS:
            now = f"sum(weight) OVER (PARTITION BY _{d})"
            steps.append(f"w{k + 1} AS MATERIALIZED (SELECT * REPLACE (CASE WHEN {now} > 0 THEN weight * t{d} / {now} ELSE 0 END AS weight) FROM w{k})")
            k += 1
    steps.append(f"ratio AS (SELECT _source, _lang, _topic, CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END AS _ratio FROM w{k})")
    return ",\n".join(steps)


def cells_sql(source: str) -> str:
    """SQL of `source` with the cell columns, tokens and uniform number of every document."""
    return f"""SELECT *, coalesce(source, '{MISSING}') AS _source, coalesce(lang, '{MISSING}') AS _lang,
    CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN contains(text, '|') THEN 'table'
         WHEN regexp_matches(text, '[%#$&*][%#$&*][%#$&*]') THEN 'markup' WHEN regexp_matches(text, '[0-9]{{4}}') THEN 'figures' ELSE 'prose' END AS _topic,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS _tokens,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '{MISSING}') || ':0'), 1, 12))::BIGINT / 281474976710656.0 AS _u FROM {source}"""
