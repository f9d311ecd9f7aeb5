"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

The model's units are the letters of all texts, each with a number of its own, and one for the text's begin.  Counts are
collected per task, summed by n-gram, and turned into probabilities by joins between n-grams, contexts and suffixes, all
keyed and therefore sharded by n-gram.  N-grams of the SYMBOLS - 2 most frequent letters, nearly all of a text, are
looked up in a table of SYMBOLS ** ORDER entries where the documents lie.  N-grams with any other letter have the same
model's probabilities from joins with the sharded tables: each distinct one once, then a sum per document.
A word model would need a join row for every word of every document.

A document is kept when its perplexity does not exceed a quantile of its language's trusted texts
that the model has not seen.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from foldwise.llm.common import byte_slices, fold_of, kept_table

ORDER, SYMBOLS = 4, 64
OTHER, BEGIN = 0, 1
LETTER_BITS = 21  # hold the number of every code point, so a context of three fits a long
FOLDS, HELD_OUT = 5, 0  # trusted rows of the fold HELD_OUT set the thresholds
QUANTILE = 0.99
LEAST_TRUSTED = 30  # languages with fewer held-out trusted texts take the threshold of all
PRIOR = 100  # symbols at the language's mean that are added to every text, which steadies short ones
MISSING = "(null)"


def symbols_of(texts: list[str], alphabet: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, each behind ORDER - 1 begins, and the length of each text."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out = np.full(len(letters) + (ORDER - 1) * len(texts), BEGIN, alphabet.dtype)
    out[places(lengths)] = alphabet[letters]
    return out, lengths


def places(lengths: np.ndarray) -> np.ndarray:
    """Where the letters of all texts are among the symbols."""
    return np.arange(int(lengths.sum())) + (ORDER - 1) * (1 + np.repeat(np.arange(len(lengths)), lengths))


def gram_codes(symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram that ends at every letter of every text, as a number in base SYMBOLS, and whether it has a symbol
    beyond them (its number then says nothing)."""
    size = max(0, len(symbols) - ORDER + 1)
    code, beyond = np.zeros(size, np.int32), np.zeros(size, bool)
    small, large = np.minimum(symbols, SYMBOLS - 1).astype(np.int32), symbols >= SYMBOLS
    for i in range(ORDER):
        code = code * SYMBOLS + small[i : size + i]
        beyond |= large[i : size + i]
    ends = places(lengths) - (ORDER - 1)
    return code[ends], beyond[ends]


def gram_keys(symbols: np.ndarray, lengths: np.ndarray, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, letter) of the n-grams that end at the chosen letters; the symbols of a context take LETTER_BITS each."""
    ends, context = places(lengths)[chosen], np.int64(0)
    for i in range(ORDER - 1, 0, -1):
        context = context << LETTER_BITS | symbols[ends - i].astype(np.int64)
    return context, symbols[ends].astype(np.int64)


def opened_codes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(context, letter) of n-grams given as numbers in base SYMBOLS."""
    codes, context = codes.astype(np.int64), np.int64(0)
    for i in range(ORDER - 1, 0, -1):
        context = context << LETTER_BITS | codes // SYMBOLS**i % SYMBOLS
    return context, codes % SYMBOLS


def counted_rows(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """The distinct rows, sorted by the first column first, and how often each is there."""
    order = np.lexsort(columns[::-1])
    ordered = [c[order] for c in columns]
    change = np.ones(len(order), bool)
    change[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in ordered])
    starts = np.flatnonzero(change)
    return *(c[starts] for c in ordered), np.diff(np.append(starts, len(order)))


def alphabet_of(texts: DataFrame, most: int | None = SYMBOLS - 2) -> np.ndarray:
    """Symbol of every code point, from the letter counts of the texts; letters beyond the `most` frequent
    are OTHER, without `most` every letter has its own symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                joined = "".join(t or "" for t in batch.column("text").to_pylist())
                found, counts = np.unique(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64)), pa.array(counts)], ["letter", "n"])

    counted = texts.select("text").mapInArrow(run, "letter long, n long").groupBy("letter").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()  # one row per code point that occurs
    letters, n = rows["letter"].to_numpy(), rows["n"].to_numpy()
    order = np.lexsort((letters, -n))[:most]
    alphabet = np.zeros(0x110000, np.int32)
    alphabet[letters[order]] = np.arange(2, len(order) + 2)
    return alphabet


def gram_counts(texts: DataFrame, alphabet: np.ndarray) -> DataFrame:
    """(context, letter, count) of the highest order."""
    shared = texts.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                symbols, lengths = symbols_of([t or "" for t in batch.column("text").to_pylist()], shared.value)
                codes, beyond = gram_codes(symbols, lengths)
                grams, counts = np.unique(codes[~beyond], return_counts=True)
                parts = [(*opened_codes(grams), counts), counted_rows(*gram_keys(symbols, lengths, beyond))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], ["context", "letter", "count"])

    return texts.select("text").mapInArrow(run, "context long, letter long, count long").groupBy("context", "letter").agg(F.sum("count").alias("count"))


def last_symbols(n: int) -> Column:
    """The context's last n symbols."""
    return F.col("context").bitwiseAND(F.lit((1 << LETTER_BITS * n) - 1))


def discounts(counts: DataFrame) -> list[float]:
    """The three discounts of an order, from how many n-grams occur once, twice, three and four times."""
    n = counts.agg(*(F.count(F.when(F.col("count") == i, 1)).alias(f"n{i}") for i in (1, 2, 3, 4))).first()
    if not n[0] or not n[1]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.0), float(i)) if n[i - 1] else 0.5 for i in (1, 2, 3)]


def probabilities(highest: DataFrame, symbols: int = SYMBOLS) -> list[tuple[DataFrame, DataFrame]]:
    """For every order from 1: (context, letter, p) of the n-grams seen, and (context, gamma) of their contexts.

    The highest order uses counts; below it an n-gram counts once for every letter seen before it.
    """
    levels = [highest]
    for order in range(ORDER - 1, 0, -1):
        levels.insert(0, kept_table(levels[0].groupBy(last_symbols(order - 1).alias("context"), "letter").agg(F.count("*").alias("count"))))
    out: list[tuple[DataFrame, DataFrame]] = []
    for order, counts in enumerate(levels, 1):
        d = discounts(counts)
        cut = F.when(F.col("count") == 1, d[0]).when(F.col("count") == 2, d[1]).otherwise(d[2])
        contexts = counts.groupBy("context").agg(F.sum("count").alias("total"), F.sum(cut).alias("freed"))
        joined = counts.join(contexts, "context")
        if order == 1:
            joined = joined.withColumn("below", F.lit(1.0 / symbols))
        else:
            lower = out[-1][0].select(F.col("context").alias("suffix"), "letter", F.col("p").alias("below"))
            joined = joined.withColumn("suffix", last_symbols(order - 2)).join(lower, ["suffix", "letter"])
        p = (F.col("count") - cut + F.col("freed") * F.col("below")) / F.col("total")
        out.append((kept_table(joined.select("context", "letter", p.alias("p"))), kept_table(contexts.select("context", (F.col("freed") / F.col("total")).alias("gamma")))))
    return out


def model_table(texts: DataFrame, alphabet: np.ndarray) -> np.ndarray:
    """log10 probability of every possible n-gram of the first SYMBOLS symbols."""
    symbols = symbols_in(alphabet)
    return common_table(probabilities(kept_table(gram_counts(texts, alphabet)), symbols), symbols)


def symbols_in(alphabet: np.ndarray) -> int:
    return max(SYMBOLS, int(alphabet.max()) + 1)


def common_table(levels: list[tuple[DataFrame, DataFrame]], symbols: int) -> np.ndarray:
    """log10 probability of every possible n-gram of the first SYMBOLS symbols: those seen, and gamma times the suffix for others."""
    field = (1 << LETTER_BITS) - 1
    below = np.full(1, 1.0 / symbols)
    for order, (seen, contexts) in enumerate(levels, 1):
        here = [F.shiftright("context", LETTER_BITS * i).bitwiseAND(F.lit(field)) for i in range(order - 1)]
        small = F.lit(True)
        context = F.lit(0).cast("long")
        for i, symbol in enumerate(here):
            small, context = small & (symbol < SYMBOLS), context + symbol * SYMBOLS**i
        gamma = np.ones(SYMBOLS ** (order - 1), np.float32)  # an unseen context leaves everything to the suffix
        rows = contexts.where(small).select(context.alias("context"), "gamma").toArrow()
        gamma[rows["context"].to_numpy()] = rows["gamma"].to_numpy()
        full = _extend(gamma, below.astype(np.float32), order)
        rows = seen.where(small & (F.col("letter") < SYMBOLS)).select((context * SYMBOLS + F.col("letter")).alias("gram"), "p").toArrow()
        full[rows["gram"].to_numpy()] = rows["p"].to_numpy()
        below = full
    return np.log10(below).astype(np.float16)


def looked_up(grams: DataFrame, levels: list[tuple[DataFrame, DataFrame]], symbols: int) -> DataFrame:
    """(context, letter, log10_p) of distinct n-grams, from the sharded tables of all orders."""
    out = grams.withColumn("p", F.lit(1.0 / symbols))
    for order, (seen, contexts) in enumerate(levels, 1):
        out = out.withColumn("_c", last_symbols(order - 1))
        out = out.join(contexts.withColumnRenamed("context", "_c"), "_c", "left")
        out = out.join(seen.select(F.col("context").alias("_c"), "letter", F.col("p").alias("_own")), ["_c", "letter"], "left")
        p = F.coalesce("_own", F.coalesce("gamma", F.lit(1.0)) * F.col("p"))
        out = out.select("context", "letter", p.alias("p"))
    return out.select("context", "letter", F.log10("p").alias("log10_p"))


def _extend(gamma: np.ndarray, below: np.ndarray, order: int) -> np.ndarray:
    """gamma(context) * p(suffix) for all n-grams of an order."""
    if order == 1:
        return np.full(SYMBOLS, gamma[0] * below[0], np.float32)
    suffix = below.reshape(SYMBOLS ** (order - 2), SYMBOLS)  # rows: the context without its first letter
    return (gamma.reshape(SYMBOLS, -1)[:, :, None] * suffix[None]).astype(np.float32).reshape(-1)


def uncommon_grams(docs: DataFrame, alphabet: np.ndarray) -> DataFrame:
    """(context, letter): the distinct n-grams of the texts that have a symbol beyond the first SYMBOLS."""
    shared = docs.sparkSession.sparkContext.broadcast(alphabet)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, "text"):
                symbols, lengths = symbols_of([t or "" for t in batch.column("text").to_pylist()], shared.value)
                found = counted_rows(*gram_keys(symbols, lengths, gram_codes(symbols, lengths)[1]))
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found[:2]], ["context", "letter"])

    return docs.select("text").mapInArrow(run, "context long, letter long").distinct()


def log_probabilities(docs: DataFrame, levels: list[tuple[DataFrame, DataFrame]], alphabet: np.ndarray) -> DataFrame:
    """(doc_id, lang, n_symbols, log10_prob) per row of docs."""
    symbols = symbols_in(alphabet)
    model = docs.sparkSession.sparkContext.broadcast((common_table(levels, symbols), alphabet))  # SYMBOLS ** ORDER half floats and a number per code point

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, letters = model.value
        for whole in batches:
            for batch in byte_slices(whole, "text", 1 << 20):
                coded, lengths = symbols_of([t or "" for t in batch.column("text").to_pylist()], letters)
                codes, beyond = gram_codes(coded, lengths)
                sums = np.concatenate([[0], np.cumsum(np.where(beyond, np.float16(0), values[codes]), dtype=np.float64)])
                ends = np.concatenate([[0], np.cumsum(lengths)])
                owner = np.repeat(np.arange(len(lengths)), lengths)[beyond]
                owner, context, letter, times = counted_rows(owner, *gram_keys(coded, lengths, beyond))
                cuts = pa.array(np.searchsorted(owner, np.arange(len(lengths) + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(cuts, pa.array(c)) for c in (context, letter, times)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("lang"), pa.array(lengths), pa.array(sums[ends[1:]] - sums[ends[:-1]]), *lists],
                    ["doc_id", "lang", "n_symbols", "common", "context", "letter", "times"],
                )

    schema = "doc_id long, lang string, n_symbols long, common double, context array<long>, letter array<long>, times array<long>"
    scored = docs.select("doc_id", F.coalesce("lang", F.lit(MISSING)).alias("lang"), "text").mapInArrow(run, schema)
    if symbols == SYMBOLS:  # no other letters
        return scored.select("doc_id", "lang", "n_symbols", F.col("common").alias("log10_prob"))
    rows = scored.withColumn("row", F.monotonically_increasing_id()).withColumn("_g", F.explode_outer(F.arrays_zip("context", "letter", "times")))
    # a text without such n-grams has a context of its own that is not found, so that these texts do not meet in one task
    rows = rows.select("row", "doc_id", "lang", "n_symbols", "common", F.coalesce("_g.context", -1 - F.col("row")).alias("context"), F.col("_g.letter").alias("letter"), "_g.times")
    found = kept_table(looked_up(kept_table(uncommon_grams(docs, alphabet)), levels, symbols))
    joined = rows.join(found, (rows["context"] == found["context"]) & (F.coalesce(rows["letter"], F.lit(0)) == found["letter"]), "left")
    total = F.first("common") + F.coalesce(F.sum(F.col("times") * F.col("log10_p")), F.lit(0.0))
    return joined.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("lang").alias("lang"), F.first("n_symbols").alias("n_symbols"), total.alias("log10_prob")).drop("row")


def quality_verdicts(docs: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """One row per row of docs: doc_id, lang, n_symbols, log10_prob, perplexity, threshold, keep.

    trusted: doc_id of texts to learn from.  perplexity is per letter, with PRIOR letters at the
    language's mean added.  Texts without letters (null, empty) have no perplexity and are not
    kept; a null lang is a language of its own ('(null)').  Without trusted texts all letters are equally likely and
    every other text is kept.  Rows that repeat are judged alike.
    """
    ids = trusted.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()
    seen = docs.select("doc_id", "text").where(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).join(ids.hint("merge"), "doc_id", "left_semi")
    texts = seen.select("text")
    alphabet = alphabet_of(docs, None)
    levels = probabilities(kept_table(gram_counts(texts, alphabet)), symbols_in(alphabet))
    scores = kept_table(log_probabilities(docs, levels, alphabet))
    means = scores.groupBy("lang").agg((F.sum("log10_prob") / F.greatest(F.sum("n_symbols"), F.lit(1))).alias("mean"))
    rated = scores.join(means, "lang").withColumn(
        "perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(10.0), -(F.col("log10_prob") + PRIOR * F.col("mean")) / (F.col("n_symbols") + PRIOR)))
    )
    unseen = rated.where((fold_of(F.col("doc_id"), FOLDS) == HELD_OUT) & F.col("perplexity").isNotNull()).join(ids, "doc_id", "left_semi")
    at = F.percentile_approx("perplexity", F.lit(quantile), F.lit(10000))
    own = unseen.groupBy("lang").agg(F.count("*").alias("n"), at.alias("own")).where(F.col("n") >= LEAST_TRUSTED).drop("n")
    every = unseen.agg(at).first()[0]
    limit = F.coalesce("own", F.lit(every if every is not None else math.inf))
    return rated.join(own, "lang", "left").select(
        "doc_id", "lang", "n_symbols", "log10_prob", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(False)).alias("keep")
    )
