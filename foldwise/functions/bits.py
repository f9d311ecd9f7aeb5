"""Fingerprints as packed 64-bit words, built and compared with column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

WORD = 64


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _bit(position: Column) -> Column:
    # The shift count must be INT; Spark shifts BIGINT words in two's complement.
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(position, F.lit(WORD)).cast("int"))


def pack_bits(bits: Column | str, n_bits: int) -> Column:
    """Distinct on-bit positions to ``n_bits / 64`` words."""
    bits = _col(bits)
    words = F.sequence(F.lit(0), F.lit((n_bits + WORD - 1) // WORD - 1))

    def word(w: Column) -> Column:
        inside = F.filter(bits, lambda b: F.floor(b / WORD) == w)
        return F.aggregate(inside, F.lit(0).cast("bigint"), lambda acc, b: acc.bitwiseOR(_bit(b)))

    return F.transform(words, word)


def sign_bits(vector: Column | str) -> Column:
    """Positions of the positive components of a dense vector."""
    numbered = F.transform(_col(vector), lambda x, i: F.when(x > 0, i))
    return F.filter(numbered, lambda i: i.isNotNull())


def token_words(df: DataFrame, keys: Sequence[str], text: str, n_bits: int, name: str = "words") -> DataFrame:
    """Hashed token fingerprint of the whole text of each key.

    Tokens become rows, and one aggregation ORs them into the words.  The partial
    aggregation leaves one row per document and task, so however long a text is,
    only its words are shuffled.
    """
    tokens = df.select(*keys, F.explode_outer(F.split(F.col(text), r"[ \n\t\r]+")).alias("_token"))
    hashed = F.conv(F.substring(F.md5("_token"), 1, 8), 16, 10).cast("bigint") % n_bits
    placed = tokens.select(*keys, F.when(F.col("_token") != "", hashed).alias("_b"))
    placed = placed.select(*keys, F.floor(F.col("_b") / WORD).alias("_w"), _bit(F.col("_b")).alias("_v"))
    words = [
        F.coalesce(F.bit_or(F.when(F.col("_w") == w, F.col("_v"))), F.lit(0).cast("bigint"))
        for w in range((n_bits + WORD - 1) // WORD)
    ]
    return placed.groupBy(*keys).agg(F.array(*words).alias(name))


def on_bits(words: Column | str) -> Column:
    """Positions of the set bits of packed words."""
    words = _col(words)
    every = F.sequence(F.lit(0), F.size(words) * WORD - 1)
    return F.filter(every, lambda b: F.get(words, F.floor(b / WORD).cast("int")).bitwiseAND(_bit(b)) != 0)


def popcount(words: Column | str) -> Column:
    return F.aggregate(_col(words), F.lit(0), lambda acc, w: acc + F.bit_count(w))


def tanimoto(a: Column | str, b: Column | str) -> Column:
    """Shared bits over all bits; two empty fingerprints count as identical."""
    a, b = _col(a), _col(b)
    shared = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseAND(y))), F.lit(0), lambda acc, n: acc + n)
    union = popcount(a) + popcount(b) - shared
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)
