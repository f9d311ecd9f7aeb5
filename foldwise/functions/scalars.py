"""Column builders: the scalar vocabulary of the engine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

# Group-key labels with a reserved meaning.
EMPTY_GROUP = "No_Scaffold"
INVALID_GROUP = "Invalid_SMILES"
FAILED_GROUP = "Error"

# Which labels count as "no group" in each kind of analysis.
EMPTY_LABELS = {
    "library": (EMPTY_GROUP,),
    "splitter": (EMPTY_GROUP,),
    "repair": (INVALID_GROUP, EMPTY_GROUP, FAILED_GROUP),
    "evaluation": (EMPTY_GROUP, INVALID_GROUP, FAILED_GROUP, ""),
}

# Size limits and the (train, valid, test) slots that go with them.
SIZE_RULES = ((1000, (3, 1, 1)), (3000, (5, 1, 1)), (None, (8, 1, 1)))

SPLITS = ("train", "valid", "test")


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def known(value: Column | str) -> Column:
    """NaN becomes NULL, so that aggregates skip it and sorts place it last."""
    value = _col(value)
    return F.when(~F.isnan(value), value)


def to_number(value: Column | str) -> Column:
    """Lenient cast of anything to DOUBLE; what does not parse becomes NULL."""
    return known(_col(value).try_cast("double"))


def finite(value: Column | str) -> Column:
    """NULL, NaN and both infinities become NULL."""
    value = _col(value).cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def open_ratio(top: Column, bottom: Column) -> Column:
    """x / y where a zero divisor gives a signed infinity and 0 / 0 gives NULL."""
    return F.when(
        bottom == 0,
        F.when(top > 0, F.lit(float("inf"))).when(top < 0, F.lit(float("-inf"))),
    ).otherwise(F.try_divide(top, bottom))


def share(condition: Column) -> Column:
    """Aggregate: fraction of rows where the condition holds; NULL counts as False."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("int"))


def count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.coalesce(condition, F.lit(False)).cast("long")), F.lit(0).cast("long"))


def is_empty_group(group: Column | str, variant: str = "library") -> Column:
    return F.coalesce(_col(group).isin(*EMPTY_LABELS[variant]), F.lit(False))


def is_invalid_group(group: Column | str) -> Column:
    return F.coalesce(_col(group).isin(INVALID_GROUP, FAILED_GROUP), F.lit(False))


def group_status(is_empty: Column | str) -> Column:
    return F.when(_col(is_empty), F.lit("no_scaffold")).otherwise(F.lit("scaffold_bearing"))


def _by_size(n: Column, pick) -> Column:
    out = None
    for limit, slots in SIZE_RULES:
        value = F.lit(pick(slots))
        if limit is None:
            return out.otherwise(value)
        out = F.when(n <= limit, value) if out is None else out.when(n <= limit, value)
    return out


def fold_count(n: Column | str) -> Column:
    """How many folds a dataset of n members gets."""
    return _by_size(_col(n), sum)


def split_slots(n: Column | str, split: str) -> Column:
    return _by_size(_col(n), lambda slots: slots[SPLITS.index(split)])


def split_ratio(n: Column | str, split: str) -> Column:
    return split_slots(n, split).cast("double") / fold_count(n)


def slot_text(n: Column | str) -> Column:
    return _by_size(_col(n), lambda slots: ":".join(map(str, slots)))


def target_counts(n: Column | str, ratios: Sequence[Column] | None = None) -> Column:
    """Largest-remainder rounding of n into (train, valid, test) counts.

    Left-over members go to the largest fractions; equal fractions are served in
    the order train, valid, test.  Returns a struct of three BIGINTs.
    """
    n = _col(n)
    ratios = ratios or [split_ratio(n, s) for s in SPLITS]
    raw = [r * n for r in ratios]
    base = [F.floor(x) for x in raw]
    rest = n - (base[0] + base[1] + base[2])
    order = F.array_sort(
        F.array(
            *[
                F.struct((-(F.round(x - b, 9))).alias("f"), F.lit(i).alias("i"))
                for i, (x, b) in enumerate(zip(raw, base))
            ]
        )
    )
    served = F.transform(F.slice(order, 1, F.greatest(F.lit(0), rest).cast("int")), lambda e: e["i"])
    return F.struct(
        *[
            (b + F.array_contains(served, i).cast("long")).cast("long").alias(s)
            for i, (s, b) in enumerate(zip(SPLITS, base))
        ]
    )


def max_cluster_size(targets: Column, fraction: Column | float) -> Column:
    """Floor of a fraction of the smallest non-zero target, at least one."""
    smallest = F.least(*[F.when(targets[s] > 0, targets[s]) for s in SPLITS])
    fraction = F.lit(fraction) if isinstance(fraction, (int, float)) else fraction
    return F.coalesce(F.greatest(F.lit(1), F.floor(smallest * fraction)), F.lit(1)).cast("long")


def stable_seed(label: Column | str, seed: int | str = 20250328) -> Column:
    """Leading 32 bits of sha256('<seed>:<label>') as an unsigned number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), _col(label)), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def shuffle_key(identifier: Column | str, seed: int | str) -> Column:
    """Deterministic pseudo-random order: the same in every engine that has md5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), _col(identifier).cast("string")))


def entity_id(dataset: Column | str, ordinal: Column | str, width: int = 8) -> Column:
    return F.concat(_col(dataset), F.lit("_"), zero_filled(ordinal, width))


def zero_filled(number: Column | str, width: int) -> Column:
    """A number as text of at least ``width`` digits; longer ones keep all their digits."""
    text = _col(number).cast("string")
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, "0"))


def acyclic(text: Column | str) -> Column:
    """A valid molecule string has no ring iff no ring-closure digit stands outside brackets."""
    return ~F.regexp_like(F.regexp_replace(_col(text), r"\[[^\]]*\]", ""), F.lit("[0-9%]"))


def part_name(part: Column | str) -> Column:
    return F.concat(F.lit("part_"), (_col(part) + 1).cast("string"))


def fold_name(fold: Column | str) -> Column:
    return F.concat(F.lit("fold_"), (_col(fold) + 1).cast("string"))


def normalize_name(name: Column | str, hyphens: bool = True) -> Column:
    """Trim, lower-case and turn blanks (and hyphens) into underscores."""
    return F.translate(F.lower(F.trim(_col(name))), " -" if hyphens else " ", "__" if hyphens else "_")


def pretty_name(name: Column | str) -> Column:
    return F.translate(_col(name), "_", " ")


def tail_text(text: Column | str, length: int = 4000) -> Column:
    return F.right(_col(text), F.lit(length))


def bernoulli_jsd(p: Column | str, q: Column | str, eps: float = 1e-12) -> Column:
    """Jensen-Shannon divergence (natural log) of two Bernoulli rates."""
    p, q = (F.greatest(F.least(_col(x), F.lit(1 - eps)), F.lit(eps)) for x in (p, q))
    m = (p + q) / 2

    def divergence(a: Column) -> Column:
        return a * F.ln(a / m) + (1 - a) * F.ln((1 - a) / (1 - m))

    return (divergence(p) + divergence(q)) / 2


def hedges_g(n_x, mean_x, var_x, n_y, mean_y, var_y) -> Column:
    """Small-sample corrected standardised mean difference from group moments."""
    n_x, mean_x, var_x, n_y, mean_y, var_y = map(_col, (n_x, mean_x, var_x, n_y, mean_y, var_y))
    total = n_x + n_y
    pooled = F.try_divide((n_x - 1) * var_x + (n_y - 1) * var_y, (total - 2).cast("double"))
    effect = F.try_divide(mean_x - mean_y, F.sqrt(F.when(pooled > 0, pooled)))
    correction = 1 - F.try_divide(F.lit(3.0), (4 * total - 9).cast("double"))
    return F.when((n_x >= 2) & (n_y >= 2), effect * correction)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every DOUBLE column; adding zero folds -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )
