"""Ordered computations that never put a whole group into one task.

A running total per key is computed in two levels.  Values are cut into buckets
at quantiles of the data; the bucket sums are scanned per key (a handful of rows
each) to give every bucket its starting offset; inside a bucket an ordinary
window adds the local part.  A key that holds a third of all rows is thereby
spread over as many tasks as there are buckets.  Tied values are merged before
anything is ordered, so one hot value is a single row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from foldwise.session import balance_factor, cut_lineage


def with_bucket(df: DataFrame, value: str, sample_of: DataFrame | None = None, name: str = "_bucket") -> DataFrame:
    """Add the index of the quantile bucket of a numeric column.

    The cut points come from a scalar subquery, so they are computed once per
    query, and a lost task sees the same cut points when it is run again.
    """
    buckets = balance_factor(df.sparkSession)
    fractions = [i / buckets for i in range(1, buckets)]
    source = df if sample_of is None else sample_of
    cuts = source.select(
        F.percentile_approx(F.col(value).cast("double"), fractions, max(1000, 10 * buckets)).alias("cuts")
    ).scalar()
    steps, width = [], buckets // 2
    while width:
        steps.append(F.lit(width))
        width //= 2
    position = F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, step: F.when(
            F.element_at(F.col("_cuts"), at + step) < F.col(value).cast("double"), at + step
        ).otherwise(at),
    )
    return df.withColumn("_cuts", cuts).withColumn(name, F.coalesce(position, F.lit(0))).drop("_cuts")


def running_totals(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    totals: Mapping[str, str],
    descending: bool = False,
    sample_of: DataFrame | None = None,
) -> DataFrame:
    """Inclusive running sums per key in value order.

    ``df`` holds one row per (keys, value); ``totals`` maps an output name to the
    column that is summed.  Values must be unique inside a key.
    """
    keys = list(keys)
    cells = with_bucket(df, value, sample_of)
    direction = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    sums = cells.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_s_{o}") for o, c in totals.items()])
    before = Window.partitionBy(*keys).orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_s_{o}").over(before), F.lit(0)).alias(f"_o_{o}") for o in totals]
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(F.col(value).desc() if descending else F.col(value).asc())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    joined = cells.join(offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{o}")).alias(o) for o, c in totals.items()]
    )


def ordinal_within(df: DataFrame, keys: Sequence[str], order: str, name: str = "ordinal") -> DataFrame:
    """Zero-based position of each row inside its key; ``order`` is a unique number."""
    numbered = running_totals(df.withColumn("_one", F.lit(1).cast("long")), keys, order, {name: "_one"})
    return numbered.withColumn(name, F.col(name) - 1).drop("_one")


def global_ordinal(df: DataFrame, order: str, name: str = "ordinal") -> DataFrame:
    """Zero-based position of each row in the whole table, without a single-task sort."""
    keyed = ordinal_within(df.withColumn("_all", F.lit(0)), ["_all"], order, name)
    return keyed.drop("_all")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, name: str = "avg_rank") -> DataFrame:
    """One row per (keys, value): multiplicity ``n`` and the 1-based tie-averaged rank."""
    merged = df.groupBy(*keys, value).agg((F.sum("n") if "n" in df.columns else F.count(F.lit(1))).alias("n"))
    ranked = running_totals(merged, keys, value, {"_upto": "n"}, sample_of=df)
    return ranked.withColumn(name, F.col("_upto") - F.col("n") + (F.col("n") + 1) / 2.0).drop("_upto")


def grouped_median(df: DataFrame, keys: Sequence[str], value: str, name: str = "median") -> DataFrame:
    """Exact median per key from running counts (no per-key value map in memory)."""
    clean = df.where(F.col(value).isNotNull())
    merged = clean.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    run = running_totals(merged, keys, value, {"_upto": "n"}, sample_of=clean)
    sizes = merged.groupBy(*keys).agg(F.sum("n").alias("_total"))
    low = F.floor((F.col("_total") + 1) / 2.0)
    high = F.ceil((F.col("_total") + 1) / 2.0)

    def covers(position: Column) -> Column:
        return (F.col("_upto") - F.col("n") < position) & (position <= F.col("_upto"))

    return (
        run.join(sizes, list(keys))
        .where(covers(low) | covers(high))
        .groupBy(*keys)
        .agg(((F.min(value) + F.max(value)) / 2.0).alias(name))
    )


def ordinal_by(
    df: DataFrame, keys: Sequence[str], major: str, minor: str, descending: bool = False, name: str = "ordinal"
) -> DataFrame:
    """Zero-based position by (major, minor); ties of ``major`` are ordered by the unique ``minor``.

    The table is read several times, so it is materialised first.
    """
    keys = list(keys)
    df = cut_lineage(df)
    counts = df.groupBy(*keys, major).agg(F.count(F.lit(1)).alias("_c"))
    run = running_totals(counts, keys, major, {"_upto": "_c"}, descending, sample_of=df)
    starts = run.select(*keys, major, (F.col("_upto") - F.col("_c")).alias("_start"))
    inside = ordinal_within(df, [*keys, major], minor, "_inside")
    return inside.join(starts, [*keys, major]).withColumn(name, F.col("_start") + F.col("_inside")).drop("_start", "_inside")


def text_numbers(ids: DataFrame, identifier: str, name: str = "number") -> DataFrame:
    """(identifier, name): a dense number from 0 for every distinct text, in the order of the texts.

    The dictionary between text identifiers and the numbers that similarity, leader, repair and
    sweep operators work on.  Texts are range-partitioned and sorted; the parts' sizes give each part's first number.
    """
    parts = int(ids.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = ids.select(identifier).where(F.col(identifier).isNotNull()).distinct()
    ranged = distinct.repartitionByRange(parts, identifier).sortWithinPartitions(identifier)
    # the lower bits of the generated number are the position in its part
    placed = cut_lineage(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id() % (1 << 33)}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # one row per part
    firsts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return placed.join(firsts, "_part").select(identifier, (F.col("_first") + F.col("_at")).alias(name))


def with_number(df: DataFrame, identifier: str, name: str) -> DataFrame:
    """Add a BIGINT that orders rows as their identifier does: the identifier itself if it is a number, else its
    number in the dictionary of all texts."""
    if dict(df.dtypes)[identifier] != "string":
        return df.withColumn(name, F.col(identifier).cast("bigint"))
    return df.join(text_numbers(df, identifier, name), identifier, "left")
