"""Regression metrics from mergeable moments and tie-averaged ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from foldwise.functions.scalars import finite
from foldwise.operators.ranking import running_totals
from foldwise.session import cut_lineage


def finite_pairs(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """The rows with a finite target and a finite prediction."""
    pairs = df.select(*keys, finite(y).alias("y"), finite(pred).alias("pred"))
    return pairs.where(F.col("y").isNotNull() & F.col("pred").isNotNull())


def _correlation(cov: Column, var_x: Column, var_y: Column) -> Column:
    spread = F.sqrt(F.when((var_x > 0) & (var_y > 0), var_x * var_y))
    return F.try_divide(cov, spread)


def pearson(x: str, y: str) -> Column:
    """Aggregate column; NULL where either side is constant or fewer than two rows."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    px, py = F.when(both, F.col(x)), F.when(both, F.col(y))
    return F.when(F.count(px) >= 2, _correlation(F.covar_pop(px, py), F.var_pop(px), F.var_pop(py)))


def spearman(pairs: DataFrame, keys: Sequence[str], x: str = "y", y: str = "pred", name: str = "Spearman_rho") -> DataFrame:
    """Pearson correlation of tie-averaged ranks, from pairs that may repeat or carry a count ``n``.

    Rows without a key or a value are left out.
    """
    keys = list(keys)
    count = (F.col("n") if "n" in pairs.columns else F.lit(1)).cast("long")
    whole = pairs.dropna(subset=[*keys, x, y]).select(*keys, count.alias("_w"), F.col(x).alias("y"), F.col(y).alias("pred"))
    points, rows = numbered(whole, keys, F.sum("_w").alias("_size0"))
    by_pred = cut_lineage(rows.groupBy("_point", "pred").agg(F.sum("_w").alias("_n0")))
    found = points.join(_rank_products(points, rows, by_pred, by_pred, [F.lit(True)], F.col("_w")), "_point")
    rho = F.when(F.col("_size0") >= 2, _correlation(F.col("_xy0"), F.col("_xx0"), F.col("_yy0")))
    return found.select(*keys, rho.alias(name))


def moments(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred", constant_r2: str = "null") -> DataFrame:
    """Everything but the rank correlation, in one partial-aggregated pass over the rows.

    ``constant_r2='score'`` gives a constant target the R2 1 (perfect) or 0.
    """
    pairs = finite_pairs(df, keys, y, pred)
    error = F.col("y") - F.col("pred")
    sums = pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.abs(error)).alias("MAE"),
        F.avg(error * error).alias("_mse"),
        F.var_pop("y").alias("_vy"),
        F.var_pop("pred").alias("_vp"),
        F.covar_pop("y", "pred").alias("_cov"),
        F.avg(F.abs("y")).alias("target_scale_mean_abs"),
    )
    many = F.col("n") >= 2
    r2 = F.when(many & (F.col("_vy") > 0), 1 - F.try_divide("_mse", "_vy"))
    if constant_r2 == "score":
        perfect = F.when(F.col("_mse") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
        r2 = F.when(many & (F.col("_vy") == 0), perfect).otherwise(r2)
    sample = F.try_divide(F.col("n").cast("double"), F.col("n") - 1)
    return sums.select(
        *keys,
        "n",
        "MAE",
        F.sqrt("_mse").alias("RMSE"),
        r2.alias("R2"),
        F.when(many, _correlation(F.col("_cov"), F.col("_vy"), F.col("_vp"))).alias("Pearson_r"),
        "target_scale_mean_abs",
        F.try_divide("MAE", "target_scale_mean_abs").alias("relMAE"),
        F.sqrt(F.col("_vp") * sample).alias("Prediction_SD"),
        F.sqrt(F.col("_vy") * sample).alias("Target_SD"),
    )


POINTS_LIMIT = 100_000  # rows of a table of keys that is still broadcast


def numbered(df: DataFrame, keys: Sequence[str], *about: Column) -> tuple[DataFrame, DataFrame]:
    """(points, rows): a number ``_point`` for every combination of keys, with aggregates over its rows, and
    the rows with that number and those aggregates in place of the keys.

    Later shuffles and sorts then move one number instead of several texts.  The number is a hash of the keys, so a row has it
    without a lookup of texts; should two combinations ever share one, all are drawn anew with another seed.
    """
    keys = list(keys)
    found = cut_lineage(df.groupBy(*keys).agg(*(about or (F.count(F.lit(1)).alias("_rows"),))))
    seed = 0
    while not found.groupBy(_number(keys, seed).alias("_point")).count().where("count > 1").isEmpty():
        seed += 1
    points = found.withColumn("_point", _number(keys, seed))
    rows = df.select(_number(keys, seed).alias("_point"), *[c for c in df.columns if c not in keys])
    return points, rows.join(small_side(points.drop(*keys)), "_point") if about else rows


def _number(keys: Sequence[str], seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *keys)


def small_side(points: DataFrame) -> DataFrame:
    """A checkpointed table of keys, broadcast up to POINTS_LIMIT rows."""
    return F.broadcast(points) if points.count() <= POINTS_LIMIT else points


# Sums over the pairs of a part of a point, around the means of its whole point, so that nothing cancels.
SUMS = ("n", "abs_e", "e2", "dy", "dy2", "dp", "dp2", "dydp", "abs_y")


def _inside(sides: Sequence[Column], value: Column, name: str) -> list[Column]:
    """The sum of a value over the rows of each side."""
    return [F.sum(F.when(side, value).otherwise(F.lit(0))).alias(f"{name}{i}") for i, side in enumerate(sides)]


def _side_ranks(points: DataFrame, counts: DataFrame, value: str, sample_of: DataFrame, sides: int) -> DataFrame:
    """``counts`` (per point and value) with the tie-averaged rank inside every side, less the mean rank there."""
    run = running_totals(counts, ["_point"], value, {f"_u{i}": f"_n{i}" for i in range(sides)}, sample_of=sample_of)
    sizes = small_side(points.select("_point", *[f"_size{i}" for i in range(sides)]))
    ranks = [(F.col(f"_u{i}") - F.col(f"_n{i}") + (F.col(f"_n{i}") + 1) / 2.0 - (F.col(f"_size{i}") + 1) / 2.0).alias(f"_r{i}") for i in range(sides)]
    return run.join(sizes, "_point").select(*counts.columns, *ranks)


def _rank_products(points: DataFrame, rows: DataFrame, counts: DataFrame, sample_of: DataFrame, sides: Sequence[Column], count: Column) -> DataFrame:
    """Per point and side the sums of products of ranks: _xy, _xx and _yy.

    ``counts`` has the rows of every side per point and ``pred``.  The ranks of ``pred`` go to the rows, which then merge
    to one row per distinct ``y`` with the sum of these ranks: pairs never become a table.
    """
    ranks = cut_lineage(_side_ranks(points, counts, "pred", sample_of, len(sides)))
    found = rows.join(small_side(ranks.drop(*[f"_n{i}" for i in range(len(sides))])), ["_point", "pred"])
    summed = [F.sum(F.when(side, count * F.col(f"_r{i}")).otherwise(0.0)).alias(f"_z{i}") for i, side in enumerate(sides)]
    by_y = cut_lineage(found.groupBy("_point", "y").agg(*_inside(sides, count, "_n"), *summed))
    placed = _side_ranks(points, by_y, "y", by_y, len(sides))

    def squares(name: str) -> list[Column]:
        return [F.sum(F.col(f"_n{i}") * F.col(f"_r{i}") * F.col(f"_r{i}")).alias(f"{name}{i}") for i in range(len(sides))]

    products = [F.sum(F.col(f"_r{i}") * F.col(f"_z{i}")).alias(f"_xy{i}") for i in range(len(sides))]
    both = placed.groupBy("_point").agg(*products, *squares("_xx"))
    return both.join(ranks.groupBy("_point").agg(*squares("_yy")), "_point")


def paired_metrics(pairs: DataFrame, keys: Sequence[str], constant_r2: str = "null", status: str | None = None, subsets: Sequence[str] = ()) -> DataFrame:
    """Error, association and spread metrics of finite ``y`` and ``pred`` per key.

    With a boolean ``status`` and the names of three subsets (all rows, without, with), per key and Subset.
    Rows are merged per distinct ``pred`` and per distinct ``y``, each with a count for each status: running totals give the
    ranks inside all three subsets.  Sums of the parts of a point add up to those of the whole point, so no row is fanned out.
    """
    keys = list(keys)
    flag = F.lit(False) if status is None else F.coalesce(F.col(status), F.lit(False))
    sides = [F.lit(True)] if status is None else [F.lit(True), ~F.col("_s"), F.col("_s")]
    means = [F.avg("y").alias("_cy"), F.avg("pred").alias("_cp")]
    points, rows = numbered(pairs.select(*keys, flag.alias("_s"), "y", "pred"), keys, *means, *_inside(sides, F.lit(1).cast("long"), "_size"))
    error, dy, dp, n = F.col("y") - F.col("pred"), F.col("y") - F.col("_cy"), F.col("pred") - F.col("_cp"), F.col("_n")
    of_y = {"n": F.lit(1), "abs_e": F.abs(error), "e2": error * error, "dy": dy, "dy2": dy * dy, "abs_y": F.abs("y")}
    ends = {c: [F.min(c).alias(f"min_{c}"), F.max(c).alias(f"max_{c}")] for c in ("y", "pred")}
    by_pred = cut_lineage(rows.groupBy("_point", "_s", "pred").agg(*[F.sum(v).alias(f"_{s}") for s, v in of_y.items()], *ends["y"]))
    counts = by_pred.groupBy("_point", "pred").agg(*_inside(sides, n, "_n"))
    products = _rank_products(points, rows, counts, by_pred, sides, F.lit(1).cast("long"))

    centred = by_pred.join(small_side(points.select("_point", "_cp")), "_point")
    of_pred = {"dp": n * dp, "dp2": n * dp * dp, "dydp": F.col("_dy") * dp}
    merged = [F.min("min_y").alias("min_y"), F.max("max_y").alias("max_y")]
    parts = centred.groupBy("_point", "_s").agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in of_y], *[F.sum(v).alias(f"_{s}") for s, v in of_pred.items()], *merged, *ends["pred"])
    member = [F.lit(0)] if status is None else [F.lit(0), F.when(F.col("_s"), 2).otherwise(1)]
    parts = parts.withColumn("_side", F.explode(F.array(*member)))
    merged += [F.min("min_pred").alias("min_pred"), F.max("max_pred").alias("max_pred")]
    sums = parts.groupBy("_point", "_side").agg(*[F.sum(f"_{s}").alias(f"_{s}") for s in SUMS], *merged)
    ranks = ("_xy", "_xx", "_yy")
    of_side = [F.struct(F.lit(i).alias("_side"), *[F.col(f"{r}{i}").alias(r) for r in ranks]) for i in range(len(sides))]
    sums = sums.join(products.select("_point", F.explode(F.array(*of_side)).alias("_z")).select("_point", "_z.*"), ["_point", "_side"])
    mean = {s: F.col(f"_{s}") / n for s in SUMS}

    def spread(column: str, first: str, second: str) -> Column:
        return F.when(F.col(f"min_{column}") == F.col(f"max_{column}"), 0.0).otherwise(F.greatest(mean[second] - mean[first] * mean[first], F.lit(0.0)))

    vy, vp, many = spread("y", "dy", "dy2"), spread("pred", "dp", "dp2"), n >= 2
    r2 = F.when(many & (vy > 0), 1 - F.try_divide(mean["e2"], vy))
    if constant_r2 == "score":
        r2 = F.when(many & (vy == 0), F.when(mean["e2"] == 0, 1.0).otherwise(0.0)).otherwise(r2)
    varies = many & (vy > 0) & (vp > 0)
    sample = F.try_divide(n.cast("double"), n - 1)
    by = [] if status is None else [F.element_at(F.array(*map(F.lit, subsets)), F.col("_side") + 1).alias("Subset")]
    out = sums.select(
        "_point",
        *by,
        n.alias("n"),
        mean["abs_e"].alias("MAE"),
        F.sqrt(mean["e2"]).alias("RMSE"),
        r2.alias("R2"),
        F.when(varies, _correlation(mean["dydp"] - mean["dy"] * mean["dp"], vy, vp)).alias("Pearson_r"),
        mean["abs_y"].alias("target_scale_mean_abs"),
        F.try_divide(mean["abs_e"], mean["abs_y"]).alias("relMAE"),
        F.sqrt(vp * sample).alias("Prediction_SD"),
        F.sqrt(vy * sample).alias("Target_SD"),
        F.when(varies, _correlation(*map(F.col, ranks))).alias("Spearman_rho"),
    )
    return out.join(small_side(points.select("_point", *keys)), "_point").select(*keys, *out.columns[1:])


def regression_summary(
    df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred", constant_r2: str = "null"
) -> DataFrame:
    return paired_metrics(finite_pairs(df, keys, y, pred), keys, constant_r2)
