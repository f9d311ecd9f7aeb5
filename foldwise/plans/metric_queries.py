"""Classification, regression and distribution-shift metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.functions.scalars import bernoulli_jsd, hedges_g
from foldwise.operators import classification as C
from foldwise.operators import ranking, regression as R, shift as D
from foldwise.operators.evaluation import direction_agreement, with_subsets
from foldwise.plans.registry import query
from foldwise.plans.roles import CLASSIFIED, LABELLED, LINES, REGRESSED, classified, labelled, regressed, _lines
from foldwise.sources.tables import load

SERIES = ["Dataset", "Target", "Model"]
# Documents: label 'quality' and 'toxic' against a tying score, whole set and by status.
_SCORED = f"""WITH {LABELLED}, pts AS (
    SELECT t.target, s.subset, t.y, score FROM lab, LATERAL (VALUES ('quality', quality), ('toxic', toxic)) t(target, y),
      LATERAL (VALUES ('all_test'), (CASE WHEN is_empty THEN 'no_scaffold' ELSE 'scaffold_bearing' END)) s(subset)),
  thr AS (SELECT target, subset, score, sum(y) AS pos, count(*) AS n FROM pts GROUP BY ALL),
  cum AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS upto FROM thr
    WINDOW w AS (PARTITION BY target, subset ORDER BY score DESC)),
  tot AS (SELECT target, subset, sum(pos) AS p, sum(n) - sum(pos) AS m, sum(pos * (tp / upto::DOUBLE)) AS ap_sum,
    sum(pos * ((n + 1) / 2.0::DOUBLE - upto)) AS rank_sum FROM cum GROUP BY ALL),
  met AS (SELECT target, subset, CASE WHEN p > 0 AND m > 0 THEN ap_sum / p END AS average_precision,
    CASE WHEN p > 0 AND m > 0 THEN (rank_sum + p * (p + m) - p * (p + 1) / 2.0::DOUBLE) / (p * m)::DOUBLE END AS roc_auc,
    p / (p + m)::DOUBLE AS rate, p, m FROM tot)"""


def _scored(spark, folder):
    targets = F.explode(
        F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).cast("double").alias("y")) for t in ("quality", "toxic")])
    )
    fanned = with_subsets(labelled(spark, folder)).withColumn("_t", targets)
    return fanned.select("_t.*", F.col("Subset").alias("subset"), "score")


def _ranking(spark, folder):
    points = _scored(spark, folder)
    counts = C.score_counts(points, ["target", "subset"]).select("target", "subset", "score", "pos", "neg")
    return C.ranking_metrics(counts, ["target", "subset"], points.select("score"))


@query("avg_precision", f"{_SCORED} SELECT target, subset, average_precision FROM met", "average_precision")
def avg_precision(spark, folder):
    return _ranking(spark, folder).select("target", "subset", "average_precision")


@query("roc_auc", f"{_SCORED} SELECT target, subset, roc_auc FROM met", "roc_auc")
def roc_auc(spark, folder):
    return _ranking(spark, folder).select("target", "subset", "roc_auc")


@query(
    "norm_pr",
    f'{_SCORED} SELECT target, subset, (average_precision - rate) / (1 - rate) AS "normPR" FROM met',
    "normPR",
)
def norm_pr(spark, folder):
    return _ranking(spark, folder).select("target", "subset", "normPR")


# labels of -1 and 1 count as 0 and 1
_CONFUSION = """coded AS (SELECT * REPLACE (CASE WHEN y = -1 THEN 0 ELSE y END AS y) FROM cls),
  cm AS (SELECT "Dataset", "Target", "Model", count(*) AS n, sum(y) AS p,
    count(*) FILTER (y = 1 AND score >= 0.5)::DOUBLE AS tp, count(*) FILTER (y = 0 AND score >= 0.5)::DOUBLE AS fp,
    count(*) FILTER (y = 1 AND score < 0.5)::DOUBLE AS fn, count(*) FILTER (y = 0 AND score < 0.5)::DOUBLE AS tn
    FROM coded GROUP BY ALL),
  th AS (SELECT "Dataset", "Target", "Model", n, p / n AS positive_rate, (tp + tn) / n AS accuracy,
    coalesce((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, tp / nullif(tp + fn, 0), tn / nullif(tn + fp, 0))
      AS balanced_accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0) AS f1,
    (tp * tn - fp * fn) / nullif(sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)), 0) AS mcc FROM cm)"""


def _coded(spark, folder):
    return C.binary_labels(classified(spark, folder), SERIES, "y").drop("y").withColumnRenamed("label", "y")


@query(
    "threshold_metrics",
    f"WITH {CLASSIFIED}, {_CONFUSION} SELECT * FROM th",
    "positive_rate accuracy balanced_accuracy f1 mcc",
)
def threshold_metrics(spark, folder):
    return C.threshold_metrics(C.score_counts(_coded(spark, folder), SERIES), SERIES)


_RANKED = """thr AS (SELECT "Dataset", "Target", "Model", score, sum(y) AS pos, count(*) AS c FROM coded GROUP BY ALL),
  cum AS (SELECT *, sum(pos) OVER w AS hits, sum(c) OVER w AS upto FROM thr
    WINDOW w AS (PARTITION BY "Dataset", "Target", "Model" ORDER BY score DESC)),
  tot AS (SELECT "Dataset", "Target", "Model", sum(pos) AS p, sum(c) - sum(pos) AS m, sum(pos * (hits / upto)) AS aps,
    sum(pos * ((c + 1) / 2.0::DOUBLE - upto)) AS ranks FROM cum GROUP BY ALL),
  rk AS (SELECT "Dataset", "Target", "Model", aps / p AS average_precision,
    (ranks + p * (p + m) - p * (p + 1) / 2.0::DOUBLE) / (p * m) AS roc_auc,
    (aps / p - p / (p + m)) / (1 - p / (p + m)) AS "normPR" FROM tot)"""


@query(
    "classification_summary",
    f'WITH {CLASSIFIED}, {_CONFUSION}, {_RANKED} SELECT * FROM th JOIN rk USING ("Dataset", "Target", "Model")',
    "positive_rate accuracy balanced_accuracy f1 mcc average_precision roc_auc normPR",
)
def classification_summary(spark, folder):
    return C.classification_summary(_coded(spark, folder), SERIES)


@query(
    "binary_label_recode",
    """WITH v AS (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN (user_id % 2)::DOUBLE
        WHEN 'view' THEN (user_id % 3 - 1)::DOUBLE WHEN 'error' THEN (user_id % 11) / 10.0::DOUBLE
        WHEN 'signup' THEN 2 * (user_id % 2) - 1.0::DOUBLE ELSE value END AS raw FROM events),
      w AS (SELECT event_id, event_type, CASE WHEN event_id % 17 = 0 THEN NULL ELSE raw END AS raw FROM v),
      f AS (SELECT event_type, bool_and(raw IN (0, 1)) AS u, bool_and(raw IN (-1, 0, 1)) AS s,
        min(raw) >= 0 AND max(raw) <= 1 AS p FROM w WHERE raw IS NOT NULL GROUP BY event_type)
      SELECT event_id, event_type, CASE WHEN u THEN raw WHEN s THEN coalesce((raw > 0)::INT, 0)::DOUBLE
        WHEN p THEN coalesce((raw >= 0.5::DOUBLE)::INT, 0)::DOUBLE END AS label FROM w JOIN f USING (event_type)""",
    "label",
)
def binary_label_recode(spark, folder):
    user = F.col("user_id")
    raw = (
        F.when(F.col("event_type") == "click", (user % 2).cast("double"))
        .when(F.col("event_type") == "view", (user % 3 - 1).cast("double"))
        .when(F.col("event_type") == "error", (user % 11) / 10.0)
        .when(F.col("event_type") == "signup", (2 * (user % 2) - 1).cast("double"))
        .otherwise(F.col("value"))
    )
    events = load(spark, folder, "events").select(
        "event_id", "event_type", F.when(F.col("event_id") % 17 != 0, raw).alias("raw")
    )
    return C.binary_labels(events, ["event_type"], "raw").select("event_id", "event_type", "label")


@query(
    "eligible_binary_gate",
    f"""WITH {CLASSIFIED} SELECT "Dataset", "Fold", "Target", "Model", is_empty, count(*) FILTER (y = 1) AS n_positive,
      count(*) FILTER (y <> 1) AS n_negative FROM cls GROUP BY ALL
      HAVING count(*) FILTER (y = 1) >= 10 AND count(*) FILTER (y <> 1) >= 10""",
)
def eligible_binary_gate(spark, folder):
    counts = classified(spark, folder).groupBy("Dataset", "Fold", "Target", "Model", "is_empty").agg(
        F.sum((F.col("y") == 1).cast("long")).alias("n_positive"), F.sum((F.col("y") != 1).cast("long")).alias("n_negative")
    )
    return counts.where(C.eligible(F.col("n_positive"), F.col("n_negative")))


@query(
    "subset_fanout",
    f"""WITH {LINES} SELECT "Dataset", s.subset AS "Subset", count(*) AS n FROM lines,
      LATERAL (VALUES ('all_test'), (CASE WHEN is_empty THEN 'no_scaffold' ELSE 'scaffold_bearing' END)) s(subset)
      GROUP BY ALL""",
)
def subset_fanout(spark, folder):
    return with_subsets(_lines(spark, folder)).groupBy("Dataset", "Subset").agg(F.count(F.lit(1)).alias("n"))


_KEY = '"Dataset", "Target", "Model"'
_MOMENTS = f"""mo AS (SELECT {_KEY}, count(*) AS n, avg(abs(y - pred)) AS "MAE", sqrt(avg((y - pred) * (y - pred))) AS "RMSE",
    1 - avg((y - pred) * (y - pred)) / nullif(var_pop(y), 0) AS "R2", corr(y, pred) AS "Pearson_r",
    avg(abs(y)) AS target_scale_mean_abs, avg(abs(y - pred)) / nullif(avg(abs(y)), 0) AS "relMAE",
    stddev_samp(pred) AS "Prediction_SD", stddev_samp(y) AS "Target_SD"
    FROM reg GROUP BY ALL)"""


def _register_moment(name: str, *columns: str):
    picked = ", ".join(f'"{c}"' for c in columns)

    @query(name, f"WITH {REGRESSED}, {_MOMENTS} SELECT {_KEY}, {picked} FROM mo", " ".join(c for c in columns if c != "n"))
    def run(spark, folder):
        return R.moments(regressed(spark, folder), SERIES).select(*SERIES, *columns)

    return run


mae_rmse = _register_moment("mae_rmse", "n", "MAE", "RMSE")
r2 = _register_moment("r2", "R2")
pearson = _register_moment("pearson", "Pearson_r")
rel_mae = _register_moment("rel_mae", "target_scale_mean_abs", "relMAE")
target_sd = _register_moment("target_sd", "Prediction_SD", "Target_SD")

_RANKS = f"""rk AS (SELECT {_KEY},
    rank() OVER (PARTITION BY {_KEY} ORDER BY y) + (count(*) OVER (PARTITION BY {_KEY}, y) - 1) / 2.0::DOUBLE AS ry,
    rank() OVER (PARTITION BY {_KEY} ORDER BY pred) + (count(*) OVER (PARTITION BY {_KEY}, pred) - 1) / 2.0::DOUBLE AS rp
    FROM reg),
  sp AS (SELECT {_KEY}, corr(ry, rp) AS "Spearman_rho" FROM rk GROUP BY ALL)"""


@query("spearman", f"WITH {REGRESSED}, {_RANKS} SELECT * FROM sp", "Spearman_rho")
def spearman(spark, folder):
    return R.spearman(R.finite_pairs(regressed(spark, folder), SERIES), SERIES)


@query(
    "regression_summary",
    f"WITH {REGRESSED}, {_MOMENTS}, {_RANKS} SELECT * FROM mo JOIN sp USING ({_KEY})",
    "MAE RMSE R2 Pearson_r target_scale_mean_abs relMAE Prediction_SD Target_SD Spearman_rho",
)
def regression_summary(spark, folder):
    return R.regression_summary(regressed(spark, folder), SERIES)


@query(
    "avg_rank",
    """SELECT DISTINCT event_type, value, count(*) OVER (PARTITION BY event_type, value) AS n,
      rank() OVER (PARTITION BY event_type ORDER BY value)
        + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0::DOUBLE AS avg_rank FROM events""",
    "value avg_rank",
)
def avg_rank(spark, folder):
    return ranking.average_ranks(load(spark, folder, "events").select("event_type", "value"), ["event_type"], "value")


@query(
    "grouped_median",
    "SELECT l_returnflag, median(l_extendedprice) AS median FROM lineitem GROUP BY ALL",
    "median",
)
def grouped_median(spark, folder):
    lines = load(spark, folder, "lineitem").select("l_returnflag", "l_extendedprice")
    return ranking.grouped_median(lines, ["l_returnflag"], "l_extendedprice")


@query(
    "gini",
    """WITH v AS (SELECT c_mktsegment AS segment, c_acctbal AS x FROM customer),
      s AS (SELECT segment, x - least(0, min(x) OVER (PARTITION BY segment)) AS x FROM v),
      o AS (SELECT segment, x, row_number() OVER (PARTITION BY segment ORDER BY x) AS i,
        count(*) OVER (PARTITION BY segment) AS n FROM s)
      SELECT segment, (2 * sum(i * x) / sum(x) - (max(n) + 1)) / max(n) AS gini FROM o GROUP BY segment""",
    "gini",
)
def gini(spark, folder):
    customers = load(spark, folder, "customer").select(F.col("c_mktsegment").alias("segment"), "c_acctbal")
    return D.gini(customers, ["segment"], "c_acctbal")


_SIDES = """sd AS (SELECT event_type, count(*) FILTER (f) AS n_x, avg(value) FILTER (f) AS mean_x,
    var_samp(value) FILTER (f) AS var_x, count(*) FILTER (NOT f) AS n_y, avg(value) FILTER (NOT f) AS mean_y,
    var_samp(value) FILTER (NOT f) AS var_y FROM (SELECT *, user_id % 3 = 0 AS f FROM events) GROUP BY event_type)"""


def _sides(spark, folder):
    return load(spark, folder, "events").select("event_type", "value", (F.col("user_id") % 3 == 0).alias("first"))


@query(
    "hedges_g",
    f"""WITH {_SIDES} SELECT event_type, (mean_x - mean_y)
      / sqrt(((n_x - 1) * var_x + (n_y - 1) * var_y) / (n_x + n_y - 2)) * (1 - 3.0::DOUBLE / (4 * (n_x + n_y) - 9)) AS g
      FROM sd""",
    "g",
)
def hedges(spark, folder):
    sides = D.side_moments(_sides(spark, folder), ["event_type"], "value", "first")
    return sides.select("event_type", hedges_g("n_x", "mean_x", "var_x", "n_y", "mean_y", "var_y").alias("g"))


@query(
    "ks_two_sample",
    """WITH v AS (SELECT event_type, value, count(*) FILTER (user_id % 3 = 0) AS x, count(*) FILTER (user_id % 3 <> 0) AS y
        FROM events GROUP BY ALL),
      c AS (SELECT event_type, sum(x) OVER w / sum(x) OVER (PARTITION BY event_type)::DOUBLE AS cx,
        sum(y) OVER w / sum(y) OVER (PARTITION BY event_type)::DOUBLE AS cy FROM v
        WINDOW w AS (PARTITION BY event_type ORDER BY value))
      SELECT event_type, max(abs(cx - cy)) AS ks FROM c GROUP BY event_type""",
    "ks",
)
def ks_two_sample(spark, folder):
    return D.ks_statistic(_sides(spark, folder), ["event_type"], "value", "first", "ks")


_JSD = """(p * ln(p / m) + (1 - p) * ln((1 - p) / (1 - m)) + q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m))) / 2"""


@query(
    "bernoulli_jsd",
    f"""WITH r AS (SELECT o_orderpriority AS priority, avg((o_orderstatus = 'F')::INT) AS p0,
        avg((o_orderstatus = 'O')::INT) AS q0 FROM orders GROUP BY 1),
      c AS (SELECT priority, greatest(least(p0, 1 - 1e-12), 1e-12) AS p, greatest(least(q0, 1 - 1e-12), 1e-12) AS q FROM r),
      k AS (SELECT *, (p + q) / 2 AS m FROM c) SELECT priority, {_JSD} AS jsd FROM k""",
    "jsd",
)
def jsd(spark, folder):
    def rate(status):
        return F.avg((F.col("o_orderstatus") == status).cast("int"))

    rates = load(spark, folder, "orders").groupBy(F.col("o_orderpriority").alias("priority")).agg(
        rate("F").alias("p"), rate("O").alias("q")
    )
    return rates.select("priority", bernoulli_jsd("p", "q").alias("jsd"))


_SHIFT_KEYS = '"Dataset", "Target"'


@query(
    "label_shift_regression",
    f"""WITH {REGRESSED}, one AS (SELECT * FROM reg WHERE "Model" = 'linear'),
      sd AS (SELECT {_SHIFT_KEYS}, count(*) FILTER (is_empty) AS n_x, avg(y) FILTER (is_empty) AS mx,
        var_samp(y) FILTER (is_empty) AS vx, count(*) FILTER (NOT is_empty) AS n_y, avg(y) FILTER (NOT is_empty) AS my,
        var_samp(y) FILTER (NOT is_empty) AS vy FROM one GROUP BY ALL),
      v AS (SELECT {_SHIFT_KEYS}, y, count(*) FILTER (is_empty) AS a, count(*) FILTER (NOT is_empty) AS b FROM one GROUP BY ALL),
      c AS (SELECT {_SHIFT_KEYS}, abs(sum(a) OVER w / sum(a) OVER p::DOUBLE - sum(b) OVER w / sum(b) OVER p::DOUBLE) AS d
        FROM v WINDOW w AS (PARTITION BY {_SHIFT_KEYS} ORDER BY y), p AS (PARTITION BY {_SHIFT_KEYS})),
      ks AS (SELECT {_SHIFT_KEYS}, max(d) AS "KS_Statistic" FROM c GROUP BY ALL)
      SELECT {_SHIFT_KEYS}, n_x AS "N_NoScaffold", n_y AS "N_HasScaffold", mx AS "No_Mean", my AS "Has_Mean",
        sqrt(vx) AS "No_SD", sqrt(vy) AS "Has_SD", mx - my AS "Mean_Diff_NoMinusHas",
        abs((mx - my) / sqrt(((n_x - 1) * vx + (n_y - 1) * vy) / (n_x + n_y - 2))
          * (1 - 3.0::DOUBLE / (4 * (n_x + n_y) - 9))) AS "Abs_StandardizedMeanDiff", "KS_Statistic"
      FROM sd JOIN ks USING ({_SHIFT_KEYS}) WHERE n_x >= 6 AND n_y >= 6""",
    "No_Mean Has_Mean No_SD Has_SD Mean_Diff_NoMinusHas Abs_StandardizedMeanDiff KS_Statistic",
)
def label_shift_regression(spark, folder):
    rows = regressed(spark, folder).where(F.col("Model") == "linear")
    return D.regression_label_shift(rows, ["Dataset", "Target"])


@query(
    "label_shift_classification",
    f"""WITH {CLASSIFIED}, sd AS (SELECT {_SHIFT_KEYS}, count(*) FILTER (is_empty) AS n_x,
        avg((y > 0)::INT) FILTER (is_empty) AS p, count(*) FILTER (NOT is_empty) AS n_y,
        avg((y > 0)::INT) FILTER (NOT is_empty) AS q FROM cls WHERE "Model" = 'volume' GROUP BY ALL),
      k AS (SELECT *, (p + q) / 2 AS m FROM sd WHERE n_x >= 6 AND n_y >= 6)
      SELECT {_SHIFT_KEYS}, n_x AS "N_NoScaffold", n_y AS "N_HasScaffold", p AS "No_PositiveRate", q AS "Has_PositiveRate",
        p - q AS "PositiveRate_Diff_NoMinusHas", abs(p - q) AS "Abs_PositiveRate_Diff", {_JSD} AS "Bernoulli_JSD" FROM k""",
    "No_PositiveRate Has_PositiveRate PositiveRate_Diff_NoMinusHas Abs_PositiveRate_Diff Bernoulli_JSD",
)
def label_shift_classification(spark, folder):
    rows = classified(spark, folder).where(F.col("Model") == "volume")
    return D.classification_label_shift(rows, ["Dataset", "Target"])


@query(
    "direction_agreement",
    """SELECT o_orderpriority AS priority, avg(((o_totalprice > 150000) = (c_acctbal > 4000))::INT) AS agreement
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""",
    "agreement",
)
def agreement(spark, folder):
    joined = load(spark, folder, "orders").join(load(spark, folder, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    same_side = direction_agreement(F.col("o_totalprice") - 150000, F.col("c_acctbal") - 4000)
    return joined.groupBy(F.col("o_orderpriority").alias("priority")).agg(same_side.alias("agreement"))
