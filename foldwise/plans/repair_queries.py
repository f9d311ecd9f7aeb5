"""Leader clusters, repair of empty-group members and the condition sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldwise.operators import clusters as C
from foldwise.operators import repair as R
from foldwise.operators.similarity import merge_copies
from foldwise.operators.sweep import SWEEP_CONDITIONS, capacity_clusters, condition_sweep
from foldwise.plans.registry import query
from foldwise.plans.similarity_queries import SIM, VECTORS, vectors


def _members(spark, folder):
    """Vectors whose first five classes play the empty group, mostly outside train."""
    vecs = vectors(spark, folder)
    empty = F.col("group_key").isin("No_Scaffold", "class_1", "class_2", "class_3", "class_4")
    stays = F.col("vec_id") % 10 < 2
    sparse = F.when(stays, "train").when(F.col("vec_id") % 2 == 0, "valid").otherwise("test")
    return vecs.select(
        "dataset", F.col("vec_id").alias("node"), "words", empty.alias("is_empty"),
        F.when(empty, sparse).otherwise(F.col("split")).alias("split"),
    )


# Sequential scan as a recursion over members in order; the leaders so far travel as a list.
_LEADERS = f"""WITH RECURSIVE {VECTORS},
  o AS (SELECT dataset, vec_id, word, row_number() OVER (PARTITION BY dataset ORDER BY vec_id) AS rn FROM vec),
  near AS (SELECT a.dataset, b.rn, list(a.vec_id ORDER BY a.vec_id) AS earlier FROM o a JOIN o b
    ON a.dataset = b.dataset AND a.rn < b.rn WHERE {SIM} >= 0.4::DOUBLE GROUP BY ALL),
  s(dataset, rn, leaders) AS (SELECT DISTINCT dataset, 0::BIGINT, []::BIGINT[] FROM o
    UNION ALL SELECT s.dataset, o.rn, CASE WHEN len(list_intersect(coalesce(n.earlier, []), s.leaders)) > 0 THEN s.leaders
      ELSE list_append(s.leaders, o.vec_id) END
    FROM s JOIN o ON o.dataset = s.dataset AND o.rn = s.rn + 1 LEFT JOIN near n ON n.dataset = o.dataset AND n.rn = o.rn),
  lead AS (SELECT dataset, unnest(leaders) AS leader FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY rn DESC) = 1)"""


@query("leader_pick", f"{_LEADERS} SELECT dataset, leader FROM lead")
def leader_pick(spark, folder):
    nodes = merge_copies(vectors(spark, folder), ["dataset"], "vec_id")
    return C.pick_leaders(nodes, ["dataset"]).select("dataset", F.col("node").alias("leader"))


_ASSIGN = f"""{_LEADERS}, pr AS (SELECT a.dataset, a.vec_id, b.vec_id AS leader, {SIM} AS similarity FROM vec a
    JOIN lead l ON l.dataset = a.dataset JOIN vec b ON b.vec_id = l.leader),
  asg AS (SELECT * FROM pr QUALIFY row_number() OVER (PARTITION BY dataset, vec_id ORDER BY similarity DESC, leader) = 1)"""


@query("leader_assign_argmax", f"{_ASSIGN} SELECT * FROM asg", "similarity")
def leader_assign(spark, folder):
    nodes = merge_copies(vectors(spark, folder), ["dataset"], "vec_id")
    leaders = C.pick_leaders(nodes, ["dataset"])
    return C.nearest_leader(nodes, leaders, ["dataset"], C.LEADER_THRESHOLD).withColumnRenamed("node", "vec_id")


@query(
    "similarity_chunks",
    f"""WITH {VECTORS}, f AS (SELECT dataset, min(vec_id) AS first FROM vec GROUP BY dataset),
      s AS (SELECT a.dataset, a.vec_id, {SIM} AS sim FROM vec a JOIN f USING (dataset) JOIN vec b ON b.vec_id = f.first)
      SELECT dataset, vec_id, row_number() OVER (PARTITION BY dataset ORDER BY sim DESC, vec_id) - 1 AS rank,
        (row_number() OVER (PARTITION BY dataset ORDER BY sim DESC, vec_id) - 1) // 30 AS chunk FROM s""",
)
def similarity_chunks(spark, folder):
    members = vectors(spark, folder).select("dataset", "vec_id", "words", F.lit(30).alias("size"))
    return C.similarity_chunks(members, ["dataset"], "vec_id", "size").select("dataset", "vec_id", "rank", "chunk")


# Clusters above twelve members are led once more; what is still too large is cut by similarity to its first member.
_MICRO = f"""{_ASSIGN}, big AS (SELECT dataset, leader, vec_id, word FROM asg JOIN vec USING (dataset, vec_id)
    QUALIFY count(*) OVER (PARTITION BY dataset, leader) > 12),
  o2 AS (SELECT *, row_number() OVER (PARTITION BY dataset, leader ORDER BY vec_id) AS rn FROM big),
  near2 AS (SELECT a.dataset, a.leader, b.rn, list(a.vec_id) AS earlier FROM o2 a JOIN o2 b
    ON a.dataset = b.dataset AND a.leader = b.leader AND a.rn < b.rn WHERE {SIM} >= 0.4::DOUBLE GROUP BY ALL),
  s2(dataset, leader, rn, subs) AS (SELECT DISTINCT dataset, leader, 0::BIGINT, []::BIGINT[] FROM o2
    UNION ALL SELECT s2.dataset, s2.leader, o2.rn, CASE WHEN len(list_intersect(coalesce(n.earlier, []), s2.subs)) > 0 THEN s2.subs
      ELSE list_append(s2.subs, o2.vec_id) END
    FROM s2 JOIN o2 ON o2.dataset = s2.dataset AND o2.leader = s2.leader AND o2.rn = s2.rn + 1
      LEFT JOIN near2 n ON n.dataset = o2.dataset AND n.leader = o2.leader AND n.rn = o2.rn),
  lead2 AS (SELECT dataset, leader, unnest(subs) AS sub FROM s2
    QUALIFY row_number() OVER (PARTITION BY dataset, leader ORDER BY rn DESC) = 1),
  asg2 AS (SELECT a.dataset, a.leader, a.vec_id, l.sub FROM o2 a JOIN lead2 l ON l.dataset = a.dataset AND l.leader = a.leader
    JOIN vec b ON b.vec_id = l.sub
    QUALIFY row_number() OVER (PARTITION BY a.dataset, a.leader, a.vec_id ORDER BY {SIM} DESC, l.sub) = 1),
  sized AS (SELECT *, count(*) OVER w AS n, min(vec_id) OVER w AS first FROM asg2 WINDOW w AS (PARTITION BY dataset, leader, sub)),
  ranked AS (SELECT z.*, row_number() OVER (PARTITION BY z.dataset, leader, sub ORDER BY {SIM} DESC, z.vec_id) - 1 AS rank
    FROM sized z JOIN vec a ON a.vec_id = z.vec_id JOIN vec b ON b.vec_id = z.first),
  placed AS (SELECT dataset, vec_id, leader, -1::BIGINT AS sub, 0::BIGINT AS chunk, vec_id AS pos FROM asg
      QUALIFY count(*) OVER (PARTITION BY dataset, leader) <= 12
    UNION ALL SELECT dataset, vec_id, leader, sub, CASE WHEN n > 12 THEN rank // 12 ELSE 0 END, CASE WHEN n > 12 THEN rank ELSE vec_id END FROM ranked),
  made AS (SELECT dataset, leader, sub, chunk, count(*) AS cluster_size, min_by(vec_id, pos) AS head FROM placed GROUP BY ALL),
  told AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY cluster_size DESC, head) AS cluster_no FROM made)
  SELECT dataset, vec_id, cluster_no, cluster_size FROM placed JOIN told USING (dataset, leader, sub, chunk)"""


@query("microclusters", _MICRO)
def microclusters(spark, folder):
    members = vectors(spark, folder).select("dataset", "vec_id", "words", F.lit(12).alias("limit"))
    return C.microclusters(members, ["dataset"], "vec_id", "limit").select("dataset", "vec_id", "cluster_no", "cluster_size")


# The same scan with room for nine: the leaders chosen so far travel as a list, one per row seen.
_CAPACITY = f"""WITH RECURSIVE {VECTORS},
  o AS (SELECT dataset, vec_id, word, row_number() OVER (PARTITION BY dataset ORDER BY vec_id) AS rn FROM vec),
  near AS (SELECT a.dataset, b.rn, list(a.vec_id ORDER BY a.vec_id) AS earlier FROM o a JOIN o b
    ON a.dataset = b.dataset AND a.rn < b.rn WHERE {SIM} >= 0.4::DOUBLE GROUP BY ALL),
  s(dataset, rn, chosen) AS (SELECT DISTINCT dataset, 0::BIGINT, []::BIGINT[] FROM o
    UNION ALL SELECT s.dataset, o.rn, list_append(s.chosen, coalesce(list_min(list_filter(coalesce(n.earlier, []),
      lambda x: len(list_filter(s.chosen, lambda y: y = x)) BETWEEN 1 AND 8)), o.vec_id))
    FROM s JOIN o ON o.dataset = s.dataset AND o.rn = s.rn + 1 LEFT JOIN near n ON n.dataset = o.dataset AND n.rn = o.rn),
  e AS (SELECT dataset, chosen FROM s QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY rn DESC) = 1)
  SELECT o.dataset, o.vec_id AS node, e.chosen[o.rn] AS leader FROM o JOIN e USING (dataset)"""


@query("capacity_clusters", _CAPACITY)
def capacity(spark, folder):
    members = vectors(spark, folder).select("dataset", F.col("vec_id").alias("node"), "words", F.lit(9).cast("long").alias("limit"))
    return capacity_clusters(members, ["dataset"], "limit")


_EMPTY_VECTORS = VECTORS.replace("vec AS", "vraw AS") + """,
  vall AS (SELECT * EXCLUDE (split), grp IN ('No_Scaffold', 'class_1', 'class_2', 'class_3', 'class_4') AS empty,
    CASE WHEN grp NOT IN ('No_Scaffold', 'class_1', 'class_2', 'class_3', 'class_4') THEN split
      WHEN vec_id % 10 < 2 THEN 'train' WHEN vec_id % 2 = 0 THEN 'valid' ELSE 'test' END AS split FROM vraw),
  shares AS (SELECT dataset, count(*) FILTER (empty) AS ne, CASE WHEN count(*) <= 1000 THEN [0.6, 0.2, 0.2] WHEN count(*) <= 3000
    THEN [5 / 7, 1 / 7, 1 / 7] ELSE [0.8, 0.1, 0.1] END::DOUBLE[] AS share FROM vall GROUP BY dataset),
  wholes AS (SELECT dataset, ne, i, floor(share[i] * ne)::BIGINT AS base, row_number() OVER (PARTITION BY dataset ORDER BY -round(share[i] * ne - floor(share[i] * ne), 9), i) AS turn
    FROM shares, range(1, 4) AS r(i)),
  target AS (SELECT dataset, ne, max(t) FILTER (i = 1) AS t_train, max(t) FILTER (i = 2) AS t_valid, max(t) FILTER (i = 3) AS t_test,
    greatest(1, coalesce(floor(min(t) FILTER (t > 0) * {fraction}), 1))::BIGINT AS lim
    FROM (SELECT *, base + (turn <= ne - sum(base) OVER (PARTITION BY dataset))::BIGINT AS t FROM wholes) GROUP BY dataset, ne),
  vec AS (SELECT vall.*, lim FROM vall JOIN target USING (dataset) WHERE empty)"""


def _repair_sql(condition: R.RepairCondition) -> str:
    """Microclusters with a size limit per dataset, one step of the walk per cluster, then the backfill."""
    c = condition
    sides = ("train", "valid", "test")
    couple = {("train", "valid"): c.lambda_internal + c.lambda_valid, ("train", "test"): c.lambda_internal + c.lambda_test, ("valid", "test"): c.lambda_internal}
    to_train = {"train": 0.0, "valid": c.lambda_valid, "test": c.lambda_test}
    double = "{}::DOUBLE".format

    def score(option: str) -> tuple[str, str, str]:
        """Whether an option is feasible, its score and its cost."""
        after = {s: f"(n_{s} + {'size' if s == option else '0'})" for s in sides}
        gap = {s: f"greatest(0, l_{s} - {after[s]})" for s in sides}
        cost = f"{double(c.lambda_drop)} * size"
        if option != "drop":
            pulls = [f"{double(couple[tuple(sorted((option, s), key=sides.index))])} * near_{s}" for s in sides if s != option]
            cost = " + ".join([f"{double(to_train[option])} * const", *pulls])
        for s in sides:
            off = f"{after[s]} - t_{s}"
            cost += f" + {double(c.lambda_imbalance)} * (3 * greatest(0, {off}) + abs({off})) / greatest(t_{s}, 1)"
        gaps = " + ".join(gap.values())
        extra = f"2 * ({gaps}) / greatest(1, ne)::DOUBLE"
        if option == "drop":
            extra += " + 10 * (" + " + ".join(f"({g} > 0)::INT" for g in gap.values()) + ")"
        return f"n_drop + {'size' if option == 'drop' else '0'} <= budget AND {gaps} <= rest", f"round({cost} + {extra}, 12)", cost

    options = {o: score(o) for o in (*sides, "drop")}
    ranked = ", ".join(
        f"{{'bad': NOT ({ok}), 'score': {full}, 'drop': {int(o == 'drop')}, 'n': {f'n_{o}' if o != 'drop' else '0'}, 'o': {i}}}" for i, (o, (ok, full, _)) in enumerate(options.items())
    )
    costs = ", ".join(f"{{'cost': {cost}, 'o': {i}}}" for i, (_, _, cost) in enumerate(options.values()))
    names = "['train', 'valid', 'test', 'drop']"
    floors = ", ".join(f"CASE WHEN t_{s} > 0 THEN greatest(1, floor(t_{s} * {getattr(c, f'lower_{s}')})) ELSE 0 END::BIGINT AS l_{s}" for s in sides)
    rising = ", ".join(f"CASE WHEN pick = '{s}' THEN near_{s} + total ELSE near_{s} END" for s in sides)
    counted = ", ".join(f"coalesce(sum(size) FILTER (choice = '{s}') OVER w, 0)::BIGINT AS n_{s}" for s in (*sides, "drop"))
    of_next = ", ".join(f"max({x}) FILTER (pos = step + 1) OVER w AS {x}" for x in ("size", "const", "near_train", "near_valid", "near_test", "rest"))
    lack = {s: f"greatest(0, l_{s} - n_{s})" for s in sides}
    final = ", ".join(f"coalesce(sum(size) FILTER (choice = '{s}'), 0)::BIGINT AS n_{s}" for s in sides)
    leaders = _ASSIGN.replace(VECTORS, _EMPTY_VECTORS.format(fraction=c.max_cluster_to_smallest_target))
    return f"""{leaders}, big AS (SELECT dataset, leader, vec_id, word FROM asg JOIN vec USING (dataset, vec_id)
    QUALIFY count(*) OVER (PARTITION BY dataset, leader) > lim),
  o2 AS (SELECT *, row_number() OVER (PARTITION BY dataset, leader ORDER BY vec_id) AS rn FROM big),
  near2 AS (SELECT a.dataset, a.leader, b.rn, list(a.vec_id) AS earlier FROM o2 a JOIN o2 b
    ON a.dataset = b.dataset AND a.leader = b.leader AND a.rn < b.rn WHERE {SIM} >= 0.4::DOUBLE GROUP BY ALL),
  s2(dataset, leader, rn, subs) AS (SELECT DISTINCT dataset, leader, 0::BIGINT, []::BIGINT[] FROM o2
    UNION ALL SELECT s2.dataset, s2.leader, o2.rn, CASE WHEN len(list_intersect(coalesce(n.earlier, []), s2.subs)) > 0 THEN s2.subs
      ELSE list_append(s2.subs, o2.vec_id) END
    FROM s2 JOIN o2 ON o2.dataset = s2.dataset AND o2.leader = s2.leader AND o2.rn = s2.rn + 1
      LEFT JOIN near2 n ON n.dataset = o2.dataset AND n.leader = o2.leader AND n.rn = o2.rn),
  lead2 AS (SELECT dataset, leader, unnest(subs) AS sub FROM s2 QUALIFY row_number() OVER (PARTITION BY dataset, leader ORDER BY rn DESC) = 1),
  asg2 AS (SELECT a.dataset, a.leader, a.vec_id, l.sub FROM o2 a JOIN lead2 l ON l.dataset = a.dataset AND l.leader = a.leader JOIN vec b ON b.vec_id = l.sub
    QUALIFY row_number() OVER (PARTITION BY a.dataset, a.leader, a.vec_id ORDER BY {SIM} DESC, l.sub) = 1),
  sized AS (SELECT *, count(*) OVER w AS n, min(vec_id) OVER w AS first FROM asg2 WINDOW w AS (PARTITION BY dataset, leader, sub)),
  ranked AS (SELECT z.*, a.lim, row_number() OVER (PARTITION BY z.dataset, leader, sub ORDER BY {SIM} DESC, z.vec_id) - 1 AS rank
    FROM sized z JOIN vec a ON a.vec_id = z.vec_id JOIN vec b ON b.vec_id = z.first),
  cut AS (SELECT dataset, vec_id, leader, -1::BIGINT AS sub, 0::BIGINT AS chunk, vec_id AS place FROM asg JOIN vec USING (dataset, vec_id)
      QUALIFY count(*) OVER (PARTITION BY dataset, leader) <= lim
    UNION ALL SELECT dataset, vec_id, leader, sub, CASE WHEN n > lim THEN rank // lim ELSE 0 END, CASE WHEN n > lim THEN rank ELSE vec_id END FROM ranked),
  made AS (SELECT dataset, leader, sub, chunk, count(*) AS size, min_by(vec_id, place) AS head FROM cut GROUP BY ALL),
  told AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY size DESC, head) AS cluster_no FROM made),
  mem AS (SELECT dataset, vec_id, word, cluster_no, size FROM cut JOIN told USING (dataset, leader, sub, chunk) JOIN vec USING (dataset, vec_id)),
  costed AS (SELECT a.dataset, a.cluster_no, any_value(a.size) AS size, coalesce(sum(round({SIM} * 1e9)::BIGINT) / 1e9::DOUBLE, 0) AS const
    FROM mem a JOIN vall b ON b.dataset = a.dataset AND NOT b.empty AND b.split = 'train' GROUP BY a.dataset, a.cluster_no),
  posed AS (SELECT *, row_number() OVER w AS pos, sum(size) OVER (w ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM costed
    WINDOW w AS (PARTITION BY dataset ORDER BY size DESC, const DESC, cluster_no)),
  mp AS (SELECT mem.dataset, mem.word, pos FROM mem JOIN posed USING (dataset, cluster_no)),
  pt AS (SELECT a.dataset, a.pos, b.pos AS other, sum(round({SIM} * 1e9)::BIGINT) / 1e9::DOUBLE AS total FROM mp a JOIN mp b USING (dataset) GROUP BY ALL),
  aims AS (SELECT *, {floors}, floor(ne * {c.drop_budget})::BIGINT AS budget FROM target),
  walk(dataset, pos, size, const, rest, near_train, near_valid, near_test, choice, step) AS (
    SELECT dataset, pos, size, const, ne - upto, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, ''::VARCHAR, 0::BIGINT FROM posed JOIN aims USING (dataset)
    UNION ALL SELECT dataset, pos, own, own_const, own_rest, {rising.replace('near_', 'own_')}, CASE WHEN pos = step + 1 THEN pick ELSE choice END, step + 1
    FROM (SELECT *, CASE WHEN best.bad THEN {names}[list_min([{costs}]).o + 1] ELSE {names}[best.o + 1] END AS pick FROM (
      SELECT *, list_min([{ranked}]) AS best FROM (
        SELECT k.dataset, k.pos, k.step, k.choice, k.size AS own, k.const AS own_const, k.rest AS own_rest,
          k.near_train AS own_train, k.near_valid AS own_valid, k.near_test AS own_test, t.total, g.* EXCLUDE (gd), {counted}, {of_next}
        FROM walk k JOIN (SELECT dataset AS td, pos AS tp, other, total FROM pt) t ON t.td = k.dataset AND t.tp = k.pos AND t.other = k.step + 1
          JOIN (SELECT dataset AS gd, * EXCLUDE (dataset) FROM aims) g ON g.gd = k.dataset
        WINDOW w AS (PARTITION BY k.dataset))))),
  done AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY dataset)),
  state AS (SELECT dataset, {final} FROM done GROUP BY dataset),
  needy AS (SELECT dataset, {lack['valid']} AS lv, {lack['test']} AS lt, n_train - l_train AS spare FROM state JOIN aims USING (dataset)
    WHERE {lack['train']} = 0 AND {lack['valid']} + {lack['test']} > 0),
  line AS (SELECT dataset, pos, size, lv, lt, spare, sum(size) OVER (PARTITION BY dataset ORDER BY size, const, pos ROWS UNBOUNDED PRECEDING) AS upto
    FROM done JOIN needy USING (dataset) WHERE choice = 'train'),
  movable AS (SELECT *, coalesce(max(upto) FILTER (upto - size < lv) OVER (PARTITION BY dataset), 0) AS used FROM line WHERE upto <= spare),
  moved AS (SELECT dataset, pos, CASE WHEN upto - size < lv THEN 'valid' WHEN upto - size >= used AND upto - size - used < lt THEN 'test' END AS move FROM movable),
  fate AS (SELECT dataset, cluster_no, 'ESA_' || CASE WHEN cluster_no < 100000 THEN lpad(cluster_no::VARCHAR, 5, '0') ELSE cluster_no::VARCHAR END AS label,
    coalesce(move, choice) AS split, posed.size, posed.const FROM done JOIN posed USING (dataset, pos) LEFT JOIN moved USING (dataset, pos))"""


@query(
    "greedy_repair",
    f"""{_repair_sql(R.CONDITIONS["D_train_support_priority"])}
  SELECT v.dataset, v.vec_id AS node, v.empty AS is_empty, fate.label AS "ESA_cluster_id", v.split AS "RawSplit",
    CASE WHEN v.empty THEN coalesce(fate.split, 'drop') ELSE v.split END AS "Split",
    CASE WHEN v.empty THEN 'ESA_D_train_support_priority' ELSE 'DataSAIL_scaffold_backbone' END AS "SplitSource"
  FROM vall v LEFT JOIN mem USING (dataset, vec_id) LEFT JOIN fate USING (dataset, cluster_no)""",
)
def greedy_repair(spark, folder):
    audit, _ = R.repair_split(_members(spark, folder), ["dataset"], "node")
    return audit.drop("words")


@query(
    "repair_cluster_summary",
    f"""{_repair_sql(R.CONDITIONS["A_balanced_baseline"])}
  SELECT dataset, label AS cluster_id, split, size AS cluster_size, round(const::DECIMAL(18, 9), 6)::DOUBLE AS const_to_sb_train, false AS is_invalid_fp_group FROM fate""",
    "const_to_sb_train",
)
def repair_cluster_summary(spark, folder):
    return R.repair_split(_members(spark, folder), ["dataset"], "node", "A_balanced_baseline")[1]


# Scan with room per condition, then the clusters walk one step at a time: every member's row holds its best similarity
# to train and to test so far, and windows over the rows of a condition give the three scores.
def _sums(split: str) -> str:
    """Sums and sizes if the cluster of this step joins a split."""
    train, test = ("greatest({0}, sim)" if split == s else "{0}" for s in ("train", "test"))
    asks = {s: f"(branch = '{s}'" + (" OR pos = step + 1)" if split == s else ")") for s in ("valid", "test")}

    def mean(query: str, best: str) -> str:
        return f"coalesce(sum({best}) FILTER ({asks[query]}) OVER w / 1e9 / nullif(count(*) FILTER ({asks[query]}) OVER w, 0), 0)"

    def size(s: str) -> str:
        return f"(count(*) FILTER (branch = '{s}') OVER w" + (" + count(*) FILTER (pos = step + 1) OVER w)" if s == split else ")")

    total = "(" + " + ".join(size(s) for s in ("train", "valid", "test")) + ")"
    uneven = " + ".join(f"abs({size(s)} / {total} - t_{s})" for s in ("train", "valid", "test"))
    return (
        f"round(w_cross * {mean('valid', test.format('bt'))} + w_valid * {mean('valid', train.format('ba'))} + w_test * {mean('test', train.format('ba'))}"
        f" + w_size * ({uneven}) - CASE WHEN count(*) FILTER (branch = '{split}') OVER w < l_{split} THEN 1 ELSE 0 END, 9)"
    )


_CONDITIONS = ", ".join(str(c) for c in SWEEP_CONDITIONS)
_SWEEP = f"""WITH RECURSIVE {VECTORS},
  mem AS (SELECT dataset, vec_id AS node, word, grp IN ('No_Scaffold', 'class_1', 'class_2', 'class_3', 'class_4') AS empty, split FROM vec),
  cond(condition, priority, f, w_cross, w_valid, w_test, w_size, f_train, f_valid, f_test, drops) AS (VALUES {_CONDITIONS}),
  sized AS (SELECT dataset, count(*) AS n, count(*) FILTER (empty) AS ne,
    CASE WHEN count(*) <= 1000 THEN 0.6::DOUBLE WHEN count(*) <= 3000 THEN 5 / 7::DOUBLE ELSE 0.8::DOUBLE END AS t_train,
    CASE WHEN count(*) <= 1000 THEN 0.2::DOUBLE WHEN count(*) <= 3000 THEN 1 / 7::DOUBLE ELSE 0.1::DOUBLE END AS t_valid FROM mem GROUP BY dataset),
  want AS (SELECT *, t_valid AS t_test, greatest(1, floor(ne * t_train)) AS n_train, greatest(1, floor(ne * t_valid)) AS n_valid FROM sized),
  plan AS (SELECT dataset, condition, priority, n, ne, t_train, t_valid, t_test, w_cross, w_valid, w_test, w_size,
    floor(n_train * f_train) AS l_train, floor(n_valid * f_valid) AS l_valid, floor(n_valid * f_test) AS l_test,
    greatest(1, ceil(f * least(n_train, n_valid)))::BIGINT AS room FROM want, cond),
  o AS (SELECT dataset, condition, node, word, room, row_number() OVER (PARTITION BY dataset, condition ORDER BY node) AS rn
    FROM mem JOIN plan USING (dataset) WHERE empty),
  near AS (SELECT a.dataset, a.condition, b.rn, list(a.node ORDER BY a.node) AS earlier FROM o a JOIN o b
    ON a.dataset = b.dataset AND a.condition = b.condition AND a.rn < b.rn WHERE {SIM} >= 0.4::DOUBLE GROUP BY ALL),
  s(dataset, condition, rn, chosen) AS (SELECT DISTINCT dataset, condition, 0::BIGINT, []::BIGINT[] FROM o
    UNION ALL SELECT s.dataset, s.condition, o.rn, list_append(s.chosen, coalesce(list_min(list_filter(coalesce(x.earlier, []),
      lambda l: len(list_filter(s.chosen, lambda y: y = l)) BETWEEN 1 AND o.room - 1)), o.node))
    FROM s JOIN o ON o.dataset = s.dataset AND o.condition = s.condition AND o.rn = s.rn + 1
      LEFT JOIN near x ON x.dataset = o.dataset AND x.condition = o.condition AND x.rn = o.rn),
  e AS (SELECT dataset, condition, chosen FROM s QUALIFY row_number() OVER (PARTITION BY dataset, condition ORDER BY rn DESC) = 1),
  cl AS (SELECT o.dataset, o.condition, o.node, o.word, e.chosen[o.rn] AS leader FROM o JOIN e USING (dataset, condition)),
  posed AS (SELECT dataset, condition, leader, row_number() OVER (PARTITION BY dataset, condition ORDER BY count(*) DESC, leader) AS pos
    FROM cl GROUP BY dataset, condition, leader),
  cp AS (SELECT * FROM cl JOIN posed USING (dataset, condition, leader)),
  mc AS (SELECT a.dataset, a.condition, a.node, b.pos AS at, max(round({SIM} * 1e9)::BIGINT) AS sim
    FROM cp a JOIN cp b ON a.dataset = b.dataset AND a.condition = b.condition GROUP BY ALL),
  back AS (SELECT a.dataset, a.node, max(round({SIM} * 1e9)::BIGINT) AS ba FROM mem a JOIN mem b ON a.dataset = b.dataset
    WHERE a.empty AND NOT b.empty AND b.split = 'train' GROUP BY ALL),
  walk(dataset, condition, node, pos, step, branch, ba, bt) AS (
    SELECT dataset, condition, node, pos, 0::BIGINT, ''::VARCHAR, coalesce(back.ba, 0)::BIGINT, 0::BIGINT FROM cp LEFT JOIN back USING (dataset, node)
    UNION ALL SELECT dataset, condition, node, pos, step + 1, CASE WHEN pos = step + 1 THEN pick ELSE branch END,
      CASE WHEN pick = 'train' THEN greatest(ba, sim) ELSE ba END, CASE WHEN pick = 'test' THEN greatest(bt, sim) ELSE bt END
    FROM (SELECT *, CASE WHEN a <= b AND a <= c THEN 'train' WHEN b <= c THEN 'valid' ELSE 'test' END AS pick FROM (
      SELECT k.*, mc.sim, {_sums('train')} AS a, {_sums('valid')} AS b, {_sums('test')} AS c
      FROM walk k JOIN mc ON mc.dataset = k.dataset AND mc.condition = k.condition AND mc.node = k.node AND mc.at = k.step + 1
        JOIN plan p ON p.dataset = k.dataset AND p.condition = k.condition
      WINDOW w AS (PARTITION BY k.dataset, k.condition)))),
  placed AS (SELECT * FROM walk QUALIFY step = max(step) OVER (PARTITION BY dataset, condition)),
  sums AS (SELECT dataset, condition, max(pos) AS n_microclusters,
    count(*) FILTER (branch = 'train') AS e_train, count(*) FILTER (branch = 'valid') AS e_valid, count(*) FILTER (branch = 'test') AS e_test,
    coalesce(sum(ba) FILTER (branch = 'valid') / 1e9 / count(*) FILTER (branch = 'valid'), 0) AS valid_train_similarity,
    coalesce(sum(ba) FILTER (branch = 'test') / 1e9 / count(*) FILTER (branch = 'test'), 0) AS test_train_similarity FROM placed GROUP BY ALL),
  bear AS (SELECT dataset, count(*) FILTER (split = 'train') AS b_train, count(*) FILTER (split = 'valid') AS b_valid,
    count(*) FILTER (split = 'test') AS b_test FROM mem WHERE NOT empty GROUP BY ALL),
  prop AS (SELECT dataset, condition, priority, ne AS n_no_scaffold, n_microclusters, ne / n::DOUBLE AS full_no_scaffold_proportion,
    e_train / (e_train + b_train)::DOUBLE AS train_no_scaffold_proportion, e_valid / (e_valid + b_valid)::DOUBLE AS valid_no_scaffold_proportion,
    e_test / (e_test + b_test)::DOUBLE AS test_no_scaffold_proportion, valid_train_similarity, test_train_similarity
    FROM plan JOIN sums USING (dataset, condition) JOIN bear USING (dataset)),
  told AS (SELECT *, train_no_scaffold_proportion / full_no_scaffold_proportion AS support_recovery,
    greatest(valid_no_scaffold_proportion, test_no_scaffold_proportion) / train_no_scaffold_proportion AS sink_ratio,
    greatest(valid_train_similarity, test_train_similarity) AS max_eval_train_similarity,
    greatest(abs(train_no_scaffold_proportion - full_no_scaffold_proportion), abs(valid_no_scaffold_proportion - full_no_scaffold_proportion),
      abs(test_no_scaffold_proportion - full_no_scaffold_proportion)) AS distribution_gap FROM prop)
  SELECT *, abs(support_recovery - 1) + sink_ratio + distribution_gap + max_eval_train_similarity AS score FROM told"""


@query(
    "condition_sweep",
    _SWEEP,
    "full_no_scaffold_proportion train_no_scaffold_proportion valid_no_scaffold_proportion test_no_scaffold_proportion support_recovery"
    " sink_ratio valid_train_similarity test_train_similarity max_eval_train_similarity distribution_gap score",
)
def sweep(spark, folder):
    return condition_sweep(_members(spark, folder), ["dataset"], "node")
