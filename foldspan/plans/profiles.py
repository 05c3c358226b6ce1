"""Queries that profile decisions, targets and clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.functions import actions as A
from foldspan.functions import buckets as B
from foldspan.functions import vectors as V
from foldspan.operators import profile as P
from foldspan.plans.common import FINITE, LEGAL
from foldspan.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _rounded(df, places: int = 8):
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


PHASE = "CASE WHEN kyoku < 4 THEN 'early' WHEN kyoku < 8 THEN 'middle' WHEN kyoku >= 8 THEN 'late' END"
GAP = "CASE WHEN score_gap >= 12000 THEN 'ahead_big' WHEN score_gap >= 0 THEN 'ahead' WHEN score_gap > -12000 THEN 'behind' WHEN score_gap <= -12000 THEN 'behind_big' END"
COUNT = "CASE WHEN legal_actions <= 5 THEN '1_5' WHEN legal_actions <= 10 THEN '6_10' WHEN legal_actions > 10 THEN '11_plus' END"
READY = "CASE WHEN shanten <= 0 THEN 'tenpai_or_agari' WHEN shanten <= 2 THEN CAST(shanten AS VARCHAR) WHEN shanten > 2 THEN '3_plus' END"
CLEAN = "t AS (SELECT * FROM decisions WHERE target IS NOT NULL AND isfinite(target))"


@query(f"WITH {CLEAN} SELECT {PHASE} AS phase_bucket, current_rank, {GAP} AS gap_bucket, own_riichi, {COUNT} AS legal_bucket, {READY} AS shanten_bucket, count(*) AS n, round(avg(target), 8) AS mean, round(stddev_pop(target), 8) AS std FROM t GROUP BY 1, 2, 3, 4, 5, 6")
def stratum_bucket_stats(spark, d):
    t = table(spark, d, "decisions").select(B.phase("kyoku").alias("phase_bucket"), "current_rank", B.score_gap("score_gap").alias("gap_bucket"), "own_riichi", B.legal_count("legal_actions").alias("legal_bucket"), B.shanten("shanten").alias("shanten_bucket"), "target")
    return _rounded(P.scalar_stats(t, ["phase_bucket", "current_rank", "gap_bucket", "own_riichi", "legal_bucket", "shanten_bucket"], "target"))


NAME = "CASE WHEN action IS NULL THEN NULL WHEN action BETWEEN 0 AND 36 THEN 'discard' WHEN action = 37 THEN 'reach' WHEN action = 38 THEN 'chi_low' WHEN action = 39 THEN 'chi_mid' WHEN action = 40 THEN 'chi_high' WHEN action = 41 THEN 'pon' WHEN action = 42 THEN 'kan' WHEN action = 43 THEN 'agari' WHEN action = 44 THEN 'ryukyoku' WHEN action = 45 THEN 'pass' ELSE 'other' END"


@query(f"WITH c AS (SELECT {PHASE} AS phase_bucket, {NAME} AS kind, count(*) AS c FROM decisions GROUP BY 1, 2), s AS (SELECT phase_bucket, sum(c) AS n, count(*) AS kinds FROM c GROUP BY 1) SELECT c.phase_bucket, CAST(max(s.n) AS BIGINT) AS n, max(s.kinds) AS kinds, round(-sum((c.c / s.n) * ln(c.c / s.n)), 8) AS entropy FROM c JOIN s ON c.phase_bucket IS NOT DISTINCT FROM s.phase_bucket GROUP BY 1")
def stratum_entropy(spark, d):
    t = table(spark, d, "decisions").select(B.phase("kyoku").alias("phase_bucket"), A.name("action").alias("kind"))
    return _rounded(P.category_entropy(t, ["phase_bucket"], "kind"))


@query(f"WITH c AS (SELECT route, {NAME} AS kind, count(*) AS n FROM decisions GROUP BY 1, 2) SELECT route, kind, n, round(n / sum(n) OVER (PARTITION BY route), 8) AS share FROM c")
def action_mix(spark, d):
    c = table(spark, d, "decisions").groupBy("route", A.name("action").alias("kind")).agg(F.count("*").alias("n"))
    total = c.groupBy("route").agg(F.sum("n").alias("all"))
    return c.join(total.withColumnRenamed("route", "r"), F.col("route").eqNullSafe(F.col("r"))).select("route", "kind", "n", F.round(F.col("n") / F.col("all"), 8).alias("share"))


STEPS = "CASE WHEN steps_to_done <= 0 THEN '0' WHEN steps_to_done <= 4 THEN '1_4' WHEN steps_to_done <= 12 THEN '5_12' WHEN steps_to_done <= 24 THEN '13_24' WHEN steps_to_done > 24 THEN '25_plus' END"


@query(f"WITH t AS (SELECT * FROM learnability_rows WHERE q_target IS NOT NULL AND isfinite(q_target)), b AS (SELECT unnest(['all', 'steps_' || {STEPS}, 'phase_' || phase, 'current_rank_' || current_rank, 'score_gap_' || {GAP}, 'own_riichi_' || own_riichi]) AS bucket, q_target AS v FROM t) SELECT bucket, count(*) AS n, round(avg(v), 8) AS mean, round(stddev_pop(v), 8) AS std FROM b WHERE bucket IS NOT NULL GROUP BY 1")
def overlapping_strata(spark, d):
    names = F.array(F.lit("all"), F.concat(F.lit("steps_"), B.steps("steps_to_done")), F.concat(F.lit("phase_"), "phase"), F.concat(F.lit("current_rank_"), F.col("current_rank").cast("string")), F.concat(F.lit("score_gap_"), B.score_gap("score_gap")), F.concat(F.lit("own_riichi_"), F.col("own_riichi").cast("string")))
    return _rounded(P.overlapping(table(spark, d, "learnability_rows"), names, "q_target"))


@query(f"""WITH b AS (SELECT route, action, mask[action + 1] AS m, q[action + 1] AS o, {LEGAL} AS l FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL AND action IS NOT NULL),
c AS (SELECT route, action, CASE WHEN m AND o IS NOT NULL AND isfinite(o) THEN o END AS own, l, list_sort(list_transform(l, lambda x: x.q), 'DESC') AS v FROM b),
e AS (SELECT route, own, v[1] - own AS regret, v[1] - v[2] AS margin, v[1] AS top, len(list_filter(v, lambda x: x > own)) + 1 AS rank, list_avg(list_transform(v, lambda x: abs(x))) AS scale, CASE WHEN list_min(list_transform(list_filter(l, lambda x: x.q = v[1]), lambda x: x.a)) = action THEN 1.0 ELSE 0.0 END AS agree FROM c)
SELECT route, count(*) AS states, count(own) AS legal, round(avg(CASE WHEN own IS NOT NULL THEN agree END), 8) AS agreement, round(avg(CASE WHEN own IS NOT NULL THEN rank END), 8) AS mean_rank, round(avg(regret), 8) AS regret, round(avg(CASE WHEN own IS NOT NULL THEN margin END), 8) AS margin, round(avg(own), 8) AS own_q, round(avg(CASE WHEN own IS NOT NULL THEN top END), 8) AS top_q, round(avg(CASE WHEN own IS NOT NULL THEN scale END), 8) AS scale FROM e GROUP BY 1""")
def behaviour_support(spark, d):
    return _rounded(P.support(table(spark, d, "decisions"), ["route"]))


def _reg(x, y, src, key):
    ok = f"{x} IS NOT NULL AND {y} IS NOT NULL AND isfinite({x}) AND isfinite({y})"
    return f"""WITH g AS (SELECT {key}, count(*) AS n, avg({x}) AS xm, stddev_pop({x}) AS xs, avg({y}) AS ym, stddev_pop({y}) AS ys, covar_pop({x}, {y}) AS cov, avg({y} - {x}) AS rm, var_pop({y} - {x}) AS rv FROM {src} WHERE {ok} GROUP BY 1)
SELECT {key}, n, round(xm, 6) AS x_mean, round(xs, 6) AS x_std, round(ym, 6) AS y_mean, round(ys, 6) AS y_std, round(CASE WHEN xs > 0 AND ys > 0 THEN cov / (xs * ys) END, 6) AS pearson, round(CASE WHEN xs > 0 THEN cov / (xs * xs) END, 6) AS slope, round(CASE WHEN xs > 0 THEN ym - cov / (xs * xs) * xm END, 6) AS intercept, round(rm, 6) AS residual_mean, round(sqrt(rv), 6) AS residual_std, round(CASE WHEN ys > 0 THEN 1 - rv / (ys * ys) END, 6) AS identity_explained FROM g"""


@query(_reg("terminal_return", "q_target", "learnability_rows", "own_riichi"))
def target_regression(spark, d):
    return _rounded(P.regression(table(spark, d, "learnability_rows"), ["own_riichi"], "terminal_return", "q_target"), 6)


@query(_reg("l_quantity", "l_extendedprice", "lineitem", "l_returnflag"))
def price_regression(spark, d):
    return _rounded(P.regression(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"), 6)


@query("WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY l_returnflag ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_returnflag, l_discount) - 1) / 2.0 AS ry FROM lineitem) SELECT l_returnflag, count(*) AS n, round(corr(rx, ry), 8) AS rho FROM r GROUP BY 1")
def spearman_avg_rank(spark, d):
    return _rounded(P.spearman(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_discount"))


CONTRIB = """WITH s AS (SELECT {0} AS c, count(*) AS n FROM {1} GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n) AS i, row_number() OVER (ORDER BY n DESC) AS j, count(*) OVER () AS m FROM s), t AS (SELECT max(m) AS m, sum(n) AS rows_, sum(n * n) AS sq, sum((2 * i - m - 1) * n) AS g, sum(CASE WHEN j <= greatest(1, ceil(m * 0.01)) THEN n ELSE 0 END) AS t1, sum(CASE WHEN j <= greatest(1, ceil(m * 0.05)) THEN n ELSE 0 END) AS t5, sum(CASE WHEN j <= greatest(1, ceil(m * 0.1)) THEN n ELSE 0 END) AS t10, quantile_cont(n, [0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1]) AS q FROM r)
SELECT m AS clusters, CAST(rows_ AS BIGINT) AS rows, round(t1 / rows_, 8) AS top_1pct_share, round(t5 / rows_, 8) AS top_5pct_share, round(t10 / rows_, 8) AS top_10pct_share, round(g / (m * rows_), 8) AS gini, round(rows_ * rows_ / sq, 8) AS ess, round(q[1], 8) AS p0, round(q[2], 8) AS p25, round(q[3], 8) AS p50, round(q[4], 8) AS p75, round(q[5], 8) AS p90, round(q[6], 8) AS p95, round(q[7], 8) AS p99, round(q[8], 8) AS p100 FROM t"""


@query(CONTRIB.format("log_id", "decisions"))
def contribution_gini_ess(spark, d):
    return _rounded(P.contribution(table(spark, d, "decisions"), "log_id"))


@query(CONTRIB.format("l_partkey", "lineitem"))
def contribution_parts(spark, d):
    return _rounded(P.contribution(table(spark, d, "lineitem"), "l_partkey"))


@query("SELECT phase, count(*) AS n, round(quantile_cont(margin, 0.05), 8) AS p5, round(quantile_cont(margin, 0.5), 8) AS p50, round(quantile_cont(margin, 0.95), 8) AS p95, round(avg(margin), 8) AS mean, round(min(margin), 8) AS least, round(max(margin), 8) AS most FROM decision_snapshots WHERE margin IS NOT NULL AND isfinite(margin) GROUP BY 1")
def quantiles_linear(spark, d):
    s = table(spark, d, "decision_snapshots").where(FINITE.format("margin"))
    p = lambda x: F.round(F.percentile("margin", F.lit(x)), 8)
    return s.groupBy("phase").agg(F.count("*").alias("n"), p(0.05).alias("p5"), p(0.5).alias("p50"), p(0.95).alias("p95"), F.round(F.avg("margin"), 8).alias("mean"), F.round(F.min("margin"), 8).alias("least"), F.round(F.max("margin"), 8).alias("most"))


@query("WITH r AS (SELECT phase, margin, row_number() OVER (PARTITION BY phase ORDER BY margin) - 1 AS i, count(*) OVER (PARTITION BY phase) AS n FROM decision_snapshots WHERE margin IS NOT NULL AND isfinite(margin)) SELECT phase, max(n) AS n, max(CASE WHEN i = least(floor(n * 0.05), n - 1) THEN margin END) AS q5, max(CASE WHEN i = least(floor(n * 0.5), n - 1) THEN margin END) AS q50, max(CASE WHEN i = least(floor(n * 0.95), n - 1) THEN margin END) AS q95 FROM r GROUP BY 1")
def quantiles_nearest(spark, d):
    return P.nearest_rank(table(spark, d, "decision_snapshots"), ["phase"], "margin", (0.05, 0.5, 0.95))


@query("SELECT route, count(*) AS n, round(avg(target), 8) AS mean, round(stddev_pop(target), 8) AS std FROM decisions WHERE target IS NOT NULL AND isfinite(target) GROUP BY 1")
def partial_final_merge(spark, d):
    parts = P.scalar_stats(table(spark, d, "decisions"), ["route", "log_id"], "target")
    return _rounded(P.merge_partials(parts, ["route"]))


@query("WITH c AS (SELECT source, sha256(text) AS h, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) SELECT source, CAST(sum(c) AS BIGINT) AS rows, count(*) AS \"distinct\", CAST(sum(c) - count(*) AS BIGINT) AS dup_rows, round((sum(c) - count(*)) / sum(c), 8) AS dup_rate, max(c) AS most FROM c GROUP BY 1")
def duplicate_hash_audit(spark, d):
    return _rounded(P.duplicates(table(spark, d, "documents"), ["source"], F.sha2("text", 256)))


@query()
def duplicate_state_audit(spark, d):
    from foldspan.functions.hashing import state_hash

    return _rounded(P.duplicates(table(spark, d, "decisions"), ["route"], state_hash("obs", "mask")))


@query(f"""WITH e AS (SELECT route, list_filter(list_transform(range(46), lambda i: CASE WHEN mask[i + 1] AND isfinite(q[i + 1]) THEN {{'x': q[i + 1], 'y': round(q[i + 1] * 0.9 + 0.02 * (i % 5), 9)}} END), lambda x: x IS NOT NULL) AS l FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL),
f AS (SELECT route, len(l) AS k, list_sum(list_transform(l, lambda p: abs(p.y - p.x))) AS s, CASE WHEN list_position(list_transform(l, lambda p: p.x), list_max(list_transform(l, lambda p: p.x))) <> list_position(list_transform(l, lambda p: p.y), list_max(list_transform(l, lambda p: p.y))) THEN 1 ELSE 0 END AS ch FROM e WHERE len(l) > 0)
SELECT route, count(*) AS states, round(sum(s) / sum(k), 8) AS pooled_abs, round(avg(s / k), 8) AS per_state_abs, round(avg(ch), 8) AS greedy_changed FROM f GROUP BY 1""")
def value_drift(spark, d):
    moved = F.transform("q", lambda x, i: F.round(x * 0.9 + 0.02 * F.pmod(i, F.lit(5)), 9))
    t = table(spark, d, "decisions").where("q is not null and mask is not null").withColumn("q2", F.when(F.size("q") > 0, moved))
    return _rounded(P.drift(t, "q", "q2", "mask", ["route"]))


EDGES = (0.0, 0.05, 0.1, 0.25, 0.5, 1.0, 2.0)
BIN = "CASE " + " ".join(f"WHEN margin >= {a} AND margin < {b} THEN '[{a:g},{b:g})'" for a, b in zip(EDGES, EDGES[1:])) + f" WHEN margin >= {EDGES[-1]} THEN '[{EDGES[-1]:g},inf)' END"


@query(f"SELECT phase, {BIN} AS bin, count(*) AS n, CAST(sum(CASE WHEN margin <= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS close FROM decision_snapshots WHERE margin IS NOT NULL AND isfinite(margin) GROUP BY 1, 2")
def margin_histogram(spark, d):
    s = table(spark, d, "decision_snapshots").where(FINITE.format("margin"))
    return s.groupBy("phase", B.histogram_bin("margin", list(EDGES)).alias("bin")).agg(F.count("*").alias("n"), F.count_if(F.col("margin") <= 0.5).alias("close"))


@query("SELECT top1_action, top2_action, count(*) AS n, round(avg(CASE WHEN isfinite(margin) THEN margin END), 8) AS mean_margin FROM decision_snapshots WHERE top1_action IS NOT NULL AND top2_action IS NOT NULL GROUP BY 1, 2")
def transition_counts(spark, d):
    s = table(spark, d, "decision_snapshots").where("top1_action is not null and top2_action is not null")
    return s.groupBy("top1_action", "top2_action").agg(F.count("*").alias("n"), F.round(F.avg(B.finite("margin")), 8).alias("mean_margin"))


SEM = "CASE WHEN {0} < 37 THEN 'discard' WHEN {0} = 37 THEN 'reach' WHEN {0} < 41 THEN 'chi' WHEN {0} = 41 THEN 'pon' WHEN {0} = 42 THEN 'kan' WHEN {0} = 43 THEN 'agari' WHEN {0} = 44 THEN 'ryukyoku' ELSE 'pass' END"


@query(f"SELECT phase, count(*) AS n, round(avg(CASE WHEN {SEM.format('top1_action')} = {SEM.format('top2_action')} THEN 1.0 ELSE 0.0 END), 8) AS same_semantic FROM decision_snapshots WHERE top1_action IS NOT NULL AND top2_action IS NOT NULL GROUP BY 1")
def same_semantic_rate(spark, d):
    s = table(spark, d, "decision_snapshots").where("top1_action is not null and top2_action is not null")
    kind = lambda c: F.regexp_replace(A.name(c), "^chi_.*", "chi")
    return s.groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg(F.when(kind("top1_action") == kind("top2_action"), 1.0).otherwise(0.0)), 8).alias("same_semantic"))


@query("SELECT event_type, CAST(user_id % 4 AS INTEGER) AS seat, count(*) AS n, count(DISTINCT user_id) AS clusters FROM events GROUP BY 1, 2")
def event_counts_by_actor(spark, d):
    # per cluster first: the distinct count becomes a plain count
    per = table(spark, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("c"))
    return per.groupBy("event_type", F.pmod("user_id", F.lit(4)).cast("int").alias("seat")).agg(F.sum("c").alias("n"), F.count("*").alias("clusters"))


@query("WITH c AS (SELECT log_id, sum(CASE WHEN action_kind = 'reach' THEN 1 ELSE 0 END) AS r, count(*) AS n FROM decisions GROUP BY 1) SELECT count(*) AS clusters, CAST(sum(CASE WHEN r > 0 THEN 1 ELSE 0 END) AS BIGINT) AS with_event, CAST(min(r) AS BIGINT) AS least, round(median(r), 8) AS mid, CAST(max(r) AS BIGINT) AS most, round(sum(r) / sum(n), 8) AS rate FROM c")
def clusters_with_event(spark, d):
    c = table(spark, d, "decisions").groupBy("log_id").agg(F.count_if(F.col("action_kind") == "reach").alias("r"), F.count("*").alias("n"))
    return c.agg(F.count("*").alias("clusters"), F.count_if(F.col("r") > 0).alias("with_event"), F.min("r").alias("least"), F.round(F.median("r"), 8).alias("mid"), F.max("r").alias("most"), F.round(F.sum("r") / F.sum("n"), 8).alias("rate"))


@query("SELECT phase, count(*) AS n, round(avg(abs(q_target)), 8) AS mean_abs, round(avg(q_target), 8) AS mean, round(stddev_pop(q_target), 8) AS std, round(avg(CASE WHEN q_target <> 0 THEN 1.0 ELSE 0.0 END), 8) AS nonzero, round(quantile_cont(q_target, 0.01), 8) AS p1, round(quantile_cont(q_target, 0.99), 8) AS p99 FROM learnability_rows WHERE q_target IS NOT NULL AND isfinite(q_target) GROUP BY 1")
def reward_distribution(spark, d):
    t = table(spark, d, "learnability_rows").where(FINITE.format("q_target"))
    return _rounded(t.groupBy("phase").agg(F.count("*").alias("n"), F.avg(F.abs("q_target")).alias("mean_abs"), F.avg("q_target").alias("mean"), F.stddev_pop("q_target").alias("std"), F.avg(F.when(F.col("q_target") != 0, 1.0).otherwise(0.0)).alias("nonzero"), F.percentile("q_target", F.lit(0.01)).alias("p1"), F.percentile("q_target", F.lit(0.99)).alias("p99")))


@query("""WITH m AS (SELECT l_returnflag AS k, l_discount AS v, sum(l_quantity) AS w FROM lineitem WHERE l_quantity > 0 GROUP BY 1, 2), c AS (SELECT k, v, sum(w) OVER (PARTITION BY k ORDER BY v) / sum(w) OVER (PARTITION BY k) AS hi FROM m), l AS (SELECT *, coalesce(lag(hi) OVER (PARTITION BY k ORDER BY v), 0) AS lo, coalesce(lag(v) OVER (PARTITION BY k ORDER BY v), v) AS prev FROM c), i AS (SELECT unnest(range(16)) AS i)
SELECT k AS l_returnflag, CAST(i.i AS INTEGER) AS i, round(prev + (v - prev) * ((i.i + 0.5) / 16 - lo) / (hi - lo), 8) AS x FROM l JOIN i ON (i.i + 0.5) / 16 > lo + 1e-12 AND (i.i + 0.5) / 16 <= hi + 1e-12""")
def weighted_quantiles(spark, d):
    return _rounded(P.weighted_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity", 16))


@query(f"""WITH b AS (SELECT route, action, list_transform({LEGAL}, lambda x: x.q) AS v, q[action + 1] AS own, target FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL AND action IS NOT NULL AND mask[action + 1] AND isfinite(q[action + 1]) AND target IS NOT NULL AND isfinite(target)),
c AS (SELECT route, own, target, list_avg(v) AS m, list_max(v) + ln(list_sum(list_transform(v, lambda x: exp(x - list_max(v))))) AS lse, list_max(v) AS top, list_stddev_pop(v) AS sd FROM b)
SELECT route, count(*) AS n, round(avg(0.5 * (own - greatest(-9, least(9, target))) * (own - greatest(-9, least(9, target)))), 8) AS value_loss, round(avg(lse - own), 8) AS cql, round(avg(m), 8) AS legal_mean, round(avg(sd), 8) AS legal_std, round(avg(own - m), 8) AS centred_advantage, round(avg(top - own), 8) AS regret FROM c GROUP BY 1""")
def objective_columns(spark, d):
    t = table(spark, d, "decisions").where(F.col("q").isNotNull() & F.col("mask").isNotNull() & F.col("action").isNotNull()).where(FINITE.format("target"))
    t = t.select("route", F.greatest(F.lit(-9.0), F.least(F.lit(9.0), F.col("target"))).alias("target"), F.col("action"), V.legal().alias("l")).select("route", "target", V.values("l").alias("v"), F.get(F.filter("l", lambda x: x["action"] == F.col("action")), F.lit(0))["q"].alias("own")).where("own is not null")
    m = V.mean("v")
    sd = F.sqrt(F.greatest(F.lit(0.0), V.mean(F.transform("v", lambda x: x * x)) - m * m))
    t = t.select("route", "target", "own", m.alias("m"), sd.alias("sd"), V.log_sum_exp("v").alias("lse"), F.array_max("v").alias("top"))
    e = F.col("own") - F.col("target")
    return _rounded(t.groupBy("route").agg(F.count("*").alias("n"), F.avg(0.5 * e * e).alias("value_loss"), F.avg(F.col("lse") - F.col("own")).alias("cql"), F.avg("m").alias("legal_mean"), F.avg("sd").alias("legal_std"), F.avg(F.col("own") - F.col("m")).alias("centred_advantage"), F.avg(F.col("top") - F.col("own")).alias("regret")))
