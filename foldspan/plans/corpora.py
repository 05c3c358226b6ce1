"""Queries on whole corpora: scans, contract violations, resampled deltas and votes, exposure, reconciliation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.functions import buckets as B
from foldspan.functions.actions import name as action_name
from foldspan.operators import compare as C
from foldspan.operators import corpora as O
from foldspan.operators import resample as S
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


def _rounded(df, n=8):
    return df.select(*[F.round(c, n).alias(c) if t in ("double", "float") else c for c, t in df.dtypes])


MEASURED = f"""l AS (SELECT *, {LEGAL} AS l FROM decisions WHERE route IS NOT NULL), t AS (SELECT *, list_sort(list_transform(l, lambda x: {{'k': -x.q, 'a': x.a}})) AS o, list_filter(l, lambda x: x.a = action) AS own FROM l),
m AS (SELECT * EXCLUDE (l, o, own), CASE WHEN len(o) > 0 THEN len(o) END AS legal_n, o[1].a AS greedy, own[1].q AS own_q, -o[1].k - own[1].q AS regret, CASE WHEN len(o) > 0 THEN coalesce(o[2].k - o[1].k, 0) END AS margin, CASE WHEN isfinite(target) THEN target END AS y FROM t)"""


def _measured(spark, d):
    return O.measures(table(spark, d, "decisions").where("route is not null")).withColumn("y", B.finite("target"))


@query(f"""WITH {MEASURED}, b AS (SELECT route, count(*) AS rows, CAST(sum(CASE WHEN own_q IS NOT NULL AND y IS NOT NULL AND greedy = action THEN 1 ELSE 0 END) AS BIGINT) AS agreed, coalesce(nullif(corr(own_q, y) FILTER (y IS NOT NULL AND own_q IS NOT NULL), 'NaN'::DOUBLE), 0) AS corr, count(y) AS ny, sum(y) AS sy, sum(y * y) AS syy, count(DISTINCT obs_id) AS decisions, count(DISTINCT hash(log_id, kyoku)) FILTER (log_id IS NOT NULL AND kyoku IS NOT NULL) AS states FROM m GROUP BY 1),
c AS (SELECT route, count(*) AS clusters, min(c) AS least, quantile_cont(c, 0.5) AS median, max(c) AS most FROM (SELECT route, log_id, count(*) AS c FROM m GROUP BY 1, 2) GROUP BY 1), s AS (SELECT route, sum(ss - s * s / n) AS w FROM (SELECT route, phase, kyoku, count(y) AS n, sum(y) AS s, sum(y * y) AS ss FROM m GROUP BY 1, 2, 3) WHERE n >= 2 GROUP BY 1)
SELECT b.route, rows, clusters, least, median, most, states, decisions, round(agreed / rows, 8) AS agreement, round(corr, 8) AS corr, round(CASE WHEN ny > 1 AND syy - sy * sy / ny > 0 THEN coalesce(w, 0) / (syy - sy * sy / ny) ELSE 1 END, 8) AS within_ratio FROM b JOIN c USING (route) LEFT JOIN s USING (route)""")
def corpus_scan(spark, d):
    """Cohorts at a glance; a state is a segment of a log here, so that SQL can count it too."""
    state = F.when(F.col("log_id").isNotNull() & F.col("kyoku").isNotNull(), F.xxhash64("log_id", "kyoku"))
    return _rounded(O.scan(_measured(spark, d), "route", "log_id", ["phase", "kyoku"], state, F.col("obs_id"), "y"))


@query(f"""WITH {MEASURED}, h AS (SELECT route, unnest([{{'h': 'action', 'b': CASE WHEN action IS NULL THEN NULL WHEN action BETWEEN 0 AND 36 THEN 'discard' ELSE coalesce(['reach', 'chi_low', 'chi_mid', 'chi_high', 'pon', 'kan', 'agari', 'ryukyoku', 'pass'][action - 36], 'other') END}}, {{'h': 'phase', 'b': CASE WHEN kyoku < 4 THEN 'early' WHEN kyoku < 8 THEN 'middle' WHEN kyoku >= 8 THEN 'late' END}}, {{'h': 'rank', 'b': CAST(current_rank AS VARCHAR)}}, {{'h': 'legal', 'b': CASE WHEN legal_n <= 5 THEN '1_5' WHEN legal_n <= 10 THEN '6_10' WHEN legal_n > 10 THEN '11_plus' END}}, {{'h': 'regret', 'b': CASE WHEN regret < 1 THEN 'lt_1' WHEN regret < 3 THEN '1_3' WHEN regret >= 3 THEN 'ge_3' END}}, {{'h': 'margin', 'b': CASE WHEN margin < 1 THEN 'lt_1' WHEN margin < 3 THEN '1_3' WHEN margin >= 3 THEN 'ge_3' END}}]) AS x FROM m) SELECT route, x.h AS histogram, x.b AS bucket, count(*) AS n FROM h WHERE x.b IS NOT NULL GROUP BY 1, 2, 3""")
def corpus_histograms(spark, d):
    m = _measured(spark, d)
    return O.histograms(m, "route", {"action": action_name("action"), "phase": B.phase("kyoku"), "rank": F.col("current_rank"), "legal": B.legal_count("legal_"), "regret": B.margin("regret_"), "margin": B.margin("margin_")})


KEY = ["generation_seed", "seed_key", "seat", "kyoku_index", "decision_index"]
_RULES = {
    "context": "seat NOT BETWEEN 0 AND 3 OR kyoku_index < 0 OR decision_index < 0",
    "missing_context": " OR ".join(f"{k} IS NULL" for k in KEY),
    "own_riichi": "eligible AND own_riichi",
    "semantic": "eligible AND NOT (top1_action BETWEEN 0 AND 36 AND top2_action BETWEEN 0 AND 36 AND top1_action <> top2_action)",
    "missing_q": "eligible AND (top1_q IS NULL OR top2_q IS NULL OR margin IS NULL)",
    "order": "abs(top1_q) < 1e300 AND abs(top2_q) < 1e300 AND top1_q < top2_q",
    "margin_identity": "abs(margin) < 1e300 AND abs(top1_q) < 1e300 AND abs(top2_q) < 1e300 AND abs(margin - (top1_q - top2_q)) > 1e-6",
    "threshold": "eligible AND abs(margin) < 1e300 AND margin > 0.5 + 1e-12",
    "negative_margin": "abs(margin) < 1e300 AND margin < 0",
    "few_legal": "eligible AND legal_action_count < 2",
    "action": "eligible AND action NOT IN (top1_action, top2_action)",
    "phase": "phase NOT IN ('early', 'middle', 'late')",
}
_COUNTED = {"legal_pair": ("eligible AND NOT (list_contains(finite_legal_actions, top1_action) AND list_contains(finite_legal_actions, top2_action))", "eligible AND NOT (array_contains(finite_legal_actions, top1_action) AND array_contains(finite_legal_actions, top2_action))"), "legal_count": ("len(finite_legal_actions) > legal_action_count", "size(finite_legal_actions) > legal_action_count AND finite_legal_actions IS NOT NULL"), "repeated_legal": ("len(finite_legal_actions) <> len(list_distinct(finite_legal_actions))", "size(finite_legal_actions) <> size(array_distinct(finite_legal_actions)) AND finite_legal_actions IS NOT NULL")}


@query(" UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({sql}) AS n FROM decision_snapshots" for k, sql in {**_RULES, **{k: v[0] for k, v in _COUNTED.items()}}.items()) + f" UNION ALL SELECT 'duplicate_context', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM decision_snapshots GROUP BY {', '.join(KEY)})")
def contract_violations(spark, d):
    """Sixteen kinds of violation of the exploration contract, each row held to all of them."""
    rules = {k: F.expr(v) for k, v in {**_RULES, **{k: v[1] for k, v in _COUNTED.items()}}.items()}
    return O.violations(table(spark, d, "decision_snapshots"), rules, KEY)


# ---------------------------------------------------------------- resampled deltas
FAMILIES = ("score_gap", "shanten", "legal_actions", "current_rank")
_DAYS = """ids AS (SELECT day, row_number() OVER (ORDER BY day) - 1 AS place FROM (SELECT DISTINCT CAST(CAST(played_at AS DATE) AS VARCHAR) AS day FROM decisions WHERE played_at IS NOT NULL)), n AS (SELECT count(*) AS n FROM ids), d AS (SELECT r.r AS rep, (('0x' || substr(sha256('days|' || r.r || '|' || s.s), 1, 8))::UBIGINT % n.n) AS place FROM n, unnest(range(1000)) r(r), (SELECT unnest(range(n)) AS s FROM n) s), m AS (SELECT rep, place, count(*) AS times FROM d GROUP BY 1, 2)"""
_LONG = " UNION ALL ".join(f"SELECT '{f}' AS family, CAST(CAST(played_at AS DATE) AS VARCHAR) AS day, route, CAST({f} AS DOUBLE) AS v FROM decisions WHERE played_at IS NOT NULL AND route IS NOT NULL AND {f} IS NOT NULL AND isfinite(CAST({f} AS DOUBLE))" for f in FAMILIES)
_DELTAS = "SELECT family, rep, {0} - abs(max(CASE WHEN route = 'D1' THEN x END) - max(CASE WHEN route = 'D2' THEN x END)) AS delta1, {1} - abs(max(CASE WHEN route = 'D1' THEN x END) - max(CASE WHEN route = 'D2' THEN x END)) AS delta3 FROM w GROUP BY 1, 2"
_PLAIN = _DELTAS.format(*["(max(CASE WHEN route = 'M0' THEN x END) - max(CASE WHEN route = '{0}' THEN x END))".format(r) for r in ("D1", "D3")])
_FAR = _DELTAS.format(*["abs(max(CASE WHEN route = 'M0' THEN x END) - max(CASE WHEN route = '{0}' THEN x END))".format(r) for r in ("D1", "D3")])
_W = f"WITH {_DAYS}, x AS ({_LONG}), p AS (SELECT family, place, route, sum(v) AS s, count(*) AS c FROM x JOIN ids USING (day) GROUP BY 1, 2, 3), w AS (SELECT family, rep, route, sum(s * times) / sum(c * times) AS x FROM p JOIN m USING (place) GROUP BY 1, 2, 3)"
_CI = "ci AS (SELECT family, 'delta1' AS measure, quantile_cont(delta1, 0.025) AS lo, quantile_cont(delta1, 0.975) AS hi FROM dl GROUP BY 1 UNION ALL SELECT family, 'delta3', quantile_cont(delta3, 0.025), quantile_cont(delta3, 0.975) FROM dl GROUP BY 1)"


def _long(spark, d):
    day = F.to_date("played_at").cast("string").alias("day")
    each = F.array(*[F.struct(F.lit(f).alias("family"), F.col(f).cast("double").alias("v")) for f in FAMILIES])
    t = table(spark, d, "decisions").where("played_at is not null and route is not null")
    return t.select(day, "route", F.explode(each).alias("x")).select("day", "route", "x.family", "x.v").where(FINITE.format("v"))


def _drawn(spark, d, reps):
    ids = S.dense_ids(table(spark, d, "decisions").where("played_at is not null").select(F.to_date("played_at").cast("string").alias("day")).distinct(), "day", "place")
    return ids, S.multiplicities(ids.agg(F.count("*").alias("n")), reps, "days")


@query(f"{_W}, dl AS ({_PLAIN}), {_CI} SELECT family, measure, round(lo, 8) AS lo, round(hi, 8) AS hi, coalesce(lo > 0, false) AS above FROM ci")
def support_bootstrap(spark, d, reps=1000):
    """Intervals of cohort means less the gap between two views, over resampled days."""
    ids, times = _drawn(spark, d, reps)
    per = _long(spark, d).join(ids, "day").groupBy("family", "place", "route").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    means = per.join(times, "place").groupBy("family", "rep", "route").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times"))).alias("x"))
    out = None
    for f in FAMILIES:
        ci = O.interval(O.view_gap_deltas(means.where(F.col("family") == f), "x"), ["delta1", "delta3"]).select(F.lit(f).alias("family"), "measure", "lo", "hi", "above")
        out = ci if out is None else out.unionByName(ci)
    return _rounded(out)


def _mean_distance(va, wa, vb, wb) -> float:
    return abs((va * wa).sum() / wa.sum() - (vb * wb).sum() / wb.sum())


def _family_ci(spark, d, reps):
    ids, times = _drawn(spark, d, reps)
    placed = _long(spark, d).join(ids, "day").groupBy("family", "place", "route", "v").agg(F.count("*").alias("n"))
    out = None
    for f in FAMILIES:
        ci = O.interval(O.family_deltas(placed.where(F.col("family") == f).drop("family"), times, _mean_distance), ["delta1", "delta3"]).select(F.lit(f).alias("family"), "measure", "lo", "hi", "above")
        out = ci if out is None else out.unionByName(ci)
    return out


@query(f"{_W}, dl AS ({_FAR}), {_CI} SELECT family, measure, round(lo, 7) AS lo, round(hi, 7) AS hi FROM ci")
def distance_bootstrap(spark, d, reps=1000):
    """The same with a distance of one's choice between the cohorts' weighted values."""
    return _rounded(_family_ci(spark, d, reps).drop("above"), 7)


@query(f"{_W}, dl AS ({_FAR}), {_CI}, v AS (SELECT family, bool_and(lo > 0) AS vote FROM ci GROUP BY 1) SELECT count(*) FILTER (vote) AS votes, CASE WHEN count(*) FILTER (vote) >= 3 THEN 'supported' ELSE 'not_supported' END AS verdict FROM v")
def representation_votes(spark, d, reps=1000):
    """A verdict where at least three of four families have both intervals above zero."""
    return O.votes(_family_ci(spark, d, reps), 3)


@query("WITH u AS (SELECT c_nationkey % 3 AS s, c_nationkey, avg(c_acctbal) - 4500 AS v FROM customer GROUP BY 1, 2), m AS (SELECT s, avg(v) AS m FROM u GROUP BY 1), g AS (SELECT count(*) AS n, avg(v) AS pooled, quantile_cont(v, 0.5) AS median, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) / count(*) AS ahead, count(*) FILTER (v > 1e-12) AS k, count(*) FILTER (abs(v) > 1e-12) AS t FROM u) SELECT n, round((SELECT avg(m) FROM m), 6) AS mean, round(pooled, 6) AS pooled, round(median, 6) AS median, (SELECT count(*) FROM m WHERE m > 0) AS positive_seeds, round(ahead, 8) AS ahead, round((SELECT sum(factorial(CAST(t AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(t - i AS INTEGER)))) FROM unnest(range(CAST(k AS BIGINT), t + 1)) r(i)) / pow(2, t), 8) AS sign_p, CASE WHEN (SELECT bool_and(m > 0) FROM m) THEN 'all_seeds_positive' WHEN (SELECT avg(m) FROM m) > 0 THEN 'mixed' ELSE 'not_positive' END AS verdict FROM g")
def comparison_block(spark, d):
    """One paired comparison: mean of seed means, pooled mean, median, seeds ahead, sign test, verdict."""
    u = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 3).alias("s"), "c_nationkey").agg((F.avg("c_acctbal") - 4500).alias("v")).withColumn("one", F.lit(1))
    seeds = u.groupBy("s").agg(F.avg("v").alias("m")).agg(F.avg("m").alias("mean"), F.count_if(F.col("m") > 0).alias("positive_seeds"), F.bool_and(F.col("m") > 0).alias("all_"))
    pooled = u.agg(F.count("*").alias("n"), F.avg("v").alias("pooled"), F.percentile("v", F.lit(0.5)).alias("median"), (F.count_if(F.col("v") > 0) / F.count("*")).alias("ahead"))
    sign = S.sign_test(u, ["one"], "v").select(F.col("p").alias("sign_p"))
    one = lambda df: df.withColumn("k_", F.lit(1))
    j = one(pooled).join(one(seeds), "k_").join(one(sign), "k_")  # one row each
    verdict = F.when(F.col("all_"), "all_seeds_positive").when(F.col("mean") > 0, "mixed").otherwise("not_positive")
    return j.select("n", F.round("mean", 6).alias("mean"), F.round("pooled", 6).alias("pooled"), F.round("median", 6).alias("median"), "positive_seeds", F.round("ahead", 8).alias("ahead"), F.round("sign_p", 8).alias("sign_p"), verdict.alias("verdict"))


# ---------------------------------------------------------------- exposure
_EXPOSED = "s AS (SELECT log_id, count(*) AS n FROM decisions WHERE log_id IS NOT NULL GROUP BY 1), t AS (SELECT e.e AS epoch, log_id, n, sha256('expose|' || e.e || '|' || log_id) AS o FROM s, range(3) e(e)), b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY epoch ORDER BY o, log_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), c AS (SELECT log_id, CAST(sum(greatest(0, least(n, 1500 - epoch * (SELECT sum(n) FROM s) - before))) AS BIGINT) AS consumed FROM b GROUP BY 1)"


def _exposed(spark, d):
    sizes = table(spark, d, "decisions").where("log_id is not null").groupBy("log_id").agg(F.count("*").alias("n"))
    return O.exposure(sizes, "log_id", "n", 3, 1500, lambda e, c: F.sha2(F.concat_ws("|", F.lit("expose"), e.cast("string"), c), 256))


@query(f"WITH {_EXPOSED} SELECT * FROM c")
def exposure_draws(spark, d):
    return _exposed(spark, d)


@query(f"WITH {_EXPOSED}, r AS (SELECT consumed, row_number() OVER (ORDER BY consumed) AS i, row_number() OVER (ORDER BY consumed DESC) AS j, count(*) OVER () AS n FROM c) SELECT CAST(sum(consumed) AS BIGINT) AS total, count(*) FILTER (consumed > 0) AS unique, round((sum(consumed) - count(*) FILTER (consumed > 0)) / sum(consumed), 8) AS repeat_rate, round(sum((2 * i - n - 1) * consumed) / (max(n) * sum(consumed)), 8) AS gini, round(sum(CASE WHEN j <= greatest(1, n // 100) THEN consumed END) / sum(consumed), 8) AS top_1, round(sum(CASE WHEN j <= greatest(1, n // 20) THEN consumed END) / sum(consumed), 8) AS top_5, round(sum(CASE WHEN j <= greatest(1, n // 10) THEN consumed END) / sum(consumed), 8) AS top_10, round(pow(sum(consumed), 2) / sum(consumed * consumed), 8) AS effective_n FROM r")
def exposure_report(spark, d):
    return _rounded(O.exposure_report(_exposed(spark, d)))


@query("WITH c AS (SELECT kyoku % 3 AS family, own_riichi AS seed, route, action % 5 AS k, count(*) AS n FROM decisions WHERE kyoku IS NOT NULL AND own_riichi IS NOT NULL AND route IN ('M0', 'D1') AND action IS NOT NULL GROUP BY 1, 2, 3, 4), z AS (SELECT f.family, f.seed, r.route, k.k FROM (SELECT family, seed FROM c GROUP BY 1, 2 HAVING count(DISTINCT route) = 2) f, (VALUES ('M0'), ('D1')) r(route), range(5) k(k)), s AS (SELECT z.*, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY z.family, z.seed, z.route) AS p FROM z LEFT JOIN c ON z.family = c.family AND z.seed = c.seed AND z.route = c.route AND z.k = c.k), w AS (SELECT family, seed, k, max(CASE WHEN route = 'M0' THEN p END) AS p, max(CASE WHEN route = 'D1' THEN p END) AS q FROM s GROUP BY 1, 2, 3), j AS (SELECT family, seed, sqrt(greatest(0, 0.5 * sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12))) + 0.5 * sum(q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))))) AS jsd FROM w GROUP BY 1, 2) SELECT CAST(family AS INTEGER) AS family, count(*) AS seeds, round(avg(jsd), 8) AS mean_jsd FROM j GROUP BY 1")
def between_seed_jsd(spark, d):
    """Divergence of two cohorts per family and seed that has both, averaged over seeds."""
    t = table(spark, d, "decisions").where("kyoku is not null and own_riichi is not null and route in ('M0', 'D1') and action is not null")
    cells = t.groupBy((F.col("kyoku") % 3).alias("family"), F.col("own_riichi").alias("seed"), "route", (F.col("action") % 5).alias("k")).agg(F.count("*").alias("n"))
    shares = cells.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("family", "seed", "route")))  # a few cells
    one = lambda r: F.coalesce(F.max(F.when(F.col("route") == r, F.col("p"))), F.lit(0.0))
    two = shares.groupBy("family", "seed", "k").agg(one("M0").alias("p"), one("D1").alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.col(x) * F.ln((F.col(x) + C.EPS) / (m + C.EPS))
    j = two.groupBy("family", "seed").agg(F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q")))).alias("jsd"), F.sum("p").alias("a"), F.sum("q").alias("b")).where("a > 0 and b > 0")
    return _rounded(j.groupBy("family").agg(F.count("*").alias("seeds"), F.avg("jsd").alias("mean_jsd")))


@query("WITH c AS (SELECT phase, log_id, count(*) AS n FROM decisions WHERE phase IS NOT NULL GROUP BY 1, 2) SELECT phase AS category, CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, min(n) AS least, quantile_cont(n, 0.5) AS median, max(n) AS most FROM c GROUP BY 1")
def category_clusters(spark, d):
    per = table(spark, d, "decisions").where("phase is not null").groupBy(F.col("phase").alias("category"), "log_id").agg(F.count("*").alias("c"))
    return per.groupBy("category").agg(F.sum("c").alias("n"), F.count("*").alias("clusters"), F.min("c").alias("least"), F.percentile("c", F.lit(0.5)).alias("median"), F.max("c").alias("most"))


# ---------------------------------------------------------------- reconciliation
@query("WITH a AS (SELECT manifest_id, file_count AS v FROM export_manifests), b AS (SELECT manifest_id, count(*) AS v FROM export_jobs GROUP BY 1) SELECT CASE WHEN b.v IS NULL THEN 'missing' WHEN a.manifest_id IS NULL THEN 'unlisted' WHEN a.v IS NOT DISTINCT FROM b.v THEN 'match' ELSE 'differs' END AS state, count(*) AS n FROM a FULL JOIN b ON a.manifest_id = b.manifest_id GROUP BY 1")
def ledger_reconciliation(spark, d):
    ledger = table(spark, d, "export_manifests").select("manifest_id", F.col("file_count").alias("v"))
    return O.reconciled(ledger, table(spark, d, "export_jobs").groupBy("manifest_id").agg(F.count("*").alias("v")), ["manifest_id"], "v")


@query("SELECT manifest_id, sha256('{\"files\":[' || array_to_string(list_transform(list_sort(list_filter(files, lambda x: x IS NOT NULL)), lambda x: '\"' || x || '\"'), ',') || '],\"name\":\"' || schema_name || '\"}') AS digest FROM export_manifests WHERE files IS NOT NULL AND schema_name IS NOT NULL")
def nested_digests(spark, d):
    """Digest of a nested value in canonical form: keys in order, a set as a sorted list."""
    t = table(spark, d, "export_manifests").where("files is not null and schema_name is not null")
    quoted = F.transform(F.sort_array(F.filter("files", lambda x: x.isNotNull())), lambda x: F.concat(F.lit('"'), x, F.lit('"')))
    return t.select("manifest_id", F.sha2(F.concat(F.lit('{"files":['), F.array_join(quoted, ","), F.lit('],"name":"'), "schema_name", F.lit('"}')), 256).alias("digest"))


@query("WITH k AS (SELECT obs_id, min(loaded_at) AS a, max(loaded_at) AS b FROM decisions WHERE obs_id IS NOT NULL AND loaded_at IS NOT NULL AND q IS NOT NULL GROUP BY 1 HAVING min(loaded_at) < max(loaded_at)), x AS (SELECT DISTINCT ON (k.obs_id) k.obs_id, f.q AS f, l.q AS l FROM k JOIN decisions f ON f.obs_id = k.obs_id AND f.loaded_at = k.a AND f.q IS NOT NULL JOIN decisions l ON l.obs_id = k.obs_id AND l.loaded_at = k.b AND l.q IS NOT NULL) SELECT count(*) AS again, count(*) FILTER (len(f) = len(l)) AS same_length FROM x")
def rehydration_gate(spark, d):
    """Rows delivered again against their first delivery: how many there are, and how many of like shape."""
    t = table(spark, d, "decisions").where("obs_id is not null and loaded_at is not null and q is not null")
    both = t.groupBy("obs_id").agg(F.min_by("q", "loaded_at").alias("f"), F.max_by("q", "loaded_at").alias("l"), F.min("loaded_at").alias("a"), F.max("loaded_at").alias("b")).where("a < b")
    return both.agg(F.count("*").alias("again"), F.count_if(F.size("f") == F.size("l")).alias("same_length"))


_PTS = "CASE player_rank WHEN 1 THEN 90.0 WHEN 2 THEN 45.0 WHEN 3 THEN 0.0 WHEN 4 THEN -135.0 END"


@query(f"WITH r AS (SELECT *, {_PTS} AS p, max(row_idx) OVER (PARTITION BY log_id) AS last FROM learnability_rows WHERE player_rank BETWEEN 1 AND 4 AND log_id IS NOT NULL AND row_idx IS NOT NULL) SELECT log_id, count(*) AS n, round(sum(p), 6) AS final_rank_mc, round(sum(CASE WHEN row_idx = last THEN p ELSE 0 END), 6) AS terminal_rank, round(sum(CASE WHEN isfinite(q_target) THEN q_target ELSE 0 END), 6) AS model_delta FROM r GROUP BY 1")
def reward_modes(spark, d):
    t = table(spark, d, "learnability_rows").where("player_rank between 1 and 4 and log_id is not null and row_idx is not null")
    last = t.groupBy(F.col("log_id").alias("g")).agg(F.max("row_idx").alias("last"))
    r = t.join(last, F.col("log_id") == F.col("g")).withColumn("model", F.coalesce(B.finite("q_target"), F.lit(0.0)))
    made = {m: O.rewards(r, m, "player_rank", "row_idx", "last", [90, 45, 0, -135], "model") for m in ("final_rank_mc", "terminal_rank", "model_delta")}
    return r.groupBy("log_id").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 6).alias(m) for m, c in made.items()])


@query("SELECT route AS label, count(*) AS n, sha256(array_to_string(list_sort(list_distinct(list(log_id))), chr(10))) AS manifest FROM decisions WHERE route IS NOT NULL AND log_id IS NOT NULL GROUP BY 1")
def dataset_contract(spark, d):
    """Rows per label, and the digest of its sorted list of logs; a list of logs is as long as a manifest."""
    per = table(spark, d, "decisions").where("route is not null and log_id is not null").groupBy(F.col("route").alias("label"), "log_id").agg(F.count("*").alias("c"))
    return per.groupBy("label").agg(F.sum("c").alias("n"), F.sha2(F.array_join(F.sort_array(F.collect_list("log_id")), "\n"), 256).alias("manifest"))


@query("SELECT phase, kyoku, count(*) AS n, round(stddev_pop(target), 8) AS std FROM decisions WHERE isfinite(target) AND phase IS NOT NULL AND kyoku IS NOT NULL GROUP BY 1, 2 ORDER BY std DESC, n DESC, phase, kyoku LIMIT 20")
def top_buckets(spark, d):
    """The report's twenty buckets of widest spread."""
    t = table(spark, d, "decisions").where(FINITE.format("target")).where("phase is not null and kyoku is not null")
    return t.groupBy("phase", "kyoku").agg(F.count("*").alias("n"), F.round(F.stddev_pop("target"), 8).alias("std")).orderBy(F.desc("std"), F.desc("n"), "phase", "kyoku").limit(20)


@query("SELECT obs_id, 'action outside mask' AS error FROM (SELECT DISTINCT obs_id FROM decisions WHERE action IS NOT NULL AND mask[action + 1] = false AND obs_id IS NOT NULL) ORDER BY obs_id LIMIT 50")
def error_samples(spark, d):
    """The first fifty errors of a report."""
    t = table(spark, d, "decisions").where("action is not null and obs_id is not null").where(~F.get("mask", F.col("action"))).select("obs_id").distinct()
    return t.orderBy("obs_id").limit(50).withColumn("error", F.lit("action outside mask"))


@query("WITH b AS (SELECT o_orderkey, row_number() OVER (ORDER BY sha256('shuffle|' || o_orderkey)) - 1 AS place FROM orders) SELECT o_orderkey, place FROM b")
def shuffled_stream(spark, d):
    """Every row once, in the order of a seeded hash: what a shuffle buffer of any size is to give."""
    t = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.lit("shuffle"), F.col("o_orderkey").cast("string")), 256).alias("h"))
    return S.dense_ids(t, "h", "place").select("o_orderkey", "place")


@query("WITH a AS (SELECT manifest_id, sum(size_bytes) AS bytes, count(*) AS n FROM export_jobs WHERE manifest_id IS NOT NULL GROUP BY 1) SELECT m.manifest_id, coalesce(a.n, 0) AS jobs, m.file_count IS NOT DISTINCT FROM coalesce(a.n, 0) AS files_agree, coalesce(m.exported_file_count, 0) + coalesce(m.skipped_existing_file_count, 0) = m.processed_file_count AS parts_agree FROM export_manifests m LEFT JOIN a ON m.manifest_id = a.manifest_id")
def artifact_validation(spark, d):
    """Summaries against their detail rows."""
    a = table(spark, d, "export_jobs").where("manifest_id is not null").groupBy("manifest_id").agg(F.count("*").alias("jobs"))
    m = table(spark, d, "export_manifests").join(a, "manifest_id", "left").withColumn("jobs", F.coalesce("jobs", F.lit(0)))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return m.select("manifest_id", "jobs", F.col("file_count").eqNullSafe(F.col("jobs")).alias("files_agree"), (zero("exported_file_count") + zero("skipped_existing_file_count") == F.col("processed_file_count")).alias("parts_agree"))
