"""Queries on ordered logs: segments, history, as-of, budgets, ranks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.functions import hashing
from foldspan.operators import ranking as R
from foldspan.operators import windows as W
from foldspan.plans.common import EV, POINTS, SEATS, SEG, event_log, seat_scores
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


def _log(spark, d):
    return W.segment_ids(event_log(spark, d), "user_id", "idx", F.col("event_type") == "signup")


@query(f"WITH {SEG} SELECT user_id, event_id, idx, segment FROM seg")
def segment_ids(spark, d):
    return _log(spark, d).select("user_id", "event_id", "idx", "segment")


@query(f"WITH {SEG} SELECT user_id, event_id, idx, segment FROM seg")
def segment_ids_of_hot_clusters(spark, d):
    # the same result where one cluster may hold a third of all rows
    e = table(spark, d, "events").select("user_id", "event_id", "ts", "event_type")
    ranges = max(8, spark.sparkContext.defaultParallelism)
    r = W.running_sums(e, "user_id", ["ts", "event_id"], {"idx": F.lit(1).cast("bigint"), "segment": F.when(F.col("event_type") == "signup", 1).otherwise(0).cast("bigint")}, ranges)
    return r.select("user_id", "event_id", (F.col("idx") - 1).alias("idx"), (F.col("segment") - 1).alias("segment"))


@query(f"WITH {SEG} SELECT user_id, event_id, coalesce(max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS flag FROM seg")
def sticky_flag(spark, d):
    return W.sticky_flag(_log(spark, d), ["user_id", "segment"], "idx", F.col("event_type") == "purchase", "flag").select("user_id", "event_id", "flag")


@query(f"WITH {EV}, e AS (SELECT *, event_type = 'error' AS done, event_type IN ('click', 'view') AS c, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx DESC) AS ep, max(idx) OVER (PARTITION BY user_id) AS mx FROM ev) SELECT user_id, event_id, CAST(sum(CASE WHEN c AND NOT done AND idx <> mx THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ep ORDER BY idx DESC) AS BIGINT) AS steps FROM e")
def steps_to_done(spark, d):
    e = event_log(spark, d)
    return W.steps_to_done(e, "user_id", "idx", F.col("event_type") == "error", F.col("event_type").isin("click", "view"), "steps").select("user_id", "event_id", "steps")


@query(f"""WITH {SEG}, t AS (SELECT *, concat(event_type[1], least(15, (sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY idx) - CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) // 4)) AS tok FROM seg WHERE event_type <> 'signup'),
h AS (SELECT user_id, event_id, list(tok) OVER (PARTITION BY user_id, segment ORDER BY idx ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS l FROM t)
SELECT user_id, event_id, repeat('-,', 48 - coalesce(len(l), 0)) || coalesce(array_to_string(l, ','), '') AS history FROM h""")
def event_history_48(spark, d):
    log = _log(spark, d).where("event_type <> 'signup'")
    w = Window.partitionBy("user_id", "segment").orderBy("idx").rowsBetween(W.FIRST, -1)
    turn = F.least(F.lit(15), F.floor(F.coalesce(F.sum(F.when(F.col("event_type") == "click", 1).otherwise(0)).over(w), F.lit(0)) / 4))
    log = log.withColumn("token", F.concat(F.substring("event_type", 1, 1), turn.cast("string")))
    h = W.history(log, ["user_id", "segment"], "idx", F.col("token"), F.lit("-"), 48, "h")
    tail = F.filter("h", lambda x: x != "-")
    return h.select("user_id", "event_id", F.concat(F.repeat(F.lit("-,"), F.lit(48) - F.size(tail)), F.array_join(tail, ",")).alias("history"))


KINDS = ("click", "view", "purchase", "error")


@query(f"WITH {SEG}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY idx) AS pos_ FROM seg), r AS (SELECT user_id, event_id, pos_, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN pos_ END) OVER w AS l_{k}, coalesce(sum(CASE WHEN event_type = '{k}' THEN 1 ELSE 0 END) OVER w, 0) AS c_{k}" for k in KINDS) + " FROM s WINDOW w AS (PARTITION BY user_id, segment ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, " + ", ".join(f"CASE WHEN l_{k} IS NULL THEN 0.0 ELSE greatest(0.0, 1 - least(pos_ - l_{k}, 16) / 16.0) END AS rec_{k}, round(least(1.0, c_{k} / {c}), 6) AS cnt_{k}" for k, c in zip(KINDS, (60.0, 16.0, 8.0, 4.0))) + " FROM r")
def history_recency(spark, d):
    r = W.recency(_log(spark, d), ["user_id", "segment"], "idx", "event_type", list(KINDS))
    r = W.running_counts(r, ["user_id", "segment"], "idx", "event_type", dict(zip(KINDS, (60.0, 16.0, 8.0, 4.0))))
    return r.select("user_id", "event_id", *[f"rec_{k}" for k in KINDS], *[F.round(f"cnt_{k}", 6).alias(f"cnt_{k}") for k in KINDS])


@query(f"WITH {EV} SELECT user_id, event_id, max_by(value, idx) FILTER (WHERE event_type = 'click') OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_click FROM ev".replace("max_by(value, idx) FILTER (WHERE event_type = 'click') OVER", "last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER"))
def asof_last_event(spark, d):
    return W.asof(event_log(spark, d), ["user_id"], "idx", F.col("event_type") == "click", F.col("value"), "last_click").select("user_id", "event_id", "last_click")


@query(f"WITH {EV} SELECT user_id, event_id, first_value(CASE WHEN event_type NOT IN ('view', 'error') THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_id FROM ev")
def next_meaningful_event(spark, d):
    return W.next_match(event_log(spark, d), ["user_id"], "idx", ~F.col("event_type").isin("view", "error"), F.col("event_id"), "next_id").select("user_id", "event_id", "next_id")


@query(f"WITH {EV} SELECT a.user_id, a.event_id AS anchor_id, b.event_id AS target_id, CAST(b.idx - a.idx AS INTEGER) AS \"offset\" FROM ev a JOIN ev b ON a.user_id = b.user_id AND b.idx BETWEEN a.idx + 1 AND a.idx + 8 WHERE a.event_type = 'purchase'")
def lookahead_relations(spark, d):
    return W.lookahead(event_log(spark, d), ["user_id"], "idx", F.col("event_type") == "purchase", 8, F.col("event_id"))


@query(f"WITH {SEG}, s AS (SELECT *, row_number() OVER (PARTITION BY user_id, segment ORDER BY idx) AS pos_, count(*) OVER (PARTITION BY user_id, segment) AS n, max_by(value, idx) OVER (PARTITION BY user_id, segment) AS fin FROM seg) SELECT user_id, event_id, CAST(pow(0.99, n - pos_) * fin / 30000 AS FLOAT) AS target FROM s")
def mc_return_targets(spark, d):
    return W.discounted(_log(spark, d), ["user_id", "segment"], "idx", F.col("value") / 30000, 0.99, "target").select("user_id", "event_id", F.col("target").cast("float").alias("target"))


@query(f"WITH {SEG}, p AS (SELECT user_id, segment, max_by(value, idx) FILTER (WHERE event_type = 'signup') AS base, coalesce(sum(CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -value END), 0) AS delta, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS sticks FROM seg GROUP BY 1, 2) SELECT user_id, max(segment) AS segments, round(max_by(coalesce(base, 0) + delta - 10 * sticks, segment), 6) AS final, round(max_by(coalesce(base, 0) + delta, segment), 6) AS final_without_sticks FROM p GROUP BY 1")
def score_reconstruction(spark, d):
    return R.final_scores(_log(spark, d), "user_id", "segment", "idx", base=F.when(F.col("event_type") == "signup", F.col("value")), delta=F.when(F.col("event_type") == "purchase", F.col("value")).when(F.col("event_type") == "error", -F.col("value")), stick=F.col("event_type") == "click", cost=10)


@query("SELECT log_id, row_idx, row_number() OVER (PARTITION BY log_id ORDER BY row_idx) - 1 AS ordinal, loaded_at, CASE WHEN coalesce(action, -1) NOT IN (44, 45) THEN CAST(sum(CASE WHEN coalesce(action, -1) NOT IN (44, 45) THEN 1 ELSE 0 END) OVER (PARTITION BY log_id ORDER BY row_idx) - 1 AS BIGINT) END AS arena FROM (SELECT log_id, row_idx, max(loaded_at) AS loaded_at, max_by(action, loaded_at) AS action FROM decisions WHERE log_id IS NOT NULL AND row_idx IS NOT NULL GROUP BY 1, 2)")
def arena_index(spark, d):
    t = table(spark, d, "decisions").where("log_id is not null and row_idx is not null").groupBy("log_id", "row_idx").agg(F.max("loaded_at").alias("loaded_at"), F.max_by(F.struct("action"), "loaded_at").alias("a"))
    t = t.select("log_id", "row_idx", "loaded_at", F.col("a.action").alias("action"))
    t = W.numbered(t, ["log_id"], "row_idx", ~F.coalesce("action", F.lit(-1)).isin(44, 45), "arena")
    return t.select("log_id", "row_idx", (F.row_number().over(Window.partitionBy("log_id").orderBy("row_idx")) - 1).alias("ordinal"), "loaded_at", "arena")


@query(f"WITH {SEATS} SELECT game, seat, score, row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) AS rank FROM g")
def rank_by_seat(spark, d):
    return W.ranks(seat_scores(spark, d), ["game"], "score", "seat").select("game", "seat", "score", "rank")


@query(f"WITH {SEATS} SELECT game, seat, score, row_number() OVER (PARTITION BY game ORDER BY score DESC, (seat - day % 4 + 4) % 4) - 1 AS rank FROM g")
def rank_dealer_tiebreak(spark, d):
    r = W.ranks(seat_scores(spark, d), ["game"], "score", "seat", F.pmod("day", F.lit(4)))
    return r.select("game", "seat", "score", (F.col("rank") - 1).alias("rank"))


@query(f"WITH {SEATS} SELECT a.game, a.seat, CAST(1 + sum(CASE WHEN b.score > a.score OR (b.score = a.score AND b.seat < a.seat) THEN 1 ELSE 0 END) AS INTEGER) AS rank, a.score - max(CASE WHEN b.seat <> a.seat THEN b.score END) AS gap FROM g a JOIN g b ON a.game = b.game GROUP BY a.game, a.seat, a.score")
def rank_by_count_formula(spark, d):
    g = seat_scores(spark, d).groupBy("game").pivot("seat", [0, 1, 2, 3]).agg(F.first("score"))
    g = g.select("game", F.array("0", "1", "2", "3").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("seat")).where(F.get("s", F.col("seat")).isNotNull())
    return g.select("game", "seat", W.rank_in_array(F.col("s"), F.col("seat")).alias("rank"), W.gap_to_best_other(F.col("s"), F.col("seat")).alias("gap"))


BOARD = f"WITH {SEATS}, r AS (SELECT *, row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) AS rank FROM g)"


@query(f"{BOARD} SELECT seat, count(*) AS games, CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS rank_1, CAST(sum(CASE WHEN rank = 2 THEN 1 ELSE 0 END) AS BIGINT) AS rank_2, CAST(sum(CASE WHEN rank = 3 THEN 1 ELSE 0 END) AS BIGINT) AS rank_3, CAST(sum(CASE WHEN rank = 4 THEN 1 ELSE 0 END) AS BIGINT) AS rank_4, round(avg(rank), 6) AS avg_rank, round(avg({POINTS}), 6) AS avg_rank_pt FROM r GROUP BY 1")
def rank_leaderboard(spark, d):
    ranks = W.ranks(seat_scores(spark, d), ["game"], "score", "seat")
    return R.summarise_ranks(ranks, ["seat"], "rank", R.PROFILES["reference_90_45"])


@query(f"{BOARD} SELECT seat, profile, round(avg(CASE rank WHEN 1 THEN p1 WHEN 2 THEN p2 WHEN 3 THEN p3 ELSE p4 END), 6) AS avg_rank_pt FROM r, (VALUES ('reference_90_45', 90.0, 45.0, 0.0, -135.0), ('default_6_4_2_0', 6.0, 4.0, 2.0, 0.0), ('avoid4_raw', 4.0, 3.0, 2.0, -3.0), ('top1_raw', 8.0, 3.0, 1.0, -2.0)) v(profile, p1, p2, p3, p4) GROUP BY 1, 2")
def rank_point_profiles(spark, d):
    ranks = W.ranks(seat_scores(spark, d), ["game"], "score", "seat")
    return R.profile_points(ranks, ["seat"], "rank", ["reference_90_45", "default_6_4_2_0", "avoid4_raw", "top1_raw"])


@query(f"{BOARD} SELECT game, max(CASE WHEN seat = 0 THEN pt END) - max(CASE WHEN seat = 1 THEN pt END) AS d01, max(CASE WHEN seat = 0 THEN pt END) - max(CASE WHEN seat = 2 THEN pt END) AS d02, max(CASE WHEN seat = 0 THEN rank END) - max(CASE WHEN seat = 1 THEN rank END) AS rank_diff FROM (SELECT *, {POINTS} AS pt FROM r) GROUP BY 1")
def pivot_paired_deltas(spark, d):
    ranks = W.ranks(seat_scores(spark, d), ["game"], "score", "seat").withColumn("pt", R.points(F.col("rank"), R.PROFILES["reference_90_45"]))
    p = ranks.groupBy("game").pivot("seat", [0, 1, 2]).agg(F.first("pt").alias("pt"), F.first("rank").alias("rank"))
    return p.select("game", (F.col("0_pt") - F.col("1_pt")).alias("d01"), (F.col("0_pt") - F.col("2_pt")).alias("d02"), (F.col("0_rank") - F.col("1_rank")).alias("rank_diff"))


@query("SELECT CASE WHEN user_id % 3 = 0 THEN 'M0' WHEN user_id % 3 = 1 THEN 'D1' ELSE 'other' END AS family, CAST(count(DISTINCT user_id) AS BIGINT) AS games, count(*) AS rounds, CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS BIGINT) AS wins, round(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) / count(*), 8) AS win_rate, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) / count(*), 8) AS deal_in_rate, round(sum(CASE WHEN event_type = 'purchase' THEN value END) / sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END), 6) AS mean_win FROM events GROUP BY 1")
def family_rollup_rates(spark, d):
    e = table(spark, d, "events")
    fam = F.when(F.pmod("user_id", F.lit(3)) == 0, "M0").when(F.pmod("user_id", F.lit(3)) == 1, "D1").otherwise("other")
    return R.rollup_rates(e, fam, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", F.col("value"))


U = "((CAST('0x' || " + " || ".join(f"substr(h, {i}, 2)" for i in range(15, 0, -2)) + " AS UBIGINT))::DOUBLE / 18446744073709551616.0)"
KEY = "generation_seed, seed_key, seat, kyoku_index, decision_index"
ELIGIBLE = "NOT own_riichi AND top1_action < 37 AND top2_action < 37 AND margin <= 0.5 AND isfinite(margin)"


def _explored(spark, d):
    s = table(spark, d, "decision_snapshots")
    keys = [F.col(k) for k in KEY.split(", ")]
    s = s.where("not own_riichi and top1_action < 37 and top2_action < 37 and margin <= 0.5 and not isnan(margin) and margin > -1e300")
    s = s.groupBy(*keys).agg(F.count("*").alias("n"))
    s = s.withColumn("order", F.struct("kyoku_index", "decision_index"))
    return W.budgeted(s, ["generation_seed", "seed_key", "seat"], "kyoku_index", "order", hashing.exploration_u()).drop("order")


BUDGET = f"""e AS (SELECT {KEY}, count(*) AS n FROM decision_snapshots WHERE {ELIGIBLE} GROUP BY {KEY}), f AS (SELECT *, sha256('D3_top2_discard_v1|' || generation_seed || '|' || seed_key || '|' || seat || '|' || kyoku_index || '|' || decision_index) AS h FROM e WHERE generation_seed IS NOT NULL), u AS (SELECT *, {U} AS u FROM f),
a AS (SELECT *, sum(CASE WHEN u < 0.25 THEN 1 ELSE 0 END) OVER (PARTITION BY generation_seed, seed_key, seat, kyoku_index ORDER BY decision_index) AS hits FROM u), b AS (SELECT *, CASE WHEN u < 0.25 AND hits = 1 THEN 1 ELSE 0 END AS fst, hits - CASE WHEN u < 0.25 THEN 1 ELSE 0 END AS seen FROM a), c AS (SELECT *, coalesce(sum(fst) OVER (PARTITION BY generation_seed, seed_key, seat ORDER BY kyoku_index, decision_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM b)"""


@query(f"WITH {BUDGET} SELECT {KEY}, n, CASE WHEN used >= 8 THEN 'hanchan_budget_exhausted' WHEN seen > 0 THEN 'kyoku_budget_exhausted' WHEN u >= 0.25 THEN 'hash_rejected' ELSE 'explored' END AS reason FROM c")
def hash_uniform_budget(spark, d):
    return _explored(spark, d)


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events) SELECT user_id, CAST(p - 1 AS INTEGER) AS place, (SELECT 1) AS one, event_id FROM r WHERE p <= 3".replace(", (SELECT 1) AS one", ""))
def first_three_per_cluster(spark, d):
    return event_log(spark, d).where("idx < 3").select("user_id", F.col("idx").cast("int").alias("place"), "event_id")


@query("WITH n AS (SELECT DISTINCT c_custkey + c_custkey // 7 AS v, c_nationkey FROM customer), g AS (SELECT c_nationkey, v, v - row_number() OVER (PARTITION BY c_nationkey ORDER BY v) AS g FROM n) SELECT c_nationkey, min(v) AS first, max(v) AS last, count(*) AS n FROM g GROUP BY c_nationkey, g")
def contiguous_islands(spark, d):
    c = table(spark, d, "customer").select("c_nationkey", (F.col("c_custkey") + F.floor(F.col("c_custkey") / 7)).alias("v"))
    return W.islands(c, ["c_nationkey"], "v")


@query(f"WITH {SEG} SELECT user_id, segment, count(*) AS n, array_to_string(list(segment_total ORDER BY s2), ',') AS prefix FROM (SELECT DISTINCT a.user_id, a.segment, b.segment AS s2, b.n AS segment_total, a.n AS own FROM (SELECT user_id, segment, count(*) AS n FROM seg GROUP BY 1, 2) a JOIN (SELECT user_id, segment, count(*) AS n FROM seg GROUP BY 1, 2) b ON a.user_id = b.user_id AND b.segment <= a.segment) GROUP BY 1, 2".replace("count(*) AS n, array_to_string(list(segment_total", "max(own) AS n, array_to_string(list(segment_total"))
def prefix_expansion(spark, d):
    n = _log(spark, d).groupBy("user_id", "segment").agg(F.count("*").alias("n"))
    return W.prefixes(n, ["user_id"], "segment", "n").select("user_id", "segment", "n", F.array_join(F.transform("prefix", lambda x: x.cast("string")), ",").alias("prefix"))


@query("WITH k AS (SELECT DISTINCT shard FROM export_jobs WHERE shard IS NOT NULL), m AS (SELECT DISTINCT manifest_id FROM export_manifests), c AS (SELECT manifest_id, shard, count(*) AS n FROM export_jobs GROUP BY 1, 2), f AS (SELECT k.shard, m.manifest_id, coalesce(c.n, 0) AS n FROM k CROSS JOIN m LEFT JOIN c ON c.shard = k.shard AND c.manifest_id = m.manifest_id) SELECT shard, count(*) AS manifests, CAST(sum(n) AS BIGINT) AS files, round(quantile_cont(n, 0.5), 6) AS mid, round(quantile_cont(n, 0.95), 6) AS p95 FROM f GROUP BY 1")
def zero_filled_counts(spark, d):
    jobs = table(spark, d, "export_jobs").select("manifest_id", "shard")
    shards = jobs.select("shard").where("shard is not null").distinct()
    universe = W.crossed(table(spark, d, "export_manifests").select("manifest_id").distinct(), shards, "shard")
    c = W.filled(jobs.groupBy("manifest_id", "shard").agg(F.count("*").alias("n")), universe, ["manifest_id", "shard"], "n")
    return c.groupBy("shard").agg(F.count("*").alias("manifests"), F.sum("n").alias("files"), F.round(F.percentile("n", F.lit(0.5)), 6).alias("mid"), F.round(F.percentile("n", F.lit(0.95)), 6).alias("p95"))
