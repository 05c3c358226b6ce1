"""Queries for reports, audits and the remaining row-level measures."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.functions import vectors as V
from foldspan.operators import audits as U
from foldspan.operators import resample as S
from foldspan.operators import windows as W
from foldspan.plans.common import EV, LEGAL, POINTS, SEATS, SEG, at_reps, event_log, seat_scores
from foldspan.plans.comparing import KNN, _knn
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


@query(f"WITH {SEG}, s AS (SELECT user_id, segment, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS w, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS l, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS c, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS wp, sum(CASE WHEN event_type = 'error' THEN value ELSE 0 END) AS lp, count(*) AS t FROM seg GROUP BY 1, 2) SELECT user_id, count(*) AS rounds, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(l) AS BIGINT) AS deal_ins, CAST(sum(c) AS BIGINT) AS calls, round(sum(CASE WHEN w > 0 THEN 1 ELSE 0 END) / count(*), 8) AS win_rate, round(sum(CASE WHEN l > 0 THEN 1 ELSE 0 END) / count(*), 8) AS deal_in_rate, round(sum(CASE WHEN c > 0 THEN 1 ELSE 0 END) / count(*), 8) AS call_rate, round(sum(wp) / nullif(sum(w), 0), 6) AS win_points, round(sum(lp) / nullif(sum(l), 0), 6) AS deal_in_points, round((sum(wp) - sum(lp)) / count(*), 6) AS round_points, round(avg(t), 8) AS turns FROM s GROUP BY 1")
def player_stat_report(spark, d):
    log = W.segment_ids(event_log(spark, d), "user_id", "idx", F.col("event_type") == "signup")
    return U.stat_report(log, "user_id", "segment", "event_type", "value", win="purchase", lose="error", call="view")


@query("WITH v AS (SELECT label, label % 4 AS y, list_transform(embedding[1:4], lambda x: CAST(x AS DOUBLE)) AS z FROM embeddings), p AS (SELECT label, y, list_transform(z, lambda x: exp(x) / list_sum(list_transform(z, lambda w: exp(w)))) AS p FROM v), r AS (SELECT label, y, p, list_transform(range(4), lambda i: p[i + 1] - CASE WHEN i = y THEN 1.0 ELSE 0.0 END) AS e FROM p) SELECT CAST(label % 3 AS INTEGER) AS stage, count(*) AS samples, round(avg(-ln(p[y + 1])), 8) AS nll, round(avg(CASE WHEN list_position(p, list_max(p)) - 1 = y THEN 1.0 ELSE 0.0 END), 8) AS top1, round(avg(list_sum(list_transform(e, lambda x: x * x))), 8) AS brier, round(avg(abs(90 * p[1] + 45 * p[2] - 135 * p[4] - CASE y WHEN 0 THEN 90.0 WHEN 1 THEN 45.0 WHEN 2 THEN 0.0 ELSE -135.0 END)), 6) AS points_mae, round(avg(list_sum(list_transform(e, lambda x: abs(x))) / 4), 8) AS ece_proxy FROM r GROUP BY 1")
def classifier_report(spark, d):
    e = table(spark, d, "embeddings")
    z = F.transform(F.slice("embedding", 1, 4), lambda x: x.cast("double"))
    rows = e.select((F.col("label") % 3).alias("stage"), (F.col("label") % 4).alias("y"), V.softmax(z).alias("p"))
    return U.classifier_report(rows, "stage", "y", "p", (90.0, 45.0, 0.0, -135.0))


@query(f"WITH {EV} SELECT user_id, count(*) AS n, round(min_by(value, idx), 6) AS first, round(max_by(value, idx), 6) AS last, round(max_by(value, idx) - min_by(value, idx), 6) AS delta, round(avg(value), 6) AS mean, round(avg(abs(value)), 6) AS abs_mean, min(value) AS least, max(value) AS most FROM ev GROUP BY 1")
def series_summary(spark, d):
    return _rounded(U.series_summary(event_log(spark, d), "user_id", "idx", "value"), 6)


@query("SELECT label, round(sqrt(sum(list_sum(list_transform(embedding, lambda x: (0.1 * CAST(x AS DOUBLE) + 0.001) * (0.1 * CAST(x AS DOUBLE) + 0.001)))) / sum(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))), 8) AS relative_l2 FROM embeddings GROUP BY 1")
def parameter_drift(spark, d):
    e = table(spark, d, "embeddings").select("label", F.transform("embedding", lambda x: x.cast("double")).alias("p"))
    return _rounded(U.relative_l2(e.withColumn("q", F.transform("p", lambda x: x * 1.1 + 0.001)), ["label"], "p", "q"))


@query("WITH h AS (SELECT l_orderkey, list(lpad(hex(i), 16, '0') || h ORDER BY i) AS l FROM (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, sha256(l_partkey || '|' || l_suppkey) AS h FROM lineitem) GROUP BY 1) SELECT l_orderkey, sha256(unhex(array_to_string(l, ''))) AS digest FROM h".replace("lpad(hex(i), 16, '0')", "printf('%016X', i)"))
def ordered_digest(spark, d):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    rows = table(spark, d, "lineitem").select("l_orderkey", i.cast("bigint").alias("i"), F.sha2(F.concat_ws("|", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")), 256).alias("h"))
    return U.ordered_digest(rows, ["l_orderkey"], "i", "h")


@query("WITH a AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i, l_quantity AS v FROM lineitem), b AS (SELECT l_orderkey, i, CASE WHEN v > 45 THEN v + 1 ELSE v END AS v FROM a WHERE i < 5) SELECT coalesce(a.l_orderkey, b.l_orderkey) AS l_orderkey, min(CASE WHEN a.v IS DISTINCT FROM b.v THEN coalesce(a.i, b.i) END) AS first_mismatch FROM a FULL JOIN b ON a.l_orderkey = b.l_orderkey AND a.i = b.i GROUP BY 1")
def first_mismatch(spark, d):
    i = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    a = table(spark, d, "lineitem").select("l_orderkey", i.alias("i"), F.col("l_quantity").alias("v"))
    b = a.where("i < 5").withColumn("v", F.when(F.col("v") > 45, F.col("v") + 1).otherwise(F.col("v")))
    return U.first_mismatch(a, b, ["l_orderkey"], "i", "v")


@query(f"WITH {SEG}, p AS (SELECT user_id % 40 AS game, user_id // 40 AS seat, segment, sum(value) AS v FROM seg WHERE user_id < 160 GROUP BY 1, 2, 3), c AS (SELECT game, seat, segment, sum(v) OVER (PARTITION BY game, seat ORDER BY segment) AS s FROM p), r AS (SELECT game, seat, segment, row_number() OVER (PARTITION BY game, segment ORDER BY round(s, 6) DESC, seat) AS rank FROM c) SELECT game, seat, segment, rank, lead(rank) OVER (PARTITION BY game, seat ORDER BY segment) AS next_rank FROM r")
def rank_sequence(spark, d):
    log = W.segment_ids(event_log(spark, d), "user_id", "idx", F.col("event_type") == "signup").where("user_id < 160")
    p = log.groupBy((F.col("user_id") % 40).alias("game"), F.floor(F.col("user_id") / 40).alias("seat"), "segment").agg(F.sum("value").alias("v"))
    return U.rank_sequence(p, "game", "seat", "segment", "v")


@query(f"WITH {SEG}, c AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id, segment ORDER BY idx) - 1 AS r FROM seg WHERE event_type = 'click') SELECT user_id, event_id, CAST(least(7, r // 3) AS BIGINT) AS part FROM c")
def discard_turn_part(spark, d):
    log = W.segment_ids(event_log(spark, d), "user_id", "idx", F.col("event_type") == "signup").where("event_type = 'click'")
    at = F.row_number().over(Window.partitionBy("user_id", "segment").orderBy("idx")) - 1
    return log.select("user_id", "event_id", F.least(F.lit(7), F.floor(at / 3)).cast("bigint").alias("part"))


@query("WITH w AS (SELECT p_partkey, sum(CAST(p_size AS BIGINT)) OVER (ORDER BY p_partkey) AS hi, sum(CAST(p_size AS BIGINT)) OVER (ORDER BY p_partkey) - p_size AS lo, sum(CAST(p_size AS BIGINT)) OVER () AS t FROM part), d AS (SELECT CAST(i AS BIGINT) AS draw, ('0x' || substr(sha256('ws|' || i), 1, 8))::UBIGINT AS u FROM unnest(range(300)) r(i)) SELECT d.draw, w.p_partkey FROM d JOIN w ON CAST(d.u % w.t AS BIGINT) >= w.lo AND CAST(d.u % w.t AS BIGINT) < w.hi")
def weighted_draws(spark, d):
    return U.weighted_draws(table(spark, d, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("w")), "p_partkey", "w", 300, "ws")


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY sha256('epoch1|' || o_orderkey)) - 1) // 64 AS batch_id FROM orders")
def resumable_batches(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", F.lit("epoch1"), F.col("o_orderkey").cast("string")), 256).alias("h"))
    return S.dense_ids(o, "h", "i").select("o_orderkey", F.floor(F.col("i") / 64).cast("bigint").alias("batch_id"))


@query("SELECT m.mix AS condition, s.seed, h.shard, m.mix || '-' || s.seed || '-' || h.shard AS run FROM (SELECT DISTINCT mix FROM mix_targets) m, (VALUES (1), (2), (3)) s(seed), (SELECT unnest(range(4)) AS shard) h")
def run_matrix(spark, d):
    return U.run_matrix(table(spark, d, "mix_targets").select(F.col("mix").alias("condition")).distinct(), {"seed": [1, 2, 3], "shard": [0, 1, 2, 3]})


@query("WITH a AS (SELECT log_id, row_idx, row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS o FROM (SELECT DISTINCT log_id, row_idx FROM decisions WHERE log_id IS NOT NULL AND row_idx IS NOT NULL)), b AS (SELECT log_id, row_idx AS other_idx, row_number() OVER (PARTITION BY log_id ORDER BY row_idx) AS o FROM (SELECT DISTINCT log_id, row_idx FROM learnability_rows WHERE log_id IS NOT NULL AND row_idx IS NOT NULL)) SELECT coalesce(a.log_id, b.log_id) AS log_id, CAST(sum(CASE WHEN a.o IS NOT NULL AND b.o IS NOT NULL THEN 1 ELSE 0 END) AS BIGINT) AS matched, CAST(sum(CASE WHEN b.o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS left_over, CAST(sum(CASE WHEN a.o IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS right_over, CAST(sum(CASE WHEN a.row_idx <> b.other_idx THEN 1 ELSE 0 END) AS BIGINT) AS mismatched FROM a FULL JOIN b ON a.log_id = b.log_id AND a.o = b.o GROUP BY 1")
def positional_join(spark, d):
    side = lambda t: table(spark, d, t).where("log_id is not null and row_idx is not null").select("log_id", "row_idx").distinct()
    return U.positional_join(side("decisions"), side("learnability_rows"), "log_id", "row_idx")


@query(f"WITH {SEATS}, r AS (SELECT game, seat, row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) AS rank FROM g), n AS (SELECT game, seat, ['M0', 'D1', 'D2', 'D3'][CAST((seat + day(CAST(game AS DATE))) % 4 + 1 AS INTEGER)] AS role FROM r) SELECT n.role, count(*) AS games, round(avg(rank), 8) AS avg_rank, round(avg({POINTS}), 8) AS avg_pt FROM n JOIN r ON n.game = r.game AND n.seat = r.seat GROUP BY 1")
def roles_by_seat(spark, d):
    ranks = W.ranks(seat_scores(spark, d), ["game"], "score", "seat")
    names = ranks.groupBy("game").agg(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.element_at(F.array(*map(F.lit, ("M0", "D1", "D2", "D3"))), (F.pmod(s + F.dayofmonth(F.to_date("game")), F.lit(4)) + 1).cast("int"))).alias("names"))
    return _rounded(U.roles_by_seat(names, ranks, "game"))


PERMS = "(VALUES ('mps', 'mps'), ('mps', 'msp'), ('mps', 'pms'), ('mps', 'psm'), ('mps', 'smp'), ('mps', 'spm')) p(a, b)"


@query(f"SELECT snapshot_id, loaded_at, actor, b AS perm, translate(array_to_string(list_filter(hand, lambda x: x IS NOT NULL), ' '), a, b) AS hand FROM snapshots, {PERMS} WHERE hand IS NOT NULL")
def suit_permutations(spark, d):
    s = table(spark, d, "snapshots").where("hand is not null").select("snapshot_id", "loaded_at", "actor", F.array_join(F.filter("hand", lambda x: x.isNotNull()), " ").alias("hand"))
    return U.suit_permutations(s, "hand")


@query("WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT count(*) AS n FROM v), i AS (SELECT vec_id, v, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM v), d AS (SELECT r.k AS k, CAST(('0x' || substr(sha256('pair|a|' || r.k), 1, 8))::UBIGINT % n.n AS BIGINT) AS a, CAST(('0x' || substr(sha256('pair|b|' || r.k), 1, 8))::UBIGINT % n.n AS BIGINT) AS b FROM n, unnest(range(400)) r(k)) SELECT count(*) AS pairs, round(median(sqrt(list_sum(list_transform(range(64), lambda t: (x.v[t + 1] - y.v[t + 1]) * (x.v[t + 1] - y.v[t + 1]))))), 8) AS sigma FROM d JOIN i x ON d.a = x.place JOIN i y ON d.b = y.place WHERE d.a <> d.b")
def median_distance(spark, d, reps=400):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    return _rounded(U.median_distance(e, "vec_id", "v", reps, "pair"))


at_reps(QUERIES, ORACLE, "median_distance", 65536, ("range(400)", "range(65536)"))


@query(f"WITH {KNN}, j AS (SELECT k.q, e.label % 3 AS y FROM k JOIN e ON k.r = e.vec_id WHERE place <= 16), c AS (SELECT q, y, count(*) AS c FROM j GROUP BY 1, 2), h AS (SELECT q, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM c GROUP BY 1), g AS (SELECT ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT label % 3 AS y, count(*) AS c FROM embeddings GROUP BY 1)) SELECT h.q, round(h.h, 8) AS h_local, round(1 - h.h / g.h, 8) AS predictability FROM h, g")
def local_predictability(spark, d):
    y = table(spark, d, "embeddings").select("vec_id", (F.col("label") % 3).alias("y"))
    return _rounded(U.local_predictability(_knn(spark, d, 16), y, "vec_id", "y"))


@query(f"WITH b AS (SELECT route, list_transform({LEGAL}, lambda x: x.q) AS v, list_transform({LEGAL}, lambda x: x.q * 0.8 + 0.1 + 0.01 * (x.a % 3)) AS w FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL), c AS (SELECT route, v, w, list_avg(v) AS mv, list_avg(w) AS mw FROM b WHERE len(v) > 1) SELECT route, count(*) AS states, round(avg(mw - mv), 8) AS offset_mean, round(avg(abs(mw - mv)), 8) AS offset_abs, round(avg(list_avg(list_transform(range(1, len(v) + 1), lambda i: abs((w[i] - mw) - (v[i] - mv))))), 8) AS centred_abs, round(avg(list_max(w) - list_max(v)), 8) AS top_change, round(avg(CASE WHEN list_position(v, list_max(v)) = list_position(w, list_max(w)) THEN 1.0 ELSE 0.0 END), 8) AS same_top FROM c GROUP BY 1")
def value_decomposition(spark, d):
    t = table(spark, d, "decisions").where("q is not null and mask is not null").select("route", V.legal().alias("l"))
    t = t.select("route", V.values("l").alias("v"), F.transform("l", lambda x: x["q"] * 0.8 + 0.1 + 0.01 * (x["action"] % 3)).alias("w")).where(F.size("v") > 1)
    return _rounded(U.value_decomposition(t, ["route"], "v", "w"))


@query("SELECT source, count(*) AS n, count(DISTINCT editor) AS editors, count(DISTINCT lang) AS langs, count(DISTINCT ns) = 1 AS one_ns FROM documents GROUP BY 1")
def provenance_consistency(spark, d):
    return U.consistency(table(spark, d, "documents"), "source", {"editors": "editor", "langs": "lang"}, "ns")


@query("WITH h AS (SELECT sha256(text) AS h, source, doc_id FROM documents WHERE text IS NOT NULL), o AS (SELECT h, source, min(doc_id) AS d FROM h GROUP BY 1, 2), r AS (SELECT h, source, d, row_number() OVER (PARTITION BY h ORDER BY d) AS k, count(*) OVER (PARTITION BY h) AS n FROM o) SELECT h, max(n) AS sources, max(CASE WHEN k = 1 THEN d END) AS first_id, max(CASE WHEN k = 2 THEN d END) AS second_id FROM r WHERE n > 1 GROUP BY 1")
def cross_source_duplicates(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return U.cross_shard(t, "h", "source", "doc_id")


@query("WITH p AS (SELECT phase, avg(CASE WHEN seat % 2 = 0 AND isfinite(margin) THEN margin END) AS a, avg(CASE WHEN seat % 2 = 1 AND isfinite(margin) THEN margin END) AS b FROM decision_snapshots GROUP BY 1) SELECT phase, round(a, 8) AS m0, round(b, 8) AS d1, round(b - a, 8) AS difference FROM p")
def cohort_difference(spark, d):
    s = table(spark, d, "decision_snapshots").withColumn("m", F.when(~F.isnan("margin") & (F.abs("margin") < float("inf")), F.col("margin")))
    return _rounded(U.cohort_difference(s, ["phase"], F.col("seat") % 2 == 0, F.col("seat") % 2 == 1, "m"))


@query("WITH e AS (SELECT log_id, count(*) AS n FROM decisions WHERE log_id IS NOT NULL GROUP BY 1), w AS (SELECT log_id, n, CAST(('0x' || substr(sha256('x|' || log_id), 1, 8))::UBIGINT % 4 AS BIGINT) AS times FROM e) SELECT count(*) AS clusters, CAST(sum(CASE WHEN times > 0 THEN 1 ELSE 0 END) AS BIGINT) AS used, CAST(sum(n * times) AS BIGINT) AS rows_seen, round((sum(times) - sum(CASE WHEN times > 0 THEN 1 ELSE 0 END)) / sum(times), 8) AS repeat_rate, round(sum(times) * sum(times) / sum(times * times), 8) AS ess FROM w")
def exposure_stats(spark, d):
    e = table(spark, d, "decisions").where("log_id is not null").groupBy("log_id").agg(F.count("*").alias("n"))
    return _rounded(U.exposure(e.withColumn("times", S.draw(F.lit(4).cast("bigint"), "x", F.col("log_id"))), "n", "times"))


@query(f"WITH {EV} SELECT user_id, event_id, CASE WHEN lead(event_type, 1) OVER w = 'purchase' THEN 'win' WHEN lead(event_type, 1) OVER w = 'view' AND lead(event_type, 2) OVER w = 'purchase' THEN 'late_win' WHEN lead(event_type, 1) OVER w IN ('click', 'signup') THEN 'pass' WHEN lead(event_type, 1) OVER w IS NULL THEN 'end' ELSE 'other' END AS expected FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY idx)")
def expected_label(spark, d):
    e, w = event_log(spark, d), Window.partitionBy("user_id").orderBy("idx")
    one, two = F.lead("event_type", 1).over(w), F.lead("event_type", 2).over(w)
    return e.select("user_id", "event_id", F.when(one == "purchase", "win").when((one == "view") & (two == "purchase"), "late_win").when(one.isin("click", "signup"), "pass").when(one.isNull(), "end").otherwise("other").alias("expected"))


@query(f"WITH b AS (SELECT route, action, q[action + 1] AS own, list_transform({LEGAL}, lambda x: x.a) AS a, list_transform({LEGAL}, lambda x: x.q) AS v FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL AND action IS NOT NULL), c AS (SELECT route, v, a, action, list_transform(v, lambda x: exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v))))) AS p FROM b WHERE list_contains(a, action) AND len(v) > 1), g AS (SELECT route, p, list_transform(range(1, len(p) + 1), lambda i: p[i] - CASE WHEN a[i] = action THEN 1.0 ELSE 0.0 END) AS g FROM c) SELECT route, count(*) AS n, round(avg(sqrt(list_sum(list_transform(g, lambda x: x * x)))), 8) AS norm, round(avg(-list_sum(list_transform(p, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END))), 8) AS entropy, round(avg(list_sum(g)), 8) AS common FROM g GROUP BY 1")
def gradient_columns(spark, d):
    t = table(spark, d, "decisions").where("q is not null and mask is not null and action is not null").select("route", "action", V.legal().alias("l"))
    t = t.where((F.size("l") > 1) & F.exists("l", lambda x: x["action"] == F.col("action")))
    return _rounded(U.gradients(t, ["route"], "l", "action"))


@query(f"WITH a AS (SELECT log_id, row_idx, max(action) AS action FROM decisions WHERE log_id IS NOT NULL AND row_idx IS NOT NULL AND action IS NOT NULL GROUP BY 1, 2), w AS (SELECT *, coalesce(lag(action) OVER o = 42, false) AS aux, lead(action) OVER o AS nxt FROM a WINDOW o AS (PARTITION BY log_id ORDER BY row_idx)) SELECT log_id, row_idx, NOT aux AS \"primary\", (aux AND NOT action BETWEEN 0 AND 36) OR (action = 42 AND nxt IS NULL) AS fault FROM w")
def primary_row_flags(spark, d):
    t = table(spark, d, "decisions").where("log_id is not null and row_idx is not null and action is not null").groupBy("log_id", "row_idx").agg(F.max("action").alias("action"))
    return U.primary_flags(t, ["log_id"], "row_idx", "action").select("log_id", "row_idx", "primary", "fault")


@query("WITH e AS (SELECT DISTINCT log_id, row_idx FROM learnability_rows UNION SELECT DISTINCT log_id, row_idx FROM probe_states), p AS (SELECT log_id, row_idx, count(*) AS n, min(obs_id) AS r FROM decisions GROUP BY 1, 2) SELECT e.log_id, e.row_idx, coalesce(n, 0) AS hits, r AS row FROM e LEFT JOIN p ON e.log_id = p.log_id AND e.row_idx = p.row_idx")
def event_row_mapping(spark, d):
    e = table(spark, d, "learnability_rows").select("log_id", "row_idx").union(table(spark, d, "probe_states").select("log_id", "row_idx")).distinct()
    return U.mapped_events(e, table(spark, d, "decisions"), ["log_id", "row_idx"], "obs_id")


@query("SELECT l_returnflag, round(sum(l_quantity), 4) AS weight, round(sum(l_discount * l_quantity) / sum(l_quantity), 8) AS mean FROM lineitem GROUP BY 1")
def game_weighted_mean(spark, d):
    w = U.weighted_mean(table(spark, d, "lineitem"), ["l_returnflag"], "l_discount", "l_quantity")
    return w.select("l_returnflag", F.round("weight", 4).alias("weight"), F.round("mean", 8).alias("mean"))


@query("WITH h AS (SELECT action_kind, action_kind LIKE 'chi%' AS chi, target_rank = current_rank AS hit FROM decisions WHERE action_kind IS NOT NULL), u AS (SELECT action_kind AS name, hit FROM h UNION ALL SELECT 'chi', hit FROM h WHERE action_kind IN ('chi_low', 'chi_mid', 'chi_high') UNION ALL SELECT 'call', hit FROM h WHERE action_kind IN ('chi_low', 'chi_mid', 'chi_high', 'pon', 'kan')) SELECT name, count(*) AS n, CAST(sum(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits, round(sum(CASE WHEN hit THEN 1 ELSE 0 END) / count(*), 8) AS accuracy FROM u GROUP BY 1")
def accuracy_by_action(spark, d):
    chi = ["chi_low", "chi_mid", "chi_high"]
    t = table(spark, d, "decisions").where("action_kind is not null")
    return _rounded(U.accuracy_by_group(t, "action_kind", F.coalesce(F.col("target_rank") == F.col("current_rank"), F.lit(False)), {"chi": chi, "call": [*chi, "pon", "kan"]}))


@query("WITH c AS (SELECT log_id, action_kind, count(*) AS n FROM decisions WHERE log_id IS NOT NULL GROUP BY 1, 2), w AS (SELECT DISTINCT log_id, CAST(('0x' || substr(sha256('x|' || log_id), 1, 8))::UBIGINT % 4 AS BIGINT) AS times FROM c) SELECT action_kind, CAST(sum(n * times) AS BIGINT) AS exposed FROM c JOIN w ON c.log_id = w.log_id GROUP BY 1")
def exposure_weighted_counts(spark, d):
    c = table(spark, d, "decisions").where("log_id is not null").groupBy("log_id", "action_kind").agg(F.count("*").alias("n"))
    w = c.select("log_id").distinct().withColumn("times", S.draw(F.lit(4).cast("bigint"), "x", F.col("log_id")))
    return U.exposed_counts(c, w, "log_id", "action_kind", "n", "times")


@query("SELECT o_orderpriority, count(*) AS n, round(coalesce(corr(o_totalprice, o_custkey), 0), 8) AS r FROM orders GROUP BY 1")
def correlation_or_zero(spark, d):
    return _rounded(U.correlation(table(spark, d, "orders"), ["o_orderpriority"], "o_totalprice", "o_custkey"))


@query("WITH v AS (SELECT label % 2 AS cohort, list_transform(embedding[1:6], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), i AS (SELECT unnest(range(6)) AS i) SELECT CAST(cohort AS INTEGER) AS cohort, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(v[a.i + 1]), 8) AS mean_i, round(avg(v[b.i + 1]), 8) AS mean_j, round(avg(v[a.i + 1] * v[b.i + 1]), 8) AS m FROM v, i a, i b WHERE a.i <= b.i GROUP BY 1, 2, 3")
def second_moments(spark, d):
    e = table(spark, d, "embeddings").select((F.col("label") % 2).alias("cohort"), F.slice("embedding", 1, 6).alias("v"))
    return _rounded(U.second_moments(e, ["cohort"], "v", 6))


@query("WITH v AS (SELECT label % 2 AS cohort, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE len(embedding) = 64), i AS (SELECT unnest(range(64)) AS i) SELECT CAST(cohort AS INTEGER) AS cohort, CAST(a.i AS INTEGER) AS i, CAST(b.i AS INTEGER) AS j, round(avg(v[a.i + 1]), 8) AS mean_i, round(avg(v[b.i + 1]), 8) AS mean_j, round(avg(v[a.i + 1] * v[b.i + 1]), 8) AS m FROM v, i a, i b WHERE a.i <= b.i GROUP BY 1, 2, 3")
def second_moments_64(spark, d):
    """Whole vectors; ``second_moments`` and its SQL take the first six entries."""
    e = table(spark, d, "embeddings").where(F.size("embedding") == 64).select((F.col("label") % 2).alias("cohort"), F.col("embedding").alias("v"))
    return _rounded(U.second_moments(e, ["cohort"], "v", 64))


@query("SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount, l_quantity DESC, l_extendedprice DESC, l_linenumber) AS r FROM lineitem) WHERE r = 1")
def lexicographic_best(spark, d):
    return U.first_best(table(spark, d, "lineitem"), ["l_orderkey"], "l_linenumber", ["l_discount"], ["l_quantity", "l_extendedprice"])


@query("SELECT manifest_id, schema_name, array_to_string(list_filter([CASE WHEN file_count < 0 OR file_count IS NULL THEN 'file_count' END, CASE WHEN exported_file_count > file_count THEN 'exported' END, CASE WHEN processed_file_count + skipped_existing_file_count <> file_count THEN 'processed' END, CASE WHEN len(files) <> file_count THEN 'files' END], lambda x: x IS NOT NULL), ',') AS reasons FROM export_manifests")
def manifest_reasons(spark, d):
    c = F.col
    rules = {"file_count": c("file_count").isNull() | (c("file_count") < 0), "exported": c("exported_file_count") > c("file_count"), "processed": c("processed_file_count") + c("skipped_existing_file_count") != c("file_count"), "files": c("files").isNotNull() & (F.size("files") != c("file_count"))}
    return U.reasons(table(spark, d, "export_manifests"), rules).select("manifest_id", "schema_name", F.array_join("reasons", ",").alias("reasons"))


@query(f"WITH {SEATS}, r AS (SELECT game, seat % 2 AS side, row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) AS rank FROM g) SELECT rank, round(100 * (sum(CASE WHEN side = 1 THEN 1 ELSE 0 END) / (SELECT count(*) FROM r WHERE side = 1) - sum(CASE WHEN side = 0 THEN 1 ELSE 0 END) / (SELECT count(*) FROM r WHERE side = 0)), 8) AS difference_pp FROM r GROUP BY 1")
def rank_rate_differences(spark, d):
    r = W.ranks(seat_scores(spark, d), ["game"], "score", "seat").withColumn("side", F.when(F.col("seat") % 2 == 0, "even").otherwise("odd"))
    return _rounded(U.rate_differences(r, "game", "side", "rank", "even", "odd"))


@query(f"WITH b AS (SELECT route, action, list_filter({LEGAL}, lambda x: x.a <> action) AS l FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL AND action IS NOT NULL), c AS (SELECT route, l, list_max(list_transform(l, lambda x: x.q)) AS top FROM b WHERE len(l) > 0) SELECT route, count(*) AS n, round(avg(top), 8) AS mean_q, round(avg(list_min(list_transform(list_filter(l, lambda x: x.q = top), lambda x: x.a))), 8) AS mean_action FROM c GROUP BY 1")
def best_alternatives(spark, d):
    t = table(spark, d, "decisions").where("q is not null and mask is not null and action is not null").select("route", V.best_alternative(V.legal(), "action").alias("b")).where("b is not null")
    return _rounded(t.groupBy("route").agg(F.count("*").alias("n"), F.avg("b.q").alias("mean_q"), F.avg("b.action").alias("mean_action")))
