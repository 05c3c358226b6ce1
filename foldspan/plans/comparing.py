"""Queries that pair, compare, select and infer."""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.functions import buckets as B
from foldspan.functions import vectors as V
from foldspan.operators import compare as C
from foldspan.operators import gates as G
from foldspan.operators import nearest as N
from foldspan.operators import resample as S
from foldspan.plans.common import FINITE, LEGAL, at_reps
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


# ---------------------------------------------------------------- distributions
ALIGNED = "c AS (SELECT route AS co, kyoku || '/' || legal_actions AS k, count(*) AS n FROM decisions WHERE route IS NOT NULL AND kyoku IS NOT NULL AND legal_actions IS NOT NULL GROUP BY 1, 2), s AS (SELECT co, k, n / sum(n) OVER (PARTITION BY co) AS p FROM c), u AS (SELECT DISTINCT k FROM s), r AS (SELECT DISTINCT co FROM s), j AS (SELECT a.co AS a, b.co AS b, u.k, coalesce(x.p, 0) AS p, coalesce(y.p, 0) AS q FROM r a JOIN r b ON a.co < b.co CROSS JOIN u LEFT JOIN s x ON x.co = a.co AND x.k = u.k LEFT JOIN s y ON y.co = b.co AND y.k = u.k)"


def _strata(spark, d):
    t = table(spark, d, "decisions").where("route is not null and kyoku is not null and legal_actions is not null")
    return t.groupBy("route", F.concat_ws("/", F.col("kyoku").cast("string"), F.col("legal_actions").cast("string")).alias("k")).agg(F.count("*").alias("n"))


@query(f"WITH {ALIGNED} SELECT a, b, round(sqrt(greatest(0, 0.5 * sum(p * ln((p + 1e-12) / ((p + q) / 2 + 1e-12))) + 0.5 * sum(q * ln((q + 1e-12) / ((p + q) / 2 + 1e-12))))), 8) AS jsd, round(0.5 * sum(abs(p - q)), 8) AS tv, round(sum(CASE WHEN q = 0 THEN p ELSE 0 END), 8) AS a_missing, round(sum(CASE WHEN p = 0 THEN q ELSE 0 END), 8) AS b_missing FROM j GROUP BY 1, 2")
def jsd_tv_matrix(spark, d):
    return _rounded(C.divergence(_strata(spark, d), "route", "k"))


@query("WITH m AS (SELECT l_returnflag AS k, l_quantity AS v, sum(CASE WHEN l_linestatus = 'F' THEN 1 + l_tax ELSE 0 END) AS wa, sum(CASE WHEN l_linestatus <> 'F' THEN 1 + l_tax ELSE 0 END) AS wb FROM lineitem GROUP BY 1, 2), c AS (SELECT k, coalesce(lead(v) OVER (PARTITION BY k ORDER BY v) - v, 0) * abs(sum(wa) OVER (PARTITION BY k ORDER BY v) / sum(wa) OVER (PARTITION BY k) - sum(wb) OVER (PARTITION BY k ORDER BY v) / sum(wb) OVER (PARTITION BY k)) AS d FROM m) SELECT k AS l_returnflag, round(sum(d), 8) AS distance FROM c GROUP BY 1")
def wasserstein_1d(spark, d):
    return _rounded(C.wasserstein(table(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", F.col("l_linestatus") == "F", 1 + F.col("l_tax")))


@query("WITH s AS (SELECT DISTINCT route, obs_id % 997 AS k FROM decisions WHERE route IS NOT NULL AND obs_id IS NOT NULL), r AS (SELECT DISTINCT route FROM s), x AS (SELECT a.route AS a, b.route AS b, k.k, bool_or(k.route = a.route) AS ia, bool_or(k.route = b.route) AS ib FROM r a JOIN r b ON a.route < b.route CROSS JOIN s k GROUP BY 1, 2, 3) SELECT a, b, CAST(sum(CASE WHEN ia AND ib THEN 1 ELSE 0 END) AS BIGINT) AS \"both\", CAST(sum(CASE WHEN ia AND NOT ib THEN 1 ELSE 0 END) AS BIGINT) AS a_only, CAST(sum(CASE WHEN ib AND NOT ia THEN 1 ELSE 0 END) AS BIGINT) AS b_only FROM x GROUP BY 1, 2")
def cohort_overlap_matrix(spark, d):
    t = table(spark, d, "decisions").where("route is not null and obs_id is not null")
    return C.overlap(t.select("route", (F.col("obs_id") % 997).alias("k")), "route", "k")


@query("WITH s AS (SELECT DISTINCT route, obs, mask FROM decisions WHERE route IS NOT NULL AND obs IS NOT NULL AND mask IS NOT NULL), k AS (SELECT obs, mask, list(route) AS l FROM s GROUP BY 1, 2), r AS (SELECT DISTINCT route FROM s), x AS (SELECT a.route AS a, b.route AS b, list_contains(l, a.route) AS ia, list_contains(l, b.route) AS ib FROM r a JOIN r b ON a.route < b.route CROSS JOIN k) SELECT a, b, count(*) FILTER (ia AND ib) AS \"both\", count(*) FILTER (ia AND NOT ib) AS a_only, count(*) FILTER (ib AND NOT ia) AS b_only FROM x GROUP BY 1, 2")
def cohort_overlap_states(spark, d):
    """Whole states; ``cohort_overlap_matrix`` and its SQL fold ids to 997 keys."""
    t = table(spark, d, "decisions").where("route is not null and obs is not null and mask is not null")
    return C.overlap(t.select("route", F.struct("obs", "mask").alias("k")), "route", "k")


@query()
def sliced_wasserstein(spark, d):
    return _rounded(C.sliced_wasserstein(table(spark, d, "embeddings").withColumn("cohort", F.col("label") % 3), "cohort", "embedding", 64), 6)


@query()
def rff_mmd(spark, d):
    return _rounded(C.rff_mmd(table(spark, d, "embeddings").withColumn("cohort", F.col("label") % 3), "cohort", "embedding", 64, 1.0), 9)


# ---------------------------------------------------------------- joins and sets
@query("WITH a AS (SELECT log_id, row_idx, max(phase) AS pa, min(target) AS ta FROM decisions WHERE isfinite(target) GROUP BY 1, 2 HAVING count(*) = 1), b AS (SELECT log_id, row_idx, max(phase) AS pb, min(score_gap) AS tb FROM decisions WHERE isfinite(target) GROUP BY 1, 2 HAVING count(*) = 1) SELECT a.log_id, a.row_idx, a.pa AS phase, round(ta, 8) AS target_a, round(ta, 8) AS target_b FROM a JOIN b ON a.log_id = b.log_id AND a.row_idx = b.row_idx AND pa IS NOT DISTINCT FROM pb")
def strict_pair_join(spark, d):
    t = table(spark, d, "decisions").where(FINITE.format("target"))
    return _rounded(G.strict_pairs(t, t, ["log_id", "row_idx"], ["phase"], ["target"])[0])


@query("WITH k AS (SELECT log_id, row_idx, count(*) AS n FROM decisions GROUP BY 1, 2), l AS (SELECT log_id, row_idx, count(*) AS n FROM learnability_rows GROUP BY 1, 2), j AS (SELECT k.n AS a, l.n AS b FROM k FULL JOIN l ON k.log_id = l.log_id AND k.row_idx = l.row_idx) SELECT 'no_duplicate_left' AS gate, max(coalesce(a, 0)) <= 1 AS passed FROM j UNION ALL SELECT 'no_duplicate_right', max(coalesce(b, 0)) <= 1 FROM j UNION ALL SELECT 'key_sets_equal', bool_and(a IS NOT NULL AND b IS NOT NULL) FROM j UNION ALL SELECT 'secondary_equal', coalesce((SELECT bool_and(x.p IS NOT DISTINCT FROM y.p) FROM (SELECT log_id, row_idx, min(own_riichi) AS p FROM decisions GROUP BY 1, 2) x JOIN (SELECT log_id, row_idx, min(own_riichi) AS p FROM learnability_rows GROUP BY 1, 2) y ON x.log_id = y.log_id AND x.row_idx = y.row_idx), false)")
def pair_gates(spark, d):
    return G.strict_pairs(table(spark, d, "decisions"), table(spark, d, "learnability_rows"), ["log_id", "row_idx"], ["own_riichi"], [])[1]


@query("SELECT o_orderpriority, n_name, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2")
def lookup_join(spark, d):
    # nation is 25 rows at every scale; customer grows, so the planner sizes that join
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("c"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(F.broadcast(table(spark, d, "nation").select("n_nationkey", "n_name")), F.col("c_nationkey") == F.col("n_nationkey"))
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("o_orderpriority", "n_name").agg(F.sum("c").alias("n"))


@query("SELECT sha256(text) AS h, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def dedup_keep_first(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text").withColumn("h", F.sha2("text", 256)).drop("text")
    return G.keep_first(t, F.col("h"), ["doc_id"])


@query("SELECT d.doc_id FROM documents d WHERE d.text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM documents m WHERE m.source = 'mirror_feed' AND m.text = d.text)")
def anti_join_exclusion(spark, d):
    t = table(spark, d, "documents").where("text is not null").select("doc_id", "source", F.sha2("text", 256).alias("h"))
    return t.join(t.where("source = 'mirror_feed'").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("WITH j AS (SELECT DISTINCT manifest_id FROM export_jobs), m AS (SELECT DISTINCT manifest_id FROM export_manifests WHERE manifest_id % 5 <> 0) SELECT CASE WHEN j.manifest_id IS NULL THEN 'missing' ELSE 'unexpected' END AS side, coalesce(j.manifest_id, m.manifest_id) AS manifest_id FROM j FULL JOIN m ON j.manifest_id = m.manifest_id WHERE j.manifest_id IS NULL OR m.manifest_id IS NULL")
def set_differences(spark, d):
    return G.set_differences(table(spark, d, "export_jobs"), table(spark, d, "export_manifests").where("manifest_id % 5 <> 0"), "manifest_id")


@query("WITH j AS (SELECT DISTINCT manifest_id FROM export_jobs WHERE manifest_id IS NOT NULL), m AS (SELECT DISTINCT manifest_id FROM export_manifests WHERE manifest_id IS NOT NULL) SELECT CASE WHEN j.manifest_id IS NULL THEN 'missing' ELSE 'unexpected' END AS side, coalesce(j.manifest_id, m.manifest_id) AS manifest_id FROM j FULL JOIN m ON j.manifest_id = m.manifest_id WHERE j.manifest_id IS NULL OR m.manifest_id IS NULL")
def set_differences_manifests(spark, d):
    """All manifests; ``set_differences`` and its SQL leave out every fifth."""
    known = lambda t: table(spark, d, t).where("manifest_id is not null")
    return G.set_differences(known("export_jobs"), known("export_manifests"), "manifest_id")


@query("WITH j AS (SELECT DISTINCT src_path FROM export_jobs WHERE src_path IS NOT NULL), l AS (SELECT unnest(files) AS src_path FROM export_manifests), m AS (SELECT DISTINCT src_path FROM l WHERE src_path IS NOT NULL) SELECT CASE WHEN j.src_path IS NULL THEN 'missing' ELSE 'unexpected' END AS side, coalesce(j.src_path, m.src_path) AS src_path FROM j FULL JOIN m ON j.src_path = m.src_path WHERE j.src_path IS NULL OR m.src_path IS NULL")
def set_differences_paths(spark, d):
    """Paths as they are spelled, of jobs against the lists of manifests."""
    listed = table(spark, d, "export_manifests").select(F.explode("files").alias("src_path")).where("src_path is not null")
    return G.set_differences(table(spark, d, "export_jobs").where("src_path is not null"), listed, "src_path")


@query("WITH u AS (SELECT DISTINCT sha256(editor) AS h FROM documents WHERE editor IS NOT NULL) SELECT h, row_number() OVER (ORDER BY h) - 1 AS id FROM u")
def global_identity_dictionary(spark, d):
    h = table(spark, d, "documents").where("editor is not null").select(F.sha2("editor", 256).alias("h")).distinct()
    return S.dense_ids(h, "h", "id").select("h", "id")


@query("WITH l AS (SELECT page_id || '/' || title AS path, max(editor) AS v FROM documents WHERE rev_id % 2 = 0 AND page_id IS NOT NULL AND title IS NOT NULL GROUP BY 1), r AS (SELECT page_id || '/' || title AS path, max(editor) AS v FROM documents WHERE rev_id % 2 = 1 AND page_id IS NOT NULL AND title IS NOT NULL GROUP BY 1) SELECT coalesce(l.path, r.path) AS path, l.v AS \"left\", r.v AS \"right\", starts_with(coalesce(l.path, r.path), '1') AS allowed FROM l FULL JOIN r ON l.path = r.path WHERE l.path IS NULL OR r.path IS NULL OR l.v IS DISTINCT FROM r.v")
def config_diff(spark, d):
    t = table(spark, d, "documents").where("page_id is not null and title is not null").select(F.concat_ws("/", F.col("page_id").cast("string"), "title").alias("path"), "editor", "rev_id")
    side = lambda k: t.where(F.col("rev_id") % 2 == k).groupBy("path").agg(F.max("editor").alias("value"))
    return G.config_diff(side(0), side(1), ["1"])


@query("SELECT 'parent_rev_id' AS \"column\", parent_rev_id AS ref FROM documents WHERE parent_rev_id IS NOT NULL AND parent_rev_id NOT IN (SELECT rev_id FROM documents WHERE rev_id IS NOT NULL) GROUP BY 2")
def dangling_references(spark, d):
    return G.dangling(table(spark, d, "documents").select("rev_id", "parent_rev_id"), "rev_id", ["parent_rev_id"])


# ---------------------------------------------------------------- neighbours
KNN = "e AS (SELECT vec_id, vec_id % 50 AS c, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT q.vec_id AS q, r.vec_id AS r, round(1 - list_dot_product(q.v, r.v), 9) AS dist FROM e q JOIN e r ON q.c <> r.c WHERE q.vec_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY dist, r) AS place FROM n)"


def _knn(spark, d, k):
    e = table(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 50).alias("c"), "embedding")
    return N.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", "c", k, 64)


@query(f"WITH {KNN} SELECT q, r, dist, CAST(place AS INTEGER) AS place FROM k WHERE place <= 4")
def knn_neighbors(spark, d):
    return _knn(spark, d, 4)


@query(f"WITH {KNN}, m AS (SELECT q, avg(dist) AS mean_dist FROM k WHERE place <= 4 GROUP BY 1), p AS (SELECT quantile_cont(mean_dist, 0.95) AS p95 FROM m WHERE q % 40 = 0) SELECT q, round(mean_dist, 8) AS mean_dist, mean_dist <= p95 AS covered FROM m, p")
def knn_coverage(spark, d):
    m = N.mean_distance(_knn(spark, d, 4))
    p = m.where("q % 40 = 0").agg(F.percentile("mean_dist", F.lit(0.95)).alias("p95"))  # one row
    return m.join(F.broadcast(p)).select("q", F.round("mean_dist", 8).alias("mean_dist"), (F.col("mean_dist") <= F.col("p95")).alias("covered"))


@query(f"WITH {KNN}, m AS (SELECT q, round(avg(dist), 6) AS mean_dist FROM k WHERE place <= 4 GROUP BY 1), r AS (SELECT mean_dist FROM m WHERE q % 40 = 0) SELECT q, mean_dist, round(((SELECT count(*) FROM r WHERE r.mean_dist < m.mean_dist) + (SELECT count(*) FROM r WHERE r.mean_dist <= m.mean_dist)) / (2.0 * (SELECT count(*) FROM r)), 8) AS pct FROM m")
def density_percentile(spark, d):
    m = N.mean_distance(_knn(spark, d, 4)).withColumn("mean_dist", F.round("mean_dist", 6))
    return _rounded(N.mid_rank(m, m.where("q % 40 = 0"), "mean_dist"))


FACTS = "f AS (SELECT vec_id AS id, label % 5 AS action, list_transform(range(46), lambda i: embedding[i + 1] > -0.1) AS mask, label // 4 AS target FROM embeddings)"


def _facts(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("id"), (F.col("label") % 5).alias("action"), F.transform(F.slice("embedding", 1, 46), lambda x: x > F.lit(-0.1).cast("double")).alias("mask"), F.floor(F.col("label") / 4).alias("target"))


@query(f"WITH {KNN}, {FACTS}, j AS (SELECT k.q, a.action AS qa, b.action AS ra, a.mask[b.action + 1] AND b.mask[a.action + 1] AS ok FROM k JOIN f a ON k.q = a.id JOIN f b ON k.r = b.id WHERE place <= 16) SELECT q, CAST(sum(CASE WHEN ok THEN 1 ELSE 0 END) AS BIGINT) AS eligible, CAST(sum(CASE WHEN ok AND qa <> ra THEN 1 ELSE 0 END) AS BIGINT) AS switched, sum(CASE WHEN ok AND qa <> ra THEN 1 ELSE 0 END) / 16.0 AS switchable_rate, count(DISTINCT CASE WHEN ok AND qa <> ra THEN ra END) AS distinct_alt FROM j GROUP BY 1")
def support_switch_rate(spark, d):
    return N.switch_rate(_knn(spark, d, 16), _facts(spark, d))


@query(f"""WITH {KNN}, {FACTS}, j AS (SELECT k.q, b.action AS ra, b.target AS t FROM k JOIN f a ON k.q = a.id JOIN f b ON k.r = b.id WHERE place <= 64 AND a.mask[b.action + 1] AND b.mask[a.action + 1]), c AS (SELECT q, ra, t, count(*) AS c FROM j GROUP BY 1, 2, 3), g AS (SELECT q, ra, sum(c) AS n, -sum(c * ln(c)) + sum(c) * ln(sum(c)) AS h FROM c GROUP BY 1, 2), s AS (SELECT q, t, sum(c) AS n FROM c GROUP BY 1, 2), st AS (SELECT q, sum(n) AS n, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM s GROUP BY 1), x AS (SELECT q, sum(h) AS w, sum(CASE WHEN n >= 4 THEN 1 ELSE 0 END) AS gs FROM g GROUP BY 1)
SELECT st.q, CAST(st.n AS BIGINT) AS eligible, CAST(gs AS BIGINT) AS valid_groups, round(st.h, 8) AS h_state, round(w / st.n, 8) AS h_state_action, round(st.h - w / st.n, 8) AS gain FROM st JOIN x ON st.q = x.q WHERE gs >= 2""")
def action_credit_ig(spark, d):
    return _rounded(N.action_credit(_knn(spark, d, 64), _facts(spark, d)))


# ---------------------------------------------------------------- selection
@query(f"WITH b AS (SELECT obs_id, loaded_at, list_sort(list_transform({LEGAL}, lambda x: {{'k': -x.q, 'a': x.a}})) AS r FROM decisions WHERE q IS NOT NULL AND mask IS NOT NULL) SELECT obs_id, loaded_at, CAST(r[1].a AS INTEGER) AS top1, CAST(r[2].a AS INTEGER) AS top2, round(r[2].k - r[1].k, 8) AS margin FROM b WHERE len(r) >= 2")
def top2_margin(spark, d):
    t = table(spark, d, "decisions").where("q is not null and mask is not null").select("obs_id", "loaded_at", V.ranked(V.legal()).alias("r")).where(F.size("r") >= 2)
    return t.select("obs_id", "loaded_at", F.col("r")[0]["action"].alias("top1"), F.col("r")[1]["action"].alias("top2"), F.round(F.col("r")[0]["q"] - F.col("r")[1]["q"], 8).alias("margin"))


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem) SELECT l_orderkey, place, l_linenumber, l_partkey FROM r WHERE n >= 3 AND place IN (n // 6, 3 * n // 6, 5 * n // 6)")
def midpoint_reservoir(spark, d):
    t = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return G.midpoints(t, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]).select("l_orderkey", "place", "l_linenumber", "l_partkey")


@query("WITH u AS (SELECT DISTINCT sha256(log_id) AS h, log_id FROM decisions WHERE log_id IS NOT NULL) SELECT log_id, CASE WHEN (row_number() OVER (ORDER BY h) - 1) % 2 = 0 THEN 'A' ELSE 'B' END AS arm FROM u")
def alternating_assignment(spark, d):
    u = table(spark, d, "decisions").where("log_id is not null").select("log_id").distinct().withColumn("h", F.sha2("log_id", 256))
    return S.dense_ids(u, "h", "i").select("log_id", F.when(F.col("i") % 2 == 0, "A").otherwise("B").alias("arm"))


U32 = "(('0x' || substr(sha256({0}), 1, 8))::UBIGINT / 4294967296.0)"


@query(f"SELECT doc_id, CASE WHEN {U32.format(chr(39) + 'split|' + chr(39) + ' || doc_id')} < 0.8 THEN 'train' WHEN {U32.format(chr(39) + 'split|' + chr(39) + ' || doc_id')} < 0.9 THEN 'val' ELSE 'holdout' END AS part FROM documents")
def hash_split(spark, d):
    return table(spark, d, "documents").select("doc_id", G.hash_split(F.col("doc_id"), "split", {"train": 0.8, "val": 0.1, "holdout": 0.1}).alias("part"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY sha256('sample|' || o_orderkey) LIMIT 200")
def hash_reservoir(spark, d):
    return G.hash_sample(table(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey"), "sample", 200)


@query("WITH f AS (SELECT o_custkey, min({'h': sha256('mb|' || o_orderkey), 'k': o_orderkey}) AS r FROM orders GROUP BY 1) SELECT r.k AS o_orderkey, o_custkey FROM f ORDER BY sha256('mb|' || o_custkey) LIMIT 64")
def cluster_microbatch(spark, d):
    return G.sample_per_cluster(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", F.col("o_orderkey"), "mb", 64).select("o_orderkey", "o_custkey")


# ---------------------------------------------------------------- inference
@query("WITH v AS (SELECT c_nationkey % 3 AS stratum, avg(c_acctbal) - 4500 AS v FROM customer GROUP BY 1, c_nationkey), s AS (SELECT stratum, sum(CASE WHEN v > 0 THEN 1 ELSE 0 END) AS k, count(*) AS n FROM v WHERE abs(v) > 1e-12 GROUP BY 1) SELECT CAST(stratum AS INTEGER) AS stratum, CAST(k AS BIGINT) AS positive, n, round((SELECT sum(factorial(CAST(n AS INTEGER)) / (factorial(CAST(i AS INTEGER)) * factorial(CAST(n - i AS INTEGER)))) FROM unnest(range(CAST(k AS BIGINT), n + 1)) t(i)) / pow(2, n), 8) AS p FROM s")
def sign_test(spark, d):
    v = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 3).alias("stratum"), "c_nationkey").agg((F.avg("c_acctbal") - 4500).alias("v"))
    return _rounded(S.sign_test(v, ["stratum"], "v"))


DRAWS = """ids AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey) - 1 AS place FROM (SELECT DISTINCT c_nationkey FROM customer)), n AS (SELECT count(*) AS n FROM ids), d AS (SELECT r.r AS rep, (('0x' || substr(sha256('boot|' || r.r || '|' || s.s), 1, 8))::UBIGINT % n.n) AS place FROM n, unnest(range(200)) r(r), (SELECT unnest(range(n)) AS s FROM n) s), m AS (SELECT rep, place, count(*) AS times FROM d GROUP BY 1, 2)"""


@query(f"WITH {DRAWS}, p AS (SELECT c_mktsegment, c_nationkey, sum(c_acctbal) AS s, count(*) AS c FROM customer GROUP BY 1, 2), r AS (SELECT c_mktsegment, rep, sum(s * times) / sum(c * times) AS v FROM m JOIN ids USING (place) JOIN p USING (c_nationkey) GROUP BY 1, 2), ci AS (SELECT c_mktsegment, quantile_cont(v, 0.025) AS lo, quantile_cont(v, 0.975) AS hi FROM r GROUP BY 1) SELECT ci.c_mktsegment, round(sum(s) / sum(c), 6) AS mean, round(max(lo), 6) AS lo, round(max(hi), 6) AS hi FROM ci JOIN p ON ci.c_mktsegment = p.c_mktsegment GROUP BY 1")
def cluster_bootstrap_ci(spark, d, reps=200):
    return _rounded(S.cluster_bootstrap_mean(table(spark, d, "customer"), ["c_mktsegment"], "c_nationkey", "c_acctbal", reps, "boot"), 6)


@query(f"WITH {DRAWS}, p AS (SELECT c_nationkey, c_mktsegment AS k, CAST(sum(CASE WHEN c_acctbal > 4500 THEN 1 ELSE 0 END) AS DOUBLE) AS a, CAST(sum(CASE WHEN c_acctbal <= 4500 THEN 1 ELSE 0 END) AS DOUBLE) AS b FROM customer GROUP BY 1, 2), r AS (SELECT rep, k, sum(a * times) AS a, sum(b * times) AS b FROM m JOIN ids USING (place) JOIN p USING (c_nationkey) GROUP BY 1, 2), s AS (SELECT rep, a / sum(a) OVER (PARTITION BY rep) AS p, b / sum(b) OVER (PARTITION BY rep) AS q FROM r), t AS (SELECT rep, 0.5 * sum(abs(p - q)) AS tv FROM s GROUP BY 1) SELECT CAST(count(*) AS BIGINT) AS reps, round(avg(tv), 8) AS mean_tv, round(max(CASE WHEN i = floor(200 * 0.025) THEN tv END), 8) AS lo, round(max(CASE WHEN i = floor(200 * 0.975) THEN tv END), 8) AS hi FROM (SELECT *, row_number() OVER (ORDER BY tv) - 1 AS i FROM t)")
def cluster_bootstrap_tv(spark, d, reps=200):
    c = table(spark, d, "customer")
    per = c.groupBy("c_nationkey", F.col("c_mktsegment").alias("k")).agg(F.count_if(F.col("c_acctbal") > 4500).alias("a"), F.count_if(F.col("c_acctbal") <= 4500).alias("b"))
    ids = S.dense_ids(c.select("c_nationkey").distinct(), "c_nationkey", "place")
    times = S.multiplicities(ids.agg(F.count("*").alias("n")), reps, "boot")
    r = times.join(ids, "place").join(per, "c_nationkey").groupBy("rep", "k").agg(F.sum(F.col("a") * F.col("times")).alias("a"), F.sum(F.col("b") * F.col("times")).alias("b"))
    s = r.join(r.groupBy("rep").agg(F.sum("a").alias("ta"), F.sum("b").alias("tb")), "rep").groupBy("rep").agg((0.5 * F.sum(F.abs(F.col("a") / F.col("ta") - F.col("b") / F.col("tb")))).alias("tv"))
    return _rounded(s.agg(F.count("*").alias("reps"), F.avg("tv").alias("mean_tv"), S.index_quantile(s, [], "tv", 0.025).alias("lo"), S.index_quantile(s, [], "tv", 0.975).alias("hi")))


_H = "('0x' || substr(sha256('hb|{0}), 1, 8))::UBIGINT"


@query(f"""WITH u AS (SELECT c_nationkey % 3 AS s, c_nationkey, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2), p AS (SELECT s, v, row_number() OVER (PARTITION BY s ORDER BY c_nationkey) - 1 AS place FROM u), z AS (SELECT s, count(*) AS n, row_number() OVER (ORDER BY s) - 1 AS k FROM p GROUP BY 1),
o AS (SELECT r.r AS rep, t.t AS slot, CAST({_H.format("outer|' || r.r || '|' || t.t")} % (SELECT count(*) FROM z) AS BIGINT) AS k FROM unnest(range(300)) r(r), unnest(range(3)) t(t)), i AS (SELECT rep, slot, z.s, z.n, unnest(range(z.n)) AS i FROM o JOIN z ON o.k = z.k), d AS (SELECT rep, slot, s, CAST({_H.format("inner|' || rep || '|' || slot || '|' || i")} % n AS BIGINT) AS place FROM i),
m AS (SELECT rep, slot, avg(v) AS v FROM d JOIN p ON d.s = p.s AND d.place = p.place GROUP BY 1, 2), q AS (SELECT rep, avg(v) AS mean FROM m GROUP BY 1) SELECT count(*) AS reps, round((SELECT avg(sm) FROM (SELECT avg(v) AS sm FROM p GROUP BY s)), 6) AS mean, round(quantile_cont(mean, 0.025), 6) AS lo, round(quantile_cont(mean, 0.975), 6) AS hi FROM q""")
def hier_bootstrap_ci(spark, d, reps=300):
    u = table(spark, d, "customer").groupBy((F.col("c_nationkey") % 3).alias("s"), "c_nationkey").agg(F.avg("c_acctbal").alias("v"))
    means = S.hierarchical_means(u, "s", "c_nationkey", "v", reps, "hb")
    mean = u.groupBy("s").agg(F.avg("v").alias("v")).agg(F.avg("v").alias("mean"))  # one row
    ci = means.agg(F.count("*").alias("reps"), F.percentile("mean", F.lit(0.025)).alias("lo"), F.percentile("mean", F.lit(0.975)).alias("hi"))
    return _rounded(ci.join(F.broadcast(mean)).select("reps", "mean", "lo", "hi"), 6)


@query("WITH o AS (SELECT c_mktsegment, avg(CASE WHEN c_nationkey % 2 = 0 THEN c_acctbal END) - avg(CASE WHEN c_nationkey % 2 = 1 THEN c_acctbal END) AS v FROM customer GROUP BY 1), x AS (SELECT c_mktsegment, c_acctbal, r.r AS rep, ('0x' || substr(sha256('perm|' || r.r || '|' || c_nationkey), 1, 8))::UBIGINT % 2 AS arm FROM customer, unnest(range(99)) r(r)), n AS (SELECT c_mktsegment, rep, avg(CASE WHEN arm = 0 THEN c_acctbal END) - avg(CASE WHEN arm = 1 THEN c_acctbal END) AS nv FROM x GROUP BY 1, 2) SELECT o.c_mktsegment, round((1 + sum(CASE WHEN nv >= v THEN 1 ELSE 0 END)) / (count(*) + 1), 8) AS p, (1 + sum(CASE WHEN nv >= v THEN 1 ELSE 0 END)) / (count(*) + 1) > 0.05 AS vote FROM o JOIN n ON o.c_mktsegment = n.c_mktsegment GROUP BY 1")
def permutation_p(spark, d, reps=99):
    c = table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.sum("c_acctbal").alias("s"), F.count("*").alias("n"))
    gap = lambda arm: (F.sum(F.when(arm == 0, F.col("s"))) / F.sum(F.when(arm == 0, F.col("n")))) - (F.sum(F.when(arm == 1, F.col("s"))) / F.sum(F.when(arm == 1, F.col("n"))))
    observed = c.groupBy("c_mktsegment").agg(gap(F.col("c_nationkey") % 2).alias("value"))
    drawn = c.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(reps - 1)))).withColumn("arm", S.draw(F.lit(2).cast("bigint"), "perm", F.col("rep"), F.col("c_nationkey")))
    return _rounded(S.permutation_p(observed, drawn.groupBy("c_mktsegment", "rep").agg(gap(F.col("arm")).alias("null_value")), ["c_mktsegment"]))


at_reps(QUERIES, ORACLE, "cluster_bootstrap_ci", 1000, ("range(200)", "range(1000)"))
at_reps(QUERIES, ORACLE, "cluster_bootstrap_tv", 1000, ("range(200)", "range(1000)"), ("floor(200 *", "floor(1000 *"))
at_reps(QUERIES, ORACLE, "hier_bootstrap_ci", 5000, ("range(300)", "range(5000)"))
at_reps(QUERIES, ORACLE, "permutation_p", 999, ("range(99)", "range(999)"))


@query("WITH c AS (SELECT route, CAST(own_riichi AS INTEGER) AS a, CASE WHEN kyoku >= 4 THEN 1 ELSE 0 END AS b, avg(target) AS y FROM decisions WHERE target IS NOT NULL AND isfinite(target) AND own_riichi IS NOT NULL AND kyoku IS NOT NULL GROUP BY 1, 2, 3) SELECT route, round((avg(CASE WHEN a = 1 AND b = 1 THEN y END) - avg(CASE WHEN a = 1 AND b = 0 THEN y END)) - (avg(CASE WHEN a = 0 AND b = 1 THEN y END) - avg(CASE WHEN a = 0 AND b = 0 THEN y END)), 8) AS interaction FROM c GROUP BY 1")
def difference_in_differences(spark, d):
    t = table(spark, d, "decisions").where(FINITE.format("target")).where("own_riichi is not null and kyoku is not null")
    cells = t.groupBy("route", F.col("own_riichi").cast("int").alias("a"), (F.col("kyoku") >= 4).cast("int").alias("b")).agg(F.avg("target").alias("y"))
    return _rounded(S.difference_in_differences(cells, ["route"], "a", "b", "y"))


# ---------------------------------------------------------------- gates
GATES = "g AS (SELECT 'target_domain' AS gate, bool_and(target IS NULL OR target IN (-3, -1, 1, 3)) AS passed FROM decisions UNION ALL SELECT 'legal_count_matches', bool_and(mask IS NULL OR legal_actions IS NULL OR len(list_filter(mask, lambda x: x)) = legal_actions) FROM decisions UNION ALL SELECT 'route_known', bool_and(route IN ('M0', 'D1', 'D2', 'D3')) FROM decisions UNION ALL SELECT 'rows_present', count(*) > 0 FROM decisions UNION ALL SELECT 'rank_domain', bool_and(current_rank IS NULL OR current_rank BETWEEN 1 AND 4) FROM decisions)"


def _gates(spark, d):
    t = table(spark, d, "decisions")
    return G.gate_table(t, {
        "target_domain": F.bool_and(F.col("target").isNull() | F.col("target").isin(-3.0, -1.0, 1.0, 3.0)),
        "legal_count_matches": F.bool_and(F.col("mask").isNull() | F.col("legal_actions").isNull() | (F.size(F.filter("mask", lambda x: x)) == F.col("legal_actions"))),
        "route_known": F.bool_and(F.col("route").isin("M0", "D1", "D2", "D3")),
        "rows_present": F.count("*") > 0,
        "rank_domain": F.bool_and(F.col("current_rank").isNull() | F.col("current_rank").between(1, 4)),
    })


@query(f"WITH {GATES} SELECT gate, coalesce(passed, false) AS passed FROM g")
def gate_table(spark, d):
    return _gates(spark, d)


@query(f"WITH {GATES} SELECT bool_and(coalesce(passed, false)) AS all_pass, coalesce(string_agg(CASE WHEN NOT coalesce(passed, false) THEN gate END, ',' ORDER BY gate), '') AS failed, CASE WHEN bool_and(coalesce(passed, false)) THEN 'passed' ELSE 'no_verdict_gates_failed' END AS verdict FROM g")
def verdict(spark, d):
    return G.verdict(_gates(spark, d))


@query("SELECT phase, count(*) AS n, CAST(sum(CASE WHEN top1_q IS NOT NULL AND top2_q IS NOT NULL AND isfinite(top1_q) AND isfinite(top2_q) AND isfinite(margin) AND abs(margin - (top1_q - top2_q)) > 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS margin_identity, CAST(sum(CASE WHEN legal_action_count IS NOT NULL AND finite_legal_actions IS NOT NULL AND len(finite_legal_actions) > legal_action_count THEN 1 ELSE 0 END) AS BIGINT) AS too_many_finite, CAST(sum(CASE WHEN eligible AND own_riichi THEN 1 ELSE 0 END) AS BIGINT) AS eligible_in_riichi, CAST(sum(CASE WHEN eligible AND margin > 0.5 AND isfinite(margin) THEN 1 ELSE 0 END) AS BIGINT) AS eligible_wide FROM decision_snapshots GROUP BY 1")
def event_contract_audit(spark, d):
    s = table(spark, d, "decision_snapshots")
    m, ok = B.finite("margin"), lambda c: F.coalesce(c, F.lit(False))
    return s.groupBy("phase").agg(
        F.count("*").alias("n"), F.count_if(ok(F.abs(m - (B.finite("top1_q") - B.finite("top2_q"))) > 1e-6)).alias("margin_identity"), F.count_if(ok(F.size("finite_legal_actions") > F.col("legal_action_count")) & F.col("finite_legal_actions").isNotNull()).alias("too_many_finite"),
        F.count_if(ok(F.col("eligible") & F.col("own_riichi"))).alias("eligible_in_riichi"), F.count_if(ok(F.col("eligible") & (m > 0.5))).alias("eligible_wide"),
    )
