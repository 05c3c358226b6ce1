"""Queries on row-level expressions: tiles, actions, buckets, labels, hashes, vectors."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.functions import actions as A
from foldspan.functions import buckets as B
from foldspan.functions import hashing as H
from foldspan.functions import vectors as V
from foldspan.operators import adapters, consolidate, kernels, ranking
from foldspan.plans.logs import TILES, _counts, judged
from foldspan.plans.replays import EVENTS
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


PLAIN = "regexp_replace(regexp_replace({0}, 'r$', ''), '^0([mps])$', '5\\1')"
KEPT = f"CASE WHEN {{0}} IN ('5mr', '5pr', '5sr') THEN {{0}} ELSE {PLAIN} END"
_MELDS = "m AS (SELECT snapshot_id, loaded_at, seat.s AS seat, unnest(melds[seat.s + 1]) AS m FROM snapshots, range(4) seat(s)), k AS (SELECT snapshot_id, loaded_at, seat, m.type AS type, m.pai AS pai, m.pai_raw AS pai_raw, m.consumed AS consumed, m.target AS target FROM m WHERE m IS NOT NULL)"


def _melds(spark, d):
    t = table(spark, d, "snapshots").select("snapshot_id", "loaded_at", F.explode(F.array(*[F.struct(F.lit(i).alias("seat"), F.get("melds", F.lit(i)).alias("l")) for i in range(4)])).alias("s"))
    return t.select("snapshot_id", "loaded_at", "s.seat", F.explode("s.l").alias("m")).where("m is not null").select("snapshot_id", "loaded_at", "seat", "m.*")


@query(f"WITH x AS (SELECT unnest(hand) AS t FROM snapshots UNION ALL SELECT unnest(dora_markers) FROM snapshots) SELECT t AS tile, {KEPT.format('t')} AS kept, {PLAIN.format('t')} AS plain, count(*) AS n FROM x WHERE t IS NOT NULL GROUP BY 1")
def tile_spellings(spark, d):
    s = table(spark, d, "snapshots")
    t = s.select(F.explode("hand").alias("tile")).unionByName(s.select(F.explode("dora_markers").alias("tile"))).where("tile is not null")
    return t.groupBy("tile").agg(F.count("*").alias("n")).select("tile", A.keep_red("tile").alias("kept"), A.plain_tile("tile").alias("plain"), "n")


_DORA = "CASE WHEN i < 27 THEN i // 9 * 9 + (i + 1) % 9 WHEN i < 31 THEN 27 + (i - 26) % 4 ELSE 31 + (i - 30) % 3 END"
_INDEX = f"CASE WHEN regexp_matches(p, '^[1-9][mps]$') THEN CAST(p[1] AS INTEGER) - 1 + CASE p[2] WHEN 'm' THEN 0 WHEN 'p' THEN 9 ELSE 18 END ELSE CASE p WHEN 'E' THEN 27 WHEN 'S' THEN 28 WHEN 'W' THEN 29 WHEN 'N' THEN 30 WHEN 'P' THEN 31 WHEN 'F' THEN 32 WHEN 'C' THEN 33 ELSE -1 END END"


@query(f"WITH x AS (SELECT DISTINCT unnest(dora_markers) AS t FROM snapshots), p AS (SELECT t, {PLAIN.format('t')} AS p FROM x WHERE t IS NOT NULL), i AS (SELECT t, {_INDEX} AS i FROM p) SELECT t AS marker, CAST(i AS INTEGER) AS tile, CAST(CASE WHEN i < 0 THEN -1 ELSE {_DORA} END AS INTEGER) AS dora, CAST(CASE t WHEN '5mr' THEN 34 WHEN '5pr' THEN 35 WHEN '5sr' THEN 36 ELSE i END AS INTEGER) AS scene FROM i")
def marker_tiles(spark, d):
    t = table(spark, d, "snapshots").select(F.explode("dora_markers").alias("marker")).where("marker is not null").distinct()
    return t.select("marker", A.tile34("marker").alias("tile"), A.dora_of("marker").alias("dora"), A.scene_tile("marker").alias("scene"))


_RANK = f"CAST(left({PLAIN}, 1) AS INTEGER)"
_LOW, _HIGH, _CALLED = (f"least({_RANK.format('consumed[1]')}, {_RANK.format('consumed[2]')})", f"greatest({_RANK.format('consumed[1]')}, {_RANK.format('consumed[2]')})", _RANK.format("pai"))


@query(f"WITH {_MELDS}, c AS (SELECT *, {_CALLED} AS r, {_LOW} AS lo, {_HIGH} AS hi FROM k WHERE type = 'chi' AND len(consumed) = 2 AND consumed[1] IS NOT NULL AND consumed[2] IS NOT NULL AND pai IS NOT NULL) SELECT CASE WHEN r < lo THEN 'chi_low' WHEN r < hi THEN 'chi_mid' ELSE 'chi_high' END AS kind, CAST(CASE WHEN r < lo THEN 35 WHEN r < hi THEN 36 ELSE 37 END AS INTEGER) AS index, CAST(CASE WHEN lo = r + 1 AND hi = r + 2 THEN 38 WHEN lo = r - 1 AND hi = r + 1 THEN 39 WHEN lo = r - 2 AND hi = r - 1 THEN 40 END AS INTEGER) AS scene, count(*) AS n FROM c GROUP BY 1, 2, 3")
def chi_kinds(spark, d):
    m = _melds(spark, d).where("type = 'chi' and size(consumed) = 2 and consumed[0] is not null and consumed[1] is not null and pai is not null")
    return m.select(A.chi_kind("pai", "consumed").alias("kind"), A.index45("type", "pai", "consumed").alias("index"), A.scene_chi("pai", "consumed").alias("scene")).groupBy("kind", "index", "scene").agg(F.count("*").alias("n"))


@query(f"WITH {EVENTS[5:]}, a AS (SELECT CASE WHEN type = 'reach' AND lead(type) OVER w = 'dahai' THEN lead(pai) OVER w END AS next, type, actor, pai FROM e WINDOW w AS (PARTITION BY log_id ORDER BY event_index)), x AS (SELECT type, actor, CASE WHEN type <> 'reach' THEN pai END AS pai FROM a UNION ALL SELECT 'dahai', actor, next FROM a WHERE next IS NOT NULL) SELECT type, actor, count(*) AS n, count(pai) AS tiles FROM x GROUP BY 1, 2")
def wire_events(spark, d):
    """Actions as events: a declaration that names its discard becomes two."""
    r = consolidate.consolidated(table(spark, d, "export_jobs"))[0]
    e = r.select("log", "event_index", F.from_json("line", "type string, actor int, pai string, consumed array<string>, target int").alias("e")).select("log", "event_index", "e.*")
    w = Window.partitionBy("log").orderBy("event_index")
    tile = F.when(F.col("type") != "reach", F.col("pai")).when(F.lead("type").over(w) == "dahai", F.lead("pai").over(w))
    out = e.withColumn("pai", tile).select(F.explode(A.wire_events("type", "actor", "pai", "consumed", "target")).alias("x"))
    return out.groupBy("x.type", "x.actor").agg(F.count("*").alias("n"), F.count("x.pai").alias("tiles"))


@query(f"WITH {_MELDS} SELECT type, count(*) AS n, count(*) AS same_turned, CAST(sum(CASE WHEN pai IS NULL OR pai_raw IS NULL OR {PLAIN.format('pai')} = {PLAIN.format('pai_raw')} THEN 1 ELSE 0 END) AS BIGINT) AS same_raw FROM k WHERE type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan') GROUP BY 1")
def equivalent_actions(spark, d):
    """Calls stay the same move with their tiles in another order, and with the raw tile named."""
    m = _melds(spark, d).where("type in ('chi', 'pon', 'daiminkan', 'ankan', 'kakan')")
    turned = A.equivalent("type", "type", "pai", "pai", "consumed", F.reverse("consumed"))
    raw = A.equivalent("type", "type", "pai", "pai_raw", "consumed", "consumed")
    return m.groupBy("type").agg(F.count("*").alias("n"), F.count_if(turned).alias("same_turned"), F.count_if(raw).alias("same_raw"))


@query(f"WITH {_MELDS} SELECT type AS kind, coalesce(pai, consumed[1]) AS pai, count(*) AS n, CAST(sum(len(coalesce(consumed, []))) AS BIGINT) AS used FROM k GROUP BY 1, 2")
def action_specs(spark, d):
    m = _melds(spark, d)
    s = m.select(A.spec(F.struct(*m.columns)).alias("s"))
    return s.groupBy("s.kind", "s.pai").agg(F.count("*").alias("n"), F.sum(F.size("s.consumed")).alias("used"))


@query("SELECT CASE WHEN kyoku <= 1 THEN 'early' WHEN kyoku <= 5 THEN 'middle' WHEN kyoku > 5 THEN 'late' END AS phase, CASE WHEN kyoku <= 1 THEN 'east_front' WHEN kyoku <= 3 THEN 'east_back' WHEN kyoku <= 5 THEN 'south_front' WHEN kyoku <= 7 THEN 'south_back' WHEN kyoku > 7 THEN 'extension' END AS stage, count(*) AS n, round(sum(CASE WHEN isfinite(target) THEN greatest(-1, least(1, target)) END), 6) AS clipped, count(CASE WHEN isfinite(target) THEN 1 END) AS finite FROM decisions GROUP BY 1, 2")
def bucket_variants(spark, d):
    t = table(spark, d, "decisions")
    return t.groupBy(B.phase("kyoku", 2, 6).alias("phase"), B.stage("kyoku").alias("stage")).agg(F.count("*").alias("n"), F.round(F.sum(B.clip(B.finite("target"))), 6).alias("clipped"), F.count(B.finite("target")).alias("finite"))


@query("SELECT CASE WHEN steps_to_done <= 0 THEN '0' WHEN steps_to_done <= 4 THEN '1_4' WHEN steps_to_done <= 12 THEN '5_12' WHEN steps_to_done <= 24 THEN '13_24' WHEN steps_to_done > 24 THEN '25_plus' END AS steps, count(*) AS n FROM learnability_rows GROUP BY 1")
def step_buckets(spark, d):
    return table(spark, d, "learnability_rows").groupBy(B.steps("steps_to_done").alias("steps")).agg(F.count("*").alias("n"))


@query("SELECT CASE WHEN margin < 1 THEN 'lt_1' WHEN margin < 3 THEN '1_3' WHEN margin >= 3 THEN 'ge_3' END AS bucket, count(*) AS n FROM decision_snapshots WHERE margin IS NULL OR isfinite(margin) GROUP BY 1")
def margin_buckets(spark, d):
    return table(spark, d, "decision_snapshots").where(B.finite("margin").isNotNull() | F.col("margin").isNull()).groupBy(B.margin("margin").alias("bucket")).agg(F.count("*").alias("n"))


@query("SELECT generation_seed, seed_key, CAST(generation_seed & 3 AS INTEGER) AS seat, count(*) AS n FROM decision_snapshots WHERE generation_seed IS NOT NULL AND seed_key BETWEEN 0 AND 1000000000 GROUP BY 1, 2")
def train_seats(spark, d):
    t = table(spark, d, "decision_snapshots").where("generation_seed is not null and seed_key between 0 and 1000000000")
    return t.groupBy("generation_seed", "seed_key").agg(F.count("*").alias("n")).withColumn("seat", A.train_seat("generation_seed", "seed_key"))


@query("SELECT DISTINCT route, CASE WHEN route = 'M0' THEN 'base' ELSE route END AS family, route AS role FROM decisions")
def role_labels(spark, d):
    t = table(spark, d, "decisions").select("route").distinct()
    return t.select("route", A.family("route", {"M0": "base"}).alias("family"), A.role(F.concat("route", F.lit("_x")), ["M0", "D1", "D2", "D3"]).alias("role"))


_LEGAL = "mask[action + 1]"


@query(f"SELECT obs_id, loaded_at, action, {_LEGAL} AS legal, CASE WHEN {_LEGAL} THEN action END AS label FROM decisions WHERE action IS NOT NULL AND mask IS NOT NULL AND {_LEGAL} IS NOT NULL")
def strict_labels(spark, d):
    """Rows whose action is not legal are kept apart; the strict check passes on the others."""
    t = table(spark, d, "decisions").where("action is not null and mask is not null").select("obs_id", "loaded_at", "action", "mask", F.get("mask", F.col("action")).alias("legal")).where("legal is not null")
    return t.select("obs_id", "loaded_at", "action", "legal", F.when(F.col("legal"), A.strict_label("action", "mask")).alias("label"))


@query(f"WITH {EVENTS[5:]} SELECT log_id, CAST(min(event_index) AS BIGINT) AS first, min_by(type, event_index) AS type FROM e WHERE type IN ('hora', 'ryukyoku') GROUP BY 1")
def terminal_actions(spark, d):
    r = consolidate.consolidated(table(spark, d, "export_jobs"))[0]
    e = r.select("log", "event_index", F.get_json_object("line", "$.type").alias("type"))
    legal = e.groupBy("log").agg(F.sort_array(F.collect_list(F.struct("event_index", "type"))).alias("l"))
    return legal.select(F.col("log").alias("log_id"), A.terminal_action("l", ["HORA", "Ryukyoku"]).alias("t")).where("t is not null").select("log_id", F.col("t.event_index").alias("first"), "t.type")


@query("SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(list_reverse(embedding) AS DOUBLE[])), 8) AS cosine, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 8) AS unit_sum, true AS close FROM embeddings")
def unit_vectors(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    near = V.all_close(F.transform("v", lambda x: x * 1.000001), "v")
    return e.select("vec_id", F.round(V.cosine("v", F.reverse("v")), 8).alias("cosine"), F.round(V.total(V.unit("v")), 8).alias("unit_sum"), near.alias("close"))


_D = "list_sum(list_transform(range(1, 65), lambda i: {0} * {1}))"
_G, _M, _S = "CAST(v[i] AS DOUBLE)", "CAST(v[65 - i] AS DOUBLE)", "(CAST(v[65 - i] AS DOUBLE) / (sqrt(CAST(v[i] AS DOUBLE) * CAST(v[i] AS DOUBLE)) + 1e-8))"


@query(f"WITH e AS (SELECT vec_id, embedding AS v FROM embeddings) SELECT vec_id, round({_D.format(_G, _M)} / (sqrt({_D.format(_G, _G)}) * sqrt({_D.format(_M, _M)})), 8) AS mean, round({_D.format(_G, _S)} / (sqrt({_D.format(_G, _G)}) * sqrt({_D.format(_S, _S)})), 7) AS step FROM e")
def adam_alignment(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    a = V.adam_alignment("v", F.reverse("v"), F.transform("v", lambda x: x * x))
    return e.select("vec_id", F.round(a["mean"], 8).alias("mean"), F.round(a["step"], 7).alias("step"))


@query("SELECT obs_id, loaded_at, CAST(CASE WHEN action < 9 THEN action + 9 WHEN action < 18 THEN action - 9 ELSE action END AS INTEGER) AS moved, len(list_filter(list_transform(range(27, 46), lambda i: mask[i + 1]), lambda x: x)) AS rest, len(list_filter(list_transform(range(9), lambda i: mask[i + 10]), lambda x: x)) AS first_suit FROM decisions WHERE action IS NOT NULL AND len(mask) = 46 AND len(list_filter(mask, lambda x: x IS NULL)) = 0")
def permuted_rows(spark, d):
    t = table(spark, d, "decisions").where("action is not null and size(mask) = 46 and not exists(mask, x -> x is null)")
    m = A.permute_suits("mask", (1, 0, 2))
    many = lambda a: F.size(F.filter(a, lambda x: x)).cast("bigint")
    return t.select("obs_id", "loaded_at", A.permute_action("action", (1, 0, 2)).cast("int").alias("moved"), many(F.slice(m, 28, 19)).alias("rest"), many(F.slice(m, 1, 9)).alias("first_suit"))


@query(f"WITH {_MELDS} SELECT type, count(*) AS n, CAST(sum(CASE WHEN list_bool_and(list_transform(consumed, lambda t: len(list_filter(consumed, lambda x: x = t)) <= len(list_filter(list_concat(consumed, ['E']), lambda x: x = t)))) THEN 1 ELSE 0 END) AS BIGINT) AS held, CAST(sum(len(list_distinct(list_concat(coalesce(consumed, []), coalesce([pai], []))))) AS BIGINT) AS seen FROM k WHERE consumed IS NOT NULL AND len(consumed) > 0 AND len(list_filter(consumed, lambda x: x IS NULL)) = 0 AND pai IS NOT NULL GROUP BY 1")
def meld_sets(spark, d):
    """Used tiles against a hand that holds them, and the set of tiles a call shows."""
    m = _melds(spark, d).where("consumed is not null and size(consumed) > 0 and pai is not null and not exists(consumed, x -> x is null)")
    held = A.sub_multiset("consumed", F.concat("consumed", F.array(F.lit("E"))))
    return m.groupBy("type").agg(F.count("*").alias("n"), F.count_if(held).alias("held"), F.sum(F.size(F.array_union("consumed", F.array("pai")))).alias("seen"))


@query(f"WITH {EVENTS[5:]}, c AS (SELECT r.log, r.event_index, '{{' || array_to_string(list_transform(list_sort(json_keys(r.line)), lambda k: '\"' || k || '\":' || CAST(json_extract(r.line, '$.' || k) AS VARCHAR)), ',') || '}}' AS line FROM r WHERE n = 1) SELECT log AS log_id, count(*) AS events, sha256(string_agg(line || chr(10), '' ORDER BY event_index)) AS digest FROM c GROUP BY 1")
def canonical_log_hash(spark, d):
    """SHA-256 of each log in canonical form; a log is one game."""
    r = consolidate.consolidated(table(spark, d, "export_jobs"))[0].select("log", "event_index", H.canonical_line("line").alias("c"))
    text = F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_index", "c"))), lambda x: x["c"]), "\n"), F.lit("\n"))
    return r.groupBy(F.col("log").alias("log_id")).agg(F.count("*").alias("events"), F.sha2(text, 256).alias("digest"))


@query()
def decision_hashes(spark, d):
    t = table(spark, d, "decisions")
    return t.select("obs_id", H.state_hash("obs", "mask").alias("state"), H.decision_hash("obs", "mask", "action").alias("decision"))


@query("SELECT obs_id, loaded_at, round(CAST(action % 12 AS DOUBLE) + CASE WHEN action < 34 THEN action / 33.0 ELSE 0 END + CASE WHEN own_riichi THEN 1 ELSE 0 END + least(1, current_rank / 4.0) + least(1, kyoku / 4.0) + CASE WHEN action BETWEEN 27 AND 33 THEN 1 ELSE 0 END + CASE WHEN action < 27 AND action % 9 IN (0, 8) THEN 1 ELSE 0 END + legal_actions / 70.0, 9) AS total FROM decisions WHERE action IS NOT NULL AND own_riichi IS NOT NULL AND current_rank IS NOT NULL AND kyoku IS NOT NULL AND legal_actions IS NOT NULL")
def action_feature_sums(spark, d):
    t = table(spark, d, "decisions").where("action is not null and own_riichi is not null and current_rank is not null and kyoku is not null and legal_actions is not null")
    tile = F.when(F.col("action") < 34, F.col("action")).otherwise(-1)
    f = A.action_features(F.col("action") % 12, tile, "own_riichi", "current_rank", "kyoku", "legal_actions")
    return t.select("obs_id", "loaded_at", F.round(V.total(f), 9).alias("total"))


@query(f"{TILES}, c AS (SELECT snapshot_id, i, count(*) AS n FROM i WHERE i >= 0 GROUP BY 1, 2) SELECT snapshot_id, CAST(sum(n) AS INTEGER) AS held, CAST(sum(n * 4 * i + n * (n - 1) // 2) AS BIGINT) AS ids FROM c GROUP BY 1 HAVING max(n) <= 4")
def tile_id_sums(spark, d):
    c = _counts(spark, d).where(F.exists("counts", lambda n: n > 0) & ~F.exists("counts", lambda n: n > 4)).select("snapshot_id", kernels.tile_ids("counts").alias("ids"))
    return c.select("snapshot_id", F.size("ids").alias("held"), F.aggregate("ids", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ids"))


@query("WITH p AS (SELECT obs_id, loaded_at, abs(score_gap) AS g FROM decisions WHERE isfinite(score_gap) AND score_gap <> 0) SELECT obs_id, loaded_at, round((0.1 + 2 * 0.2 + 3 * 0.3 + 4 * 0.4), 9) AS mean_rank, NULL::DOUBLE AS uneven FROM p")
def expected_ranks(spark, d):
    t = table(spark, d, "decisions").where("score_gap is not null and not isnan(score_gap) and abs(score_gap) < double('infinity') and score_gap <> 0")
    p = F.array(*[F.lit(0.1 * i) for i in range(1, 5)])
    return t.select("obs_id", "loaded_at", F.round(kernels.expected_rank(p), 9).alias("mean_rank"), kernels.expected_rank(F.array(*[F.lit(0.2)] * 4)).alias("uneven"))


@query(f"{TILES}, c AS (SELECT snapshot_id, i, count(*) AS n FROM i WHERE i >= 0 GROUP BY 1, 2), h AS (SELECT snapshot_id, CAST(6 - sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) + greatest(0, 7 - count(*)) AS INTEGER) AS pairs, CAST(13 - sum(CASE WHEN i IN (0, 8, 9, 17, 18, 26) OR i >= 27 THEN 1 ELSE 0 END) - max(CASE WHEN (i IN (0, 8, 9, 17, 18, 26) OR i >= 27) AND n >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS ends FROM c GROUP BY 1 HAVING max(n) <= 4 AND sum(n) <= 14) SELECT snapshot_id, least(pairs, ends) AS distance FROM h")
def special_distances(spark, d):
    """Distances of the two special forms, by the kernels and not by SQL."""
    return judged(spark, d, kernels.special_waits, "w").select("snapshot_id", "w.distance").where("distance is not null")


@query()
def good_shape_draws(spark, d):
    return judged(spark, d, kernels.good_draws, "draws")


@query("SELECT profile, list_sum(points) AS total FROM (VALUES ('given', [90.0::DOUBLE, 45, 0, -135])) t(profile, points)")
def custom_rank_points(spark, d):
    points = ranking.parse_points([90, 45, 0, -135])
    return spark.createDataFrame([("given", float(sum(points)))], "profile string, total double")


_ADAPTED = "l AS (SELECT action, CASE WHEN isfinite(target) THEN greatest(-1, least(1, target)) ELSE 0 END AS value FROM decisions WHERE action IS NOT NULL AND mask[action + 1])"


@query(f"WITH {_ADAPTED}, a AS (SELECT action, value, 0 AS turned FROM l UNION ALL SELECT CASE WHEN action < 9 THEN action + 9 WHEN action < 18 THEN action - 9 ELSE action END, value, 1 FROM l) SELECT turned, CAST(action AS INTEGER) AS action, count(*) AS n, round(sum(CAST(CAST(value AS FLOAT) AS DOUBLE)), 4) AS total FROM a GROUP BY 1, 2")
def adapted_rows(spark, d):
    """Rows of the augmenting adapter: legal ones, clipped targets, each once more with two suits changed."""
    t = adapters.adapted(table(spark, d, "decisions").select("action", "mask", "target"), "augmented")
    return t.groupBy("turned", F.col("action").cast("int").alias("action")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))
