"""Queries on event logs, tiles, kernels and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.functions import actions as A
from foldspan.operators import consolidate, features, kernels
from foldspan.plans.common import EV
from foldspan.sources import sinks
from foldspan.sources.tables import table
from foldspan.streaming import logs as S

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINES = "l AS (SELECT file_id, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line, unnest(range(1, len(string_split(replace(body, chr(13), ''), chr(10))) + 1)) AS line_no FROM export_jobs), v AS (SELECT file_id, line_no, CAST(line AS JSON) AS j FROM l WHERE json_valid(line) AND line LIKE '{%'), e AS (SELECT file_id, line_no, json_extract_string(j, '$.type') AS type, CAST(json_extract_string(j, '$.actor') AS INTEGER) AS actor, CAST(CAST(json_extract_string(j, '$.event_index') AS DOUBLE) AS BIGINT) AS event_index FROM v WHERE json_extract_string(j, '$.event_index') IS NOT NULL)"


def _lines(spark, d):
    e = consolidate.event_lines(table(spark, d, "export_jobs"))
    return e.select("file_id", "line_no", "event_index", F.get_json_object("line", "$.type").alias("type"), F.get_json_object("line", "$.actor").cast("int").alias("actor"))


@query(f"WITH {LINES} SELECT type, actor, count(*) AS n, count(DISTINCT file_id) AS files FROM e GROUP BY 1, 2")
def event_line_counts(spark, d):
    per = _lines(spark, d).groupBy("type", "actor", "file_id").agg(F.count("*").alias("c"))
    return per.groupBy("type", "actor").agg(F.sum("c").alias("n"), F.count("*").alias("files"))


@query(f"WITH {LINES}, n AS (SELECT *, lead(type) OVER (PARTITION BY file_id ORDER BY line_no) AS nxt FROM e), o AS (SELECT file_id, line_no, 0 AS made, type FROM n UNION ALL SELECT file_id, line_no, 1, 'reach_accepted' FROM n WHERE type = 'reach' AND nxt IS NOT NULL AND nxt NOT IN ('hora', 'reach_accepted')) SELECT file_id, line_no, made, type FROM o")
def synthetic_event_injection(spark, d):
    # the same window as for kans, on declarations, which this table has
    after = F.lead("type").over(Window.partitionBy("file_id").orderBy("line_no"))
    add = (F.col("type") == "reach") & after.isNotNull() & ~after.isin("hora", "reach_accepted")
    e = _lines(spark, d).withColumn("add", add)
    e = e.withColumn("made", F.explode(F.when(F.col("add"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return e.select("file_id", "line_no", "made", F.when(F.col("made") == 1, "reach_accepted").otherwise(F.col("type")).alias("type"))


@query("WITH s AS (SELECT manifest_id, coalesce(shard, 'unknown') AS shard, count(*) AS n, sum(size_bytes) AS b FROM export_jobs GROUP BY 1, 2) SELECT manifest_id, CAST(sum(n) AS BIGINT) AS file_count, CAST(sum(b) AS BIGINT) AS bytes, '{' || string_agg('\"' || shard || '\":' || n, ',' ORDER BY shard) || '}' AS shard_file_counts FROM s GROUP BY 1")
def export_manifest(spark, d):
    return sinks.export_manifest(table(spark, d, "export_jobs"))


@query("SELECT upper(CASE WHEN event_type = 'click' THEN 'dahai' ELSE event_type END) AS kind, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY 1")
def json_payload(spark, d):
    e = table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.groupBy(F.upper(F.when(F.col("event_type") == "click", "dahai").otherwise(F.col("event_type"))).alias("kind")).agg(F.count("*").alias("n"), F.sum(k).alias("k"))


TILES = "WITH s AS (SELECT snapshot_id, max_by(hand, coalesce(loaded_at, TIMESTAMP '1900-01-01')) AS hand FROM snapshots GROUP BY 1), x AS (SELECT snapshot_id, unnest(hand) AS t FROM s), p AS (SELECT snapshot_id, regexp_replace(t, 'r$', '') AS t, t LIKE '5_r' AS red FROM x WHERE t IS NOT NULL), i AS (SELECT snapshot_id, red, CASE WHEN regexp_matches(t, '^[1-9][mps]$') THEN CASE t[2] WHEN 'm' THEN 0 WHEN 'p' THEN 9 ELSE 18 END + CAST(t[1] AS INTEGER) - 1 WHEN t IN ('E', 'S', 'W', 'N', 'P', 'F', 'C') THEN 27 + strpos('ESWNPFC', t) - 1 ELSE -1 END AS i FROM p)"


def _hands(spark, d):
    s = table(spark, d, "snapshots").groupBy("snapshot_id").agg(F.max_by(F.struct("hand"), F.coalesce("loaded_at", F.lit("1900-01-01").cast("timestamp_ntz"))).alias("s"))
    return s.select("snapshot_id", F.filter("s.hand", lambda t: t.isNotNull()).alias("hand"))


def _counts(spark, d):
    index = F.transform("hand", A.tile34)
    counts = F.transform(F.sequence(F.lit(0), F.lit(33)), lambda i: F.size(F.filter("index", lambda t: t == i)))
    return _hands(spark, d).where("hand is not null").withColumn("index", index).select("snapshot_id", "hand", counts.alias("counts"))


@query(f"{TILES} SELECT i AS tile, count(*) AS n, CAST(sum(CASE WHEN red THEN 1 ELSE 0 END) AS BIGINT) AS red, count(DISTINCT snapshot_id) AS hands FROM i GROUP BY 1")
def tile_counts(spark, d):
    t = _hands(spark, d).select("snapshot_id", F.explode("hand").alias("t")).select("snapshot_id", A.tile34("t").alias("tile"), A.is_red("t").cast("int").alias("red"))
    per = t.groupBy("tile", "snapshot_id").agg(F.count("*").alias("c"), F.sum("red").alias("red"))
    return per.groupBy("tile").agg(F.sum("c").alias("n"), F.sum("red").alias("red"), F.count("*").alias("hands"))


@query(f"{TILES}, c AS (SELECT snapshot_id, i, count(*) AS n FROM i WHERE i >= 0 GROUP BY 1, 2) SELECT snapshot_id, CAST(6 - sum(CASE WHEN n >= 2 THEN 1 ELSE 0 END) + greatest(0, 7 - count(*)) AS INTEGER) AS seven_pairs, CAST(13 - sum(CASE WHEN i IN (0, 8, 9, 17, 18, 26) OR i >= 27 THEN 1 ELSE 0 END) - max(CASE WHEN (i IN (0, 8, 9, 17, 18, 26) OR i >= 27) AND n >= 2 THEN 1 ELSE 0 END) AS INTEGER) AS orphans FROM c GROUP BY 1")
def special_form_distance(spark, d):
    c = _counts(spark, d).where(F.exists("counts", lambda n: n > 0))
    end = lambda i: i.isin(0, 8, 9, 17, 18, 26) | (i >= 27)
    many = lambda arr, f: F.size(F.filter(arr, f))
    ends = F.filter("counts", lambda n, i: end(i))
    return c.select("snapshot_id", (6 - many("counts", lambda n: n >= 2) + F.greatest(F.lit(0), 7 - many("counts", lambda n: n >= 1))).alias("seven_pairs"), (13 - many(ends, lambda n: n >= 1) - F.when(F.exists(ends, lambda n: n >= 2), 1).otherwise(0)).alias("orphans"))


def judged(spark, d, kernel, name: str):
    """``snapshot_id`` and what a kernel says of its hand; equal hands are judged once."""
    c = _counts(spark, d).select("snapshot_id", F.array_join(F.transform("counts", lambda n: n.cast("string")), "").alias("key"), "counts")
    once = c.groupBy("key").agg(F.first("counts").alias("counts")).select("key", kernel("counts").alias(name))
    return c.select("snapshot_id", "key").join(once, "key").drop("key")


@query()
def hand_progress(spark, d):
    return judged(spark, d, kernels.progress, "p").select("snapshot_id", "p.distance", "p.kinds", "p.live")


@query()
def snapshot_planes(spark, d):
    return features.encode(table(spark, d, "snapshots"))


@query()
def hand_effects(spark, d):
    c = _counts(spark, d).select("snapshot_id", "counts")
    return c.select("snapshot_id", F.explode(kernels.draw_deltas("counts")).alias("x")).select("snapshot_id", "x.tile", "x.distance", "x.delta", "x.live")


CODE = "(((((CAST(action % 12 AS BIGINT) * 35 + (action % 34 + 1)) * 35 + (action % 31 + 1)) * 35 + (action % 30 + 1)) * 35 + 0) * 5 + (current_rank % 4 + 1)) * 256 + kyoku % 8"


@query(f"SELECT obs_id, loaded_at, {CODE} AS code, CAST(action % 12 AS BIGINT) AS kind, CAST(action % 34 AS BIGINT) AS tile, CAST(current_rank % 4 AS BIGINT) AS target FROM decisions WHERE action IS NOT NULL AND current_rank IS NOT NULL AND kyoku IS NOT NULL")
def action_codes(spark, d):
    t = table(spark, d, "decisions").where("action is not null and current_rank is not null and kyoku is not null")
    a = F.col("action")
    t = t.withColumn("code", A.encode(a % 12, a % 34, F.array(a % 31, a % 30), F.col("current_rank") % 4, F.col("kyoku") % 8))
    back = A.decode("code")
    return t.select("obs_id", "loaded_at", "code", back["kind"].alias("kind"), back["tile"].cast("bigint").alias("tile"), back["target"].cast("bigint").alias("target"))


@query("SELECT obs_id, loaded_at, len(list_filter(list_transform(range(46), lambda i: list_contains([action, 45], i)), lambda x: x)) AS allowed FROM decisions WHERE action IS NOT NULL")
def legal_masks(spark, d):
    t = table(spark, d, "decisions").where("action is not null")
    mask = A.legal_mask(F.array("action", F.lit(45)))
    return t.select("obs_id", "loaded_at", F.size(F.filter(mask, lambda x: x)).cast("bigint").alias("allowed"))


@query("SELECT CAST(CAST(ts AS DATE) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE CAST(ts AS DATE) < (SELECT CAST(max(ts) - INTERVAL 2 HOUR AS DATE) FROM events) GROUP BY 1, 2")
def stream_window_counts(spark, d):
    out = S.drain(S.windowed_counts(S.read(spark, d, "events"), "ts", ["event_type"]))
    # windows after the watermark stay open and are not written
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"WITH {EV}, e AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx DESC) AS ep FROM ev), t AS (SELECT user_id, ep, max_by(value, idx) AS v, max(idx) AS m FROM e WHERE ep > 0 GROUP BY 1, 2) SELECT e.user_id, e.event_id, CAST(t.m - e.idx AS INTEGER) AS steps, CAST(t.v * pow(0.99, t.m - e.idx) AS FLOAT) AS target FROM e JOIN t ON e.user_id = t.user_id AND e.ep = t.ep")
def stream_pending_targets(spark, d):
    out = S.drain(S.pending_until(S.read(spark, d, "events"), "user_id", "ts", "event_type", "value", "error"))
    return out.withColumn("target", F.col("target").cast("float"))


@query("SELECT event_id, user_id FROM events")
def stream_once(spark, d):
    return S.drain(S.once(S.read(spark, d, "events").select("event_id", "user_id", "ts"), "ts", "event_id")).select("event_id", "user_id")
