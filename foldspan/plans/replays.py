"""Queries that replay the logs held by small files: state, targets, standings, canonical events.

The logs of ``export_jobs`` are merged first, every record once.  They hold no
deal, so each begins with one of unknown hands and even scores.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from foldspan.operators import consolidate, replay, report
from foldspan.plans.records import _LINES
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


_DEAL = '{"type": "start_kyoku", "bakaze": "E", "kyoku": 1, "honba": 0, "kyotaku": 0, "oya": 0, "scores": [25000, 25000, 25000, 25000], "dora_marker": "1p", "tehais": [["?"], ["?"], ["?"], ["?"]]}'
EVENTS = f"WITH {_LINES}, e AS (SELECT log AS log_id, event_index, json_extract_string(line, '$.type') AS type, CAST(json_extract_string(line, '$.actor') AS INTEGER) AS actor, json_extract_string(line, '$.pai') AS pai, CAST(json_extract(line, '$.deltas') AS INTEGER[]) AS deltas FROM r WHERE n = 1)"
EVENTS = EVENTS.replace(", e AS (SELECT file_id, log,", ", lines AS (SELECT file_id, log,").replace("FROM e WHERE event_index IS NOT NULL", "FROM lines WHERE event_index IS NOT NULL")
#: seats that declared and discarded before a place
_ROWS = """f AS (SELECT log_id, actor, min(event_index) AS declared FROM e WHERE type = 'reach' GROUP BY 1, 2), c AS (SELECT e.log_id, e.actor, min(e.event_index) AS closed FROM e JOIN f ON e.log_id = f.log_id AND e.actor = f.actor AND e.event_index > f.declared WHERE e.type = 'dahai' GROUP BY 1, 2),
b AS (SELECT e.*, count(*) FILTER (type = 'tsumo' AND pai <> '?') OVER w AS drawn, coalesce(closed < event_index, false) AS reached,
count(*) FILTER (type = 'dahai') OVER s AS river, count(*) FILTER (type IN ('chi', 'pon', 'daiminkan', 'ankan')) OVER s AS calls
FROM e LEFT JOIN c ON e.log_id = c.log_id AND e.actor = c.actor WINDOW w AS (PARTITION BY e.log_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s AS (PARTITION BY e.log_id, e.actor ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d AS (SELECT * FROM b WHERE type IN ('dahai', 'chi', 'pon', 'daiminkan', 'ankan', 'kakan', 'reach', 'hora', 'ryukyoku') AND actor BETWEEN 0 AND 3 AND NOT (type = 'dahai' AND reached))"""


def _events(spark, d):
    records = consolidate.consolidated(table(spark, d, "export_jobs"))[0].select(F.col("log").alias("log_id"), "event_index", "line")
    deals = records.select("log_id").distinct().select("log_id", F.lit(-1).cast("bigint").alias("event_index"), F.lit(_DEAL).alias("line"))
    return replay.parse(records.unionByName(deals))


def _decisions(spark, d):
    return replay.decisions(_events(spark, d)).where("kind is not null")


@query(f"{EVENTS}, {_ROWS} SELECT log_id, CAST(event_index AS INTEGER) AS event_index, actor, type AS kind, pai, reached, CAST(greatest(0, 70 - drawn) AS INTEGER) AS remaining_wall, CAST(river AS INTEGER) AS river, CAST(calls AS INTEGER) AS calls FROM d")
def replay_decisions(spark, d):
    rows = _decisions(spark, d)
    state = F.from_json("state", "discards array<array<struct<pai:string>>>, melds array<array<struct<pai:string>>>")
    rows = rows.withColumn("s", state)
    return rows.select("log_id", "event_index", "actor", "kind", "pai", "reached", "remaining_wall", F.size(F.get("s.discards", F.col("actor"))).alias("river"), F.size(F.get("s.melds", F.col("actor"))).alias("calls"))


@query(f"""{EVENTS}, {_ROWS}, z AS (SELECT log_id, max_by(actor, event_index) AS winner, max_by(deltas, event_index) AS deltas FROM e WHERE type = 'hora' GROUP BY 1), t AS (SELECT d.log_id, d.event_index, d.actor, z.winner, coalesce(z.deltas[d.actor + 1] / 30000.0, 0) AS delta, count(*) OVER (PARTITION BY d.log_id) - row_number() OVER (PARTITION BY d.log_id ORDER BY d.event_index, d.actor) AS left_ FROM d LEFT JOIN z ON d.log_id = z.log_id)
SELECT log_id, CAST(event_index AS INTEGER) AS event_index, actor, round(delta * pow(0.99, left_), 9) AS value_target, round(delta, 9) AS score_delta_target, CAST(CASE WHEN winner = actor THEN 1 ELSE 0 END AS DOUBLE) AS win_target, round(CASE WHEN winner = actor THEN greatest(delta, 0) ELSE 0 END, 9) AS pts_given_win_target FROM t""")
def replay_targets(spark, d):
    e = _events(spark, d)
    rows = replay.targets(replay.decisions(e).where("kind is not null"), e)
    return rows.select("log_id", "event_index", "actor", *[F.round(c, 9).alias(c) for c in ("value_target", "score_delta_target")], "win_target", F.round("pts_given_win_target", 9).alias("pts_given_win_target"))


@query(f"{EVENTS}, s AS (SELECT l.log_id, s.s AS seat, 25000 + coalesce((SELECT sum(deltas[s.s + 1]) FROM e WHERE e.log_id = l.log_id AND type IN ('hora', 'ryukyoku')), 0) AS score FROM (SELECT DISTINCT log_id FROM e) l, range(4) s(s)) SELECT log_id, CAST(seat AS INTEGER) AS seat, CAST(score AS BIGINT) AS final_score, CAST(row_number() OVER (PARTITION BY log_id ORDER BY score DESC, seat) - 1 AS INTEGER) AS rank FROM s")
def replay_standing(spark, d):
    return replay.final_standing(_events(spark, d))


#: the seat that pays alone for a win is its target; wins paid by several are own draws
_TARGET = "CASE WHEN type = 'hora' THEN CASE WHEN len(list_filter(deltas, lambda x: x < 0)) = 1 THEN CAST(list_position(deltas, list_min(deltas)) - 1 AS INTEGER) ELSE actor END END"


@query(f"""{EVENTS}, t AS (SELECT *, {_TARGET} AS target FROM e), m AS (SELECT *, last_value(CASE WHEN type IN ('tsumo', 'dahai', 'chi', 'pon') THEN {{'type': type, 'actor': actor, 'pai': pai}} END IGNORE NULLS) OVER w AS move, count(*) FILTER (type = 'tsumo' AND pai <> '?') OVER w AS drawn FROM t WINDOW w AS (PARTITION BY log_id ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
x AS (SELECT *, coalesce(actor = target AND move.type = 'tsumo', false) AS own, coalesce(actor <> target AND move.type = 'dahai' AND move.actor = target, false) AS given FROM m WHERE type = 'hora')
SELECT log_id, event_index, CASE WHEN own OR given THEN move.pai END AS pai, coalesce(actor = target, false) AND 70 - drawn = 0 AS is_haitei, given AND 70 - drawn = 0 AS is_houtei FROM x""")
def win_enrichment(spark, d):
    pays = F.size(F.filter("deltas", lambda x: x < 0)) == 1
    target = F.when(F.col("type") == "hora", F.when(pays, F.array_position("deltas", F.array_min("deltas")).cast("int") - 1).otherwise(F.col("actor")))
    e = replay.enrich_wins(_events(spark, d).withColumn("target", target)).where("type = 'hora'")
    return e.select("log_id", "event_index", "pai", F.coalesce("is_haitei", F.lit(False)).alias("is_haitei"), F.coalesce("is_houtei", F.lit(False)).alias("is_houtei"))


@query(f"""{EVENTS}, k AS (SELECT log_id, event_index, CASE WHEN type = 'reach' THEN 'kakan' ELSE type END AS type, regexp_replace(regexp_replace(pai, '^0', '5'), '^([1-46-9][mpsz]|[ESWNPFC])r$', '\\1') AS pai FROM e), n AS (SELECT *, lead(type) OVER (PARTITION BY log_id ORDER BY event_index) AS nxt FROM k), o AS (SELECT log_id, event_index, 0 AS made, type FROM n UNION ALL SELECT log_id, event_index, 1, 'kakan_accepted' FROM n WHERE type = 'kakan' AND nxt IS NOT NULL AND nxt NOT IN ('hora', 'kakan_accepted'))
SELECT log_id, row_number() OVER (PARTITION BY log_id ORDER BY event_index, made) - 1 AS event_index, type FROM o""")
def kan_injection(spark, d):
    # declarations stand in for kans, which these logs lack
    e = _events(spark, d).where("event_index >= 0")
    e = replay.normalise(e.withColumn("type", F.when(F.col("type") == "reach", "kakan").otherwise(F.col("type"))))
    return e.select("log_id", F.col("event_index").cast("bigint").alias("event_index"), "type")


@query(f"{EVENTS}, {_ROWS} SELECT log_id, count(*) AS decisions, CAST(sum(CASE WHEN reached THEN 1 ELSE 0 END) AS BIGINT) AS after_reach, CAST(0 AS BIGINT) AS broken FROM d GROUP BY 1")
def replay_isolation(spark, d):
    """Decisions per log beside one log that cannot be replayed, which costs the others nothing."""
    e = _events(spark, d)
    bad = e.where("event_index = -1").limit(1).withColumn("log_id", F.lit("broken")).withColumn("scores", F.lit(None).cast("array<int>"))
    rows = replay.decisions(e.unionByName(bad))
    counts = rows.groupBy("log_id").agg(F.count("kind").alias("decisions"), F.count_if("reached").alias("after_reach"), F.count_if(F.col("errors") == -1).alias("broken"))
    return counts.where("log_id <> 'broken' and decisions > 0")


_VIEW = f"""{EVENTS}, t AS (SELECT *, {_TARGET} AS target FROM e), v AS (SELECT t.*, CAST(s.s AS INTEGER) AS seat, deltas[s.s + 1] AS d, s.s = 0 AS dealer, actor = 0 AS to_dealer,
count(*) FILTER (type = 'dahai' AND actor = s.s) OVER w + 1 AS turn, count(*) FILTER (type = 'reach' AND actor = s.s) OVER w AS declared, count(*) FILTER (type = 'reach' AND actor <> s.s) OVER w AS others_declared, count(*) FILTER (actor = s.s AND type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan')) OVER w AS called
FROM t, range(4) s(s) WINDOW w AS (PARTITION BY log_id, s.s ORDER BY event_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pr AS (SELECT log_id, seat, dealer, {', '.join(report.summed(n) for n in report.ROUND)} FROM v GROUP BY 1, 2, 3), f AS (SELECT log_id, seat, 25000 + coalesce(sum(d) FILTER (type IN ('hora', 'ryukyoku')), 0) AS final_score FROM v GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY final_score DESC, seat) AS rank FROM f),
x AS (SELECT pr.seat, {', '.join(report.totals())} FROM pr JOIN rk ON pr.log_id = rk.log_id AND pr.seat = rk.seat GROUP BY 1)"""


@query(f"{_VIEW} SELECT seat, {', '.join(report.rates())} FROM x")
def player_report(spark, d):
    """All 60 fields per seat, over the merged logs; each log is one round here."""
    e = _events(spark, d)
    pays = F.size(F.filter("deltas", lambda x: x < 0)) == 1
    target = F.when(F.col("type") == "hora", F.when(pays, F.array_position("deltas", F.array_min("deltas")).cast("int") - 1).otherwise(F.col("actor")))
    rounds = e.where("event_index >= 0").select("log_id", F.lit(0).alias("segment"), "event_index", "type", "actor", target.alias("target"), "deltas")
    standing = replay.final_standing(e).withColumn("rank", F.col("rank") + 1)
    return report.player_report(report.seat_view(rounds, F.lit(0)), standing)


_PLAIN = "regexp_replace(regexp_replace({0}, 'r$', ''), '^0([mps])$', '5\\1')"
_TILE = "CASE WHEN regexp_matches(p, '^[1-9][mps]$') THEN CAST(p[1] AS INTEGER) - 1 + CASE p[2] WHEN 'm' THEN 0 WHEN 'p' THEN 9 ELSE 18 END ELSE CASE p WHEN 'E' THEN 27 WHEN 'S' THEN 28 WHEN 'W' THEN 29 WHEN 'N' THEN 30 WHEN 'P' THEN 31 WHEN 'F' THEN 32 WHEN 'C' THEN 33 ELSE -1 END END"


@query(f"""{EVENTS}, u AS (SELECT log AS log_id, event_index, unnest(CAST(json_extract(line, '$.consumed') AS VARCHAR[])) AS t FROM r WHERE n = 1), k AS (SELECT e.log_id, e.event_index, actor, pai AS t, CASE type WHEN 'tsumo' THEN 1 WHEN 'dahai' THEN -1 ELSE 0 END AS hand, CASE WHEN type IN ('chi', 'pon') THEN 1 ELSE 0 END AS meld, type <> 'tsumo' AS all_ FROM e WHERE type IN ('tsumo', 'dahai', 'chi', 'pon') AND pai IS NOT NULL AND actor BETWEEN 0 AND 3
UNION ALL SELECT e.log_id, e.event_index, actor, u.t, -1, 1, true FROM e JOIN u ON e.log_id = u.log_id AND e.event_index = u.event_index WHERE type IN ('chi', 'pon') AND actor BETWEEN 0 AND 3),
x AS (SELECT *, {_PLAIN.format('t')} AS p FROM k), y AS (SELECT *, {_TILE} AS tile FROM x), z AS (SELECT log_id, CAST(s.s AS INTEGER) AS seat, tile, CASE WHEN s.s = actor THEN hand ELSE 0 END AS hand, CASE WHEN s.s = actor THEN meld ELSE 0 END AS meld FROM y, range(4) s(s) WHERE tile >= 0 AND (all_ OR s.s = actor))
SELECT log_id, seat, CAST(tile AS INTEGER) AS tile, CAST(sum(hand) AS BIGINT) AS hand, CAST(sum(meld) AS BIGINT) AS meld, count(*) AS seen FROM z GROUP BY 1, 2, 3""")
def tracked_counts(spark, d):
    """Counts per log, seat and tile after the last event, from the running ones."""
    t = replay.tracked(replay.tile_moves(_events(spark, d).where("event_index >= 0")))
    last = t.groupBy("log_id", "seat", "tile").agg(F.max_by(F.struct("hand_now", "meld_now", "seen_now"), "event_index").alias("n"))
    return last.select("log_id", "seat", "tile", F.col("n.hand_now").alias("hand"), F.col("n.meld_now").alias("meld"), F.col("n.seen_now").alias("seen"))


@query()
def replay_passes(spark, d):
    """Decision rows with the calls that were passed over; hands are what was drawn, as these logs hold no deal."""
    return replay.decisions(_events(spark, d), passes=True).where("kind is not null").select("log_id", "event_index", "actor", "kind", "remaining_wall")
