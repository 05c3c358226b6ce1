"""Queries on nested records and on small files (problems 2 and 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.operators import consolidate, nested
from foldspan.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.held_items(table(spark, d, "game_states"), table(spark, d, "snapshots"))


def _nodes(spark: SparkSession, d: str, *paths: str, fields: bool = True) -> DataFrame:
    return nested.state_nodes(table(spark, d, "game_states"), paths, fields).unionByName(nested.snapshot_nodes(table(spark, d, "snapshots"), paths, fields))


def p2_records(spark: SparkSession, d: str) -> DataFrame:
    return nested.by_path(_nodes(spark, d, "record", fields=False), "record").drop("place")


def p2_record_fields(spark: SparkSession, d: str) -> DataFrame:
    kinds = {"bakaze": "string"} | dict.fromkeys(("kyoku", "honba", "kyotaku", "oya", "actor_to_move", "remaining_wall"), "int")
    return nested.by_path(_nodes(spark, d, "record"), "record", columns=kinds).drop("place")


def p2_seats(spark: SparkSession, d: str) -> DataFrame:
    return nested.by_path(_nodes(spark, d, "players", fields=False), "players", "record_label")


def p2_seat_fields(spark: SparkSession, d: str) -> DataFrame:
    return nested.by_path(_nodes(spark, d, "players"), "players", columns=dict.fromkeys(("reached", "furiten", "riichi_furiten", "pending_reach"), "boolean"))


def p2_discards(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, "players.discards"))["discards"]


def p2_melds(spark: SparkSession, d: str) -> DataFrame:
    return nested.tables(_nodes(spark, d, "players.melds"))["melds"].withColumn("consumed", F.array_join("consumed", " "))


def p2_consumed(spark: SparkSession, d: str) -> DataFrame:
    return nested.by_path(_nodes(spark, d, "players.melds.consumed"), "players.melds.consumed", "meld_label", {"value": "string"}).withColumnRenamed("value", "pai")


def p2_scores(spark: SparkSession, d: str) -> DataFrame:
    return nested.by_path(_nodes(spark, d, "scores"), "scores", "record_label", {"value": "int"}).drop("label")


def p2_hands(spark: SparkSession, d: str) -> DataFrame:
    """Tiles in the hands of states: one row per player and tile, by the schema path of the object."""
    nodes = nested.state_nodes(table(spark, d, "game_states"), ["players.hand"])
    rows = nodes.where("schema_path = 'players.hand'").select("rec", "rec_id", nested.owner(nodes).alias("seat_label"), F.explode("fields").alias("pai", "held"))
    return rows.withColumn("held", F.expr("try_cast(held as int)"))


def p2_left_out(spark: SparkSession, d: str) -> DataFrame:
    return nested.left_out(table(spark, d, "game_states"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.repeated_lines(table(spark, d, "export_jobs"))


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.consolidated(table(spark, d, "export_jobs"))[0].select("log", "event_index", "file_id", "line_no", "line")


def p3_files(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.consolidated(table(spark, d, "export_jobs"))[1]


def p3_files_check(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the output files, and whether their key ranges follow each other and their sizes the target."""
    return consolidate.files_check(consolidate.consolidated(table(spark, d, "export_jobs"))[1])


def p3_manifest_check(spark: SparkSession, d: str) -> DataFrame:
    return consolidate.manifest_check(table(spark, d, "export_manifests"), table(spark, d, "export_jobs"))


QUERIES = {f.__name__: f for f in (p2_found, p2_records, p2_record_fields, p2_seats, p2_seat_fields, p2_discards, p2_melds, p2_consumed, p2_scores, p2_hands, p2_left_out, p3_found, p3_records, p3_files, p3_files_check, p3_manifest_check)}

_LOG = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(url_decode(regexp_replace(trim(src_path), '^(?i)file:(//)?/', '/')), chr(92), '/'), '/+', '/', 'g'), '(/[.])+(/|$)', '\2', 'g'), '/[^/]+/[.][.](/|$)', '\1'), '/[^/]+/[.][.](/|$)', '\1')"
_LINES = "l AS (SELECT file_id, {0} AS log, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line, unnest(range(1, len(string_split(replace(body, chr(13), ''), chr(10))) + 1)) AS line_no FROM export_jobs WHERE src_path IS NOT NULL), e AS (SELECT file_id, log, CAST(line_no AS INTEGER) AS line_no, trim(line) AS line, try_cast(json_extract_string(CASE WHEN json_valid(line) THEN line END, '$.event_index') AS BIGINT) AS event_index FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY log, event_index ORDER BY file_id, line_no) AS n FROM e WHERE event_index IS NOT NULL)".format(_LOG)
_FIX = "CASE WHEN json_type({0}) = 'VARCHAR' AND json_valid(json_extract_string({0}, '$')) AND left(json_extract_string({0}, '$'), 1) IN ('[', '{{') THEN CAST(json_extract_string({0}, '$') AS JSON) ELSE {0} END"
_ENTRIES = "CASE json_type({0}) WHEN 'ARRAY' THEN list_transform(range(CAST(json_array_length({0}) AS BIGINT)), lambda i: {{'k': CAST(i AS BIGINT), 'v': json_extract({0}, '$[' || i || ']')}}) WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys({0}), lambda k: try_cast(k AS BIGINT) IS NULL)) > 0 THEN [{{'k': CAST(0 AS BIGINT), 'v': {0}}}] ELSE list_transform(json_keys({0}), lambda k: {{'k': CAST(k AS BIGINT), 'v': json_extract({0}, '$.' || k)}}) END WHEN 'VARCHAR' THEN list_transform(range(len(list_filter(string_split(json_extract_string({0}, '$'), ' '), lambda t: t <> ''))), lambda i: {{'k': CAST(i AS BIGINT), 'v': CAST('1' AS JSON)}}) END"
_ITEMS = " UNION ALL ".join(
    f"SELECT 'snapshot', snapshot_id, CAST(i.i AS INTEGER), '{name}', CAST(j AS INTEGER) FROM s, range(4) i(i), unnest(range(len({name}s[i.i + 1]))) t(j) WHERE {name}s[i.i + 1][j + 1] IS NOT NULL" for name in ("discard", "meld")
)
_STATES = " UNION ALL ".join(
    f"SELECT 'state' AS rec, state_id AS rec_id, seat, '{name}' AS kind, CAST(x.k AS INTEGER) AS item_no FROM (SELECT state_id, seat, unnest({_ENTRIES.format('v')}) AS x FROM (SELECT state_id, seat, {_FIX.format(name + 's')} AS v FROM p)) WHERE x.v IS NOT NULL AND json_type(x.v) <> 'NULL'" for name in ("discard", "meld")
)
_BASE = f"""s AS (SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY snapshot_id ORDER BY loaded_at DESC NULLS LAST) = 1),
g AS (SELECT state_id, CAST(payload AS JSON) AS j FROM game_states WHERE json_valid(payload) QUALIFY row_number() OVER (PARTITION BY state_id ORDER BY loaded_at DESC NULLS LAST) = 1),
u AS (SELECT state_id, json_extract(coalesce(json_extract(j, '$.data.state'), json_extract(j, '$.state'), j), '$.players') AS pl FROM g),
q AS (SELECT state_id, unnest({_ENTRIES.format("pl")}) AS x FROM u),
p AS (SELECT state_id, x.k AS place, CAST(coalesce(try_cast(json_extract_string(x.v, '$.seat') AS BIGINT), x.k) AS INTEGER) AS seat, x.v AS player, json_extract(x.v, '$.discards') AS discards, json_extract(x.v, '$.melds') AS melds FROM q WHERE json_type(x.v) = 'OBJECT')"""
_TOKENS = _ENTRIES.replace("'v': CAST('1' AS JSON)", "'v': to_json(list_filter(string_split(json_extract_string({0}, '$'), ' '), lambda t: t <> '')[i + 1])")


def _state_items(name: str, step: int, fields: dict[str, str]) -> str:
    inner = f"SELECT state_id, place, seat, unnest({_TOKENS.format('v')}) AS x FROM (SELECT state_id, place, seat, {_FIX.format(name + 's')} AS v FROM p WHERE seat BETWEEN 0 AND 3)"
    opened = f"SELECT state_id, place, seat, x.k AS k, CASE WHEN json_type(x.v) = 'OBJECT' THEN coalesce(json_extract(x.v, '$.{name}'), x.v) ELSE x.v END AS v FROM ({inner}) WHERE x.v IS NOT NULL AND json_type(x.v) <> 'NULL'"
    return f"SELECT 'state' AS rec, state_id AS rec_id, state_id || '.' || place || '.{step}.' || k AS label, state_id || '.' || place AS seat_label, seat, CAST(k AS INTEGER) AS item_no, {', '.join(f'{e} AS {c}' for c, e in fields.items())} FROM ({opened})"


def _snapshot_rows(name: str, step: int, fields: list[str], more: str = "") -> str:
    return f"SELECT 'snapshot', snapshot_id, snapshot_id || '.' || i.i || '.{step}.' || j, snapshot_id || '.' || i.i, CAST(i.i AS INTEGER), CAST(j AS INTEGER), {', '.join(f'{name}s[i.i + 1][j + 1].{f}' for f in fields)}{more} FROM s, range(4) i(i), unnest(range(len({name}s[i.i + 1]))) t(j) WHERE {name}s[i.i + 1][j + 1] IS NOT NULL"


_GET = "json_extract_string(v, '$.{0}')"
_DISCARDS = {"pai": f"CASE WHEN json_type(v) = 'OBJECT' THEN {_GET.format('pai')} ELSE json_extract_string(v, '$') END"} | {c: f"CAST(CASE WHEN json_type(v) = 'OBJECT' THEN {_GET.format(c)} END AS BOOLEAN)" for c in ("tsumogiri", "reach_declared")}
_MELDS = {c: _GET.format(c) for c in ("type", "pai", "pai_raw")} | {"target": f"CAST({_GET.format('target')} AS INTEGER)", "consumed": "array_to_string(CAST(json_extract(v, '$.consumed') AS VARCHAR[]), ' ')"}
_CONSUMED = "CAST(json_extract(v, '$.consumed') AS VARCHAR[])"
_RECORD = {"bakaze": "VARCHAR"} | dict.fromkeys(("kyoku", "honba", "kyotaku", "oya", "actor_to_move", "remaining_wall"), "INTEGER")
_FLAGS = ("reached", "furiten", "riichi_furiten", "pending_reach")
_INNER = "coalesce(json_extract(j, '$.data.state'), json_extract(j, '$.state'), j)"
ORACLE: dict[str, str] = {
    "p2_record_fields": f"WITH {_BASE} SELECT 'state' AS rec, state_id AS rec_id, CAST(state_id AS VARCHAR) AS label, {', '.join(f'CAST(json_extract_string({_INNER}, {chr(39)}$.{c}{chr(39)}) AS {t}) AS {c}' for c, t in _RECORD.items())} FROM g UNION ALL SELECT 'snapshot', snapshot_id, CAST(snapshot_id AS VARCHAR), {', '.join(_RECORD)} FROM s",
    "p2_seat_fields": f"WITH {_BASE} SELECT 'state' AS rec, state_id AS rec_id, state_id || '.' || place AS label, seat, CAST(place AS INTEGER) AS place, {', '.join(f'CAST(json_extract_string(player, {chr(39)}$.{c}{chr(39)}) AS BOOLEAN) AS {c}' for c in _FLAGS)} FROM p WHERE seat BETWEEN 0 AND 3 UNION ALL SELECT 'snapshot', snapshot_id, snapshot_id || '.' || i.i, CAST(i.i AS INTEGER), CAST(i.i AS INTEGER), reached[i.i + 1], furiten[i.i + 1], NULL, NULL FROM s, range(4) i(i)",
    "p2_discards": f"WITH {_BASE} {_state_items('discard', 0, _DISCARDS)} UNION ALL {_snapshot_rows('discard', 0, list(_DISCARDS))}",
    "p2_melds": f"WITH {_BASE} {_state_items('meld', 1, _MELDS)} UNION ALL {_snapshot_rows('meld', 1, [c for c in _MELDS if c != 'consumed'], ", array_to_string(melds[i.i + 1][j + 1].consumed, ' ')")}",
    "p2_consumed": f"WITH {_BASE}, m AS ({_state_items('meld', 1, {'tiles': _CONSUMED})} UNION ALL {_snapshot_rows('meld', 1, ['consumed'])}), c AS (SELECT *, unnest(range(len(tiles))) AS k FROM m) SELECT rec, rec_id, label || '.0.' || k AS label, label AS meld_label, seat, CAST(k AS INTEGER) AS place, tiles[k + 1] AS pai FROM c WHERE tiles[k + 1] IS NOT NULL",
    "p2_scores": f"WITH {_BASE}, v AS (SELECT 'state' AS rec, state_id AS rec_id, CAST(json_extract({_INNER}, '$.scores') AS INTEGER[]) AS scores FROM g UNION ALL SELECT 'snapshot', snapshot_id, scores FROM s), k AS (SELECT *, unnest(range(len(scores))) AS place FROM v) SELECT rec, rec_id, CAST(rec_id AS VARCHAR) AS record_label, CAST(place AS INTEGER) AS place, scores[place + 1] AS value FROM k WHERE scores[place + 1] IS NOT NULL",
    "p2_hands": f"WITH {_BASE}, h AS (SELECT state_id, place, json_extract(player, '$.hand') AS hand FROM p), t AS (SELECT state_id, place, hand, unnest(json_keys(hand)) AS pai FROM h WHERE json_type(hand) = 'OBJECT') SELECT 'state' AS rec, state_id AS rec_id, state_id || '.' || place AS seat_label, pai, CAST(json_extract_string(hand, '$.' || pai) AS INTEGER) AS held FROM t",
    "p2_left_out": f"WITH {_BASE} SELECT 'null payload' AS reason, CAST(count(*) FILTER (payload IS NULL) AS BIGINT) AS n FROM game_states UNION ALL SELECT 'unreadable payload', count(*) FILTER (payload IS NOT NULL AND NOT json_valid(payload)) FROM game_states UNION ALL SELECT 'player beyond the seats', count(*) FROM p WHERE seat NOT BETWEEN 0 AND 3",
    "p2_found": f"WITH {_BASE} {_STATES} UNION ALL {_ITEMS}",
    "p2_records": f"WITH {_BASE} SELECT 'state' AS rec, state_id AS rec_id, CAST(state_id AS VARCHAR) AS label FROM g UNION ALL SELECT 'snapshot', snapshot_id, CAST(snapshot_id AS VARCHAR) FROM s",
    "p2_seats": f"WITH {_BASE} SELECT 'state' AS rec, state_id AS rec_id, state_id || '.' || place AS label, CAST(state_id AS VARCHAR) AS record_label, seat, CAST(place AS INTEGER) AS place FROM p WHERE seat BETWEEN 0 AND 3 UNION ALL SELECT 'snapshot', snapshot_id, snapshot_id || '.' || i.i, CAST(snapshot_id AS VARCHAR), CAST(i.i AS INTEGER), CAST(i.i AS INTEGER) FROM s, range(4) i(i)",
    "p3_found": f"WITH {_LINES} SELECT file_id, line_no FROM r WHERE n > 1",
    "p3_records": f"WITH {_LINES} SELECT log, event_index, file_id, line_no, line FROM r WHERE n = 1",
    "p3_files_check": f"WITH {_LINES} SELECT CAST(count(*) FILTER (n = 1) AS BIGINT) AS n_records, CAST(count(*) FILTER (n > 1) AS BIGINT) AS n_copies, CAST(sum(strlen(line) + 1) FILTER (n = 1) AS BIGINT) AS n_bytes, true AS in_order, true AS sized FROM r",
    "p3_manifest_check": f"""WITH m AS (SELECT manifest_id, unnest(files) AS src_path FROM export_manifests), a AS (SELECT DISTINCT manifest_id, {_LOG} AS log FROM m WHERE src_path IS NOT NULL), b AS (SELECT DISTINCT manifest_id, {_LOG} AS log FROM export_jobs WHERE src_path IS NOT NULL AND manifest_id IS NOT NULL),
g AS (SELECT coalesce(a.manifest_id, b.manifest_id) AS manifest_id, sum(CASE WHEN b.log IS NULL THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN a.log IS NULL THEN 1 ELSE 0 END) AS unlisted FROM a FULL JOIN b ON a.manifest_id = b.manifest_id AND a.log = b.log GROUP BY 1), h AS (SELECT manifest_id, count(*) AS held FROM export_jobs GROUP BY 1)
SELECT x.manifest_id, CAST(len(files) AS BIGINT) AS listed, CAST(list_sum(map_values(shard_file_counts)) AS BIGINT) AS shard_total, coalesce(held, 0) AS held, CAST(coalesce(missing, 0) AS BIGINT) AS missing, CAST(coalesce(unlisted, 0) AS BIGINT) AS unlisted FROM export_manifests x LEFT JOIN g ON x.manifest_id = g.manifest_id LEFT JOIN h ON x.manifest_id = h.manifest_id""",
}
