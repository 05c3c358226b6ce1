"""The participant report: raw totals over rounds and the rates that follow from them.

Measures are conditions and values in plain SQL, so any engine computes the same
report.  Rows are events as each seat sees them; totals are taken per round, then
per participant, and rates only from totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_WON, _LOST = "type = 'hora' AND actor = seat", "type = 'hora' AND target = seat AND actor <> seat"
_CALL = "actor = seat AND type IN ('chi', 'pon', 'daiminkan', 'ankan', 'kakan')"
_FIRST = "type = 'reach' AND actor = seat AND declared = 0"

#: per round: what is summed where the condition holds
ROUND = {
    "point": ("type IN ('hora', 'ryukyoku')", "d"),
    **{f"{w}agari{k}": (f"{_WON}{c}", v) for w, c in (("", ""), ("oya_", " AND dealer"), ("riichi_", " AND declared > 0"), ("fuuro_", " AND declared = 0 AND called > 0"), ("dama_", " AND declared = 0 AND called = 0")) for k, v in (("", "1"), ("_point", "d"), ("_jun", "turn"))},
    **{f"houjuu{k}": (_LOST, v) for k, v in (("", "1"), ("_point", "d"), ("_jun", "turn"))},
    "houjuu_to_oya": (f"{_LOST} AND to_dealer", "1"),
    "houjuu_to_oya_point": (f"{_LOST} AND to_dealer", "d"),
    "riichi_houjuu": (f"{_LOST} AND declared > 0", "1"),
    "fuuro_houjuu": (f"{_LOST} AND declared = 0 AND called > 0", "1"),
    "calls": (_CALL, "1"),
    "riichi": (_FIRST, "1"),
    "riichi_jun": (_FIRST, "turn"),
    "chasing": (f"{_FIRST} AND others_declared > 0", "1"),
    "chases": ("type = 'reach' AND actor <> seat AND declared > 0", "1"),
    "draws": ("type = 'ryukyoku'", "1"),
    "draw_point": ("type = 'ryukyoku'", "d"),
    "yakuman": (f"{_WON} AND d >= 32000", "1"),
    "nagashi_mangan": ("type = 'ryukyoku' AND d >= 8000", "1"),
}
#: per participant: sums over rounds; what is not named here is the plain sum
TOTAL = {
    "game": "count(*)", "round": "count(*)", "oya": "sum(CASE WHEN dealer THEN 1 ELSE 0 END)", **{f"rank_{k}": f"sum(CASE WHEN rank = {k} THEN 1 ELSE 0 END)" for k in range(1, 5)},
    "tobi": "sum(CASE WHEN final_score < 0 THEN 1 ELSE 0 END)", "fuuro": "sum(CASE WHEN calls > 0 THEN 1 ELSE 0 END)", "fuuro_num": "sum(calls)", "ryukyoku": "sum(CASE WHEN draws > 0 THEN 1 ELSE 0 END)",
    "chased": "sum(CASE WHEN riichi > 0 AND chases > 0 THEN 1 ELSE 0 END)", "riichi_point": "sum(CASE WHEN riichi > 0 THEN point ELSE 0 END)", "fuuro_point": "sum(CASE WHEN calls > 0 THEN point ELSE 0 END)",
}
# fixed values: names of the report's raw and derived fields
RAW = ("game", "round", "oya", "point", "rank_1", "rank_2", "rank_3", "rank_4", "tobi", "agari", "houjuu", "fuuro", "fuuro_num", "riichi", "ryukyoku", "yakuman", "nagashi_mangan")
DERIVED = {
    **{f"rank_{k}_rate": (f"rank_{k}", "game") for k in range(1, 5)},
    "tobi_rate": ("tobi", "game"), "avg_rank": ("rank_1 + 2 * rank_2 + 3 * rank_3 + 4 * rank_4", "game"), "avg_point_per_game": ("point", "game"), "avg_point_per_round": ("point", "round"),
    "agari_rate": ("agari", "round"), "houjuu_rate": ("houjuu", "round"), "fuuro_rate": ("fuuro", "round"), "riichi_rate": ("riichi", "round"), "ryukyoku_rate": ("ryukyoku", "round"),
    "avg_point_per_agari": ("agari_point", "agari"), "avg_point_per_oya_agari": ("oya_agari_point", "oya_agari"), "avg_point_per_ko_agari": ("agari_point - oya_agari_point", "agari - oya_agari"),
    **{f"avg_point_per_{w}_agari": (f"{w}_agari_point", f"{w}_agari") for w in ("riichi", "fuuro", "dama")}, "avg_point_per_ryukyoku": ("draw_point", "draws"),
    "avg_agari_jun": ("agari_jun", "agari"), **{f"avg_{w}_agari_jun": (f"{w}_agari_jun", f"{w}_agari") for w in ("riichi", "fuuro", "dama")}, "avg_houjuu_jun": ("houjuu_jun", "houjuu"),
    "avg_point_per_houjuu": ("houjuu_point", "houjuu"), "avg_point_per_houjuu_to_oya": ("houjuu_to_oya_point", "houjuu_to_oya"), "avg_point_per_houjuu_to_ko": ("houjuu_point - houjuu_to_oya_point", "houjuu - houjuu_to_oya"),
    "chasing_riichi_rate": ("chasing", "riichi"), "riichi_chased_rate": ("chased", "riichi"), "agari_rate_after_riichi": ("riichi_agari", "riichi"), "houjuu_rate_after_riichi": ("riichi_houjuu", "riichi"),
    "avg_riichi_jun": ("riichi_jun", "riichi"), "avg_riichi_point": ("riichi_point", "riichi"), "avg_fuuro_num": ("fuuro_num", "fuuro"), "agari_rate_after_fuuro": ("fuuro_agari", "fuuro"), "houjuu_rate_after_fuuro": ("fuuro_houjuu", "fuuro"), "avg_fuuro_point": ("fuuro_point", "fuuro"),
    "agari_rate_as_oya": ("oya_agari", "oya"), "agari_as_oya_rate": ("oya_agari", "agari"), "houjuu_to_oya_rate": ("houjuu_to_oya", "houjuu"), "yakuman_rate": ("yakuman", "round"), "nagashi_mangan_rate": ("nagashi_mangan", "round"),
}


def summed(name: str) -> str:
    cond, value = ROUND[name]
    return f"sum(CASE WHEN {cond} THEN coalesce({value}, 0) ELSE 0 END) AS {name}"


def totals() -> list[str]:
    rest = [n for n in ROUND if n not in TOTAL]
    return [f"{e} AS {n}" for n, e in TOTAL.items()] + [f"sum({n}) AS {n}" for n in rest]


def rates() -> list[str]:
    """Every field of the report as an expression over totals."""
    return [f"CAST({r} AS BIGINT) AS {r}" for r in RAW] + [f"round(CAST({a} AS DOUBLE) / nullif({b}, 0), 8) AS {n}" for n, (a, b) in DERIVED.items()]


def seat_view(events: DataFrame, dealer: Column) -> DataFrame:
    """Each event as the four seats see it: own points, turn, and what was declared and called before it.

    ``events``: ``log_id, segment, event_index, type, actor, target, deltas``; one
    segment of a log is one group, as its order carries the meaning.
    """
    e = events.withColumn("seat", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    w = Window.partitionBy("log_id", "segment", "seat").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda cond: F.coalesce(F.sum(F.when(F.expr(cond), 1).otherwise(0)).over(w), F.lit(0))
    return e.withColumns({
        "d": F.get("deltas", F.col("seat")), "dealer": F.col("seat") == dealer, "to_dealer": F.col("actor") == dealer, "turn": before("type = 'dahai' AND actor = seat") + 1,
        "declared": before("type = 'reach' AND actor = seat"), "others_declared": before("type = 'reach' AND actor <> seat"), "called": before(_CALL),
    })


def player_report(view: DataFrame, standing: DataFrame, player: str = "seat") -> DataFrame:
    """17 raw and 43 derived fields per participant; rates without a denominator are null.

    ``standing``: ``log_id, seat, final_score, rank`` with rank from 1.
    """
    per = view.groupBy("log_id", "segment", "seat", "dealer").agg(*[F.expr(summed(n)) for n in ROUND])
    rounds = per.join(standing.select("log_id", "seat", "final_score", "rank"), ["log_id", "seat"])
    return rounds.groupBy(player).agg(*[F.expr(t) for t in totals()]).select(player, *[F.expr(r) for r in rates()])
