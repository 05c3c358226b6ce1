"""Replay of small hand-made logs: canonical events, states, targets, standings."""

import gzip
import json

import pytest

from foldspan.operators import replay as R
from foldspan.sources import readers

HAND = ["1m", "2m", "3m", "4m", "5mr", "6m", "7m", "8m", "9m", "E", "E", "S", "S"]


def start(**k):
    return {"type": "start_kyoku", "bakaze": "E", "kyoku": 1, "honba": 0, "kyotaku": 0, "oya": 0, "scores": [25000] * 4, "dora_marker": "1p", "tehais": [HAND, ["?"] * 13, ["?"] * 13, ["?"] * 13]} | k


def frame(spark, logs):
    rows = [(log, i, json.dumps(e)) for log, events in logs.items() for i, e in enumerate(events)]
    return R.parse(spark.createDataFrame(rows, "log_id string, event_index int, line string"))


GAME = [
    {"type": "start_game", "names": list("abcd"), "seed": [1, 2]},
    start(),
    {"type": "tsumo", "actor": 0, "pai": "0p"},
    {"type": "dahai", "actor": 0, "pai": "E", "tsumogiri": False},
    {"type": "tsumo", "actor": 1, "pai": "?"},
    {"type": "reach", "actor": 1},
    {"type": "dahai", "actor": 1, "pai": "9p", "tsumogiri": True},
    {"type": "reach_accepted", "actor": 1},
    {"type": "tsumo", "actor": 2, "pai": "?"},
    {"type": "dahai", "actor": 2, "pai": "5m", "tsumogiri": True},
    {"type": "hora", "actor": 1, "target": 2, "deltas": [0, 8000, -8000, 0]},
    {"type": "end_kyoku"},
    start(kyoku=2, oya=1, scores=[25000, 32000, 17000, 25000]),
    {"type": "ryukyoku", "deltas": [1500, -1500, 1500, -1500], "tenpai_players": [0, 2]},
    {"type": "end_game"},
]


def test_states_and_targets(spark):
    e = R.normalise(frame(spark, {"g": GAME, "broken": [GAME[0], {"type": "start_kyoku", "bakaze": "E"}]}))
    rows = R.decisions(e)
    got = {r.event_index: r for r in R.targets(rows.where("kind is not null"), e).where("log_id = 'g'").collect()}
    assert [(r.actor, r.kind) for _, r in sorted(got.items())] == [(0, "dahai"), (1, "reach"), (1, "dahai"), (2, "dahai"), (1, "hora")]
    first = got[3]
    assert first.remaining_wall == 69 and "5p" in first.hand and "5mr" in first.hand and len(first.hand) == 14 and first.errors == 0
    assert first.score_delta_target == 0 and got[5].win_target == 1 and got[9].dealin_target == 1
    assert got[5].value_target == pytest.approx(8000 / 30000 * 0.99**3) and got[10].value_target == pytest.approx(8000 / 30000)
    assert got[9].pts_given_dealin_target == pytest.approx(8000 / 30000)
    state = json.loads(got[9].state)
    assert state["discards"][1] == [{"pai": "9p", "reach_declared": True, "tsumogiri": True}] and state["reached"] == [False, True, False, False]
    assert rows.where("log_id = 'broken'").first().errors == -1


def test_standing(spark):
    got = {r.seat: (r.final_score, r.rank) for r in R.final_standing(frame(spark, {"g": GAME})).collect()}
    assert got == {0: (26500, 1), 1: (30500, 0), 2: (18500, 3), 3: (23500, 2)}
    sticks = [start(), {"type": "reach_accepted", "actor": 0}, {"type": "hora", "actor": 0, "target": 1, "deltas": [12000, -12000, 0, 0]}]
    assert [r.final_score for r in R.final_standing(frame(spark, {"g": sticks})).orderBy("seat").collect()] == [36000, 13000, 25000, 25000]
    tie = [start(oya=2, scores=[35000, 25000, 20000, 20000])]
    assert {r.seat: r.rank for r in R.final_standing(frame(spark, {"g": tie})).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}


def test_kan_acceptance_and_robbing(spark):
    pon = [start(), {"type": "kakan", "actor": 1, "pai": "3p", "consumed": ["3p"] * 3}]
    logs = {
        "moves_on": [*pon, {"type": "tsumo", "actor": 1, "pai": "?"}],
        "robbed": [*pon, {"type": "hora", "actor": 2, "target": 1, "deltas": [0] * 4}],
        "accepted": [*pon, {"type": "kakan_accepted", "actor": 1, "pai": "3p", "consumed": ["3p"] * 3}],
        "open": pon,
    }
    e = R.normalise(frame(spark, logs))
    kinds = {log: [r.type for r in e.where(e.log_id == log).orderBy("event_index").collect()] for log in logs}
    assert kinds["moves_on"] == ["start_kyoku", "kakan", "kakan_accepted", "tsumo"] and kinds["accepted"].count("kakan_accepted") == 1
    assert kinds["robbed"][-1] == "hora" and kinds["open"] == ["start_kyoku", "kakan"]
    win = R.enrich_wins(e).where("log_id = 'robbed' and type = 'hora'").first()
    assert win.is_chankan and win.pai == "3p"


def test_replacement_draw_keeps_the_wall(spark):
    log = [start(), {"type": "ankan", "actor": 0, "consumed": ["E", "E", "E", "E"]}, {"type": "tsumo", "actor": 0, "pai": "9s"}, {"type": "dahai", "actor": 0, "pai": "9s"}]
    rows = R.decisions(frame(spark, {"g": log})).orderBy("event_index").collect()
    assert [r.remaining_wall for r in rows] == [70, 69] and json.loads(rows[1].state)["melds"][0][0]["type"] == "ankan"


def test_gzip_and_bad_lines(spark, tmp_path):
    text = "\n".join([*map(json.dumps, GAME[:3]), "", "{torn", "[]"])
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        f.write(text)
    (tmp_path / "b.mjson").write_text(text.replace("\n", "\r\n"))
    (tmp_path / "c.txt").write_text("skip")
    good, bad = readers.events(spark, str(tmp_path), "*.{gz,mjson}")
    assert good.count() == 6 and bad.count() == 4 and good.where("type = 'tsumo'").first().event_index == 2
    checks = readers.strict_logs(good).collect()
    assert all(r.ok for r in checks) and len(checks) == 2
    assert R.decisions(good.limit(0)).count() == 0


def test_shard_reports_and_names(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"shard_{i}").mkdir()
        (tmp_path / f"shard_{i}/report.json").write_text(json.dumps({"shard": i, "games": 250, "ok": i != 2}, indent=1))
    schema = "shard int, games int, ok boolean"
    assert readers.shard_reports(spark, str(tmp_path), schema, 3, {"games": "games = 250"}).count() == 3
    with pytest.raises(ValueError):
        readers.shard_reports(spark, str(tmp_path), schema, 24)
    with pytest.raises(Exception, match="passed"):
        readers.shard_reports(spark, str(tmp_path), schema, 3, {"passed": "ok"}).collect()
    names = spark.createDataFrame([("g", list("wxyz"))], "log_id string, new_names array<string>")
    got = {(r.log_id, r.type): r.names for r in readers.renamed(frame(spark, {"g": GAME[:2], "h": GAME[:1]}), names).collect()}
    assert got == {("g", "start_game"): list("wxyz"), ("g", "start_kyoku"): None, ("h", "start_game"): list("abcd")}


def test_passes_and_shared_wins(spark):
    deal = start(tehais=[HAND, ["3p", "4p", "9s", "9s", "E"], ["2p", "3p"], ["5p", "5pr", "N"]])
    log = [
        deal,
        {"type": "tsumo", "actor": 0, "pai": "2p"},
        {"type": "dahai", "actor": 0, "pai": "2p", "tsumogiri": True},
        {"type": "tsumo", "actor": 1, "pai": "9s"},
        {"type": "dahai", "actor": 1, "pai": "5p", "tsumogiri": False},
        {"type": "dora", "dora_marker": "1s"},
        {"type": "tsumo", "actor": 2, "pai": "C"},
        {"type": "dahai", "actor": 2, "pai": "N", "tsumogiri": False},
        {"type": "hora", "actor": 1, "target": 2, "deltas": [0, 1000, -1000, 0], "scores": [1, 2, 3, 4]},
        {"type": "hora", "actor": 3, "target": 2, "deltas": [0, 0, -1000, 1000]},
    ]
    rows = R.decisions(frame(spark, {"g": log}), passes=True).orderBy("event_index", "actor").collect()
    assert [(r.event_index, r.actor) for r in rows if r.kind == "none"] == [(2, 1), (4, 3)]  # the seat after may run, others need a pair
    wins = [json.loads(r.state)["scores"] for r in rows if r.kind == "hora"]
    assert wins == [[25000] * 4] * 2
    moves = R.tracked(R.tile_moves(frame(spark, {"g": log})))
    nines = {r.event_index: (r.hand_now, r.seen_now) for r in moves.where("seat = 1 and tile = 26").collect()}
    assert nines == {3: (1, 1)} and moves.where("seat = 3 and tile = 18").first().seen_now == 1
