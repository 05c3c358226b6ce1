"""Shredding of nested records against a plain walk over JSON."""

import json

from foldspan.operators import nested as N

STATES = "state_id bigint, log_id string, loaded_at timestamp, payload string, label string, seat int, v string"
SNAPS = "snapshot_id bigint, loaded_at timestamp, discards array<array<struct<pai:string,tsumogiri:boolean,reach_declared:boolean>>>, melds array<array<struct<type:string,pai:string,pai_raw:string,consumed:array<string>,target:int>>>, rec string, ord int"


def ts(h):
    import datetime

    return datetime.datetime(2025, 1, 1, h)


def shapes():
    d = lambda *p: [{"pai": x} if x else None for x in p]
    meld = {"type": "pon", "pai": "E", "consumed": ["E", "E"], "target": 1}
    return [
        (1, {"players": [{"discards": d("1m", None, "2m"), "melds": []}, None, {"discards": "3p 4p 0p", "melds": meld}, {"discards": None}]}),
        (2, {"state": {"players": {"0": {"discards": ["E", None]}, "2": {"seat": 3, "melds": {"0": None, "1": meld}}}}, "v": 2}),
        (3, {"data": {"state": {"players": [{"seat": 2, "discards": json.dumps(d("1m", None, "5s"))}, {"seat": 9, "melds": json.dumps([None, meld])}]}}}),
        (4, {"players": {}}),
        (5, {"players": [{"discards": {}, "melds": ""}]}),
        (6, {"players": [{"discards": {str(i): {"pai": "1m"} for i in (10, 2, 0)}}]}),
    ]


def test_shapes_and_deliveries(spark):
    rows = [(i, "g", ts(1), json.dumps(p), "x", 7, "y") for i, p in shapes()]
    rows += [(1, "g", ts(3), '{"players": [{"disc', "x", 7, "y"), (1, "g", ts(0), '{"players": [{"discards": ["1m"]}]}', None, None, None)]
    rows += [(7, None, None, None, None, None, None), (8, None, ts(1), "[1,2]", None, None, None), (None, None, ts(1), '{"players": []}', None, None, None)]
    empty = spark.createDataFrame([], SNAPS)
    got = {tuple(r) for r in N.held_items(spark.createDataFrame(rows, STATES), empty).collect()}
    assert got == {
        ("state", 1, 0, "discard", 0), ("state", 1, 0, "discard", 2), ("state", 1, 2, "discard", 0), ("state", 1, 2, "discard", 1), ("state", 1, 2, "discard", 2), ("state", 1, 2, "meld", 0),
        ("state", 2, 0, "discard", 0), ("state", 2, 3, "meld", 1), ("state", 3, 2, "discard", 0), ("state", 3, 2, "discard", 2), ("state", 3, 1, "meld", 1),
        *[("state", 6, 0, "discard", i) for i in (0, 2, 10)],
    }


def test_snapshots_links_and_empty(spark):
    dis = [[("1m", True, None), None], None, [("2m", None, None)]]
    rows = [(1, ts(1), dis, None, "r", 1), (1, ts(0), None, [[("chi", "1m", None, None, 3)]], None, None), (2, None, None, [None, [None, ("pon", "E", "E", ["E", None], 0)]], None, None), (3, ts(1), [], [], None, None)]
    snaps = spark.createDataFrame(rows, SNAPS)
    states = spark.createDataFrame([], STATES)
    assert {tuple(r) for r in N.held_items(states, snaps).collect()} == {("snapshot", 1, 0, "discard", 0), ("snapshot", 1, 2, "discard", 0), ("snapshot", 2, 1, "meld", 1)}
    t = N.tables(N.snapshot_nodes(snaps))
    assert t["records"].count() == 3 and t["seats"].count() == 12
    assert t["discards"].join(t["seats"].withColumnRenamed("label", "seat_label"), "seat_label", "left_anti").count() == 0
    assert t["seats"].join(t["records"].withColumnRenamed("label", "record_label"), "record_label", "left_anti").count() == 0
    m = t["melds"].collect()
    assert [(r.type, r.pai, r.consumed, r.target) for r in m] == [("pon", "E", ["E", None], 0)]
    assert N.held_items(states, spark.createDataFrame([], SNAPS)).count() == 0


def test_repeated_rows_count_once(spark):
    row = (1, "g", ts(1), json.dumps(shapes()[0][1]), None, None, None)
    one = N.held_items(spark.createDataFrame([row], STATES), spark.createDataFrame([], SNAPS)).count()
    assert N.held_items(spark.createDataFrame([row] * 5, STATES), spark.createDataFrame([], SNAPS)).count() == one == 6


def test_any_depth_and_labels(spark):
    payload = {"scores": [1, None, 3], "last_discard": {"actor": 2}, "extra": [{"deep": [{"er": [7, 8]}]}], "players": [None, {"seat": 3, "hand": {"1m": 2}, "melds": [{"meld": {"type": "pon", "consumed": ["E", None, "E"]}, "src": "x"}]}]}
    wrapped = {"payload": json.dumps({"data": {"state": {"data": payload}}})}
    nodes = N.state_nodes(spark.createDataFrame([(1, "g", ts(1), json.dumps(wrapped), None, None, None)], STATES))
    got = {(r.label, r.schema_path, r.o): dict(r.fields) for r in nodes.withColumn("o", N.owner(nodes)).collect()}
    assert set(got) == {
        ("1", "record", None), ("1.1", "players", "1"), ("1.1.1.0", "players.melds", "1.1"), ("1.1.1.0.0.0", "players.melds.consumed", "1.1.1.0"), ("1.1.1.0.0.2", "players.melds.consumed", "1.1.1.0"),
        ("1.1.2", "players.hand", "1.1"), ("1.5.0", "scores", "1"), ("1.5.2", "scores", "1"), ("1.8", "last_discard", "1"),
        ("1.12.0", "extra", "1"), ("1.12.0.0.0", "extra.deep", "1.12.0"), ("1.12.0.0.0.0.0", "extra.deep.er", "1.12.0.0.0"), ("1.12.0.0.0.0.1", "extra.deep.er", "1.12.0.0.0"),
    }
    assert got["1.1.1.0", "players.melds", "1.1"] == {"type": "pon", "src": "x", "consumed": '["E", null, "E"]'}
    assert got["1.1.2", "players.hand", "1.1"] == {"1m": "2"} and got["1.8", "last_discard", "1"] == {"actor": "2"}


def test_left_out(spark):
    rows = [(1, "g", ts(1), json.dumps({"players": [{}] * 6 + [None]}), None, None, None), (None, None, None, None, None, None, None), (2, None, None, "{", None, None, None), (None, None, None, "{}", None, None, None)]
    got = {r.reason: r.n for r in N.left_out(spark.createDataFrame(rows, STATES)).collect()}
    assert got == {"null payload": 1, "unreadable payload": 1, "player beyond the seats": 2}
    assert N.left_out(spark.createDataFrame([], STATES)).where("n <> 0").count() == 0
