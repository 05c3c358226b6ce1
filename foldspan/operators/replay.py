"""Event logs: canonical events, replay through a state machine, outcome targets.

Normalising and targets are window expressions.  Only the state machine itself
is a fold: one log is one group, sorted by ``event_index`` inside the function,
as Arrow batches.  Logs are games of bounded length, the unit of order.
"""

from __future__ import annotations

import copy
import json
from collections import Counter
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.functions.actions import keep_red, tile34

#: one wide nullable record for every kind of event
EVENT = (
    "type string, actor int, target int, pai string, pai_raw string, consumed array<string>, tsumogiri boolean, rinshan boolean, skip_hand_update boolean, "
    "names array<string>, seed array<bigint>, bakaze string, kyoku int, honba int, kyotaku int, oya int, scores array<int>, dora_marker string, tehais array<array<string>>, "
    "deltas array<int>, score_delta array<int>, tenpai_players array<int>, ura_markers array<string>, is_rinshan boolean, is_haitei boolean, is_houtei boolean, is_chankan boolean"
)
META = ("reach_accepted", "dora", "new_dora")
DECISIONS = ("dahai", "chi", "pon", "daiminkan", "ankan", "kakan", "reach", "hora", "ryukyoku")


def parse(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed events from NDJSON text in ``line``; unreadable lines get a null type."""
    return lines.withColumn("e", F.from_json(line, EVENT)).select(*[c for c in lines.columns if c != line], "e.*")


def _log(order: str = "event_index"):
    return Window.partitionBy("log_id").orderBy(order)


def is_meta(kind: Column) -> Column:
    return kind.isin(*META)


def normalise(events: DataFrame) -> DataFrame:
    """Canonical tiles, and the acceptance that old logs leave out after a ``kakan``.

    A ``kakan`` that is followed by anything but a win or its acceptance gets a
    ``kakan_accepted`` right after it.  ``event_index`` is renumbered from 0.
    """
    tiles = lambda a: F.transform(a, keep_red)
    unknown = lambda t: F.when(t == "?", t).otherwise(keep_red(t))
    e = events.withColumns({c: keep_red(c) for c in ("pai_raw", "dora_marker")} | {"pai": unknown(F.col("pai"))} | {c: tiles(c) for c in ("consumed", "ura_markers")})
    e = e.withColumn("tehais", F.transform("tehais", lambda h: F.transform(h, unknown)))
    after = F.lead("type").over(_log())
    add = (F.col("type") == "kakan") & after.isNotNull() & ~after.isin("hora", "kakan_accepted")
    e = e.withColumn("copies_", F.when(add, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).withColumn("copy_", F.explode("copies_"))
    e = e.withColumn("type", F.when(F.col("copy_") == 1, "kakan_accepted").otherwise(F.col("type")))
    return e.withColumn("event_index", F.row_number().over(Window.partitionBy("log_id").orderBy("event_index", "copy_")) - 1).drop("copies_", "copy_")


def segments(events: DataFrame) -> DataFrame:
    """``segment``: running count of ``start_kyoku``, from 0 (-1 before the first)."""
    return events.withColumn("segment", F.sum(F.when(F.col("type") == "start_kyoku", 1).otherwise(0)).over(_log()) - 1)


def enrich_wins(events: DataFrame) -> DataFrame:
    """Fills the tile of wins and flags robbed kans and last-tile wins, as of the log.

    Looks back within the segment: the winner's last draw, the last discard, and
    a kan still open to being robbed.
    """
    e = segments(events)
    seg = Window.partitionBy("log_id", "segment").orderBy("event_index").rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("type")
    wall = 70 - F.count(F.when((kind == "tsumo") & (F.col("pai") != "?") & ~F.coalesce("rinshan", F.lit(False)), 1)).over(seg) - F.count(F.when(kind.isin("ankan", "daiminkan", "kakan_accepted"), 1)).over(seg)
    last = lambda cond, value: F.last(F.when(cond, value), ignorenulls=True).over(seg)
    move = kind.isin("tsumo", "dahai", "kakan", "chi", "pon", "daiminkan", "ankan", "kakan_accepted")
    e = e.withColumn("m_", last(move, F.struct("type", "actor", F.coalesce("pai_raw", "pai").alias("pai")))).withColumn("wall_", wall)
    win, own = kind == "hora", F.col("actor") == F.col("target")
    from_draw = win & own & (F.col("m_.type") == "tsumo")
    robbed = win & ~own & (F.col("m_.type") == "kakan") & (F.col("m_.actor") == F.col("target"))
    from_discard = win & ~own & (F.col("m_.type") == "dahai") & (F.col("m_.actor") == F.col("target"))
    return e.withColumns({
        "pai": F.when(win, F.coalesce("pai", F.when(from_draw | robbed | from_discard, F.col("m_.pai")))).otherwise(F.col("pai")),
        "is_chankan": F.when(robbed, True).otherwise(F.col("is_chankan")),
        "is_haitei": F.when(win & own & (F.col("wall_") == 0), True).otherwise(F.col("is_haitei")),
        "is_houtei": F.when(from_discard & (F.col("wall_") == 0), True).otherwise(F.col("is_houtei")),
    }).drop("m_", "wall_")


# ---------------------------------------------------------------- state machine
def _plain(tile: str | None) -> str | None:
    return tile[:-1] if tile and tile.endswith("r") and len(tile) == 3 else tile


class Board:
    """State of one game; ``step`` applies an event by its kind.

    Unknown kinds change nothing.  Taking a tile that is not held falls back to
    its plain or red twin; if there is none the error is counted, not raised.
    """

    handlers: dict[str, Callable] = {}

    def __init__(self) -> None:
        self.round = {"bakaze": "E", "kyoku": 1, "honba": 0, "kyotaku": 0, "oya": 0}
        self.scores, self.doras = [25000] * 4, []
        self.errors = 0
        self._deal([[], [], [], []])
        self.segment = -1

    def _deal(self, hands: Iterable[Iterable[str]]) -> None:
        self.hands = [Counter(t for t in h if t != "?") for h in hands]
        self.rivers: list[list[dict]] = [[], [], [], []]
        self.calls: list[list[dict]] = [[], [], [], []]
        self.reached, self.declared, self.rinshan = [False] * 4, [False] * 4, [False] * 4
        self.drawn: list[str | None] = [None] * 4
        self.wall, self.mover, self.discard, self.kakan, self.replacement = 70, self.round["oya"], None, None, None

    def step(self, e: dict) -> None:
        handler = self.handlers.get(e.get("type"))
        if handler:
            handler(self, e)

    def _take(self, seat: int, tile: str) -> str:
        hand = self.hands[seat]
        for t in (tile, _plain(tile), f"{tile}r"):
            if hand.get(t, 0) > 0:
                hand[t] -= 1
                if not hand[t]:
                    del hand[t]
                return t
        if sum(hand.values()):
            self.errors += 1
        return tile

    def _moved(self, mover: int | None) -> None:
        self.mover, self.discard, self.kakan = mover, None, None

    def _kan(self, seat: int) -> None:
        self.wall, self.replacement = max(0, self.wall - 1), seat

    def snapshot(self, seat: int) -> dict:
        """What is known of the game, with the hand of one seat."""
        return {
            **self.round, "scores": list(self.scores), "dora_markers": list(self.doras), "actor": seat, "hand": sorted(self.hands[seat].elements()), "tsumo_pai": self.drawn[seat],
            "discards": [list(r) for r in self.rivers], "melds": [list(c) for c in self.calls], "reached": list(self.reached), "actor_to_move": self.mover, "last_discard": self.discard, "remaining_wall": self.wall,
        }


def on(*kinds: str):
    def add(f):
        Board.handlers.update(dict.fromkeys(kinds, f))
        return f

    return add


@on("start_kyoku")
def _start(b: Board, e: dict) -> None:
    b.round = {k: e[k] for k in ("bakaze", "kyoku", "honba", "kyotaku", "oya")}
    b.scores, b.doras = list(e["scores"]), [e["dora_marker"]]
    b.segment += 1
    b._deal(e["tehais"])


@on("tsumo")
def _draw(b: Board, e: dict) -> None:
    seat, tile = e["actor"], e["pai"]
    b.rinshan[seat] = bool(e.get("rinshan")) or b.replacement == seat
    if tile != "?":
        b.hands[seat][tile] += 1
        if not b.rinshan[seat]:
            b.wall = max(0, b.wall - 1)
    b.drawn[seat] = None if tile == "?" else tile
    b._moved(seat)
    b.replacement = None


@on("dahai")
def _discard(b: Board, e: dict) -> None:
    seat = e["actor"]
    tile = e["pai"] if e.get("skip_hand_update") else b._take(seat, e["pai"])
    b.rivers[seat].append({"pai": tile, "tsumogiri": bool(e.get("tsumogiri")), "reach_declared": b.declared[seat]})
    if b.declared[seat]:
        b.reached[seat], b.declared[seat] = True, False
    b.drawn[seat], b.rinshan[seat] = None, False
    b._moved((seat + 1) % 4)
    b.discard = {"actor": seat, "pai": tile, "pai_raw": e["pai"]}


@on("chi", "pon", "daiminkan", "ankan")
def _call(b: Board, e: dict) -> None:
    seat, kind, used = e["actor"], e["type"], list(e.get("consumed") or [])
    if not e.get("skip_hand_update"):
        for t in used:
            b._take(seat, t)
    tile = e.get("pai") or (used[0] if used else None)
    b.calls[seat].append({"type": kind, "pai": tile, "pai_raw": e.get("pai_raw") or tile, "consumed": used, "target": seat if kind == "ankan" else e.get("target")})
    b.drawn[seat] = None
    b._moved(seat)
    if kind in ("daiminkan", "ankan"):
        b._kan(seat)


@on("kakan")
def _add(b: Board, e: dict) -> None:
    b.drawn[e["actor"]] = None
    b._moved(e["actor"])
    b.kakan = {"actor": e["actor"], "pai": e["pai"], "pai_raw": e.get("pai_raw") or e["pai"]}


@on("kakan_accepted")
def _added(b: Board, e: dict) -> None:
    seat, tile = e["actor"], e["pai"]
    taken = tile if e.get("skip_hand_update") else b._take(seat, tile)
    for c in b.calls[seat]:
        if c["type"] == "pon" and _plain(c["pai"]) == _plain(tile):
            c |= {"type": "kakan", "consumed": [*c["consumed"], taken]}
            break
    b.drawn[seat] = None
    b._moved(seat)
    b._kan(seat)


@on("reach")
def _declare(b: Board, e: dict) -> None:
    b.declared[e["actor"]] = True


@on("reach_accepted", "hora", "ryukyoku", "end_kyoku", "end_game")
def _settle(b: Board, e: dict) -> None:
    if e.get("scores"):
        b.scores = list(e["scores"])
    if e.get("kyotaku") is not None:
        b.round["kyotaku"] = e["kyotaku"]
    if e["type"] != "reach_accepted":
        b._moved(None)
        b.replacement = None


@on("dora", "new_dora")
def _dora(b: Board, e: dict) -> None:
    b.doras.append(e["dora_marker"])


ROWS = "log_id string, segment int, event_index int, actor int, kind string, pai string, reached boolean, remaining_wall int, hand array<string>, state string, errors int"


def could_call(hand: Counter, tile: str, follows: bool) -> bool:
    """Whether the hand holds what a call of ``tile`` uses: a pair, or a run for the seat that follows.

    A structural test; wins are not judged.
    """
    kind = _plain(tile)
    held = Counter()
    for t, n in hand.items():
        held[_plain(t)] += n
    if held[kind] >= 2:
        return True
    if not follows or len(kind) != 2 or kind[1] not in "mps":
        return False
    at = lambda k: held[f"{int(kind[0]) + k}{kind[1]}"] > 0
    return (at(-2) and at(-1)) or (at(-1) and at(1)) or (at(1) and at(2))


def fold(records: list[dict], passes: bool = False) -> list[tuple]:
    """Decision rows of one ordered log: state as it was before each decision.

    Wins that follow each other on one discard all see the state before the first.
    ``passes`` adds a row of kind ``none`` for each other seat that could have
    called a discard which the next draw passed over.
    """
    board, out, shared = Board(), [], None
    ahead: list[str | None] = [None] * len(records)
    after = None
    for i in range(len(records) - 1, -1, -1):  # the next event that is not a mere announcement
        ahead[i] = after
        if records[i].get("type") not in META:
            after = records[i].get("type")

    def row(e: dict, seat: int, kind: str, b: Board) -> tuple:
        s = b.snapshot(seat)
        return e["log_id"], b.segment, e["event_index"], seat, kind, e.get("pai"), b.reached[seat], b.wall, s["hand"], json.dumps(s, sort_keys=True, separators=(",", ":")), b.errors

    for i, e in enumerate(records):
        seat, kind = e.get("actor"), e.get("type")
        if kind == "hora" and shared is None and ahead[i] == "hora":
            shared = copy.deepcopy(board)
        if kind in DECISIONS and seat in (0, 1, 2, 3) and board.segment >= 0 and not (kind == "dahai" and board.reached[seat]):
            out.append(row(e, seat, kind, shared or board if kind == "hora" else board))
        board.step(e)
        if passes and kind == "dahai" and ahead[i] == "tsumo" and board.segment >= 0:
            for k in (1, 2, 3):
                other = (seat + k) % 4
                if not board.reached[other] and could_call(board.hands[other], e["pai"], k == 1):
                    out.append(row(e, other, "none", board))
        if kind != "hora" or ahead[i] != "hora":
            shared = None
    return out


def _value(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, list):
        return [_value(x) for x in v]
    return None if isinstance(v, float) and v != v else int(v) if isinstance(v, float) and v == int(v) else v


def decisions(events: DataFrame, passes: bool = False) -> DataFrame:
    """Replays every log and gives one row per decision of a seat, with ``passes`` also per call passed over.

    Forced discards after a declaration are no decisions.  A log whose replay
    breaks gives one row with a null kind and ``errors`` -1 and the reason in
    ``state``; other logs are not affected.
    """

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names = [f.strip().split()[0] for f in ROWS.split(",")]
        pdf = pdf.sort_values("event_index")
        records = [{k: _value(v) for k, v in r.items()} for r in pdf.to_dict("records")]
        try:
            rows = fold(records, passes)
        except (KeyError, TypeError, IndexError, ValueError) as x:
            rows = [(key[0], None, None, None, None, None, None, None, None, f"{type(x).__name__}: {x}", -1)]
        return pd.DataFrame(rows, columns=names).astype({"segment": "Int32", "event_index": "Int32", "actor": "Int32", "remaining_wall": "Int32"})

    return events.where("log_id is not null").groupBy("log_id").applyInPandas(run, ROWS)


def targets(rows: DataFrame, events: DataFrame, gamma: float = 0.99, unit: float = 30000.0) -> DataFrame:
    """Adds outcome targets to decision rows.

    The segment's last win (else its draw) settles it; without one the targets
    are 0.  ``value_target`` is the own score change over ``unit``, discounted by
    the decisions still to come in the segment.
    """
    e = segments(events).where(F.col("type").isin("hora", "ryukyoku"))
    end = e.groupBy("log_id", "segment").agg(F.max_by(F.struct("type", F.col("actor").alias("winner"), F.col("target").alias("loser"), F.coalesce("deltas", "score_delta").alias("deltas"), "tenpai_players"), F.struct((F.col("type") == "hora").cast("int").alias("h"), "event_index")).alias("t"))
    w = Window.partitionBy("log_id", "segment")
    left = F.count("*").over(w) - F.row_number().over(w.orderBy("event_index", "actor"))
    r = rows.withColumn("left_", left).join(end, ["log_id", "segment"], "left")
    delta = F.coalesce(F.get("t.deltas", F.col("actor")) / F.lit(unit), F.lit(0.0))
    won = F.coalesce((F.col("t.type") == "hora") & (F.col("t.winner") == F.col("actor")), F.lit(False))
    lost = F.coalesce((F.col("t.type") == "hora") & (F.col("t.loser") == F.col("actor")) & (F.col("t.winner") != F.col("actor")), F.lit(False))
    ready = F.coalesce((F.col("t.type") == "ryukyoku") & F.array_contains("t.tenpai_players", F.col("actor")), F.lit(False))
    return r.select(
        *rows.columns, (delta * F.pow(F.lit(gamma), F.col("left_").cast("double"))).alias("value_target"), delta.alias("score_delta_target"), won.cast("double").alias("win_target"), lost.cast("double").alias("dealin_target"),
        F.when(won, F.greatest(delta, F.lit(0.0))).otherwise(0.0).alias("pts_given_win_target"), F.when(lost, F.greatest(-delta, F.lit(0.0))).otherwise(0.0).alias("pts_given_dealin_target"), ready.cast("double").alias("ryukyoku_tenpai_target"),
    )


def final_standing(events: DataFrame, stick: int = 1000) -> DataFrame:
    """``log_id, seat, final_score, rank``: end of the last segment, ties by first dealer.

    Start scores, less a stick per accepted declaration, plus every win and draw;
    explicit ``scores`` after the last settlement are not needed.
    """
    e = segments(events).where("segment >= 0")
    seats = e.select("log_id", "segment", "event_index", "type", "oya", F.posexplode(F.when(F.col("type") == "start_kyoku", F.col("scores")).when(F.col("type").isin("hora", "ryukyoku"), F.coalesce("deltas", "score_delta")).when(F.col("type") == "reach_accepted", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda s: F.when(s == F.col("actor"), -stick).otherwise(0)))).alias("seat", "d"))
    per = seats.groupBy("log_id", "segment", "seat").agg(F.sum("d").alias("score"))
    last = per.groupBy("log_id", "seat").agg(F.max_by("score", "segment").alias("final_score"))
    dealer = e.where("type = 'start_kyoku'").groupBy("log_id").agg(F.min_by("oya", "event_index").alias("first_dealer"))
    rank = F.row_number().over(Window.partitionBy("log_id").orderBy(F.desc("final_score"), F.pmod(F.col("seat") - F.col("first_dealer"), F.lit(4))))
    return last.join(dealer, "log_id").select("log_id", "seat", "final_score", (rank - 1).alias("rank"))


def tile_moves(events: DataFrame) -> DataFrame:
    """``log_id, event_index, seat, tile, hand, meld, seen``: what each event adds to a seat's counts per tile.

    Draws add to the own hand and to what the seat has seen; discards leave the
    hand and are seen by all; tiles of calls leave the hand for the meld and are
    seen by all, the called tile too; dora markers are seen by all.
    """
    k, who = F.col("type"), F.col("actor")
    used = F.coalesce("consumed", F.array().cast("array<string>"))
    call, open_ = k.isin("chi", "pon", "daiminkan", "ankan"), k.isin("chi", "pon", "daiminkan")
    part = lambda tiles, hand, meld, all_: F.transform(tiles, lambda t: F.struct(t.alias("t"), F.lit(hand).alias("hand"), F.lit(meld).alias("meld"), F.lit(all_).alias("all_")))
    one = lambda c: F.array(c)
    none = F.array().cast("array<struct<t:string,hand:int,meld:int,all_:boolean>>")
    moves = F.concat(
        F.when(k == "tsumo", part(one(F.col("pai")), 1, 0, False)).otherwise(none),
        F.when(k == "dahai", part(one(F.col("pai")), -1, 0, True)).otherwise(none),
        F.when(call, part(used, -1, 1, True)).otherwise(none),
        F.when(open_ & F.col("pai").isNotNull(), part(one(F.col("pai")), 0, 1, True)).otherwise(none),
        F.when(k == "kakan_accepted", part(one(F.col("pai")), -1, 1, True)).otherwise(none),
        F.when(k.isin("dora", "new_dora"), part(one(F.col("dora_marker")), 0, 0, True)).otherwise(none),
    )
    rows = events.where(~k.isin("tsumo", "dahai", "chi", "pon", "daiminkan", "ankan", "kakan_accepted") | who.between(0, 3)).select("log_id", "event_index", "actor", F.explode(moves).alias("m"))
    each = rows.select("log_id", "event_index", "actor", tile34("m.t").alias("tile"), "m.hand", "m.meld", "m.all_", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("seat")).where("tile >= 0")
    own = F.coalesce(F.col("actor") == F.col("seat"), F.lit(False))
    return each.where(own | F.col("all_")).select("log_id", "event_index", "seat", "tile", F.when(own, F.col("hand")).otherwise(0).alias("hand"), F.when(own, F.col("meld")).otherwise(0).alias("meld"), F.lit(1).alias("seen"))


def tracked(moves: DataFrame) -> DataFrame:
    """``moves`` with running ``hand_now, meld_now, seen_now`` of the seat and tile after each event."""
    w = Window.partitionBy("log_id", "seat", "tile").orderBy("event_index").rangeBetween(Window.unboundedPreceding, 0)
    return moves.withColumns({f"{c}_now": F.sum(c).over(w) for c in ("hand", "meld", "seen")})
