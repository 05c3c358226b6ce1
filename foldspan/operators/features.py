"""Feature planes and scalars of snapshots, encoded in whole Arrow batches.

A snapshot becomes 57 planes over 34 tiles and 56 scalars.  Facts are gathered
as (row, plane, tile) triples over the batch and scattered at once; distances of
all hands of a batch come from one kernel call.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from foldspan.functions.actions import HONOURS, SUITS
from foldspan.operators import kernels

PLANES, TILES, SCALARS = 57, 34, 56
# fixed values: first plane of each kind
HAND, OWN_CALLS, OTHERS_RIVER, OTHERS_CALLS, OWN_RIVER, DORA, WAITS, RIVER_PARTS, DRAWN, SAFE, DRAWS, SEEN = 0, 4, 8, 14, 17, 18, 19, 20, 52, 53, 54, 56
WINDS = HONOURS[:4]
_INDEX = {f"{n}{s}": 9 * k + n - 1 for k, s in enumerate(SUITS) for n in range(1, 10)} | {h: 27 + i for i, h in enumerate(HONOURS)} | {f"5{s}r": 9 * k + 4 for k, s in enumerate(SUITS)}
_NEXT = np.array([t // 9 * 9 + (t + 1) % 9 if t < 27 else 27 + (t - 26) % 4 if t < 31 else 31 + (t - 30) % 3 for t in range(34)])
OUT = "planes array<float>, scalars array<float>"


def _tile(t) -> int:
    return _INDEX.get(t, -1) if t else -1


def _seat(lists, seat: int) -> list:
    got = lists[seat] if lists is not None and seat < len(lists) else None
    return [x for x in got or [] if x]


def encode_rows(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Planes ``[n, 57, 34]`` and scalars ``[n, 56]`` of snapshot records."""
    n = len(rows)
    planes, x = np.zeros((n, PLANES, TILES), np.float32), np.zeros((n, SCALARS), np.float32)
    marks: list[tuple[int, int, int]] = []
    hand, called, seen = (np.zeros((n, TILES), np.int64) for _ in range(3))
    red = np.zeros((n, 3), np.int64)
    doras: list[tuple[int, int]] = []
    river_n, calls_n, own_calls = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
    for r, s in enumerate(rows):
        me = s["actor"] if s["actor"] is not None else 0
        others = [p for p in range(4) if p != me]
        for t in s["hand"] or []:
            if (i := _tile(t)) >= 0:
                hand[r, i] += 1
                if t.endswith("r"):
                    red[r, SUITS.index(t[1])] += 1
        rivers = {p: [(i, d) for d in _seat(s["discards"], p) if (i := _tile(d["pai"])) >= 0] for p in range(4)}
        declared = max(((turn, p) for p in others for turn, (_, d) in enumerate(rivers[p]) if d["reach_declared"]), key=lambda c: (c[0], -c[1]), default=None)
        for p in range(4):
            slot = others.index(p) if p != me else 3
            river_n[r] += len(rivers[p])
            for turn, (i, d) in enumerate(rivers[p]):
                seen[r, i] += 1
                marks.append((r, RIVER_PARTS + 8 * slot + min(turn // 3, 7), i))
                if p == me:
                    marks.append((r, OWN_RIVER, i))
                else:
                    marks += [(r, OTHERS_RIVER + 2 * slot + k, i) for k, on in enumerate((d["reach_declared"], not d["tsumogiri"])) if on]
                if declared and p != declared[1]:
                    marks.append((r, SAFE, i))
            melds = _seat(s["melds"], p)
            if p == me:
                own_calls[r] = len(melds)
            else:
                x[r, 21 + slot] = len(melds) / 4
                calls_n[r] += sum(1 if m["type"] in ("daiminkan", "ankan", "kakan") else -1 if m["type"] in ("chi", "pon") else 0 for m in melds)
            for k, m in enumerate(melds):
                parts = [t for t in [*(m["consumed"] or []), m["pai"] if m["type"] != "ankan" else None] if _tile(t) >= 0]
                for t in parts:
                    seen[r, _tile(t)] += 1
                    if p == me:
                        called[r, _tile(t)] += 1
                        if t.endswith("r"):
                            red[r, SUITS.index(t[1])] += 1
                    if p != me or k < 4:
                        marks.append((r, OTHERS_CALLS + slot if p != me else OWN_CALLS + k, _tile(t)))
        for t in s["dora_markers"] or []:
            if (i := _tile(t)) >= 0:
                doras.append((r, int(_NEXT[i])))
                seen[r, i] += 1
        if (i := _tile(s["tsumo_pai"])) >= 0:
            marks.append((r, DRAWN, i))
    if marks:
        planes[tuple(np.array(marks).T)] = 1
    if doras:
        np.add.at(planes[:, DORA], tuple(np.array(doras).T), 1)
    for k in range(4):
        planes[:, HAND + k] = hand > k
    visible = np.minimum(4, seen + hand)
    planes[:, SEEN] = visible / 4
    judged = (hand.sum(1) >= 1) & (hand.sum(1) <= 14) & (hand.max(1, initial=0) <= 4)
    far, waits, live = np.full(n, 8), np.zeros((n, TILES), bool), np.zeros(n)
    if judged.any():
        far[judged], waits[judged], live[judged] = kernels.improving(hand[judged], visible[judged])
    ready = far == 0
    planes[:, WAITS][ready] = waits[ready]
    planes[:, DRAWS][~ready] = waits[~ready]

    all_ = hand + called
    total = np.maximum(1, all_.sum(1))
    suits = np.stack([all_[:, a:b].sum(1) for a, b in ((0, 9), (9, 18), (18, 27), (27, 34))], 1)
    held = all_.sum(1) > 0
    ends = all_[:, kernels.ENDS].sum(1)
    closed, one_suit = own_calls == 0, ((suits[:, :3] > 0).sum(1) == 1) & held
    no_honour = suits[:, 3] == 0
    simple = (ends == 0) & held
    dora_n = (all_ * planes[:, DORA]).sum(1) + red.sum(1)
    get = lambda k, default: np.array([default if r[k] is None else r[k] for r in rows])
    seat, oya, kyoku, wind = get("actor", 0), get("oya", 0), get("kyoku", 1), get("bakaze", "E")
    scores = np.array([(list(r["scores"] or []) + [25000] * 4)[:4] for r in rows], float)
    mine = scores[np.arange(n), seat] if n else np.zeros(0)
    reached = np.array([([bool(v) for v in r["reached"] or []] + [False] * 4)[:4] for r in rows], bool).reshape(n, 4)
    furiten = np.array([([bool(v) for v in r["furiten"] or []] + [False] * 4)[:4] for r in rows], bool).reshape(n, 4)
    own = (seat - oya) % 4
    triple = (hand[:, 27:] >= 3) | (called[:, 27:] >= 3)
    at = np.arange(n)
    round_wind = np.array([WINDS.index(w) if w in WINDS else 0 for w in wind], int)
    sure = triple[at, round_wind].astype(int) + (triple[at, own] & (own != round_wind)) + triple[:, 4:].sum(1) + simple + np.where(one_suit, np.where(no_honour, 6, 3) - (~closed), 0) + dora_n
    waits_n = (waits & ready[:, None]).sum(1)
    live_waits = np.where(ready, live, 0)
    for k, w in enumerate("ESW"):
        x[:, k] = wind == w
    x[:, 3], x[:, 4], x[:, 5], x[:, 6], x[:, 7] = kyoku / 4, get("honba", 0) / 8, get("kyotaku", 0) / 8, mine / 50000, (scores > mine[:, None]).sum(1) / 3
    x[:, 8], x[:, 9], x[:, 10], x[:, 11] = far / 8, waits_n / 34, np.array([len(_seat(r["discards"], p)) for r, p in zip(rows, seat)]) / 18, own_calls / 4
    for r in range(n):
        others = [p for p in range(4) if p != seat[r]]
        x[r, 12:16] = reached[r, [seat[r], *others]]
        x[r, 24:27] = (scores[r, others] - mine[r]) / 30000
    x[:, 16], x[:, 17], x[:, 18:21] = red.sum(1) / 4, simple, red > 0
    x[:, 27], x[:, 28], x[:, 29] = own / 3, np.minimum(dora_n / 10, 1), np.minimum(sure / 8, 1)
    x[:, 30:34] = suits / total[:, None]
    number_ends = all_[:, [0, 8, 9, 17, 18, 26]].sum(1)
    x[:, 34], x[:, 35], x[:, 36], x[:, 37] = closed & no_honour & held & (3 * number_ends >= total), held & (3 * ends >= total), one_suit, one_suit & no_honour
    x[:, 38], x[:, 40] = np.minimum(np.where(ready, 0, live) / 34, 1), np.minimum(live_waits / 136, 1)
    number = hand[:, :27].reshape(n, 3, 9) > 0
    x[:, 41], x[:, 42], x[:, 43] = (hand >= 2).sum(1) / 7, ((number[:, :, :-1] & number[:, :, 1:]).sum((1, 2)) + (number[:, :, :-2] & number[:, :, 2:]).sum((1, 2))) / 6, (hand >= 3).sum(1) / 4
    x[:, 44] = furiten[at, seat] if n else 0
    x[:, 45] = (reached.sum(1) - reached[at, seat]) / 3 if n else 0
    x[:, 46], x[:, 47] = np.where(closed, kernels.seven_pairs(hand), 6) / 6, np.where(closed, kernels.orphans(hand), 13) / 13
    x[:, 48], x[:, 49] = seat == oya, np.isin(wind, ["W", "N"]) | ((wind == "S") & (kyoku >= 4))
    x[:, 50], x[:, 51] = np.maximum(0, scores.max(1, initial=0) - mine) / 30000, np.maximum(0, mine - scores.min(1, initial=1e9)) / 30000
    drawn = np.array([_tile(r["tsumo_pai"]) >= 0 for r in rows], float)
    x[:, 52] = np.maximum(0, 70 - (river_n + calls_n + drawn)) / 70
    x[:, 55] = np.clip(np.where(waits_n > 0, live_waits / np.maximum(4 * waits_n, 1), 0), 0, 1)
    return planes, x


FIELDS = ("actor", "hand", "tsumo_pai", "discards", "melds", "dora_markers", "bakaze", "kyoku", "honba", "kyotaku", "oya", "scores", "reached", "furiten")


def encode(snapshots: DataFrame, ident: str = "snapshot_id") -> DataFrame:
    """``ident, planes, scalars``: row-major planes and scalars of each snapshot.

    Nulls at any level count as absent; hands that no draw can belong to (empty,
    more than 14 tiles or than four of a kind) have no distance.
    """
    key = snapshots.schema[ident].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                cols = [c.to_pylist() for c in part.columns[1:]]
                planes, x = encode_rows([dict(zip(FIELDS, v)) for v in zip(*cols)])
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * v[0].size, pa.int32()), pa.array(v.ravel())) for v in (planes, x)]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=[ident, "planes", "scalars"])

    return snapshots.select(ident, *FIELDS).mapInArrow(run, f"`{ident}` {key}, {OUT}")
