"""Combinatorial distance of count vectors: how far a hand is from complete.

A hand is a vector of 34 counts: three suits of nine ranks and seven honours.
It is complete with m groups (three of a kind, or three consecutive ranks of one
suit) and a pair.  The least number of missing tiles of a suit, by groups and
pair, comes from a walk over its ranks; suits are combined by a small min-plus
product.  Whole Arrow batches are evaluated together, repeated suits only once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

FAR = 99
ENDS = np.array([0, 8, 9, 17, 18, 26, 27, 28, 29, 30, 31, 32, 33])


def _suit_costs(counts: np.ndarray, runs: bool) -> np.ndarray:
    """``[row, groups, pair]``: tiles missing for each shape of one suit.

    Walks the ranks once; a state is how many runs began one and two ranks
    before, and carries the least cost by groups and pair for all rows together.
    No tile is wanted more than four times.
    """
    unique, back = np.unique(counts, axis=0, return_inverse=True)
    n, width = unique.shape
    start = np.full((n, 5, 2), FAR, np.int16)
    start[:, 0, 0] = 0
    states = {(0, 0): start}
    for i in range(width):
        after: dict[tuple[int, int], np.ndarray] = {}
        for (one, two), cost in states.items():
            for new in range(5 - one - two if runs and i <= width - 3 else 1):
                for triple in (0, 1):
                    for pair in (0, 1):
                        want = new + one + two + 3 * triple + 2 * pair
                        groups = new + triple
                        if want > 4 or groups > 4:
                            continue
                        missing = np.maximum(0, want - unique[:, i]).astype(np.int16)[:, None, None]
                        best = after.setdefault((new, one), np.full((n, 5, 2), FAR, np.int16))
                        part = best[:, groups:, pair:]
                        np.minimum(part, cost[:, : 5 - groups, : 2 - pair] + missing, out=part)
        states = after
    return states[0, 0][back.ravel()]


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.full(a.shape, FAR, np.int16)
    for m in range(5):
        for i in range(m + 1):
            for p in (0, 1):
                for q in range(p + 1):
                    out[:, m, p] = np.minimum(out[:, m, p], a[:, i, q] + b[:, m - i, p - q])
    return out


def regular(hands: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """Distance to ``groups`` groups and a pair; -1 is complete."""
    parts = [_suit_costs(hands[:, i : i + 9], True) for i in (0, 9, 18)] + [_suit_costs(hands[:, 27:], False)]
    total = parts[0]
    for p in parts[1:]:
        total = _join(total, p)
    return total[np.arange(len(hands)), groups, 1].astype(int) - 1


def seven_pairs(hands: np.ndarray) -> np.ndarray:
    pairs, kinds = (hands >= 2).sum(1), (hands >= 1).sum(1)
    return 6 - pairs + np.maximum(0, 7 - kinds)


def orphans(hands: np.ndarray) -> np.ndarray:
    ends = hands[:, ENDS]
    return 13 - (ends >= 1).sum(1) - (ends >= 2).any(1)


def distance(hands: np.ndarray) -> np.ndarray:
    """Least of the three forms; the special ones need a hand without calls."""
    hands = np.asarray(hands, np.int64).reshape(-1, 34)
    size = hands.sum(1)
    out = regular(hands, np.minimum(4, size // 3))
    closed = (size // 3 >= 4) & (out > 0)
    return np.where(closed, np.minimum(out, np.minimum(seven_pairs(hands), orphans(hands))), out)


def improving(hands: np.ndarray, visible: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(distance, kinds, live)``: tiles whose draw brings a hand closer.

    ``kinds`` marks them per tile; ``live`` counts copies not yet seen.
    """
    hands = np.asarray(hands, np.int64).reshape(-1, 34)
    base = distance(hands)
    kinds = np.zeros(hands.shape, bool)
    seen = hands if visible is None else np.maximum(hands, visible)
    for t in range(34):
        can = hands[:, t] < 4
        if can.any():
            drawn = hands[can].copy()
            drawn[:, t] += 1
            kinds[can, t] = distance(drawn) < base[can]
    return base, kinds, (kinds * np.maximum(0, 4 - seen)).sum(1)


def best_discards(hand: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """For a hand with one tile too many: distance and live draws after each discard."""
    hand = np.asarray(hand, np.int64)
    tiles = np.flatnonzero(hand)
    after = np.repeat(hand[None], len(tiles), 0)
    after[np.arange(len(tiles)), tiles] -= 1
    d, _, live = improving(after, np.repeat(hand[None], len(tiles), 0))
    return int(d.min()), tiles, np.where(d == d.min(), live, 0)


_PROGRESS = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("kinds", T.IntegerType()), T.StructField("live", T.IntegerType())])


@F.pandas_udf(_PROGRESS)
def progress(counts: pd.Series) -> pd.DataFrame:
    """``distance, kinds, live`` of 34-count hands.

    Null or misshapen hands give nulls.  Hands with one tile too many are judged
    after their best discard.
    """
    ok = counts.map(lambda c: c is not None and len(c) == 34 and min(c) >= 0 and max(c) <= 4 and 1 <= sum(c) <= 14)
    out = pd.DataFrame({"distance": pd.array([None] * len(counts), "Int32"), "kinds": pd.array([None] * len(counts), "Int32"), "live": pd.array([None] * len(counts), "Int32")})
    rows = np.flatnonzero(ok)
    if not len(rows):
        return out
    hands, back = np.unique(np.array([list(counts.iloc[i]) for i in rows]), axis=0, return_inverse=True)
    d, k, live = distance(hands), np.zeros(len(hands), int), np.zeros(len(hands), int)
    waiting = hands.sum(1) % 3 != 2
    if waiting.any():
        d[waiting], kinds, live[waiting] = improving(hands[waiting])
        k[waiting] = kinds.sum(1)
    open_ = np.flatnonzero(~waiting & (d >= 0))
    if len(open_):  # every discard of every such hand is judged in one call
        own, tile = np.nonzero(hands[open_])
        after = hands[open_][own]
        after[np.arange(len(own)), tile] -= 1
        far, kinds, draws = improving(after, hands[open_][own])
        least = np.minimum.reduceat(far, np.searchsorted(own, np.arange(len(open_))))
        draws = np.where(far == least[own], draws, 0)
        best = np.lexsort((tile, -draws, own))[np.searchsorted(own, np.arange(len(open_)))]
        k[open_], live[open_] = kinds[best].sum(1), draws[best]
    for name, v in (("distance", d), ("kinds", k), ("live", live)):
        out.loc[rows, name] = v[back.ravel()]
    return out


_DELTA = T.ArrayType(T.StructType([T.StructField("tile", T.IntegerType()), T.StructField("distance", T.IntegerType()), T.StructField("delta", T.IntegerType()), T.StructField("live", T.IntegerType())]))


def _valid(c) -> bool:
    return c is not None and len(c) == 34 and min(c) >= 0 and max(c) <= 4 and 1 <= sum(c) <= 14


def _deltas(counts: pd.Series, step: int) -> pd.Series:
    rows = [i for i, c in enumerate(counts) if _valid(c)]
    out: list = [None] * len(counts)
    if rows:
        hands = np.array([list(counts.iloc[i]) for i in rows])
        base = distance(hands)
        owner, tile = np.nonzero(hands < 4 if step > 0 else hands > 0)
        moved = hands[owner]
        moved[np.arange(len(owner)), tile] += step
        after = distance(moved) if len(owner) else base[:0]
        live = 4 - hands[owner, tile]
        edges = np.searchsorted(owner, np.arange(len(rows) + 1))  # owners stand in order
        for k, i in enumerate(rows):
            mine = slice(edges[k], edges[k + 1])
            out[i] = [{"tile": int(t), "distance": int(d), "delta": int(d - base[k]), "live": int(n)} for t, d, n in zip(tile[mine], after[mine], live[mine])]
    return pd.Series(out)


@F.pandas_udf(_DELTA)
def draw_deltas(counts: pd.Series) -> pd.Series:
    """What each possible draw does: ``tile, distance, delta, live`` of a hand to draw."""
    return _deltas(counts, 1)


@F.pandas_udf(_DELTA)
def discard_deltas(counts: pd.Series) -> pd.Series:
    """What each possible discard does; null or misshapen hands give null."""
    return _deltas(counts, -1)


_WAITS = T.StructType([T.StructField("distance", T.IntegerType()), T.StructField("waits", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_WAITS)
def special_waits(counts: pd.Series) -> pd.DataFrame:
    """``distance, waits`` of seven pairs and thirteen orphans alone: tiles that complete a hand one away.

    Hands of the other forms have no waits; null or misshapen hands give nulls.
    """
    rows = [i for i, c in enumerate(counts) if _valid(c)]
    far, waits = pd.array([None] * len(counts), "Int32"), [None] * len(counts)
    if rows:
        hands = np.array([list(counts.iloc[i]) for i in rows])
        pairs, ends = seven_pairs(hands), orphans(hands)
        own, tile = np.nonzero(hands < 4)
        drawn = hands[own]
        drawn[np.arange(len(own)), tile] += 1
        hit = ((pairs[own] == 0) & (seven_pairs(drawn) == -1)) | ((ends[own] == 0) & (orphans(drawn) == -1))
        edges = np.searchsorted(own, np.arange(len(rows) + 1))
        for k, i in enumerate(rows):
            part = slice(edges[k], edges[k + 1])
            far[i], waits[i] = int(min(pairs[k], ends[k])), [int(t) for t in tile[part][hit[part]]]
    return pd.DataFrame({"distance": far, "waits": waits})


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def good_draws(counts: pd.Series) -> pd.Series:
    """Of a hand two draws from complete, the draws after which some discard waits on more than four live tiles."""
    rows = [i for i, c in enumerate(counts) if _valid(c) and sum(c) % 3 == 1]
    out: list = [None] * len(counts)
    if rows:
        hands = np.array([list(counts.iloc[i]) for i in rows])
        base, kinds, _ = improving(hands)
        own, tile = np.nonzero(kinds & (base == 1)[:, None])
        drawn = hands[own]
        drawn[np.arange(len(own)), tile] += 1
        d_own, d_tile = np.nonzero(drawn)
        after = drawn[d_own]
        after[np.arange(len(d_own)), d_tile] -= 1
        far, _, live = improving(after, drawn[d_own]) if len(after) else (np.empty(0), None, np.empty(0))
        good = np.zeros(len(own), bool)
        np.logical_or.at(good, d_own, (far == 0) & (live > 4))
        edges = np.searchsorted(own, np.arange(len(rows) + 1))
        for k, i in enumerate(rows):
            part = slice(edges[k], edges[k + 1])
            out[i] = [int(t) for t in tile[part][good[part]]]
    return pd.Series(out)


def tile_ids(counts):
    """Distinct ids 0..135 of a 34-count vector: four per tile, the first ones taken."""
    c = F.col(counts) if isinstance(counts, str) else counts
    ids = F.transform(c, lambda n, i: F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda k: (i * 4 + k - 1).cast("int"))).otherwise(F.array().cast("array<int>")))
    return F.flatten(ids)


def expected_rank(probs):
    """Mean rank 1..4 of four probabilities; null unless they sum to 1 within 1e-4."""
    p = F.col(probs) if isinstance(probs, str) else probs
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    mean = F.aggregate(F.transform(p, lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return F.when((F.size(p) == 4) & (F.abs(total - 1) <= 1e-4), mean)


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def others_ready(hands: pd.Series, seat: pd.Series) -> pd.Series:
    """1 for each of the three other seats, in turn order, whose hand is one tile away or complete."""
    out, flat, where = [None] * len(hands), [], []
    for i, (four, own) in enumerate(zip(hands, seat)):
        if four is None or own is None or len(four) != 4:
            continue
        out[i] = [None] * 3
        for k in (1, 2, 3):
            h = four[(int(own) + k) % 4]
            if _valid(h):
                flat.append(h)
                where.append((i, k - 1))
    if flat:  # one call for all hands of the batch
        for (i, k), far in zip(where, distance(np.array([list(h) for h in flat]))):
            out[i][k] = float(far <= 0)
    return pd.Series(out)
