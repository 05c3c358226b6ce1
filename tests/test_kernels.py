"""Distances of hands against a search, and known hands."""

from functools import lru_cache

import numpy as np
import pytest

from foldspan.operators import kernels as K


def hand(text):
    counts, run = np.zeros(34, int), ""
    for ch in text:
        if ch.isdigit():
            run += ch
        else:
            for n in run:
                counts["mpsz".index(ch) * 9 + int(n) - 1] += 1
            run = ""
    return counts


@lru_cache(maxsize=None)
def complete(counts, groups, pair):
    if sum(counts) == 0:
        return groups == 0 and pair == 0
    i = next(k for k, c in enumerate(counts) if c)
    take = lambda *tiles: tuple(c - tiles.count(k) for k, c in enumerate(counts))
    if pair and counts[i] >= 2 and complete(take(i, i), groups, 0):
        return True
    if groups and counts[i] >= 3 and complete(take(i, i, i), groups - 1, pair):
        return True
    return bool(groups and i < 27 and i % 9 < 7 and counts[i + 1] and counts[i + 2] and complete(take(i, i + 1, i + 2), groups - 1, pair))


def test_known_hands():
    quad = np.zeros(34, int)
    quad[0], quad[[11, 19, 30]] = 4, 3
    assert K.distance(quad)[0] == 1
    single = np.zeros(34, int)
    single[[0, 3, 6, 9, 12, 15, 18, 21, 24, 27, 28, 29, 30]] = 1
    assert K.distance(single)[0] == 6
    assert K.seven_pairs(hand("1122m3344p5566s7z")[None])[0] == 0 and K.orphans(hand("19m19p19s1234567z")[None])[0] == 0
    d, kinds, live = K.improving(hand("3458m34678p668s4m"))
    assert (d[0], live[0]) == (2, 48)
    d, kinds, live = K.improving(hand("123456789m45p77s"))
    assert d[0] == 0 and np.flatnonzero(kinds[0]).tolist() == [11, 14] and live[0] == 8


@pytest.mark.parametrize("groups", [1, 2, 3, 4])
def test_complete_hands_and_one_away(groups):
    rng = np.random.default_rng(groups)
    hands = []
    for _ in range(150):
        tiles = rng.permutation(np.repeat(np.arange(34 if rng.random() < 0.3 else 9), 4))[: 3 * groups + 2]
        hands.append(np.bincount(tiles, minlength=34))
    hands = np.array(hands)
    got = K.regular(hands, np.full(len(hands), groups))
    for h, d in zip(hands, got):
        assert (d == -1) == complete(tuple(h), groups, 1)
        if d > 0:  # no exchange of one tile may complete it; some exchange brings it closer
            outs, ins = np.flatnonzero(h), np.flatnonzero(h < 4)
            swaps = np.array([h - np.eye(34, dtype=int)[o] + np.eye(34, dtype=int)[i] for o in outs for i in ins if i != o])
            after = K.regular(swaps, np.full(len(swaps), groups))
            assert after.min() == d - 1


def test_progress_column(spark):
    rows = [(1, hand("123456789m45p77s").tolist()), (2, None), (3, [1] * 5), (4, [0] * 34), (5, hand("123456789m45p77s1z").tolist()), (6, hand("123456789m456p77s").tolist())]
    df = spark.createDataFrame(rows, "id int, counts array<int>")
    got = {r.id: r.p for r in df.select("id", K.progress("counts").alias("p")).collect()}
    assert tuple(got[1]) == (0, 2, 8) and tuple(got[5]) == (0, 2, 8) and got[6][0] == -1
    assert all(v is None for i in (2, 3, 4) for v in got[i])


def test_deltas_ids_and_ranks(spark):
    from pyspark.sql import functions as F

    h = hand("123456789m45p77s")
    df = spark.createDataFrame([(1, h.tolist(), [0.1, 0.2, 0.3, 0.4], [h.tolist(), [0] * 34, hand("19m19p19s1234567z").tolist(), hand("1358m259p147s123z").tolist()]), (2, None, [0.5] * 4, None)], "id int, counts array<int>, p array<double>, four array<array<int>>")
    a, b = df.select(K.draw_deltas("counts").alias("d"), K.discard_deltas("counts").alias("o"), K.tile_ids("counts").alias("i"), K.expected_rank("p").alias("r"), K.others_ready("four", F.lit(0)).alias("t")).collect()
    assert sorted(x.tile for x in a.d if x.delta < 0) == [11, 14] and all(x.delta >= 0 for x in a.o) and len(a.o) == (h > 0).sum()
    assert len(a.i) == 13 == len(set(a.i)) and a.i[:3] == [0, 4, 8] and a.r == pytest.approx(3.0) and a.t == [None, 1.0, 0.0]
    assert (b.d, b.o, b.i, b.r, b.t) == (None, None, None, None, None)
