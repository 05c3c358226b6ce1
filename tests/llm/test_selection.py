"""Varied subsets and mixes."""

import collections
import datetime
import itertools

import numpy as np
import pytest

from foldspan.llm import diversity as D
from foldspan.llm import mixing as M

T = datetime.datetime(2025, 1, 1)
DEC = "obs_id bigint, log_id string, row_idx int, phase string, action_kind string, shanten int, obs array<float>, loaded_at timestamp, rows int, b string"


def decision(i, phase="early", kind="discard", shanten=2, obs=None, at=T):
    return (i, f"L{i}", i, phase, kind, shanten, obs, at, 1, "clash")


def test_covers_combinations_and_skew(spark):
    rng = np.random.default_rng(0)
    rows = [decision(i, obs=rng.normal(size=64).tolist()) for i in range(3000)]
    rare = [(p, k, s) for p in ("middle", "LATE ", None) for k in ("Chi-Low", "kan", "strange") for s in (-1, 99, None)]
    rows += [decision(10_000 + i, *c) for i, c in enumerate(rare)] + [decision(None)] + [decision(5, "late", "pass", 0, None, T - datetime.timedelta(1))]
    df = spark.createDataFrame(rows, DEC).repartition(5)
    got = D.varied(df, 30).collect()
    assert len(got) == 30 == len({r.obs_id for r in got})
    combos = {(r.phase, r.action_kind, r.shanten) for r in got}
    all_ = {(r.phase, r.action_kind, r.shanten): r.n for r in D.combinations(df).collect()}
    assert combos == set(all_) and all(all_[r.phase, r.action_kind, r.shanten] == r.rows_alike for r in got)
    assert all_["early", "discard", 2] == 3000 and len(all_) == 1 + 3 * 3 * 2
    few = D.varied(df, 5).collect()
    assert len(few) == 5 and len({(r.phase, r.action_kind, r.shanten) for r in few}) == 5


def test_small_empty_and_repeated(spark):
    df = spark.createDataFrame([decision(1), decision(1), decision(2, None, None, None)], DEC)
    assert sorted(r.obs_id for r in D.varied(df, 10).collect()) == [1, 2]
    assert D.varied(df.limit(0), 10).count() == 0


def test_size_beyond_the_core_sets(spark):
    rng = np.random.default_rng(4)
    rows = [decision(i, obs=rng.normal(size=64).tolist()) for i in range(2000)] + [decision(5000 + i, "late", "kan", i % 3) for i in range(24)]
    df = spark.createDataFrame(rows, DEC).repartition(5)
    got = D.varied(df, 300).collect()
    n = collections.Counter((r.phase, r.action_kind, r.shanten) for r in got)
    assert len(got) == 300 == len({r.obs_id for r in got}) and len(n) == 4
    assert len(D.varied(df.where("obs_id < 90"), 100).collect()) == 90
    assert D.level([2000, 8, 8, 8], 300) == 276 and D.level([3, 9], 600) == 9 and D.level([90, 90], 5) == D.level([], 5) == D.KEEP


def test_swaps_reach_a_local_maximum():
    rng = np.random.default_rng(2)
    code, x = rng.integers(0, 400, 40), np.zeros((40, 64))
    chosen = D.swap_search(code, x, 8)
    assert len(chosen) == 8 == len(set(chosen))
    k, s, p = len(D.KINDS) + 1, len(D.SHANTEN) + 1, 0

    def far(a, b):
        pa, pb, ka, kb, sa, sb = a // (k * s), b // (k * s), a // s % k, b // s % k, a % s, b % s
        step = 0 if sa == sb else 1 if (sa == s - 1) != (sb == s - 1) else 0.5 + 0.5 * abs(sa - sb) / len(D.SHANTEN)
        return D.W_PHASE * (pa != pb) + D.W_KIND * (ka != kb) + D.W_SHANTEN * step + (D.W_OBS / 2)

    total = lambda rows: sum(far(code[a], code[b]) for a, b in itertools.combinations(rows, 2))
    best = total(chosen)
    for o in chosen:
        for i in set(range(40)) - set(chosen):
            if code[i] != code[o] and code[i] in code[chosen]:
                continue
            assert total([c for c in chosen if c != o] + [i]) <= best + 1e-3


DOCS = "doc_id bigint, text string, source string, tokens int, mix string"
GOALS = "mix string, source string, target_share double, max_repeats int, tokens int"


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(3)
    out = []
    for source, n in (("big", 1500), ("mid", 200), ("small", 25)):
        out += [(len(out) + i, "word " * int(rng.integers(1, 60)), source, 1, "clash") for i in range(n)]
    return out + [(9001, None, "big", 1, None), (9002, "", "mid", 1, None), (9003, "lost", None, 1, None), (9004, "word", "big", None, None), (9004, "word", "big", None, None)]


def test_shares_and_caps(spark, docs):
    goals = [("even", "big", 1.0, 4, 1), ("even", "mid", 1.0, None, 1), ("even", "small", 1.0, 4, 1), ("even", "gone", 7.0, None, 1), ("tiny", "small", 0.3, 2, 1), ("tiny", "big", 0.7, 2, 1), ("odd", "gone", None, None, None), ("off", "mid", -1.0, 3, None), (None, "mid", 1.0, 1, None)]
    taken, shares = M.mixed(spark.createDataFrame(docs, DOCS).repartition(7), spark.createDataFrame(goals, GOALS))
    s = {(r.mix, r.source): r for r in shares.collect()}
    assert set(s) == {g[:2] for g in goals if g[0]}
    for key in (("even", "big"), ("even", "mid"), ("even", "small"), ("tiny", "small"), ("tiny", "big")):
        assert abs(s[key].reached_share - s[key].wanted_share) < 0.03, s[key]
    assert s["even", "small"].most_copies == 4 and s["tiny", "small"].most_copies == 2
    assert s["even", "gone"].emitted == 0 and s["odd", "gone"].wanted_share is None and s["off", "mid"].emitted == 0
    rows = taken.collect()
    for mix, source in {(r.mix, r.source) for r in rows}:
        c = [r.copies for r in rows if (r.mix, r.source) == (mix, source)]
        assert max(c) - (min(c) if len(c) == s[mix, source].n_docs else 0) <= 1
    assert not {9001, 9002, 9003} & {r.doc_id for r in rows}


def test_systematic_counts(spark, docs):
    df = spark.createDataFrame(docs, DOCS)
    place = M.positions(df).collect()
    for source in ("big", "mid", "small"):
        p = sorted((r.place, r.tokens) for r in place if r.source == source)
        assert [x[0] for x in p] == list(range(len(p))) and [x[1] for x in p] == sorted(x[1] for x in p)
    empty_docs, empty_goals = df.limit(0), spark.createDataFrame([], GOALS)
    assert M.mixed(empty_docs, spark.createDataFrame([("m", "big", 1.0, 1, 1)], GOALS))[1].collect()[0].emitted == 0
    assert M.mixed(df, empty_goals)[0].count() == 0


def test_total_beyond_a_cap(spark, docs):
    goals = spark.createDataFrame([("m", "small", 0.5, 2, 1), ("m", "big", 0.5, None, 1)], GOALS)
    s = {r.source: r for r in M.mixed(spark.createDataFrame(docs, DOCS), goals, total=20_000)[1].collect()}
    assert s["small"].most_copies == 2 and s["small"].emitted == 2 * s["small"].tokens and s["small"].reached_share < 0.5


def test_replaced_deliveries_and_checks(spark):
    rng = np.random.default_rng(9)
    rows = [decision(i, obs=rng.normal(size=64).tolist()) for i in range(50)] + [decision(7, "late", "kan", 1, None, T + datetime.timedelta(1)), decision(8, "late", "pon", 1, None, T - datetime.timedelta(1)), decision(9, "early", "discard", 2, [float("inf")] * 64, None), decision(None, "late", "pass", 3)]
    df = spark.createDataFrame(rows, DEC).repartition(3)
    got = {r.obs_id: r for r in D.varied(df, 100).collect()}
    assert set(got) == set(range(50)) and (got[7].phase, got[7].rows_alike) == ("late", 1) and got[8].phase == "early" and got[0].rows_alike == 49
    assert tuple(D.checked(df, 20).first()) == (20, 2, 0, True)
    assert tuple(D.checked(df.limit(0), 20).first()) == (0, 0, 0, True)


def test_swaps_beat_the_greedy_start():
    rng = np.random.default_rng(11)
    code = rng.integers(0, 250, 120)
    x = rng.standard_normal((120, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows, begun, total = D.search(code, x, 12)
    assert len(rows) == 12 and total >= begun


def test_mix_checks(spark, docs):
    goals = spark.createDataFrame([("m", "big", 0.5, 4, 1), ("m", "mid", 0.5, None, 1), ("m", "gone", 0.1, 1, 1), ("z", "small", 0.0, 1, 1)], GOALS)
    df = spark.createDataFrame(docs, DOCS)
    got = {(r.mix, r.source): tuple(r)[2:] for r in M.conserved(*M.mixed(df, goals)).collect()}
    assert got == {("m", "big"): (True,) * 4, ("m", "mid"): (True,) * 4, ("m", "gone"): (False, True, True, True), ("z", "small"): (False, True, True, True)}
    assert {r.reason: r.docs for r in M.left_out(df).collect()} == {"null text": 1, "empty text": 1, "no source": 1}
    assert M.left_out(df.limit(0)).count() == 0
