"""Sketches: rank errors, merging in any grouping, odd values."""

import datetime
import random

import numpy as np
import pytest

from foldspan.llm import quantiles as Q


def rank_errors(values, got, ps):
    v = np.sort(values)
    for p, x in zip(ps, got):
        lo, hi = np.searchsorted(v, x, "left") / len(v), np.searchsorted(v, x, "right") / len(v)
        yield p, 0.0 if lo <= p <= hi + 1 / len(v) else min(abs(lo - p), abs(hi - p))


@pytest.mark.parametrize("kind", ["normal", "lognormal", "ties", "sorted", "reversed"])
def test_relative_rank_error(kind):
    rng = np.random.default_rng(4)
    n = 200_000
    v = {"normal": rng.normal(size=n), "lognormal": rng.lognormal(0, 4, n), "ties": rng.integers(0, 50, n).astype(float), "sorted": np.arange(n, dtype=float), "reversed": np.arange(n, dtype=float)[::-1]}[kind]
    s = Q.Sketch()
    for part in np.array_split(v, 37):
        s.add(part, 0)
    assert s.n == n and sum(map(len, s.high.levels)) < 12_000
    for p, e in rank_errors(v, s.quantiles(Q.PERCENTS), Q.PERCENTS):
        assert e <= 3 * Q.SPREAD / Q.K * min(p, 1 - p) + 2 / n, (p, e)


def test_merge_order_and_packing():
    rng = np.random.default_rng(5)
    parts = [rng.exponential(size=rng.integers(1, 9000)) for _ in range(40)]
    v = np.concatenate(parts)
    sketches = []
    for p in parts:
        s = Q.Sketch()
        s.add(p, 1)
        sketches.append(Q.Sketch.of(s.row()))
    for order in (range(40), reversed(range(40)), random.Random(1).sample(range(40), 40)):
        total = Q.Sketch()
        for i in order:
            total.merge(Q.Sketch.of(sketches[i].row()))
        assert (total.n, total.nulls, total.lo, total.hi) == (len(v), 40, v.min(), v.max())
        for p, e in rank_errors(v, total.quantiles(Q.PERCENTS), Q.PERCENTS):
            assert e <= 3 * Q.SPREAD / Q.K * min(p, 1 - p) + 2 / len(v), (p, e)


def test_small_groups_are_exact():
    s = Q.Sketch()
    s.add(np.array([3.0, np.nan, 1.0, np.inf, 2.0]), 0)
    assert (s.n, s.odd) == (3, 2) and s.quantiles([0.0, 0.5, 1.0]) == [1.0, 2.0, 3.0]
    assert Q.Sketch().quantiles([0.5]) == [None]


def test_tables(spark):
    t = datetime.datetime(2025, 1, 1)
    d = spark.createDataFrame([(1, "early", 1.0, t, t, "x"), (1, "early", 5.0, t, t.replace(day=2), "x"), (2, " MID ", None, t, t, "x"), (3, None, float("nan"), None, None, None), (4, "early", -2.0, t.replace(day=3), t, None)], "obs_id bigint, phase string, target double, played_at timestamp, loaded_at timestamp, value string")
    s = spark.createDataFrame([], "generation_seed bigint, seed_key bigint, seat int, kyoku_index int, decision_index int, phase string, margin double, played_at timestamp, loaded_at timestamp")
    r = spark.createDataFrame([], "obs_id bigint, phase string, q_target double, played_at timestamp, loaded_at timestamp")
    got = Q.by_day_and_all(Q.values(d, s, r)).where("p = 0.5").collect()
    by = {(x.level, x.grp, str(x.day)): (x.value, x.n, x.nulls, x.odd) for x in got}
    assert by["all", "early", "None"] == (-2.0, 2, 0, 0) and by["day", "early", "2025-01-01"] == (5.0, 1, 0, 0)
    assert by["all", "middle", "None"] == (None, 0, 1, 0) and by["all", "unknown", "None"] == (None, 0, 0, 1)
    assert Q.by_day_and_all(Q.values(d.limit(0), s, r)).count() == 0


def test_files_combine_to_the_whole(spark, tmp_path):
    rng = np.random.default_rng(6)
    v = rng.lognormal(0, 2, 30_000)
    for i, part in enumerate(np.array_split(v, 3)):
        spark.createDataFrame([("m", "g", f"f{i}", float(x)) for x in part], "metric string, grp string, file string, target double").write.parquet(str(tmp_path / f"p{i}"))
    files = Q.build(spark.read.parquet(*[str(tmp_path / f"p{i}") for i in range(3)]), ["metric", "grp", "file"], "target")
    one = Q.combine(files, ["metric", "grp", "file"])
    assert Q.percentiles(one, ["metric", "grp", "file"]).where("p = 0.5").count() == 3
    whole = {r.p: r.value for r in Q.percentiles(Q.combine(one, ["metric", "grp"]), ["metric", "grp"]).collect()}
    for p, e in rank_errors(v, [whole[p] for p in Q.PERCENTS], Q.PERCENTS):
        assert e <= 3 * Q.SPREAD / Q.K * min(p, 1 - p) + 2 / len(v)


def test_files_of_all_tables_and_their_total(spark, tmp_path):
    from foldspan.llm import catalog

    for t, value in (("decisions", "target"), ("decision_snapshots", "margin"), ("learnability_rows", "q_target")):
        rows = spark.createDataFrame([("early", float(i)) for i in range(300)], f"phase string, {value} double")
        rows.repartitionByRange(3, value).write.parquet(f"{tmp_path}/{t}.parquet")
    got = catalog.p4_files(spark, str(tmp_path)).where("p = 0.5").collect()
    assert {(r.metric, r.level, r.n) for r in got} == {(m, *x) for m in ("target", "margin", "q_target") for x in (("file", 100), ("all", 300))}
    assert sum(r.level == "file" for r in got) == 9 and all(abs(r.value - 149.5) < 5 and r.file is None for r in got if r.level == "all")


def test_bounds_hold_over_many_parts(spark):
    rng = np.random.default_rng(12)
    rows = [("m", "hot" if i % 3 else None, datetime.date(2025, 1, 1 + i % 5), float(v)) for i, v in enumerate(rng.lognormal(0, 3, 30_000))] + [("m", "hot", None, None), ("m", "few", None, float("nan")), ("m", "few", None, 1.0)]
    df = spark.createDataFrame(rows, "metric string, grp string, day date, value double").repartition(40)
    got = Q.within_bounds(df).collect()
    assert {(r.grp, r.n) for r in got} == {("hot", 20_000), ("few", 1)} and all(r.within for r in got) and len(got) == 2 * len(Q.PERCENTS)
    assert Q.within_bounds(df.limit(0)).count() == 0
