"""Hand fixtures with known answers, and edge cases of the relational operators."""

import datetime
import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.functions import actions as A
from foldspan.functions import buckets as B
from foldspan.functions import hashing as H
from foldspan.functions import vectors as V
from foldspan.operators import compare as C
from foldspan.operators import gates as G
from foldspan.operators import profile as P
from foldspan.operators import ranking as R
from foldspan.operators import resample as S
from foldspan.operators import windows as W
from foldspan.plans import audits, comparing
from foldspan.sources import readers, sinks
from foldspan.streaming import logs as L


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(k) for k, c in cols.items()]).first()


def test_buckets(spark):
    df = spark.createDataFrame([(0, 15000.0, 3, -1), (3, 5000.0, 8, 1), (4, -5000.0, 14, 2), (7, -15000.0, 5, 5), (8, -12000.0, 10, 0), (20, 12000.0, 11, 3), (None, None, None, None)], "k int, g double, n int, s int")
    got = df.select(B.phase("k"), B.score_gap("g"), B.legal_count("n"), B.shanten("s")).collect()
    assert [tuple(r) for r in got] == [
        ("early", "ahead_big", "1_5", "tenpai_or_agari"), ("early", "ahead", "6_10", "1"), ("middle", "behind", "11_plus", "2"), ("middle", "behind_big", "1_5", "3_plus"), ("late", "behind_big", "6_10", "tenpai_or_agari"), ("late", "ahead_big", "11_plus", "3_plus"), (None,) * 4,
    ]
    assert one(spark, a=B.phase(F.lit(2), 2, 6), b=B.histogram_bin(F.lit(0.3), [0, 0.25, 1]), c=B.steps(F.lit(13)), d=B.margin(F.lit(1.0)), e=B.stage(F.lit(6)), f=B.clip(F.lit(-3.0)), g=B.finite(F.lit(float("nan"))))[:] == ("middle", "[0.25,1)", "13_24", "1_3", "south_back", -1.0, None)


def test_tiles_and_actions(spark):
    assert one(spark, a=A.plain_tile(F.lit("5mr")), b=A.plain_tile(F.lit("0p")), c=A.keep_red(F.lit("5sr")), d=A.tile34(F.lit("C")), e=A.tile34(F.lit("?")), f=A.dora_of(F.lit("9s")), g=A.dora_of(F.lit("N")), h=A.dora_of(F.lit("C")))[:] == ("5m", "5p", "5sr", 33, -1, 18, 27, 31)
    eq = lambda k, a, b, x=None, y=None: A.equivalent(F.lit(k), F.lit(k), F.lit(a), F.lit(b), F.lit(x) if x is None else F.array(*map(F.lit, x)), F.lit(y) if y is None else F.array(*map(F.lit, y)))
    r = one(spark, a=eq("dahai", "5m", "5m"), b=eq("dahai", "5mr", "5m"), c=eq("hora", None, "3p"), d=eq("chi", "4m", "4m", ["3m", "5mr"], ["5m", "3m"]), e=eq("pon", "4m", "4m", ["4m", "4m"], ["4m", "5m"]))
    assert tuple(r) == (True, False, True, True, False)
    code = A.encode(F.lit(11), F.lit(33), F.array(F.lit(-1), F.lit(5), F.lit(33)), F.lit(3), F.lit(255))
    assert {k: v for k, v in one(spark, **A.decode(code)).asDict().items()} == {"kind": 11, "tile": 33, "consumed": [-1, 5, 33], "target": 3, "flags": 255}


def test_hashes(spark):
    text = "D3_top2_discard_v1|1|2|3|4|5"
    want = int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "little") / 2**64
    assert one(spark, u=H.uniform("D3_top2_discard_v1", *[F.lit(i) for i in range(1, 6)])).u == want
    assert H.canonical_event({"type": "start_game", "names": [1], "meta": 2, "b": 1, "a": "é"}) == '{"a":"é","b":1,"type":"start_game"}'
    df = spark.createDataFrame([("{\"b\": 1, \"a\": 2}",), ("x",), (None,), ("[1]",)], "l string")
    assert [r[0] for r in df.select(H.canonical_line("l")).collect()] == ['{"a":2,"b":1}', None, None, None]


def test_vectors(spark):
    v = F.array(*map(F.lit, (3.0, 4.0)))
    z = F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, n=V.norm(v), u=V.unit(v), z=V.unit(z), c=V.cosine(v, z), s=V.softmax(F.array(F.lit(1000.0), F.lit(1000.0))), e=V.entropy(F.array(F.lit(0.5), F.lit(0.5), F.lit(0.0))), ok=V.all_close(v, v))
    assert r.n == 5 and r.u == [0.6, 0.8] and r.z == [0, 0] and r.c is None and r.s == [0.5, 0.5] and r.e == pytest.approx(math.log(2)) and r.ok


def test_divergences(spark):
    df = spark.createDataFrame([("p", "x", 1), ("p", "y", 1), ("q", "x", 1), ("q", "y", 3), ("r", "z", 5)], "c string, k string, n int")
    got = {(r.a, r.b): r for r in C.divergence(df, "c", "k").collect()}
    assert got["p", "q"].tv == pytest.approx(0.25) and got["p", "q"].jsd > 0 and got["p", "r"].a_missing == 1 and got["p", "r"].jsd == pytest.approx(math.sqrt(math.log(2)))
    w = spark.createDataFrame([("a", 0.0, 1.0), ("a", 1.0, 1.0), ("a", 1.0, 1.0), ("b", 0.0, 2.0), ("b", 2.0, 1.0)], "s string, v double, w double").withColumn("k", F.lit(1))
    assert C.wasserstein(w, ["k"], "v", F.col("s") == "a", F.col("w")).first().distance == pytest.approx(2 / 3)
    assert C.wasserstein(w, ["k"], "v", F.col("s") == "none", F.col("w")).first().distance is None


def test_weighted_quantiles(spark):
    df = spark.createDataFrame([(1, float(v), 1.0) for v in range(3)] + [(2, 0.0, 1.0), (2, 1.0, 3.0)], "k int, v double, w double")
    five = [r.x for r in P.weighted_quantiles(df.where("k = 1"), ["k"], "v", "w", 5).orderBy("i").collect()]
    four = [r.x for r in P.weighted_quantiles(df.where("k = 2"), ["k"], "v", "w", 4).orderBy("i").collect()]
    assert five == pytest.approx([0, 0, 0.5, 1.1, 1.7]) and four == pytest.approx([0, 1 / 6, 0.5, 5 / 6])


def test_contribution(spark):
    rows = lambda sizes: spark.createDataFrame([(c,) for c, n in enumerate(sizes) for _ in range(n)], "c int")
    assert P.contribution(rows([4] * 100), "c").first().gini == pytest.approx(0)
    x = np.array([90, 5, 3, 2])
    got = P.contribution(rows(x), "c").first()
    s, n = np.sort(x), 4
    assert got.gini == pytest.approx(((2 * np.arange(1, 5) - n - 1) * s).sum() / (n * s.sum())) and got.ess == pytest.approx(100**2 / (x**2).sum()) and got.top_1pct_share == 0.9
    assert P.contribution(rows([]), "c").first().gini == 0


def test_ranks(spark):
    r = spark.createDataFrame([(g, s, k) for g, ks in enumerate([(1, 2, 3, 4), (2, 1, 3, 4), (2, 1, 3, 4), (3, 1, 2, 4)]) for s, k in enumerate(ks)], "g int, seat int, rank int")
    got = {x.seat: x for x in R.summarise_ranks(r, ["seat"], "rank", R.PROFILES["reference_90_45"]).collect()}
    assert (got[0].games, got[0].avg_rank, got[0].avg_rank_pt) == (4, 2.0, 45.0)
    assert R.parse_points("90, 45,0,-135") == R.PROFILES["reference_90_45"]
    for bad in ("1,2,3", "1,2,3,x", (1, 2, 3, float("nan"))):
        with pytest.raises(ValueError):
            R.parse_points(bad)
    scores = F.array(*map(F.lit, (10, 30, 30, 20)))
    assert [one(spark, r=W.rank_in_array(scores, F.lit(i))).r for i in range(4)] == [4, 1, 2, 3]


def test_lookahead_and_midpoints(spark):
    df = spark.createDataFrame([(1, i) for i in range(12)], "c int, i int")
    got = W.lookahead(df, ["c"], "i", F.col("i").isin(0, 1), 8, F.col("i")).collect()
    assert len(got) == 16 and sorted(r.offset for r in got if r.target_id == 2) == [1, 2]
    for n, want in ((5, [0, 2, 4]), (10, [1, 5, 8]), (2, [])):
        assert [r.place for r in G.midpoints(df.where(F.col("i") < n), "c", ["i"]).orderBy("place").collect()] == want


def test_budget_equals_a_fold(spark):
    rng = np.random.default_rng(8)
    rows, want = [], {}
    for c in range(25):
        per, total, i = {}, 0, 0
        for seg in range(int(rng.integers(1, 16))):
            for _ in range(int(rng.integers(1, 7))):
                u = float(rng.random())
                why = "hanchan_budget_exhausted" if total >= 8 else "kyoku_budget_exhausted" if per.get(seg) else "hash_rejected" if u >= 0.25 else "explored"
                if why == "explored":
                    per[seg], total = 1, total + 1
                rows.append((c, seg, i, u))
                want[c, i] = why
                i += 1
    got = W.budgeted(spark.createDataFrame(rows, "c int, seg int, i int, u double"), ["c"], "seg", "i", F.col("u")).collect()
    assert {(r.c, r.i): r.reason for r in got} == want


def test_sign_test_and_bootstrap(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", -1.0), ("a", 0.0), ("z", 0.0)], "k string, v double")
    got = {r.k: r for r in S.sign_test(df, ["k"], "v").collect()}
    assert (got["a"].positive, got["a"].n, got["a"].p) == (2, 3, 0.5) and got["z"].p == 1.0
    assert {r.k: r.p for r in S.sign_test(df, ["k"], "v", None).collect()}["z"] is None
    b = S.hierarchical_bootstrap(spark, {1: [2.0] * 50, 2: [4.0] * 50, 3: [6.0] * 50}, reps=300).iloc[0]
    assert b["mean"] == 4 and 2 <= b["lo"] <= b["hi"] <= 6
    p = S.permutation_p(spark.createDataFrame([(1, 0.02)], "k int, value double"), spark.createDataFrame([(1, float(x)) for x in np.linspace(0, 0.01, 999)], "k int, null_value double"), ["k"]).first()
    assert p.p == pytest.approx(0.001) and not p.vote


def test_gates_and_pairs(spark):
    a = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0), (2, "y", 3.0), (None, "n", 1.0)], "k int, s string, v double")
    b = spark.createDataFrame([(1, "x", 5.0), (3, "z", 1.0)], "k int, s string, v double")
    pairs, gates = G.strict_pairs(a, b, ["k"], ["s"], ["v"])
    assert [tuple(r) for r in pairs.collect()] == [(1, "x", 1.0, 5.0)]
    assert {r.gate: r.passed for r in gates.collect()} == {"no_duplicate_left": False, "no_duplicate_right": True, "key_sets_equal": False, "secondary_equal": True}
    assert G.verdict(gates).first().verdict == "no_verdict_gates_failed"
    assert all(not r.passed for r in G.strict_pairs(a.limit(0), b.limit(0), ["k"], ["s"], ["v"])[1].where("gate = 'key_sets_equal'").collect())


def test_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, s string")
    out = str(tmp_path / "v")
    sinks.write_versioned(df, out, "facts", 3)
    assert readers and sinks.read_versioned(spark, out, "facts", 3).count() == 2
    with pytest.raises(ValueError):
        sinks.read_versioned(spark, out, "facts", 4)
    more = str(tmp_path / "m")
    assert sinks.write_missing(df, more, "k") == 2 and sinks.write_missing(df.union(spark.createDataFrame([(3, "c")], df.schema)), more, "k") == 1 and spark.read.parquet(more).count() == 3
    (tmp_path / "r.csv").write_text("﻿source_log,game_index,model_label,rank\nx,1,A,2\nx,1,B,1\n", encoding="utf-8")
    assert tuple(readers.results(spark, str(tmp_path / "r.csv"), ["A", "B"], ["source_log", "game_index"]).first()) == ("x", "1", "2", "1")
    m = spark.createDataFrame([("b\\x",), ("a/y ",), ("b/x",), (None,)], "path string")
    assert [r.path for r in readers.manifest(m, limit=5).collect()] == ["a/y", "b/x"]
    with pytest.raises(ValueError):
        readers.manifest(m, expected=3)
    s = spark.createDataFrame([("t", 1, "f1", 0, 1.0), ("t", 1, "f2", 0, 2.0), ("t", 2, "f1", 1, 3.0), ("t", 2, "f2", 1, 3.0)], "tag string, step int, f string, pos int, v double")
    kept, clash = readers.last_write_wins(s, ["tag", "step"], "f", "pos", "v")
    assert {r.step: r.v for r in kept.collect()} == {1: 2.0, 2: 3.0} and clash.count() == 1
    assert sinks.markdown([{"name": "a", "x": 0.5, "y": None}], "name").splitlines()[-2:] == ["| x | 0.500000 |", "| y | NA |"]
    assert sinks.metrics_document({"x": float("inf")}, {}, "p", (1, 2, 3, 4))["metrics"]["x"] is None


def test_stream_equals_batch_over_several_files(spark, tmp_path):
    t = datetime.datetime(2025, 1, 1)
    rows = [(i, i % 3, t + datetime.timedelta(minutes=i), "error" if i % 7 == 6 else "click", float(i)) for i in range(60)]
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], "event_id bigint, user_id bigint, ts timestamp, event_type string, value double").coalesce(1).write.parquet(str(tmp_path / f"events.parquet/p{part}"))
    schema = spark.read.parquet(str(tmp_path / "events.parquet/p0")).schema
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events.parquet"))
    got = {(r.user_id, r.event_id, r.steps) for r in L.drain(L.pending_until(stream, "user_id", "ts", "event_type", "value", "error")).collect()}
    want, waiting = set(), {}
    for i, u, _, k, v in rows:
        waiting.setdefault(u, []).append(i)
        if k == "error":
            n = len(waiting[u]) - 1
            want |= {(u, e, n - p) for p, e in enumerate(waiting.pop(u))}
    assert got == want


def test_streamed_budget_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = [(c, i // 3, i, float(rng.random())) for c in range(4) for i in range(60)]
    df = spark.createDataFrame(rows, "c int, seg int, i int, u double")
    for part in range(3):
        df.where(F.floor(F.col("i") / 20) == part).coalesce(1).write.parquet(str(tmp_path / f"s/p{part}"))
    stream = spark.readStream.schema(df.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    got = {(r.c, r.i): r.reason for r in L.drain(L.budgeted(stream, ["c"], "seg", ["i"], "u")).collect()}
    assert got == {(r.c, r.i): r.reason for r in W.budgeted(df, ["c"], "seg", "i", F.col("u")).collect()}


def test_ledger_and_remap(spark):
    led = spark.createDataFrame([("a", "PASS", 1, "x"), ("a", "FAIL", 3, "y"), ("a", "PASS", 2, "z"), ("b", "FAIL", 1, "w")], "shard string, status string, line int, v string")
    assert [tuple(r) for r in readers.latest_pass(led, "shard", "status", "line").collect()] == [("a", "PASS", 2, "z")]
    p = spark.createDataFrame([("C:\\data\\x",), ("/mnt/y",), (None,)], "p string")
    assert [r.p for r in readers.remapped(p, "p", {"C:/data": "/lake", "/mnt": "/m"}).collect()] == ["/lake/x", "/m/y", None]


def test_action_spaces(spark):
    from foldspan.operators import audits as U

    act = lambda k, p, *c: A.index45(F.lit(k), F.lit(p), F.array(*map(F.lit, c)) if c else F.lit(None).cast("array<string>"))
    assert one(spark, a=act("dahai", "5mr"), b=act("dahai", "?"), c=act("chi", "3m", "4m", "5mr"), d=act("chi", "4m", "3m", "5m"), e=act("chi", "6s", "4s", "5s"), f=act("hora", None), g=act("what", None))[:] == (4, None, 35, 36, 37, 42, 44)
    w = one(spark, e=A.wire_events(F.lit("reach"), F.lit(1), F.lit("3p"), F.lit(None).cast("array<string>"), F.lit(None).cast("int")))
    assert [x.type for x in w.e] == ["reach", "dahai"] and w.e[1].pai == "3p"
    for seed, key in ((5, 1 << 52), (7, 3), (1000, (1 << 63) - 1)):
        turned = ((key << 13) & (2**64 - 1)) | (key >> 51)
        assert one(spark, s=A.train_seat(F.lit(seed), F.lit(key).cast("bigint"))).s == (seed ^ turned) % 4
    bag = lambda *t: F.array(*map(F.lit, t))
    assert one(spark, a=A.sub_multiset(bag("1m", "1m"), bag("1m", "2m", "1m")), b=A.sub_multiset(bag("1m", "1m"), bag("1m", "2m")))[:] == (True, False)
    flags = U.primary_flags(spark.createDataFrame([(1, i, a) for i, a in enumerate([0, 42, 5, 1, 42, 9, 2])] + [(2, 0, 42), (3, 0, 42), (3, 1, 43)], "k int, i int, a int"), ["k"], "i", "a").collect()
    assert [r.primary for r in sorted(flags) if r.k == 1] == [True, True, False, True, True, False, True] and [any(r.fault for r in flags if r.k == k) for k in (1, 2, 3)] == [False, True, True]


def test_centred_readouts_and_bootstraps(spark):
    from foldspan.operators import audits as U

    g = one(spark, c=V.centred(F.array(F.lit(1.0), F.lit(3.0)))).c
    assert g.common == pytest.approx(2 * math.sqrt(2)) and g.centred_norm == pytest.approx(math.sqrt(2))
    assert U.coverage_readout(3, 4, {"D1": 0.05, "D2": 0.0}, True) == "A_coverage_priority"
    assert [U.coverage_readout(*a) for a in ((2, 4, {"a": 1}, True), (3, 4, {"a": 0}, True), (4, 4, {"a": 1}, False))] == ["inconclusive", "inconclusive", "no_verdict_gates_failed"]
    e = U.exposed_counts(spark.createDataFrame([(0, "a", 1), (1, "b", 1), (2, "a", 3)], "c int, k string, n int"), spark.createDataFrame([(0, 2), (2, 1)], "c int, t int"), "c", "k", "n", "t")
    assert {r.k: r.exposed for r in e.collect()} == {"a": 5, "b": 0}
    p = S.paired_hierarchical_bootstrap({1: [(2.0, 1.0)] * 20, 2: [(4.0, 3.0)] * 20, 3: [(6.0, 5.0)] * 20}, reps=200)
    assert p["mean"].tolist() == [4, 3] and ((p.hi - p.lo)[0] == pytest.approx((p.hi - p.lo)[1])) and 2 <= p.lo[0] <= p.hi[0] <= 6
    sums = spark.createDataFrame([(0, "a", 2, [2.0, 0.0]), (0, "b", 1, [0.0, 1.0]), (1, "a", 1, [3.0, 0.0]), (1, "b", 1, [0.0, 5.0])], "place int, co string, n int, s array<double>")
    times = spark.createDataFrame([(0, 0, 1), (0, 1, 1), (1, 0, 2)], "rep int, place int, times int")
    got = {r.rep: r.mmd2 for r in S.mmd_bootstrap(sums, times, "co", "a", "b").collect()}
    assert got[0] == pytest.approx((5 / 3) ** 2 + 9) and got[1] == pytest.approx(2.0)


def test_overlap_of_whole_states(spark, tmp_path):
    state = lambda k, routes: [(r, [float(k)], [True], k) for r in routes]
    rows = [x for k in range(3000) for x in state(k, ("M0", "D1")[: 1 + (k < 40)])] + [x for k in range(5000, 7500) for x in state(k, ("D1",))] + [("D1", None, [True], 1), (None, [1.0], [True], 2)]
    spark.createDataFrame(rows + rows[:5], "route string, obs array<float>, mask array<boolean>, obs_id bigint").write.parquet(f"{tmp_path}/decisions.parquet")
    assert [tuple(r) for r in comparing.QUERIES["cohort_overlap_states"](spark, str(tmp_path)).collect()] == [("D1", "M0", 40, 2500, 2960)]


def test_distances_at_reference_size(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    x[2000:2008] += 1000  # 0.4 % of the second cohort
    df = spark.createDataFrame([(int(i >= 2000), [float(v) for v in r]) for i, r in enumerate(x)], "c int, v array<float>")
    assert C.sliced_wasserstein(df, "c", "v", 4).first().distance > 1
    y = np.vstack([rng.normal(size=(300, 4)), rng.normal(0.3, 1, (300, 4))])
    k = np.exp(-((y[:, None] - y[None]) ** 2).sum(-1) / 2 / 0.7**2)
    exact = k[:300, :300].mean() + k[300:, 300:].mean() - 2 * k[:300, 300:].mean()
    df = spark.createDataFrame([(int(i >= 300), [float(v) for v in r]) for i, r in enumerate(y)], "c int, v array<float>")
    assert C.rff_mmd(df, "c", "v", 4, 0.7).first().mmd2 == pytest.approx(exact, rel=0.05)  # 128 features: 18 % off


def test_draws_at_reference_size(spark, tiny):
    q = {**comparing.QUERIES, **audits.QUERIES}
    assert q["cluster_bootstrap_tv_1000"](spark, tiny).first().reps == 1000 and q["hier_bootstrap_ci_5000"](spark, tiny).first().reps == 5000
    assert q["median_distance_65536"](spark, tiny).first().pairs > 60_000
    assert all((r.p * 1000) % 1 == pytest.approx(0, abs=1e-6) for r in q["permutation_p_999"](spark, tiny).collect())


def test_set_differences_of_whole_tables(spark, tmp_path):
    spark.createDataFrame([(5, "a"), (6, "b"), (7, "b"), (None, None)], "manifest_id bigint, src_path string").write.parquet(f"{tmp_path}/export_jobs.parquet")
    spark.createDataFrame([(5, ["a", "c", None]), (6, None), (10, [])], "manifest_id bigint, files array<string>").write.parquet(f"{tmp_path}/export_manifests.parquet")
    got = lambda name: {tuple(r) for r in comparing.QUERIES[name](spark, str(tmp_path)).collect()}
    assert got("set_differences_manifests") == {("unexpected", 7), ("missing", 10)}
    assert got("set_differences_paths") == {("unexpected", "b"), ("missing", "c")}


def test_second_moments_of_whole_vectors(spark, tiny):
    got = audits.QUERIES["second_moments_64"](spark, tiny).where("cohort = 0").collect()
    assert len(got) == 64 * 65 // 2 and max(r.j for r in got) == 63


def test_adapters_and_encoders(spark):
    from foldspan.operators import adapters as D

    df = spark.createDataFrame([(0, [True] * 46, 5.0), (10, [False] * 46, 1.0), (45, [True] * 46, None), (None, [True] * 46, 1.0), (3, None, 1.0)], "action int, mask array<boolean>, target double")
    rows = D.adapted(df, "augmented").collect()
    assert sorted((r.action, r.turned, r.value) for r in rows) == [(0, 0, 1.0), (9, 1, 1.0), (45, 0, 0.0), (45, 1, 0.0)]
    assert D.adapted(df.limit(0), "value").count() == 0 and D.names() == ["augmented", "policy", "value"]
    assert D.encoder("foldspan.operators.features") is D.encoder("foldspan.operators.features:encode")
    for bad in (lambda: D.adapted(df, "none"), lambda: D.register("value", D.Adapter())):
        try:
            bad()
            raise AssertionError
        except (KeyError, ValueError):
            pass
