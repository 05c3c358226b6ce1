"""Readers, writers and corpus audits: errors, empty inputs, odd values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldspan.operators import corpora as O
from foldspan.sources import readers as R
from foldspan.sources import sinks as S


def test_missing_files_and_perspectives(spark, tmp_path):
    spark.range(3).write.json(str(tmp_path / "a"))
    files = R.files_of(spark, [f"{tmp_path}/a/*.json", f"{tmp_path}/a/part*"])
    assert files.count() == files.select("path").distinct().count() > 0
    assert R.indexed(files.select("path"), files).count() == files.count()
    with pytest.raises(Exception, match="listed file is missing"):
        R.indexed(spark.createDataFrame([("/none",)], "path string"), files).collect()
    with pytest.raises(Exception):
        R.files_of(spark, [f"{tmp_path}/b/*.json"])
    logs = spark.createDataFrame([("x", 1), ("y", 2)], "log_id string, n int")
    names = spark.createDataFrame([("x", "M0")], "log_id string, label string")
    assert {r.label for r in R.perspectives(logs, label="D1").collect()} == {"D1"}
    with pytest.raises(Exception, match="no perspective"):
        R.perspectives(logs, names).collect()


def test_strict_logs_raise(spark):
    rows = [("1_2.mjson", "start_game", list("abcd"), [1, 2]), ("1_2.mjson", "start_kyoku", None, None), ("9_9.mjson", "start_game", list("abcd"), [1, 2]), ("9_9.mjson", "start_kyoku", None, None), ("n.mjson", "start_kyoku", None, None)]
    df = spark.createDataFrame(rows, "log_id string, type string, names array<string>, seed array<bigint>")
    assert {r.log_id: r.reason for r in R.strict_logs(df).collect()} == {"1_2.mjson": None, "9_9.mjson": "file name", "n.mjson": "start_game"}
    assert R.strict_logs(df.where("log_id = '1_2.mjson'"), ["M0"]).first().reason == "labels"
    with pytest.raises(Exception, match="file name"):
        R.strict_logs(df, raises=True).collect()


def test_caches_and_torn_files(spark, tmp_path):
    out = str(tmp_path / "c")
    spark.range(100).withColumn("v", F.col("id") * 2).repartition(5).write.parquet(out)
    parts = [R.cache(spark, out, {"extra": "int"}, 2, k) for k in (0, 1)]
    assert sum(p.count() for p in parts) == 100 and parts[0].where("extra is not null").count() == 0
    (tmp_path / "c" / "part-torn.parquet").write_bytes(b"PAR1")
    with pytest.raises(Exception):
        R.cache(spark, out).count()
    assert S.drop_unreadable(spark, out) == 1 and R.cache(spark, out).count() == 100
    assert S.write_missing(spark.range(110).withColumn("v", F.col("id") * 2), out, "id") == 10


def test_violations_and_reconciliation(spark):
    df = spark.createDataFrame([(1, 5), (1, None), (2, -1), (None, 7), (None, 7)], "k int, v int")
    got = {r.kind: r.n for r in O.violations(df, {"negative": F.col("v") < 0, "huge": F.col("v") > 99}, ["k", "v"]).collect()}
    assert got == {"negative": 1, "huge": 0, "duplicate_context": 1}
    assert {r.n for r in O.violations(df.limit(0), {"negative": F.col("v") < 0}, ["k"]).collect()} == {0}
    a, b = (spark.createDataFrame(x, "k int, v int") for x in ([(1, 1), (2, 2), (3, None)], [(1, 1), (2, 9), (4, 4)]))
    assert {r.state: r.n for r in O.reconciled(a, b, ["k"], "v").collect()} == {"match": 1, "differs": 1, "missing": 1, "unlisted": 1}


def test_exposure_reads_the_budget(spark):
    sizes = spark.createDataFrame([(str(i), 1 + i % 4) for i in range(40)], "c string, n bigint")
    got = O.exposure(sizes, "c", "n", 3, 150, lambda e, c: F.xxhash64(e, c)).collect()
    assert sum(r.consumed for r in got) == 150 and len(got) == 40 and all(r.consumed <= 3 * (1 + int(r.c) % 4) for r in got)
    r = O.exposure_report(spark.createDataFrame([(v,) for v in (0, 0, 1, 3, 6)], "consumed bigint")).first()
    x = np.sort([0, 0, 1, 3, 6])
    gini = ((2 * np.arange(1, 6) - 6) * x).sum() / (5 * x.sum())
    assert (r.total, r.unique) == (10, 3) and r.gini == pytest.approx(gini) and r.top_10 == 0.6 and r.effective_n == pytest.approx(100 / 46)


def test_distance_of_choice(spark):
    values = spark.createDataFrame([(0, r, float(v), 1) for r, v in (("M0", 4), ("D1", 1), ("D2", 2), ("D3", 3))], "place bigint, route string, v double, n bigint")
    times = spark.createDataFrame([(0, 0, 2)], "rep bigint, place bigint, times bigint")
    far = lambda va, wa, vb, wb: float(abs((va * wa).sum() / wa.sum() - (vb * wb).sum() / wb.sum()))
    assert tuple(O.family_deltas(values, times, far).first()) == (0, 2.0, 0.0)
    ci = O.interval(spark.createDataFrame([(1.0, -1.0), (2.0, 1.0)], "a double, b double"), ["a", "b"]).withColumn("family", F.col("measure"))
    assert tuple(O.votes(ci, 1).first()) == (1, "supported") and tuple(O.votes(ci, 2).first()) == (1, "not_supported")
