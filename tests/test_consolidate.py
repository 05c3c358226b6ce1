"""Consolidation of small files against a plain walk over the lines."""

import json
import random
import re
from urllib.parse import unquote

from foldspan.operators import consolidate as C

JOBS = "file_id bigint, manifest_id bigint, shard string, src_path string, body string, size_bytes bigint, log string, line string, event_index int"


def canonical(p):
    p = unquote(re.sub(r"^file:(//(?=/))?", "", p.strip())).replace("\\", "/").strip()
    out = []
    for x in p.split("/"):
        if x == "..":
            out and out.pop()
        elif x not in ("", "."):
            out.append(x)
    return "/" + "/".join(out)


def brute(rows):
    found = []
    for r in rows:
        if r[3] is None or r[4] is None:
            continue
        for i, line in enumerate(re.split("\r\n|\n|\r", r[4]), 1):
            try:
                e = json.loads(line)
                found.append((canonical(r[3]), int(e["event_index"]), r[0], i))
            except (ValueError, KeyError, TypeError):
                pass
    best = {}
    for f in found:
        best[f[:2]] = min(best.get(f[:2], f[2:]), f[2:])
    return {f[2:] for f in found if best[f[:2]] != f[2:]}, len(best), len(found)


def jobs(seed, n=60):
    rnd = random.Random(seed)
    spell = [lambda p: p, lambda p: "file://" + p, lambda p: p.replace("/", "\\"), lambda p: p.replace("_", "%5F") + "  ", lambda p: p.replace("/a/", "/a/./x/../"), lambda p: p.replace("/a/", "//a//")]
    rows = []
    for f in range(n):
        log = 0 if rnd.random() < 0.4 else rnd.randrange(6)
        lines = []
        for _ in range(rnd.randrange(12)):
            i = rnd.randrange(8)
            e = {"event_index": i, "type": "dahai", "pai": "1m"}
            if rnd.random() < 0.2:
                e = dict(reversed(list(e.items())))
            text = json.dumps(e)
            lines.append(rnd.choice([text, text, text, "", text[:-4], '{"type": "x"}', "  " + text + " ", "null", "[1]"]))
        body = rnd.choice(["\n", "\r\n"]).join(lines) + rnd.choice(["", "\n"])
        rows.append((f, f % 3, rnd.choice(["s", None]), rnd.choice(spell)(f"/lake/a/d{log % 2}/log_{log // 2}.mjson"), body if rnd.random() > 0.05 else rnd.choice([None, ""]), len(body), "clash", None, 1))
    rows.append((1000, None, None, None, '{"event_index": 1}', 1, None, None, None))
    return rows


def test_repeats_equal_brute_force(spark):
    for seed, ranges in ((1, 1), (2, 5), (3, 40)):
        rows = jobs(seed)
        want, kept, _ = brute(rows)
        df = spark.createDataFrame(rows, JOBS)
        got = [tuple(r) for r in C.repeated_lines(df, ranges).collect()]
        assert len(got) == len(set(got)) and set(got) == want
        records, files = C.consolidated(df, target_bytes=400, ranges=ranges)
        r = records.collect()
        assert len(r) == kept == len({(x["log"], x.event_index) for x in r})
        meta = files.collect()
        assert sum(x.n_records for x in meta) == kept and sum(x.n_copies for x in meta) == len(want)
        assert sum(x.n_bytes for x in meta) == sum(len(x["line"]) + 1 for x in r)
        by = sorted(meta, key=lambda x: (x.first_log, x.first_index))
        assert all((a.last_log, a.last_index) <= (b.first_log, b.first_index) for a, b in zip(by, by[1:]))


def test_one_hot_record_is_split(spark):
    body = "\n".join(['{"event_index": 5, "type": "t"}'] * 300)
    rows = [(f, 0, "s", "/l/hot.mjson", body, 1, None, None, None) for f in range(20)]
    got = C.repeated_lines(spark.createDataFrame(rows, JOBS).repartition(4), 16)
    assert got.count() == 20 * 300 - 1 and got.where("file_id = 0 and line_no = 1").count() == 0


def test_empty_table_and_writer(spark, tmp_path):
    empty = spark.createDataFrame([], JOBS)
    assert C.repeated_lines(empty).count() == 0
    records, files = C.consolidated(empty)
    assert records.count() == 0 and files.count() == 0
    rows = jobs(7)
    files = C.write_consolidated(spark.createDataFrame(rows, JOBS), str(tmp_path / "out"), 500)
    back = spark.read.parquet(str(tmp_path / "out/data"))
    assert back.count() == brute(rows)[1] == files.groupBy().sum("n_records").first()[0]


def test_manifest_check(spark):
    m = spark.createDataFrame([(0, ["/lake/a/d0/log_0.mjson", None, "/none"], {"s": 3, "t": None}), (1, None, None)], "manifest_id bigint, files array<string>, shard_file_counts map<string,bigint>")
    j = spark.createDataFrame([(1, 0, "s", "file:///lake/a/d0/log%5F0.mjson", "", 0, None, None, None), (2, 0, None, "/lake/a/d0/log_9.mjson", "", 0, None, None, None)], JOBS)
    got = {r.manifest_id: r for r in C.manifest_check(m, j).collect()}
    assert (got[0].listed, got[0].shard_total, got[0].held, got[0].missing, got[0].unlisted) == (3, 3, 2, 1, 1)
    assert (got[1].listed, got[1].shard_total, got[1].held) == (None, None, 0)


def test_files_follow_the_bytes(spark):
    body = lambda i: "".join(f'{{"event_index": {k}, "type": "x{i:04d}"}}\n' for k in range(10))
    jobs = spark.createDataFrame([(i, f"logs/{i:04d}.json", body(i)) for i in range(200)], "file_id bigint, src_path string, body string")
    assert [r.n_records for r in C.consolidated(jobs)[1].collect()] == [2000]
    total = sum(len(body(i)) for i in range(200))
    files = C.consolidated(jobs, target_bytes=total // 20)[1].collect()
    assert sum(r.n_records for r in files) == 2000 and 20 <= len(files) <= 42
    assert C.consolidated(jobs.limit(0))[0].count() == 0


def test_pieces_merge_like_one_sort():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(5)
    pieces = sorted((rnd.choice("ab"), sorted(rnd.randrange(30) for _ in range(rnd.randrange(1, 9))), f) for f in range(80))
    pieces.sort(key=lambda p: (p[0], p[1][0], p[2]))
    names = [f.split()[0] for f in C._PIECE.split(", ")]
    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([0] * len(part), pa.int32()), pa.array([p[0] for p in part]), pa.array([p[1][0] for p in part], pa.int64()), pa.array([p[2] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.list_(pa.int64())), pa.array([list(range(len(p[1]))) for p in part], pa.list_(pa.int32())), pa.array([[str(i) for i in p[1]] for p in part], pa.list_(pa.string()))],
            names=names,
        )
        for part in (pieces[s : s + 7] for s in range(0, 80, 7))
    ]
    got = [tuple(r.values()) for b in C._merged(iter(batches)) for r in b.to_pylist()]
    assert got == sorted((log, i, f, n, str(i)) for log, idx, f in pieces for n, i in enumerate(idx))
    assert np.diff([b.num_rows for b in C._merged(iter(batches))]).size  # pieces flow out before the last batch


def test_runs_keep_their_order_and_odd_numbers(spark):
    body = "\n".join(['{"event_index": 3}', '{"event_index": "1"}', '{"event_index": 2.0}', '{"event_index": 2.5}', '{"event_index": true}', '{"event_index": NaN}', '{"event_index": 9} x', '[{"event_index": 9}]'])
    row = C.runs(spark.createDataFrame([(1, "/a", body), (2, "/a", '{"event_index": 1}\r\n{"event_index": 1}'), (3, None, body), (4, "/a", None), (5, "/a", "")], "file_id bigint, src_path string, body string")).collect()
    assert [(r.file_id, r.in_order, r.idx, r.nos) for r in row] == [(1, False, [1, 2, 3], [2, 3, 1]), (2, True, [1, 1], [1, 2])]
