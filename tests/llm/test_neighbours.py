"""Nearest vectors against brute force."""

import datetime

import numpy as np
import pytest

from foldspan.llm import neighbours as N

SCHEMA = "obs_id bigint, obs array<float>, loaded_at timestamp, id string, g int, vec string, class int"
T0 = datetime.datetime(2025, 1, 1)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def planted():
    rng = np.random.default_rng(1)
    base = rng.standard_normal((2500, 64))
    near = base[:300] + 0.12 * rng.standard_normal((300, 64))
    nearer = base[:120] + 0.05 * rng.standard_normal((120, 64))
    x = np.vstack([base, near, nearer]).astype(np.float32)
    return np.arange(len(x)) * 3 + 1, x


def truth(ids, x, floor=0.9, k=5):
    s = unit(x.astype(np.float64))
    d = s @ s.T
    np.fill_diagonal(d, -9)
    pairs = set()
    for i in range(len(x)):
        for j in np.lexsort((ids, -d[i]))[:k]:
            if d[i, j] >= floor:
                pairs.add((min(ids[i], ids[j]), max(ids[i], ids[j])))
    return pairs


def frame(spark, ids, x, extra=()):
    return spark.createDataFrame([(int(i), v.tolist(), T0, "c", 1, "v", 2) for i, v in zip(ids, x)] + list(extra), SCHEMA)


def test_pairs(spark, planted):
    ids, x = planted
    odd = [(9001, None, T0, None, None, None, None), (9002, [1.0] * 32, T0, None, None, None, None), (9003, [0.0] * 64, T0, None, None, None, None), (9004, [float("nan")] + [1.0] * 63, T0, None, None, None, None), (9005, [None] + [1.0] * 63, T0, None, None, None, None), (None, x[0].tolist(), T0, None, None, None, None), (9006, [float("inf")] + [1.0] * 63, T0, None, None, None, None)]
    again = [(int(ids[0]), x[0].tolist(), T0 + datetime.timedelta(hours=1), None, None, None, None), (int(ids[700]), (-x[700]).tolist(), T0 - datetime.timedelta(hours=1), None, None, None, None)]
    got = [tuple(r) for r in N.similar_pairs(frame(spark, ids, x, odd + again)).collect()]
    want = truth(ids, x)
    assert len(got) == len(set(got)) and all(a < b for a, b in got)
    assert len(want & set(got)) >= 0.97 * len(want) and len(set(got) - want) <= 0.01 * len(want)


def test_latest_delivery_counts(spark, planted):
    ids, x = planted
    moved = [(int(ids[2500]), (-x[2500]).tolist(), T0 + datetime.timedelta(days=1), None, None, None, None)]
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x, moved)).collect()}
    assert not any(ids[2500] in p for p in got)


def test_many_exact_copies(spark, planted):
    ids, x = planted
    copies = np.arange(50_000, 51_200)
    got = {tuple(r) for r in N.similar_pairs(frame(spark, np.concatenate([ids, copies]), np.vstack([x, np.repeat(x[1000:1001], len(copies), 0)]))).collect()}
    klass = np.concatenate([[ids[1000]], copies])
    of_class = {p for p in got if p[0] in set(klass) or p[1] in set(klass)}
    want = {(min(c, int(o)), max(c, int(o))) for c in map(int, klass) for o in [i for i in klass[:7] if i != c][:5]}
    assert of_class == want


def test_queries_against_all(spark, planted):
    ids, x = planted
    got = N.nearest(frame(spark, ids, x), k=5, every=10).collect()
    s = unit(x.astype(np.float64))
    hits = total = 0
    by = {}
    for r in got:
        by.setdefault(r.obs_id, set()).add(r.neighbour_id)
    asked = [i for i, v in enumerate(ids) if v % 10 == 0]
    assert set(by) == {int(ids[i]) for i in asked}
    for i in asked:
        d = s @ s[i]
        d[i] = -9
        want = {int(ids[j]) for j in np.argsort(-d)[:5]}
        hits, total = hits + len(want & by[int(ids[i])]), total + 5
    assert hits / total >= 0.9


def test_small_and_empty(spark):
    assert N.similar_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    one = frame(spark, [1], np.ones((1, 64)))
    assert N.similar_pairs(one).count() == 0
    three = frame(spark, [1, 2, 3], np.vstack([np.ones((2, 64)), -np.ones((1, 64))]))
    assert [tuple(r) for r in N.similar_pairs(three).collect()] == [(1, 2)]


def test_walk_pops_the_best_open_node(planted):
    import heapq

    x = unit(planted[1]).astype(np.float32)
    tree = N.fit(x, 300_000, leaf_rows=400)
    assert len(tree.centres) > 300
    walked = tree.visits(x[:50], 12)
    for row, leaves in zip(x[:50], walked):
        queue, out = [(-float(row @ tree.centres[n]), n) for n in range(tree.roots)], []
        heapq.heapify(queue)
        while len(out) < 12:
            node = heapq.heappop(queue)[1]
            if tree.leaf[node] >= 0:
                out.append(tree.leaf[node])
            for kid in range(tree.first[node], tree.first[node] + tree.count[node]):
                heapq.heappush(queue, (-float(row @ tree.centres[kid]), kid))
        assert out == list(leaves)


@pytest.mark.parametrize("floor", [0.9, None])
def test_dense_region_needs_little_memory(floor):
    import tracemalloc

    rng = np.random.default_rng(2)
    x = unit(np.ones((8000, 64)) + 0.02 * rng.standard_normal((8000, 64))).astype(np.float16)
    x[100:140] = x[0]
    tree = N._Subtree(5, floor)
    ids, leaf = rng.permutation(8000).astype(np.int64), np.repeat(np.arange(4), 2000)
    tree.add(ids, np.zeros(8000, np.int64), leaf, x, np.tile(np.arange(4, dtype=np.uint32), 8000), np.full(8000, 4))
    tracemalloc.start()
    tree.build()
    a, b, s = (np.concatenate(p) for p in list(zip(*tree.own()))[1:])
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()
    assert len(a) == 40_000
    full, row = N._full(x), {int(i): r for r, i in enumerate(ids)}
    for q in ids[[0, 1, 120, 139, 5000]]:
        near = np.round((full @ full[row[int(q)]]).astype(np.float64), 6)
        near[row[int(q)]] = -1
        assert set(b[a == q]) == set(ids[np.lexsort((ids, -near))[:5]])


def test_copies_are_folded_over_batches():
    folder, rng = N._Copies(5), np.random.default_rng(3)
    half = np.tile(rng.standard_normal((1, 64)).astype(np.float16), (4, 1))
    kept, rest = [], []
    for first in (40, 80, 20, 60, 20):
        ids = np.arange(first, first + 4)
        keep, klass = folder.fold(ids, half)
        kept += list(ids[keep])
        rest += list(ids[~keep & (klass != 0)])
    assert kept == [40, 41, 42, 43, 80, 81, 20, 21, 22, 23] and rest == [82, 83, 60, 61, 62, 63]


def test_subtrees_in_shards(spark, planted, monkeypatch):
    ids, x = planted
    monkeypatch.setattr(N, "GROUP_ROWS", 150)
    tree = N.fit(unit(x).astype(np.float32), len(x), leaf_rows=1000, group_rows=3000)
    assert tree.shards.max() > 1
    got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x)).collect()}
    want = truth(ids, x)
    assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)


def test_recall_sees_misses(spark, planted):
    ids, x = planted
    df = frame(spark, ids, x)
    found = N.nearest(df, k=5, every=10)
    assert tuple(N.recall(df, found, every=10).first()) == (sum(i % 10 == 0 for i in ids), True)
    assert not N.recall(df, found.where("place = 1"), every=10).first().enough
    empty = spark.createDataFrame([], SCHEMA)
    assert tuple(N.recall(empty, N.nearest(empty)).first()) == (0, True)


def test_work_per_row_stays_flat_as_rows_grow():
    rng = np.random.default_rng(4)
    x = unit(rng.standard_normal((40_000, 64)) * np.linspace(1.8, 0.9, 64)).astype(np.float32)
    met = []
    for rows in (1_000_000, 20_000_000):
        aim = min(N.GROUP_ROWS // 2, rows // 8)
        tree = N.fit(x, rows, leaf_rows=aim, group_rows=aim)
        margin, most = N.calibrate_meeting(tree, x, 0.9, 5, 0.98)
        row, leaf = tree.spread(x[:5000], margin, most)
        assert np.array_equal(leaf[np.searchsorted(row, np.arange(5000))] >= 0, np.ones(5000, bool)) and len(np.unique(row)) == 5000
        met.append(len(row) / 5000)
    assert met[1] <= 2.5 * met[0]  # 20 x the rows; visits grew in proportion
    inside, margin, most = N.cells(x[:20_000], 300_000, 0.9, 5, 0.99)
    row, _ = inside.spread(x[:5000], margin, most)
    assert len(row) / 5000 <= inside.roots / 10


def test_pairs_in_subtrees_with_cells_and_shards(spark, planted, monkeypatch):
    ids, x = planted
    want = truth(ids, x)
    for group_rows, shards in ((1500, 1), (1500, 3)):
        monkeypatch.setattr(N, "GROUP_ROWS", group_rows)
        monkeypatch.setattr(N, "WHOLE_ROWS", 50)
        monkeypatch.setattr(N, "CELL_ROWS", 40)
        fit = N.fit

        def sharded(*args, **named):
            tree = fit(*args, **named)
            tree.shards = np.full(len(tree.shards), shards)
            tree.base = np.cumsum(tree.shards) - tree.shards
            return tree

        with monkeypatch.context() as m:
            m.setattr(N, "fit", sharded)
            got = {tuple(r) for r in N.similar_pairs(frame(spark, ids, x)).collect()}
        assert len(want & got) >= 0.97 * len(want) and len(got - want) <= 0.01 * len(want)
