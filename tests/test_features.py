"""Planes and scalars of hand-made snapshots."""

import numpy as np

from foldspan.operators import features as X


def snap(**k):
    d = lambda p, t=False, r=False: {"pai": p, "tsumogiri": t, "reach_declared": r}
    base = {
        "actor": 1, "hand": ["1m", "2m", "3m", "5pr", "5p", "5p", "E", "E", "7s", "8s"], "tsumo_pai": None, "dora_markers": ["4p"], "bakaze": "S", "kyoku": 4, "honba": 1, "kyotaku": 2, "oya": 1, "scores": [30000, 20000, 26000, 24000],
        "discards": [[d("9m"), d("9m", True), None, d("1p", False, True)], [d("N")], None, [d("2s", True)]], "melds": [None, [{"type": "pon", "pai": "C", "pai_raw": "C", "consumed": ["C", "C"], "target": 0}], [], [{"type": "chi", "pai": "1s", "pai_raw": None, "consumed": ["2s", "3s"], "target": 2}]],
        "reached": [True, False], "furiten": None,
    }
    return base | k


def test_planes():
    p, x = X.encode_rows([snap(), snap(hand=None, discards=None, melds=None, dora_markers=None, scores=None, actor=None, bakaze=None, kyoku=None, honba=None, kyotaku=None, oya=None, reached=None)])
    on = lambda r, c: np.flatnonzero(p[r, c]).tolist()
    assert on(0, 0) == [0, 1, 2, 13, 24, 25, 27] and on(0, 1) == [13, 27] and on(0, 2) == [13] and on(0, 3) == []
    assert on(0, X.OWN_CALLS) == [33] and on(0, X.OTHERS_RIVER) == [9] and on(0, X.OTHERS_RIVER + 1) == [8, 9] and on(0, X.OTHERS_CALLS + 2) == [18, 19, 20]
    assert on(0, X.OWN_RIVER) == [30] and on(0, X.DORA) == [13] and on(0, X.RIVER_PARTS) == [8, 9] and on(0, X.RIVER_PARTS + 24) == [30]
    assert on(0, X.SAFE) == [19, 30] and on(0, X.WAITS) == [23, 26] and on(0, X.DRAWS) == []
    assert p[0, X.SEEN, 13] == 0.75 and p[0, X.SEEN, 12] == 0.25 and p[0, X.SEEN, 8] == 0.5
    np.testing.assert_allclose(x[0, [1, 3, 4, 5, 6, 7, 8, 9, 11, 12, 13, 16, 19, 23, 24, 27, 45, 48, 49]], [1, 1, 0.125, 0.25, 0.4, 1, 0, 2 / 34, 0.25, 0, 1, 0.25, 1, 0.25, 10000 / 30000, 0, 1 / 3, 1, 1], rtol=1e-6)
    assert x[0, 28] == np.float32(0.4) and x[0, 29] == np.float32(5 / 8) and x[0, 55] == 1
    assert not p[1].any() and x[1, 0] == 1 and x[1, 8] == 1 and np.isfinite(x).all()


def test_table(spark, tiny):
    s = spark.read.parquet(f"{tiny}/snapshots.parquet")
    rows = X.encode(s).collect()
    assert len(rows) == s.count() and all(len(r.planes) == 57 * 34 and len(r.scalars) == 56 for r in rows)
    assert X.encode(s.limit(0)).count() == 0
