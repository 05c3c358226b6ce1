"""A varied subset of given size by max-sum dispersion.

Records are far apart when they differ in phase, action kind or shanten, with a
small part for the angle between their observations.  Every partition reduces
its rows to a core-set: of each combination of the three fields, the rows that
lie farthest apart.  Core-sets of core-sets are core-sets, so they are folded
level by level, and the last one, bounded by the asked size and the number of
combinations and not by the rows, is searched in one task: selected and unselected candidates are
swapped while the total pairwise distance grows and no covered combination is
lost.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.runtime import cut, partitions_for

#: rows kept of a combination, per core-set; more where the asked size needs them
KEEP = 6
#: replaced decisions that may be broadcast (16 bytes each); beyond, they are joined by a shuffle
FEW = 500_000
#: weights of the distance; they add up to 1
W_PHASE, W_KIND, W_SHANTEN, W_OBS = 0.25, 0.4, 0.25, 0.1
#: fixed values of the fields; anything else counts as unknown
PHASES = ("early", "middle", "late")
KINDS = ("discard", "pass", "pon", "reach", "agari", "chi_low", "chi_mid", "chi_high", "kan", "ryukyoku", "other")
SHANTEN = range(-1, 7)
DIM = 64


def _fields() -> list[Column]:
    """The three categories in one spelling; null or unreadable ones are ``unknown`` (shanten: null)."""
    named = lambda c, known, also: F.coalesce(F.when((t := _token(F.col(c))).isin(*known), t), *[F.when(t == a, b) for a, b in also.items()], F.lit("unknown"))
    return [
        named("phase", PHASES, {"mid": "middle"}).alias("phase"),
        named("action_kind", KINDS, {}).alias("action_kind"),
        F.when(F.col("shanten").between(min(SHANTEN), max(SHANTEN)), F.col("shanten")).cast("int").alias("shanten"),
    ]


def newest(decisions: DataFrame) -> DataFrame:
    """``obs_id, loaded_at, h, n``: the delivery of each decision that counts, without its vector.

    The latest one; of equally late ones that of the greater hash ``h`` of the
    content.  Only ids, times and hashes are shuffled.
    """
    light = decisions.where(F.col("obs_id").isNotNull()).select(F.col("obs_id").cast("bigint").alias("obs_id"), F.struct("loaded_at", _hash().alias("h")).alias("at"))
    return light.groupBy("obs_id").agg(F.max("at").alias("at"), F.min("at.h").alias("lo"), F.max("at.h").alias("hi")).select("obs_id", "at.*", (F.col("lo") != F.col("hi")).alias("differ"))


def _hash() -> Column:
    return F.xxhash64("log_id", "row_idx", *[F.col(c) for c in ("phase", "action_kind", "shanten")], "obs")


def canonical(decisions: DataFrame) -> DataFrame:
    """Decisions by their latest deliveries, with one spelling per category.

    Null or unreadable categories become ``unknown`` (shanten: null); that is a
    combination of its own.  Unusable observations become null.  Equal deliveries
    of one decision stay; those that a later, different one replaced are left out.
    Vectors are read once and not shuffled, as long as at most ``FEW`` decisions were replaced.
    """
    replaced = cut(newest(decisions).where("differ").select(F.col("obs_id").alias("id_"), F.col("h").alias("h_")))
    n = replaced.count()
    if n <= FEW:
        replaced = F.broadcast(replaced)
    obs = F.col("obs")
    usable = F.coalesce((F.size(obs) == DIM) & F.forall(obs, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    kept = decisions.where(F.col("obs_id").isNotNull()).select(F.col("obs_id").cast("bigint").alias("obs_id"), "log_id", "row_idx", *_fields(), F.when(usable, obs).alias("obs"), _hash().alias("h"))
    if not n:
        return kept.drop("h")
    return kept.join(replaced, F.col("obs_id") == F.col("id_"), "left").where(F.col("h_").isNull() | (F.col("h") == F.col("h_"))).drop("id_", "h_", "h")


def _token(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s-]+", "_")


def _code(batch: pa.RecordBatch) -> np.ndarray:
    at = lambda c, known: pc.fill_null(pc.index_in(batch.column(c), pa.array(known, batch.schema.field(c).type)), len(known)).to_numpy()
    phase, kind, shanten = at("phase", PHASES), at("action_kind", KINDS), at("shanten", list(SHANTEN))
    return (phase.astype(np.int64) * (len(KINDS) + 1) + kind) * (len(SHANTEN) + 1) + shanten


def _unit(batch: pa.RecordBatch) -> np.ndarray:
    obs, x = batch.column("obs"), np.zeros((batch.num_rows, DIM))
    held = pc.is_valid(obs).to_numpy(zero_copy_only=False)
    x[held] = obs.flatten().to_numpy(zero_copy_only=False).reshape(-1, DIM)
    x /= np.maximum(np.abs(x).max(1, keepdims=True, initial=0), 1e-30)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _spread(x: np.ndarray, keep: int) -> np.ndarray:
    """Farthest-first choice of ``keep`` rows; the first row starts it."""
    chosen = [0]
    gap = 1 - x @ x[0]
    gap[0] = -1
    while len(chosen) < min(keep, len(x)):
        i = int(gap.argmax())
        chosen.append(i)
        gap = np.minimum(gap, 1 - x @ x[i])
        gap[chosen] = -1
    return np.array(chosen)


def _reduce(keep: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            both = batch if held is None else pa.Table.from_batches([held, batch.cast(held.schema)]).combine_chunks().to_batches()[0]
            code, x, ids = _code(both), _unit(both), both.column("obs_id").to_numpy()
            order = np.lexsort((ids, code))
            once = np.ones(len(order), bool)  # equal deliveries of one decision
            once[1:] = (ids[order][1:] != ids[order][:-1]) | (code[order][1:] != code[order][:-1])
            order = order[once]
            edges = np.flatnonzero(np.diff(code[order], prepend=-1))
            groups = [order[s:e] for s, e in zip(edges, [*edges[1:], len(order)])]
            rows = np.concatenate([group[_spread(x[group], keep)] for group in groups])
            held = both.take(pa.array(rows))
        if held is not None:
            yield held

    return run


def swap_search(code: np.ndarray, x: np.ndarray, size: int) -> np.ndarray:
    """Rows of a subset of ``size`` with locally maximal total distance."""
    return search(code, x, size)[0]


def search(code: np.ndarray, x: np.ndarray, size: int) -> tuple[np.ndarray, float, float]:
    """The subset of ``swap_search``, and total distances of the start and of the result.

    Starts from one row per combination, most distant combinations first, and a
    greedy fill; then takes the best swap as long as one adds distance.  Rows
    that alone stand for their combination are not swapped out unless for the
    same combination; where ``size`` is too small for all combinations, none gets
    a second row.
    """
    n = len(code)
    s = code % (len(SHANTEN) + 1)
    kind = code // (len(SHANTEN) + 1) % (len(KINDS) + 1)
    phase = code // ((len(SHANTEN) + 1) * (len(KINDS) + 1))
    steps = np.abs(s[:, None] - s[None, :]) / len(SHANTEN)
    steps = np.where((s[:, None] == len(SHANTEN)) != (s[None, :] == len(SHANTEN)), 1.0, np.where(steps > 0, 0.5 + 0.5 * steps, 0.0))
    d = (W_PHASE * (phase[:, None] != phase[None, :]) + W_KIND * (kind[:, None] != kind[None, :]) + W_SHANTEN * steps + W_OBS * (1 - x @ x.T) / 2).astype(np.float32)
    np.fill_diagonal(d, 0)
    if size >= n:
        return np.arange(n), float(d.sum() / 2), float(d.sum() / 2)
    _, first = np.unique(code, return_index=True)
    chosen = list(first)
    if len(chosen) > size:  # more combinations than places: farthest first
        start = [int(d[np.ix_(first, first)].sum(1).argmax())]
        total = d[first][:, first[start[0]]].copy()
        while len(start) < size:
            total[start] = -1
            i = int(total.argmax())
            start.append(i)
            total = np.maximum(total, -1) + d[first][:, first[i]]
        chosen = [int(first[i]) for i in start]
    inside = np.zeros(n, bool)
    inside[chosen] = True
    total = d[:, inside].sum(1)
    while inside.sum() < size:
        i = int(np.where(inside, -1, total).argmax())
        inside[i] = True
        total += d[:, i]
    covers = len(first) <= size
    begun = float(total[inside].sum(dtype=np.float64) / 2)
    while True:  # every swap adds distance, so this ends
        ins, outs = np.flatnonzero(~inside), np.flatnonzero(inside)
        count = np.bincount(code[outs], minlength=int(code.max()) + 1)
        gain = total[ins][:, None] - total[outs][None, :] - d[np.ix_(ins, outs)]
        if covers:
            fixed = count[code[outs]] == 1
            gain[(code[ins][:, None] != code[outs][None, :]) & fixed[None, :]] = -1
        else:
            gain[(code[ins][:, None] != code[outs][None, :]) & (count[code[ins]] > 0)[:, None]] = -1
        best = int(gain.argmax())
        i, o = divmod(best, len(outs))
        if gain[i, o] <= 1e-4:
            break
        inside[ins[i]], inside[outs[o]] = True, False
        total += d[:, ins[i]] - d[:, outs[o]]
    rows = np.flatnonzero(inside)
    return rows, begun, float(d[np.ix_(rows, rows)].sum(dtype=np.float64) / 2)


_CHOSEN = "obs_id bigint, log_id string, row_idx int, phase string, action_kind string, shanten int, begun double, total double"


def _choose(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        all_ = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        code, ids = _code(all_), all_.column("obs_id").to_numpy()
        order = np.lexsort((ids, code))
        order = order[np.append(True, ids[order][1:] != ids[order][:-1])]
        all_, code = all_.take(pa.array(order)), code[order]
        rows, begun, total = search(code, _unit(all_), size)
        out = all_.take(pa.array(rows)).select(["obs_id", "log_id", "row_idx", "phase", "action_kind", "shanten"])
        yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.full(len(rows), begun)), pa.array(np.full(len(rows), total))], names=[*out.schema.names, "begun", "total"])

    return run


def level(counts: list[int], size: int, keep: int = KEEP) -> int:
    """Fewest rows per combination, ``keep`` at least, that add up to ``size`` or to all there are."""
    want = min(size, sum(counts))
    return max(keep, bisect_left(range(want), want, key=lambda k: sum(min(n, k) for n in counts)))


def varied(decisions: DataFrame, size: int = 600, keep: int = KEEP) -> DataFrame:
    """``size`` decisions: ``obs_id, log_id, row_idx, phase, action_kind, shanten, rows_alike``.

    ``rows_alike`` is the number of decisions of the same combination.  All
    combinations come out while ``size`` is at least their number.  A table of
    at most ``size`` decisions comes out whole, an empty one gives no rows.  Null
    ids are left out, nulls elsewhere kept.

    The combinations, of which there are a few hundred at most, are counted first:
    where ``keep`` rows of each do not reach ``size``, core-sets keep evenly more.
    The last task holds the distances among at most ``size`` rows and one per
    combination, or ``keep`` per combination if that is more.
    """
    counted = cut(combinations(decisions))
    alike = F.broadcast(counted.withColumnRenamed("n", "rows_alike"))  # as many rows as there are combinations
    same = ["phase", "action_kind"]
    chosen = _chosen(decisions, counted, size, keep).drop("begun", "total").withColumnRenamed("shanten", "s")
    return chosen.join(alike, [*[chosen[c] == alike[c] for c in same], chosen["s"].eqNullSafe(alike["shanten"])]).select("obs_id", "log_id", "row_idx", *[chosen[c] for c in same], F.col("s").alias("shanten"), "rows_alike")


def _chosen(decisions: DataFrame, counted: DataFrame, size: int, keep: int) -> DataFrame:
    keep = level([r.n for r in counted.collect()], size, keep)
    rows = canonical(decisions)
    core = rows.mapInArrow(_reduce(keep), rows.schema)
    # folding by combination spreads the second level; its result has at most combinations x keep rows
    width = partitions_for(decisions.sparkSession)
    core = core.repartition(width, "phase", "action_kind", "shanten").mapInArrow(_reduce(keep), rows.schema)
    return core.repartition(1).mapInArrow(_choose(size), _CHOSEN)


def checked(decisions: DataFrame, size: int = 600, keep: int = KEEP) -> DataFrame:
    """One row on the chosen subset: ``rows, combinations, repeated, gained``.

    ``gained``: the local search ended at no less total distance than its greedy start.
    """
    chosen = _chosen(decisions, cut(combinations(decisions)), size, keep)
    return chosen.agg(F.count("*").alias("rows"), F.count_distinct("phase", "action_kind", F.coalesce("shanten", F.lit(99))).alias("combinations"), (F.count("*") - F.count_distinct("obs_id")).alias("repeated"), F.coalesce(F.min("total") >= F.max("begun") - 1e-3, F.lit(True)).alias("gained"))


def combinations(decisions: DataFrame) -> DataFrame:
    """``phase, action_kind, shanten, n``: the combinations there are, each decision by its latest delivery."""
    body = F.struct(*_fields()).alias("body")
    kept = decisions.where(F.col("obs_id").isNotNull()).select(F.col("obs_id").cast("bigint").alias("obs_id"), F.struct("loaded_at", _hash().alias("h")).alias("at"), body)
    newest = kept.groupBy("obs_id").agg(F.max(F.struct("at", "body")).alias("m"))
    return newest.groupBy("m.body.phase", "m.body.action_kind", "m.body.shanten").agg(F.count("*").alias("n"))
