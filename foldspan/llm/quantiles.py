"""Percentiles of huge columns from mergeable relative-error sketches.

A sketch is a stack of compactors; a value at level h stands for 2^h values.  A
full compactor sorts itself, keeps the sections next to its protected tail and
promotes every second value of the rest, the number of sections taken growing
with the trailing ones of its counter of compactions, so that the section next
to the tail is compacted exponentially rarely.  Rank errors are thereby
proportional to the distance from the protected end.  Two stacks are kept per
group, one for either end, and a percentile is read from the nearer one.

Sketches of partitions, files or days merge level by level, in any grouping.
They are built map-side (no raw value is shuffled after the choice of the
latest delivery) and merged as a stream, so a hot group costs one sketch per
task.  The coin of a compaction comes from the content, so a re-run task gives
the same sketch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldspan.runtime import cut, partitions_for

#: section size; rank error is about ``SPREAD / K`` of the distance to the end
K = 32
SECTIONS = 3
SPREAD = 0.1306
#: parts in which the sketches of one group are merged first
SPREAD_OVER = 16
PERCENTS = (0.001, 0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


class Req:
    """One stack of compactors protecting one end."""

    __slots__ = ("high", "levels", "state", "sections", "size")

    def __init__(self, high: bool, k: int = K):
        self.high = high
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state, self.sections, self.size = [0], [SECTIONS], [float(k)]

    def _section(self, h: int) -> int:
        return max(4, 2 * round(self.size[h] / 2))

    def _grow(self, like: int) -> None:
        self.levels.append(np.empty(0))
        self.state.append(0)
        self.sections.append(SECTIONS)
        self.size.append(float(like))

    def add(self, values: np.ndarray, k: int = K) -> None:
        self.levels[0] = np.concatenate([self.levels[0], values])
        self.compress(k)

    def compress(self, k: int = K) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) >= 2 * self.sections[h] * self._section(h):
                self._compact(h, k)
            h += 1

    def _compact(self, h: int, k: int) -> None:
        values, step = np.sort(self.levels[h]), self._section(h)
        ones = (~self.state[h] & (self.state[h] + 1)).bit_length() - 1
        take = min(ones + 1, self.sections[h])
        protected = self.sections[h] * step + (self.sections[h] - take) * step
        m = (len(values) - protected) // 2 * 2
        part, rest = (values[:m], values[m:]) if self.high else (values[len(values) - m :], values[: len(values) - m])
        coin = (int(np.float64(part.sum()).view(np.uint64)) * 0x9E3779B97F4A7C15 >> 61 ^ self.state[h]) & 1
        if h + 1 == len(self.levels):
            self._grow(k)
        self.levels[h] = rest
        self.levels[h + 1] = np.concatenate([self.levels[h + 1], part[coin::2]])
        self.state[h] += 1
        if self.state[h] >= 1 << (self.sections[h] - 1) and self.size[h] > 5.7:
            self.sections[h] *= 2
            self.size[h] /= 2**0.5

    def merge(self, other: Req, k: int = K) -> None:
        while len(self.levels) < len(other.levels):
            self._grow(k)
        for h in range(len(other.levels)):
            self.levels[h] = np.concatenate([self.levels[h], other.levels[h]])
            self.state[h] |= other.state[h]
            self.sections[h] = max(self.sections[h], other.sections[h])
            self.size[h] = min(self.size[h], other.size[h])
        self.compress(k)

    def quantiles(self, ps, n: int) -> list[float]:
        """The least value whose estimated rank reaches ``p * n``."""
        values = np.concatenate(self.levels)
        weight = np.repeat([1 << h for h in range(len(self.levels))], [len(x) for x in self.levels])
        order = np.argsort(values, kind="stable")
        cum = np.cumsum(weight[order])
        total = cum[-1]
        at = np.searchsorted(cum, np.maximum(1, np.ceil(np.asarray(ps) * total - 1e-9)))
        return values[order][np.minimum(at, len(values) - 1)].tolist()

    def pack(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels), *self.state, *self.sections], np.int64)
        return head.tobytes() + np.concatenate([self.size, *self.levels]).tobytes()

    @classmethod
    def unpack(cls, raw: bytes, high: bool) -> Req:
        out = cls(high)
        depth = int(np.frombuffer(raw, np.int64, 1)[0])
        head = np.frombuffer(raw, np.int64, 3 * depth, 8)
        body = np.frombuffer(raw, np.float64, -1, 8 * (1 + 3 * depth))
        out.state, out.sections, out.size = head[depth : 2 * depth].tolist(), head[2 * depth :].tolist(), body[:depth].tolist()
        cuts = np.cumsum(head[:depth])[:-1]
        out.levels = np.split(body[depth:], cuts)
        return out


class Sketch:
    """Both ends of one group, with exact counts and extremes."""

    __slots__ = ("n", "nulls", "odd", "lo", "hi", "low", "high")

    def __init__(self):
        self.n = self.nulls = self.odd = 0
        self.lo, self.hi = np.inf, -np.inf
        self.low, self.high = Req(False), Req(True)

    def add(self, values: np.ndarray, nulls: int) -> None:
        """Finite values are sketched; null and non-finite ones are counted."""
        good = values[np.isfinite(values)]
        self.nulls += nulls
        self.odd += len(values) - len(good) - nulls
        if len(good):
            self.n += len(good)
            self.lo, self.hi = min(self.lo, good.min()), max(self.hi, good.max())
            self.low.add(good)
            self.high.add(good)

    def merge(self, other: Sketch) -> None:
        self.n, self.nulls, self.odd = self.n + other.n, self.nulls + other.nulls, self.odd + other.odd
        self.lo, self.hi = min(self.lo, other.lo), max(self.hi, other.hi)
        self.low.merge(other.low)
        self.high.merge(other.high)

    def quantiles(self, ps) -> list[float | None]:
        if not self.n:
            return [None] * len(ps)
        low, high = self.low.quantiles(ps, self.n), self.high.quantiles(ps, self.n)
        return [min(max(a if p <= 0.5 else b, self.lo), self.hi) for p, a, b in zip(ps, low, high)]

    def row(self) -> tuple:
        return self.n, self.nulls, self.odd, float(self.lo), float(self.hi), self.low.pack(), self.high.pack()

    @classmethod
    def of(cls, row) -> Sketch:
        out = cls()
        out.n, out.nulls, out.odd, out.lo, out.hi = row[:5]
        out.low, out.high = Req.unpack(row[5], False), Req.unpack(row[6], True)
        return out


_STATE = "n bigint, nulls bigint, odd bigint, lo double, hi double, low binary, high binary"
_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
_NAMES = [f.split()[0] for f in _STATE.split(", ")]


def _keys_schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def _emit(keys: list[str], types: list, held: list[tuple[tuple, Sketch]]) -> pa.RecordBatch:
    rows = [s.row() for _, s in held]
    cols = [pa.array([k[i] for k, _ in held], t) for i, t in enumerate(types)]
    cols += [pa.array([r[i] for r in rows], t) for i, t in enumerate(_ARROW)]
    return pa.RecordBatch.from_arrays(cols, names=[*keys, *_NAMES])


def build(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """One sketch per group and task: ``keys`` and the sketch's columns.

    Null keys form groups of their own; an empty table gives no sketch.
    """
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, Sketch] = {}
        types: list = []
        for batch in batches:
            types = [c.type for c in batch.columns[:n]]
            codes = np.zeros(batch.num_rows, np.int64)
            parts = []
            for c in batch.columns[:n]:
                d = c.dictionary_encode(null_encoding="encode")
                parts.append(d.dictionary.to_pylist())
                codes = codes * max(1, len(parts[-1])) + d.indices.to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            column = batch.column(n)
            values = column.to_numpy(zero_copy_only=False).astype(np.float64)[order]
            null = column.is_null().to_numpy(zero_copy_only=False)[order]
            edges = np.flatnonzero(np.diff(codes[order], prepend=-1))
            for s, e in zip(edges, [*edges[1:], len(order)]):
                code, key = int(codes[order[s]]), []
                for p in reversed(parts):
                    code, at = divmod(code, max(1, len(p)))
                    key.append(p[at])
                held.setdefault(tuple(reversed(key)), Sketch()).add(values[s:e], int(null[s:e].sum()))
        items = list(held.items())
        for i in range(0, len(items), 500):
            yield _emit(keys, types, items[i : i + 500])

    return df.select(*keys, F.col(value).cast("double").alias("value_")).mapInArrow(run, f"{_keys_schema(df, keys)}, {_STATE}")


def combine(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches merged to coarser ``keys`` (of partitions, files or days).

    In two steps, so that a group with sketches from very many tasks or files is
    first merged in ``SPREAD_OVER`` parts side by side.
    """
    salted = sketches.withColumn("salt_", F.pmod(F.xxhash64("n", "lo", "hi"), F.lit(SPREAD_OVER)).cast("int"))
    return _combined(_combined(salted, [*keys, "salt_"]), keys)


def _combined(sketches: DataFrame, keys: list[str]) -> DataFrame:
    n = len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, types, out = None, None, [], []
        for batch in batches:
            types = [c.type for c in batch.columns[:n]]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:n] != now:
                    if held is not None:
                        out.append((now, held))
                    now, held = row[:n], Sketch.of(row[n:])
                else:
                    held.merge(Sketch.of(row[n:]))
                if len(out) >= 500:
                    yield _emit(keys, types, out)
                    out = []
        if held is not None:
            yield _emit(keys, types, [*out, (now, held)])

    width = partitions_for(sketches.sparkSession)
    near = sketches.select(*keys, *_NAMES).repartition(width, *keys).sortWithinPartitions(*keys, "n", "lo", "hi")
    return near.mapInArrow(run, f"{_keys_schema(sketches, keys)}, {_STATE}")


def percentiles(sketches: DataFrame, keys: list[str], ps=PERCENTS) -> DataFrame:
    """One row per group and percentile: ``keys, p, value, n, nulls, odd, lo, hi, max_rank_error``.

    ``odd`` counts non-finite values.  ``max_rank_error`` is three standard
    errors of the value's rank as a share of n: proportional to the distance of
    p from the nearer end, 0 while a sketch still holds every value.
    """
    schema = f"{_keys_schema(sketches, keys)}, p double, value double, n bigint, nulls bigint, odd bigint, lo double, hi double, max_rank_error double"
    k, m = len(keys), len(ps)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(zip(*(c.to_pylist() for c in batch.columns)))
            read = [Sketch.of(r[k:]) for r in rows]
            each = pa.array(np.repeat(np.arange(len(rows)), m))
            wide = batch.take(each)
            ends = [pa.array([r[k + i] if r[k] else None for r in rows], pa.float64()).take(each) for i in (3, 4)]
            error = [0.0 if len(s.low.levels) == 1 else 3 * SPREAD / K * min(p, 1 - p) for s in read for p in ps]
            got = [v for s in read for v in s.quantiles(ps)]
            cols = [*wide.columns[:k], pa.array(list(ps) * len(rows), pa.float64()), pa.array(got, pa.float64()), *wide.columns[k : k + 3], *ends, pa.array(error, pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=[*keys, "p", "value", *_NAMES[:5], "max_rank_error"])

    return sketches.select(*keys, *_NAMES).mapInArrow(run, schema)


def within_bounds(values_: DataFrame) -> DataFrame:
    """``metric, grp, p, n, within``: whether the exact rank of each percentile of all days lies within its bound.

    All values are counted against the percentiles of their group, of which there
    are a few dozen rows.
    """
    got = by_day_and_all(values_).where("level = 'all'").select("metric", "grp", "p", "value", "n", "max_rank_error")
    got = F.broadcast(cut(got))
    good = values_.where(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))).select("metric", "grp", F.col("value").alias("v"))
    ranks = good.join(got, ["metric", "grp"]).groupBy("metric", "grp", "p", "n", "max_rank_error").agg(F.count_if(F.col("v") < F.col("value")).alias("lt"), F.count_if(F.col("v") <= F.col("value")).alias("le"))
    off = F.greatest(F.lit(0.0), F.col("lt") / F.col("n") - F.col("p"), F.col("p") - F.col("le") / F.col("n"))
    return ranks.select("metric", "grp", "p", "n", (off <= F.col("max_rank_error") + 1 / F.col("n")).alias("within"))


def by_day_and_all(values_: DataFrame) -> DataFrame:
    """Percentiles per metric, group and day, and of all days together.

    ``level`` is ``day`` or ``all`` (``day`` null).  The sketches of all days are
    merged from those of the single days; no value is read for them again.
    """
    return by_part_and_all(values_, "day")


def by_part_and_all(values_: DataFrame, part: str) -> DataFrame:
    """The same for any column ``part`` that splits the values, such as files."""
    keys = ["metric", "grp", part]
    parts = cut(combine(build(values_, keys, "value"), keys))
    one = percentiles(parts, keys).withColumn("level", F.lit(part))
    total = percentiles(combine(parts, keys[:2]), keys[:2]).withColumn("level", F.lit("all")).withColumn(part, F.lit(None).cast(values_.schema[part].dataType))
    return one.unionByName(total).select("level", *keys, "p", "value", "n", "nulls", "odd", "lo", "hi", "max_rank_error")


def phase(column: Column) -> Column:
    """One spelling per phase: early, middle, late; ``unknown`` for null or blank."""
    p = F.lower(F.trim(column))
    return F.when(p.isNull() | (p == ""), "unknown").when(p == "mid", "middle").otherwise(p)


def newest(df: DataFrame, keys: list[str], group: Column, value: str, metric: str) -> DataFrame:
    """``metric, grp, day, value`` of each record's latest delivery."""
    body = F.struct(F.col(value).cast("double").alias("value"), group.alias("grp"), F.to_date("played_at").alias("day"))
    got = df.groupBy(*keys).agg(F.max_by(body, F.struct("loaded_at", F.xxhash64(value).alias("tie"))).alias("b"))
    return got.select(F.lit(metric).alias("metric"), F.col("b.grp").alias("grp"), F.col("b.day").alias("day"), F.col("b.value").alias("value"))


def values(decisions: DataFrame, snapshots: DataFrame, rows: DataFrame) -> DataFrame:
    """The three measured columns by phase and day.

    Every record counts once, by its latest delivery; values are taken as they
    are, finite outliers and odd signs included.
    """
    one = newest(decisions, ["obs_id"], phase(F.col("phase")), "target", "target")
    two = newest(snapshots, ["generation_seed", "seed_key", "seat", "kyoku_index", "decision_index"], phase(F.col("phase")), "margin", "margin")
    three = newest(rows, ["obs_id"], phase(F.col("phase")), "q_target", "q_target")
    return one.unionByName(two).unionByName(three)
