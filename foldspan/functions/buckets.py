"""Bucket expressions; nulls give null unless stated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def phase(segment, early: int = 4, middle: int = 8) -> Column:
    """``early`` below the first cut, ``middle`` below the second, else ``late``.

    The drift audit cuts at 2 and 6 instead; pass those cuts for it.
    """
    s = _c(segment)
    return F.when(s < early, "early").when(s < middle, "middle").when(s >= middle, "late")


def score_gap(gap) -> Column:
    g = _c(gap)
    return F.when(g >= 12000, "ahead_big").when(g >= 0, "ahead").when(g > -12000, "behind").when(g <= -12000, "behind_big")


def legal_count(n) -> Column:
    n = _c(n)
    return F.when(n <= 5, "1_5").when(n <= 10, "6_10").when(n > 10, "11_plus")


def shanten(value, ready: str = "tenpai_or_agari") -> Column:
    v = _c(value)
    return F.when(v <= 0, ready).when(v <= 2, v.cast("string")).when(v > 2, "3_plus")


def steps(value) -> Column:
    v = _c(value)
    return F.when(v <= 0, "0").when(v <= 4, "1_4").when(v <= 12, "5_12").when(v <= 24, "13_24").when(v > 24, "25_plus")


def margin(value) -> Column:
    v = _c(value)
    return F.when(v < 1, "lt_1").when(v < 3, "1_3").when(v >= 3, "ge_3")


def stage(value) -> Column:
    v = _c(value)
    return F.when(v <= 1, "east_front").when(v <= 3, "east_back").when(v <= 5, "south_front").when(v <= 7, "south_back").when(v > 7, "extension")


def histogram_bin(value, edges: list[float]) -> Column:
    """Label ``[lo,hi)`` over fixed edges; the last bin is open to infinity."""
    v, out = _c(value), None
    spans = [*zip(edges, edges[1:]), (edges[-1], None)]
    for lo, hi in spans:
        inside = (v >= lo) if hi is None else (v >= lo) & (v < hi)
        label = f"[{lo:g},{'inf' if hi is None else f'{hi:g}'})"
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def clip(value, lo: float = -1.0, hi: float = 1.0) -> Column:
    v = _c(value)  # least and greatest pass over nulls
    return F.when(v.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), v)))


def finite(value) -> Column:
    """The value, or null where it is NaN or infinite."""
    v = _c(value)
    return F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v)
