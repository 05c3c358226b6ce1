"""Final scores, rank points, and roll-ups of raw totals to rates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: rank-point profiles, first to fourth place
PROFILES: dict[str, tuple[float, ...]] = {
    "reference_90_45": (90.0, 45.0, 0.0, -135.0),
    "default_6_4_2_0": (6.0, 4.0, 2.0, 0.0),
    "avoid4_norm": (15.0 / 7.0, 9.0 / 7.0, 3.0 / 7.0, -27.0 / 7.0),
    "top1_norm": (3.3, 0.3, -0.9, -2.7),
    "avoid4_raw": (4.0, 3.0, 2.0, -3.0),
    "top1_raw": (8.0, 3.0, 1.0, -2.0),
}


def parse_points(value: str | Sequence[float]) -> tuple[float, ...]:
    """Four finite numbers, from text or a sequence; anything else is an error."""
    parts = [float(x) for x in (value.split(",") if isinstance(value, str) else value) if str(x).strip()]
    if len(parts) != 4 or not all(map(math.isfinite, parts)):
        raise ValueError(f"rank points must be four finite numbers, got {value!r}")
    return tuple(parts)


def points(rank: Column, profile: Sequence[float]) -> Column:
    """Points of rank 1..4; null for other ranks."""
    return F.when(rank == 1, float(profile[0])).when(rank == 2, float(profile[1])).when(rank == 3, float(profile[2])).when(rank == 4, float(profile[3]))


def summarise_ranks(ranks: DataFrame, keys: list[str], rank: str, profile: Sequence[float]) -> DataFrame:
    """Games, rank counts, mean rank and mean points; null means without games."""
    r = F.col(rank)
    return ranks.groupBy(*keys).agg(
        F.count(r).alias("games"), *[F.count_if(r == k).alias(f"rank_{k}") for k in (1, 2, 3, 4)], F.round(F.avg(r), 6).alias("avg_rank"), F.round(F.avg(points(r, profile)), 6).alias("avg_rank_pt")
    )


def profile_points(ranks: DataFrame, keys: list[str], rank: str, names: Sequence[str]) -> DataFrame:
    """Mean points under several profiles, one row per group and profile."""
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("profile"), points(F.col(rank), PROFILES[n]).alias("pt")) for n in names]))
    return ranks.select(*keys, each.alias("x")).groupBy(*keys, "x.profile").agg(F.round(F.avg("x.pt"), 6).alias("avg_rank_pt"))


def final_scores(log: DataFrame, cluster: str, segment: str, order: str, base: Column, delta: Column, stick: Column, cost: float) -> DataFrame:
    """Scores at the end of the last segment: its base, all changes, less sticks.

    One aggregation per segment, then the last segment of the cluster; also
    without the cost of sticks, as an old audit has it.
    """
    per = log.groupBy(cluster, segment).agg(
        F.coalesce(F.max_by(base, F.when(base.isNotNull(), F.col(order))), F.lit(0.0)).alias("base"), F.coalesce(F.sum(delta), F.lit(0.0)).alias("delta"), F.count_if(stick).alias("sticks")
    )
    end = F.col("base") + F.col("delta")
    last = lambda c: F.round(F.max_by(c, F.col(segment)), 6)
    return per.groupBy(cluster).agg(F.max(segment).alias("segments"), last(end - F.lit(cost) * F.col("sticks")).alias("final"), last(end).alias("final_without_sticks"))


def rollup_rates(log: DataFrame, family: Column, cluster: str, win: Column, deal_in: Column, value: Column) -> DataFrame:
    """Raw totals per family first, rates from totals; rates are never averaged."""
    per = log.groupBy(family.alias("family"), cluster).agg(F.count("*").alias("rounds"), F.count_if(win).alias("wins"), F.count_if(deal_in).alias("deal_ins"), F.sum(F.when(win, value)).alias("won"))
    t = per.groupBy("family").agg(F.count("*").alias("games"), *[F.sum(c).alias(c) for c in ("rounds", "wins", "deal_ins", "won")])
    return t.select("family", "games", "rounds", "wins", F.round(F.try_divide("wins", "rounds"), 8).alias("win_rate"), F.round(F.try_divide("deal_ins", "rounds"), 8).alias("deal_in_rate"), F.round(F.try_divide("won", "wins"), 6).alias("mean_win"))
