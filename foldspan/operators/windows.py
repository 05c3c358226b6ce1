"""Ordered analytics over clusters: segments, flags, history, returns.

A cluster is a game or a user; within it rows are ordered by ``order``.  Windows
partition by cluster (and segment), the unit whose order carries the meaning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FIRST = Window.unboundedPreceding
LAST = Window.unboundedFollowing


def segment_ids(df: DataFrame, cluster: str, order: str, opens: Column, out: str = "segment") -> DataFrame:
    """Running count of opening markers, from 0; rows before the first one get -1."""
    w = Window.partitionBy(cluster).orderBy(order)
    return df.withColumn(out, (F.sum(F.when(opens, 1).otherwise(0)).over(w) - 1).cast("bigint"))


def running_sums(df: DataFrame, cluster: str, order: list[str], sums: dict[str, Column], ranges: int) -> DataFrame:
    """Running sums per cluster, for clusters too large for one task.

    Rows are range-sorted by cluster and order, so a hot cluster is cut into many
    ranges; sums run within a range and are shifted by the totals of the ranges
    before.  ``order`` must be unique within a cluster.  Null summands count as 0.
    """
    from foldspan.runtime import cut

    ranged = df.repartitionByRange(ranges, cluster, *order).withColumn("part_", F.spark_partition_id())
    local = Window.partitionBy("part_", cluster).orderBy(*order)
    held = cut(ranged).withColumns({n: F.coalesce(c, F.lit(0)) for n, c in sums.items()})
    totals = held.groupBy(cluster, "part_").agg(*[F.sum(n).alias(n) for n in sums])
    before = Window.partitionBy(cluster).orderBy("part_").rowsBetween(FIRST, -1)
    shift = totals.select(F.col(cluster).alias("c_"), F.col("part_").alias("p_"), *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"s_{n}") for n in sums])
    run = held.withColumns({n: F.sum(n).over(local) for n in sums})
    out = run.join(shift, F.col(cluster).eqNullSafe(F.col("c_")) & (F.col("part_") == F.col("p_")))
    return out.select(*[c for c in df.columns if c not in sums], *[(F.col(n) + F.col(f"s_{n}")).alias(n) for n in sums])


def sticky_flag(df: DataFrame, keys: list[str], order: str, raised: Column, out: str) -> DataFrame:
    """True for rows after the one that raised the flag, within the keys."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(FIRST, -1)
    return df.withColumn(out, F.coalesce(F.max(raised).over(w), F.lit(False)))


def steps_to_done(df: DataFrame, cluster: str, order: str, done: Column, counts: Column, out: str) -> DataFrame:
    """Counting rows from here to the end of the episode; the closing row has 0.

    An episode ends with a ``done`` row or with the cluster; that last row is 0.
    """
    back = Window.partitionBy(cluster).orderBy(F.desc(order))
    df = df.withColumn("ep_", F.sum(F.when(done, 1).otherwise(0)).over(back)).withColumn("end_", done | (F.row_number().over(back) == 1))
    w = Window.partitionBy(cluster, "ep_").orderBy(F.desc(order))
    return df.withColumn(out, F.sum(F.when(~F.col("end_") & counts, 1).otherwise(0)).over(w).cast("bigint")).drop("ep_", "end_")


def history(df: DataFrame, keys: list[str], order: str, token: Column, pad: Column, size: int, out: str) -> DataFrame:
    """The ``size`` tokens before each row, oldest first, padded on the left."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1)
    seen = F.collect_list(token).over(w)
    return df.withColumn("h_", seen).withColumn(out, F.concat(F.array_repeat(pad, F.lit(size) - F.size("h_")), F.col("h_"))).drop("h_")


def recency(df: DataFrame, keys: list[str], order: str, kind: str, kinds: list[str], horizon: int = 16) -> DataFrame:
    """``rec_<kind>``: ``max(0, 1 - distance / horizon)`` to the last row of each kind.

    Distance counts rows; 1 is the row just before; a kind not seen yet gives 0.
    """
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(FIRST, -1)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    df = df.withColumn("at_", place)
    for k in kinds:
        last = F.last(F.when(F.col(kind) == k, F.col("at_")), ignorenulls=True).over(before)
        df = df.withColumn(f"rec_{k}", F.when(last.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), 1 - F.least(F.col("at_") - last, F.lit(horizon)) / float(horizon))))
    return df.drop("at_")


def running_counts(df: DataFrame, keys: list[str], order: str, kind: str, caps: dict[str, float]) -> DataFrame:
    """``cnt_<kind>``: rows of each kind before this one, over its cap, at most 1."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(FIRST, -1)
    for k, cap in caps.items():
        df = df.withColumn(f"cnt_{k}", F.least(F.lit(1.0), F.coalesce(F.sum(F.when(F.col(kind) == k, 1).otherwise(0)).over(w), F.lit(0)) / cap))
    return df


def discounted(df: DataFrame, keys: list[str], order: str, final: Column, gamma: float, out: str) -> DataFrame:
    """``gamma^(last - place) * final``, the segment's outcome brought back to each row."""
    whole = Window.partitionBy(*keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    df = df.withColumn("at_", place).withColumn("n_", F.count("*").over(whole))
    end = F.max_by(final, F.col(order)).over(whole)
    return df.withColumn(out, F.pow(F.lit(gamma), (F.col("n_") - F.col("at_")).cast("double")) * end).drop("at_", "n_")


def asof(df: DataFrame, keys: list[str], order: str, match: Column, value: Column, out: str) -> DataFrame:
    """The value of the latest matching row before each row; null if there is none."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(FIRST, -1)
    return df.withColumn(out, F.last(F.when(match, value), ignorenulls=True).over(w))


def next_match(df: DataFrame, keys: list[str], order: str, match: Column, value: Column, out: str) -> DataFrame:
    """The value of the next matching row after each row."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, LAST)
    return df.withColumn(out, F.first(F.when(match, value), ignorenulls=True).over(w))


def lookahead(df: DataFrame, keys: list[str], order: str, anchor: Column, reach: int, ident: Column) -> DataFrame:
    """One row per anchor and each of the next ``reach`` rows: ``anchor_id, target_id, offset``.

    Rows met from several anchors come out once per anchor.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1, reach)
    ahead = df.withColumn("next_", F.collect_list(ident).over(w)).where(anchor)
    return ahead.select(*keys, ident.alias("anchor_id"), F.posexplode("next_").alias("p_", "target_id")).select(*keys, "anchor_id", "target_id", (F.col("p_") + 1).alias("offset"))


def numbered(df: DataFrame, keys: list[str], order: str, counts: Column, out: str) -> DataFrame:
    """Running number of counted rows from 0; rows that do not count get null."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.when(counts, F.sum(F.when(counts, 1).otherwise(0)).over(w) - 1).cast("bigint"))


def ranks(df: DataFrame, game: list[str], score: str, seat: str, dealer: Column | None = None, out: str = "rank") -> DataFrame:
    """Rank 1.. by score; ties by seat, or by distance from the dealer's seat."""
    tie = F.col(seat) if dealer is None else F.pmod(F.col(seat) - dealer, F.lit(4))
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*game).orderBy(F.desc(score), tie)))


def rank_in_array(scores: Column, seat: Column) -> Column:
    """Rank by counting: one, plus greater scores, plus equal ones at lower seats."""
    own = F.get(scores, seat)
    worse = F.filter(scores, lambda s, i: (s > own) | ((s == own) & (i < seat)))
    return F.size(worse) + 1


def gap_to_best_other(scores: Column, seat: Column) -> Column:
    return F.get(scores, seat) - F.array_max(F.filter(scores, lambda s, i: i != seat))


def prefixes(df: DataFrame, keys: list[str], order: str, value: str, out: str = "prefix") -> DataFrame:
    """Each row with the values of its cluster up to itself.

    A cluster of n rows gives n lists of up to n values, so it is for clusters of
    bounded length, as the segments of one game are.
    """
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(FIRST, 0)
    return df.withColumn(out, F.collect_list(value).over(w))


def budgeted(df: DataFrame, cluster: list[str], segment: str, order: str, u: Column, p: float = 0.25, per_segment: int = 1, per_cluster: int = 8) -> DataFrame:
    """``reason`` of each eligible row under a budget per segment and per cluster.

    A row is explored if its draw is below p and neither budget is used up; the
    checks run in the order cluster, segment, draw.  Closed form for one pick per
    segment: a segment's first row below p is picked as long as fewer than
    ``per_cluster`` segments were picked before it.
    """
    if per_segment != 1:
        raise ValueError("the closed form holds for one pick per segment")
    rows = df.withColumn("u_", u)
    seg = Window.partitionBy(*cluster, segment).orderBy(order)
    all_ = Window.partitionBy(*cluster).orderBy(order)
    hits = F.sum(F.when(F.col("u_") < p, 1).otherwise(0)).over(seg)
    rows = rows.withColumn("first_", (F.col("u_") < p) & (hits == 1)).withColumn("seen_", F.coalesce(F.sum(F.when(F.col("u_") < p, 1).otherwise(0)).over(seg.rowsBetween(FIRST, -1)), F.lit(0)))
    rows = rows.withColumn("used_", F.coalesce(F.sum(F.col("first_").cast("int")).over(all_.rowsBetween(FIRST, -1)), F.lit(0)))
    reason = (
        F.when(F.col("used_") >= per_cluster, "hanchan_budget_exhausted").when(F.col("seen_") > 0, "kyoku_budget_exhausted").when(F.col("u_") >= p, "hash_rejected").otherwise("explored")
    )
    return rows.withColumn("reason", reason).drop("first_", "seen_", "used_", "u_")


def crossed(keys: DataFrame, values: DataFrame, column: str, most: int = 10_000) -> DataFrame:
    """Every key with every value of a small set, which may hold ``most`` values; more raise."""
    names = [r[0] for r in values.select(column).distinct().limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"{column} has more than {most} values")
    kind = values.schema[column].dataType
    return keys.withColumn(column, F.explode(F.array(*map(F.lit, names)).cast(f"array<{kind.simpleString()}>")))


def filled(df: DataFrame, keys: DataFrame, on: list[str], value: str) -> DataFrame:
    """Counts over a full key universe, absent keys as zero."""
    return keys.join(df, on, "left").withColumn(value, F.coalesce(value, F.lit(0)))


def islands(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Runs of consecutive whole numbers: ``first, last, n`` of each."""
    w = Window.partitionBy(*keys).orderBy(value)
    return df.select(*keys, value).distinct().withColumn("g_", F.col(value) - F.row_number().over(w)).groupBy(*keys, "g_").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.count("*").alias("n")).drop("g_")
