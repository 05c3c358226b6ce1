"""Cluster and hierarchical resampling, permutation and sign tests.

Draws come from SHA-256 of ``(replicate, place)``, so that any engine gives the
same replicates; numpy draws are there for parity with published intervals.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 4_096


def draw(n: Column, *parts: Column | str) -> Column:
    """A whole number in [0, n) from the first 32 bits of a SHA-256."""
    text = F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])
    u = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")
    return F.pmod(u, n)


def multiplicities(clusters: DataFrame, reps: int, name: str) -> DataFrame:
    """``rep, place, times``: how often each of n clusters is drawn per replicate.

    ``clusters`` has one row with ``n``; places run from 0 to n - 1.  Draws are
    the numbers of one range over replicates and slots, so no row holds a replicate.
    """
    n = int(clusters.first()["n"] or 0)
    slots = clusters.sparkSession.range(reps * n).select(F.expr(f"id div {max(n, 1)}").alias("rep"), F.pmod("id", F.lit(max(n, 1))).alias("slot"))
    return slots.select("rep", draw(F.lit(n).cast("bigint"), name, F.col("rep"), F.col("slot")).alias("place")).groupBy("rep", "place").agg(F.count("*").alias("times"))


def index_quantile(values: DataFrame, keys: list[str], value: str, p: float) -> Column:
    return F.get(F.sort_array(F.collect_list(value)), F.floor(F.count(value) * p).cast("int"))


def cluster_bootstrap_mean(rows: DataFrame, keys: list[str], cluster: str, value: str, reps: int, name: str) -> DataFrame:
    """``keys, mean, lo, hi``: mean and 95 % interval over resampled clusters.

    Clusters are reduced to sums first, so replicates touch clusters, not rows.
    """
    per = rows.where(F.col(value).isNotNull()).groupBy(*keys, cluster).agg(F.sum(value).alias("s"), F.count("*").alias("c"))
    ids = rows.select(cluster).where(F.col(cluster).isNotNull()).distinct()
    placed = dense_ids(ids, cluster, "place")
    times = multiplicities(placed.agg(F.count("*").alias("n")), reps, name)
    reps_ = times.join(placed, "place").join(per, cluster).groupBy(*keys, "rep").agg((F.sum(F.col("s") * F.col("times")) / F.sum(F.col("c") * F.col("times"))).alias("m"))
    ci = reps_.groupBy(*keys).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return per.groupBy(*keys).agg((F.sum("s") / F.sum("c")).alias("mean")).join(ci, keys)


def dense_ids(df: DataFrame, order: str, out: str) -> DataFrame:
    """Dense numbers 0.. in the order of a unique column, without a global window.

    Rows are range-sorted; each range is shifted by the counts of those before.
    """
    spark = df.sparkSession
    ranged = df.repartitionByRange(max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "8"))), order).sortWithinPartitions(order)
    local = ranged.withColumn("m_", F.monotonically_increasing_id()).withColumn("part_", F.shiftrightunsigned("m_", 33)).withColumn("at_", F.col("m_").bitwiseAND(F.lit((1 << 33) - 1)))
    from pyspark.sql import Window

    from foldspan.runtime import cut

    local = cut(local)
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    shift = local.groupBy("part_").agg(F.count("*").alias("c_")).select("part_", F.coalesce(F.sum("c_").over(before), F.lit(0)).alias("s_"))
    return local.join(F.broadcast(shift), "part_").withColumn(out, F.col("at_") + F.col("s_")).drop("m_", "part_", "at_", "s_")


def hierarchical_bootstrap(spark: SparkSession, values: dict[int, list[float]], reps: int = 5000, seed: int = 20260818, choice: bool = False) -> pd.DataFrame:
    """Interval of the mean of means: strata drawn first, then rows within each.

    ``values`` are paired differences by stratum: a few strata of at most some
    thousand games, as evaluation sets have.  Draws are numpy's in published
    order (``choice`` for the variant that also pools), so intervals match.
    """
    arrays = [np.asarray(values[k], float) for k in sorted(values)]
    rng, means, pooled, whole = np.random.default_rng(seed), [], [], np.concatenate(arrays)
    for _ in range(reps):
        if choice:
            pooled.append(rng.choice(whole, size=whole.size, replace=True).mean())
        picked = rng.integers(0, len(arrays), size=len(arrays))
        draw_ = (lambda a: rng.choice(a, size=a.size, replace=True)) if choice else (lambda a: a[rng.integers(0, a.size, size=a.size)])
        means.append(float(np.mean([draw_(arrays[i]).mean() for i in picked])))
    out = {"mean": float(np.mean([a.mean() for a in arrays])), "lo": float(np.quantile(means, 0.025)), "hi": float(np.quantile(means, 0.975))}
    if choice:
        out |= {"pooled_lo": float(np.quantile(pooled, 0.025)), "pooled_hi": float(np.quantile(pooled, 0.975))}
    return pd.DataFrame([out])


def sign_test(rows: DataFrame, keys: list[str], value: str, empty: float | None = 1.0) -> DataFrame:
    """``positive, n, p``: exact one-sided test, ties (within 1e-12) left out.

    ``empty`` is p without a row that counts: 1 or null by convention.  The tail
    is summed by its term ratio, from the largest term down in log space.
    """
    v = F.col(value)
    g = rows.where(F.abs(v) > 1e-12).groupBy(*keys).agg(F.count_if(v > 0).alias("positive"), F.count("*").alias("n"))

    @F.pandas_udf("double")
    def tail(k: pd.Series, n: pd.Series) -> pd.Series:
        def one(a, b):
            lg = lambda i: math.lgamma(b + 1) - math.lgamma(i + 1) - math.lgamma(b - i + 1) - b * math.log(2)
            if b <= 1000:
                return float(sum(math.comb(b, i) for i in range(a, b + 1)) / 2**b)
            return min(1.0, math.fsum(math.exp(lg(i)) for i in range(a, b + 1)))

        return pd.Series([one(int(a), int(b)) for a, b in zip(k, n)])

    tested = g.withColumn("p", tail("positive", "n"))
    groups = rows.select(*keys).distinct()
    return groups.join(tested, keys, "left").select(*keys, F.coalesce("positive", F.lit(0)).alias("positive"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("p", F.lit(empty).cast("double")).alias("p"))


def permutation_p(observed: DataFrame, null: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """``p = (1 + #null >= observed) / (N + 1)`` and whether it exceeds alpha."""
    j = observed.join(null, keys).groupBy(*keys).agg(F.count_if(F.col("null_value") >= F.col("value")).alias("ge"), F.count("*").alias("n"))
    p = (1 + F.col("ge")) / (F.col("n") + 1)
    return j.select(*keys, p.alias("p"), (p > alpha).alias("vote"))


def difference_in_differences(cells: DataFrame, keys: list[str], a: str, b: str, value: str) -> DataFrame:
    """``(y11 - y10) - (y01 - y00)`` of 0/1 factors, per group."""
    cell = lambda i, j: F.avg(F.when((F.col(a) == i) & (F.col(b) == j), F.col(value)))
    return cells.groupBy(*keys).agg(((cell(1, 1) - cell(1, 0)) - (cell(0, 1) - cell(0, 0))).alias("interaction"))


def paired_hierarchical_bootstrap(values: dict[int, list[tuple[float, float]]], reps: int = 5000, seed: int = 20260818) -> pd.DataFrame:
    """Two measures of the same games resampled with the same draws."""
    arrays = [np.asarray(values[k], float).reshape(-1, 2) for k in sorted(values)]
    rng, means = np.random.default_rng(seed), np.empty((reps, 2))
    for r in range(reps):
        picked = rng.integers(0, len(arrays), size=len(arrays))
        means[r] = np.mean([arrays[i][rng.integers(0, len(arrays[i]), size=len(arrays[i]))].mean(0) for i in picked], axis=0)
    lo, hi = np.quantile(means, [0.025, 0.975], axis=0)
    return pd.DataFrame({"mean": np.mean([a.mean(0) for a in arrays], axis=0), "lo": lo, "hi": hi})


def mmd_bootstrap(cluster_sums: DataFrame, times: DataFrame, cohort: str, a, b) -> DataFrame:
    """``rep, mmd2``: squared gap of mean features of two cohorts under cluster multiplicities.

    ``cluster_sums``: ``place, cohort, n, s array<double>``; ``times``: ``rep,
    place, times``.  Feature sums per cluster make a replicate cheap.
    """
    j = cluster_sums.join(times, "place").select("rep", F.col(cohort).alias("c"), (F.col("n") * F.col("times")).alias("n"), F.posexplode(F.transform("s", lambda x: x * F.col("times"))).alias("i", "v"))
    per = j.groupBy("rep", "c", "i").agg((F.sum("v") / F.sum("n")).alias("m"))
    gap = F.max(F.when(F.col("c") == a, F.col("m"))) - F.max(F.when(F.col("c") == b, F.col("m")))
    return per.groupBy("rep", "i").agg(gap.alias("d")).groupBy("rep").agg(F.sum(F.col("d") * F.col("d")).alias("mmd2"))


def hierarchical_means(units: DataFrame, stratum: str, order: str, value: str, reps: int, name: str) -> DataFrame:
    """``rep, mean``: strata drawn with replacement, then units within each; mean of means.

    Hash-driven and distributed: a replicate's draws are made row by row and meet
    their unit by place.  Units are few per stratum (games, clusters), not rows.
    """
    from pyspark.sql import Window

    placed = units.where(F.col(value).isNotNull()).select(F.col(stratum).alias("s"), F.col(value).alias("v"), (F.row_number().over(Window.partitionBy(stratum).orderBy(order)) - 1).cast("bigint").alias("place"))
    sizes = placed.groupBy("s").agg(F.count("*").alias("n"))
    numbered = sizes.select("s", "n", (F.row_number().over(Window.orderBy("s")) - 1).cast("bigint").alias("k"))  # one row per stratum
    count = numbered.agg(F.count("*").alias("m"))
    outer = units.sparkSession.range(reps).select(F.col("id").alias("rep")).join(F.broadcast(count)).select("rep", "m", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)).alias("slot"))
    outer = outer.select("rep", "slot", draw(F.col("m"), name, "outer", F.col("rep"), F.col("slot")).alias("k")).join(numbered, "k")
    # slots are made in blocks, so that no row holds all of a stratum
    blocks = outer.select("rep", "slot", "s", "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {BLOCK}"))).alias("b"))
    inner = blocks.select("rep", "slot", "s", "n", F.explode(F.sequence(F.col("b") * BLOCK, F.least(F.col("n"), (F.col("b") + 1) * BLOCK) - 1)).alias("i")).select("rep", "slot", "s", draw(F.col("n"), name, "inner", F.col("rep"), F.col("slot"), F.col("i")).alias("place"))
    per = inner.join(placed, ["s", "place"]).groupBy("rep", "slot").agg(F.avg("v").alias("v"))
    return per.groupBy("rep").agg(F.avg("v").alias("mean"))
