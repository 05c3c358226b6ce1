"""Distances between distributions held in long form ``(cohort, key, n)``."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspan.runtime import cut, partitions_for

EPS = 1e-12


def shares(counts: DataFrame, cohort: str, key: str, n: str = "n") -> DataFrame:
    """Each key's share of its cohort."""
    total = counts.groupBy(cohort).agg(F.sum(n).alias("t_"))
    return counts.join(total, cohort).select(cohort, key, (F.col(n) / F.col("t_")).alias("p"))


def pairs(counts: DataFrame, cohort: str, key: str) -> DataFrame:
    """Aligned shares of every pair of cohorts, absent keys as zero.

    A key's cohorts are gathered into one map, so pairs are formed per key from
    as many entries as there are cohorts.  ``a < b``.
    """
    p = shares(counts, cohort, key)
    cohorts = p.groupBy().agg(F.sort_array(F.collect_set(cohort)).alias("all_"))  # few cohorts
    by_key = p.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(cohort, "p"))).alias("m"))
    each = by_key.join(F.broadcast(cohorts))
    two = each.select(key, "m", F.explode("all_").alias("a"), "all_").select(key, "m", "a", F.explode("all_").alias("b")).where("a < b")
    share = lambda c: F.coalesce(F.element_at("m", F.col(c)), F.lit(0.0))
    return two.select(key, "a", "b", share("a").alias("p"), share("b").alias("q"))


def divergence(counts: DataFrame, cohort: str, key: str) -> DataFrame:
    """``a, b, jsd, tv, a_missing, b_missing`` per pair of cohorts.

    ``jsd`` is the distance (root, natural log, epsilon inside the logs) and
    ``a_missing`` the mass of a on keys that b lacks.
    """
    m = (F.col("p") + F.col("q")) / 2
    part = lambda x: F.col(x) * F.ln((F.col(x) + EPS) / (m + EPS))
    return pairs(counts, cohort, key).groupBy("a", "b").agg(
        F.sqrt(F.greatest(F.lit(0.0), 0.5 * F.sum(part("p")) + 0.5 * F.sum(part("q")))).alias("jsd"), (0.5 * F.sum(F.abs(F.col("p") - F.col("q")))).alias("tv"),
        F.sum(F.when(F.col("q") == 0, F.col("p")).otherwise(0.0)).alias("a_missing"), F.sum(F.when(F.col("p") == 0, F.col("q")).otherwise(0.0)).alias("b_missing"),
    )


def wasserstein(df: DataFrame, keys: list[str], value: str, side_a, weight) -> DataFrame:
    """Exact weighted 1-Wasserstein distance between two sides of each group.

    Weights are normalised per side; a side without weight makes it null.  Distinct
    values are range-sorted and sums shifted from range to range, so that one
    group of very many values is spread over tasks.
    """
    group = F.struct(*keys) if keys else F.lit(0)
    mass = df.where(F.col(value).isNotNull()).groupBy(group.alias("g"), F.col(value).alias("v")).agg(F.sum(F.when(side_a, weight).otherwise(0)).alias("wa"), F.sum(F.when(~side_a, weight).otherwise(0)).alias("wb"))
    held = cut(mass.repartitionByRange(partitions_for(df.sparkSession), "g", "v").withColumn("part", F.spark_partition_id()))
    local = Window.partitionBy("part", "g").orderBy("v")
    run = held.withColumns({"ca": F.sum("wa").over(local), "cb": F.sum("wb").over(local), "next": F.lead("v").over(local)})
    edges = held.groupBy("g", "part").agg(F.sum("wa").alias("sa"), F.sum("wb").alias("sb"), F.min("v").alias("first"))  # one row per group and range
    parts, whole = Window.partitionBy("g").orderBy("part"), Window.partitionBy("g")
    before = lambda c: F.coalesce(F.sum(c).over(parts.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = edges.select(F.col("g").alias("h"), F.col("part").alias("p"), before("sa").alias("ba"), before("sb").alias("bb"), F.sum("sa").over(whole).alias("ta"), F.sum("sb").over(whole).alias("tb"), F.lead("first").over(parts).alias("then"))
    all_ = run.join(shift, F.col("g").eqNullSafe(F.col("h")) & (F.col("part") == F.col("p")))
    gap = F.abs(F.try_divide(F.col("ca") + F.col("ba"), "ta") - F.try_divide(F.col("cb") + F.col("bb"), "tb"))
    step = F.coalesce(F.coalesce("next", "then") - F.col("v"), F.lit(0))
    out = all_.groupBy("g").agg(F.sum(step * gap).alias("distance"))
    return out.select(*[F.col(f"g.{k}").alias(k) for k in keys], "distance")


def overlap(df: DataFrame, cohort: str, key: str) -> DataFrame:
    """``a, b, both, a_only, b_only``: distinct keys shared by pairs of cohorts."""
    sets = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sort_array(F.collect_set(cohort)).alias("s"))
    sizes = sets.groupBy("s").agg(F.count("*").alias("n"))  # at most 2^cohorts rows
    names = df.groupBy().agg(F.sort_array(F.collect_set(cohort)).alias("all_"))
    two = sizes.join(F.broadcast(names)).select("s", "n", F.explode("all_").alias("a"), "all_").select("s", "n", "a", F.explode("all_").alias("b")).where("a < b")
    has = lambda c: F.array_contains("s", F.col(c))
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return two.groupBy("a", "b").agg(count(has("a") & has("b")).alias("both"), count(has("a") & ~has("b")).alias("a_only"), count(has("b") & ~has("a")).alias("b_only"))


def directions(dim: int, n: int, seed: int) -> np.ndarray:
    """Fixed unit directions for projections."""
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def sliced_wasserstein(df: DataFrame, cohort: str, vec: str, dim: int, n_directions: int = 256, n_quantiles: int = 4096, seed: int = 3) -> DataFrame:
    """``a, b, distance``: mean over directions of the 1-D distance of quantiles.

    Vectors are projected in Arrow batches; the quantiles come from Spark's
    mergeable percentile sketch per direction and cohort.
    """
    dirs = directions(dim, n_directions, seed).T.astype(np.float64)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) @ dirs
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dirs.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["cohort", "x"])

    p = df.where(F.size(vec) == dim).select(F.col(cohort).alias("cohort"), vec).mapInArrow(run, f"cohort {df.schema[cohort].dataType.simpleString()}, x array<double>")
    flat = p.select("cohort", F.posexplode("x").alias("dir", "v"))
    at = F.array(*[F.lit((i + 0.5) / n_quantiles) for i in range(n_quantiles)])
    q = flat.groupBy("cohort", "dir").agg(F.percentile_approx("v", at, max(10_000, 4 * n_quantiles)).alias("q"))
    by_dir = q.groupBy("dir").agg(F.collect_list(F.struct("cohort", "q")).alias("l"))
    two = by_dir.select("dir", F.explode("l").alias("a"), "l").select("dir", "a", F.explode("l").alias("b")).where("a.cohort < b.cohort")
    gap = F.aggregate(F.zip_with("a.q", "b.q", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / n_quantiles
    return two.groupBy(F.col("a.cohort").alias("a"), F.col("b.cohort").alias("b")).agg(F.avg(gap).alias("distance"))


def rff_mmd(df: DataFrame, cohort: str, vec: str, dim: int, sigma: float, n_features: int = 2048, seed: int = 5) -> DataFrame:
    """``a, b, mmd2`` by random Fourier features: squared gap of mean features."""
    rng = np.random.default_rng(seed)
    w, shift = rng.standard_normal((dim, n_features)) / sigma, rng.uniform(0, 2 * np.pi, n_features)

    def run(batches):
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            names, at = np.unique(np.array(b.column(0).to_pylist()), return_inverse=True)
            sums = np.zeros((len(names), n_features))
            for k in range(0, len(x), 1024):  # few rows at once, as features are many times their size
                f = np.sqrt(2 / n_features) * np.cos(x[k : k + 1024] @ w + shift)
                sums += (at[k : k + 1024] == np.arange(len(names))[:, None]).astype(np.float64) @ f
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1) * n_features, pa.int32()), pa.array(sums.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(names).cast(b.column(0).type), pa.array(np.bincount(at, minlength=len(names)), pa.int64()), lists], names=["cohort", "n", "s"])

    parts = df.where((F.size(vec) == dim) & F.col(cohort).isNotNull()).select(F.col(cohort).alias("cohort"), vec).mapInArrow(run, f"cohort {df.schema[cohort].dataType.simpleString()}, n bigint, s array<double>")
    total = parts.groupBy("cohort").agg(F.sum("n").alias("n"))
    means = parts.select("cohort", F.posexplode("s").alias("i", "v")).groupBy("cohort", "i").agg(F.sum("v").alias("v")).join(total, "cohort").select("cohort", "i", (F.col("v") / F.col("n")).alias("m"))
    by = means.groupBy("i").agg(F.collect_list(F.struct("cohort", "m")).alias("l"))
    two = by.select("i", F.explode("l").alias("a"), "l").select("a", F.explode("l").alias("b")).where("a.cohort < b.cohort")
    d = F.col("a.m") - F.col("b.m")
    return two.groupBy(F.col("a.cohort").alias("a"), F.col("b.cohort").alias("b")).agg(F.sum(d * d).alias("mmd2"))
