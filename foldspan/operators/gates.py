"""Strict joins, selections and gates: rows in, named verdicts out."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gate_table(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``gate, passed``: each gate as an aggregate over all rows; null counts as failed."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"g{i}") for i, c in enumerate(gates.values())])
    return row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(f"g{i}").alias("passed")) for i, n in enumerate(gates)])).alias("x")).select("x.gate", "x.passed")


def verdict(gates: DataFrame, supported: Column | None = None) -> DataFrame:
    """One row: whether all gates passed, which failed, and the verdict."""
    v = F.when(~F.bool_and("passed"), "no_verdict_gates_failed").otherwise("passed" if supported is None else F.when(F.bool_and(supported), "supported").otherwise("not_confirmed"))
    return gates.agg(F.coalesce(F.bool_and("passed"), F.lit(False)).alias("all_pass"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("passed"), F.col("gate")))), ",").alias("failed"), F.coalesce(v, F.lit("no_verdict_gates_failed")).alias("verdict"))


def strict_pairs(a: DataFrame, b: DataFrame, on: Sequence[str], same: Sequence[str], values: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """One-to-one join with its gates.

    Returns the pairs (both sides unique, secondary columns equal) and the gate
    table: no duplicate key on either side, equal key sets, equal secondary
    columns.  Sides are reduced per key first, so the join is 1:1 whatever the input.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.groupBy(*on).agg(F.count("*").alias(f"n_{tag}"), *[F.min(c).alias(f"{c}_{tag}") for c in (*same, *values)])

    j = side(a, "a").join(side(b, "b"), list(on), "full_outer")
    equal = reduce(lambda x, y: x & y, [F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")) for c in same], F.lit(True))
    both = F.col("n_a").isNotNull() & F.col("n_b").isNotNull()
    gates = gate_table(j, {
        "no_duplicate_left": F.max(F.coalesce("n_a", F.lit(0))) <= 1, "no_duplicate_right": F.max(F.coalesce("n_b", F.lit(0))) <= 1,
        "key_sets_equal": F.bool_and(both), "secondary_equal": F.bool_and(F.when(both, equal)),
    })
    pairs = j.where(both & (F.col("n_a") == 1) & (F.col("n_b") == 1) & equal)
    return pairs.select(*on, *[F.col(f"{c}_a").alias(c) for c in same], *[F.col(f"{c}_{t}") for c in values for t in "ab"]), gates


def set_differences(actual: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """``side, key`` of keys on one side only."""
    j = actual.select(key).distinct().withColumn("a", F.lit(True)).join(expected.select(key).distinct().withColumn("e", F.lit(True)), key, "full_outer")
    return j.where("a is null or e is null").select(F.when(F.col("a").isNull(), "missing").otherwise("unexpected").alias("side"), key)


def keep_first(df: DataFrame, content: Column, order: Sequence[str]) -> DataFrame:
    """The first row of each content hash with the number of its copies.

    By aggregation, so copies meet map-side and never in one window.
    """
    rest = [c for c in df.columns if c not in order]
    return df.withColumn("h_", content).where("h_ is not null").groupBy("h_").agg(F.min(F.struct(*order, *rest)).alias("r"), F.count("*").alias("copies")).select("r.*", "copies")


def config_diff(a: DataFrame, b: DataFrame, allowed: Sequence[str] = ()) -> DataFrame:
    """``path, left, right, allowed`` of settings that differ; null equals null."""
    j = a.select("path", F.col("value").alias("left"), F.lit(True).alias("a")).join(b.select("path", F.col("value").alias("right"), F.lit(True).alias("b")), "path", "full_outer")
    ok = reduce(lambda x, y: x | y, [F.col("path").startswith(p) for p in allowed], F.lit(False))
    return j.where(F.col("a").isNull() | F.col("b").isNull() | ~F.col("left").eqNullSafe(F.col("right"))).select("path", "left", "right", ok.alias("allowed"))


def dangling(df: DataFrame, ident: str, refs: Sequence[str]) -> DataFrame:
    """``column, ref`` of references that name no row."""
    ids = df.select(F.col(ident).alias("ref")).distinct()
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("ref")) for c in refs])).alias("x")).select("x.*").where("ref is not null")
    return long.join(ids, "ref", "left_anti").distinct().select("column", "ref")


def midpoints(df: DataFrame, cluster: str, order: Sequence[str], parts: int = 3) -> DataFrame:
    """The rows at the midpoints of equal parts of each cluster; small clusters are left out."""
    w = Window.partitionBy(cluster).orderBy(*order)
    at = F.row_number().over(w) - 1
    n = F.count("*").over(Window.partitionBy(cluster))
    hit = reduce(lambda x, y: x | y, [F.col("at_") == F.floor((2 * j + 1) * F.col("n_") / (2 * parts)) for j in range(parts)])
    return df.withColumn("at_", at).withColumn("n_", n).where((F.col("n_") >= parts) & hit).drop("n_").withColumnRenamed("at_", "place")


def hash_split(key: Column, seed: str, shares: dict[str, float]) -> Column:
    """A split name by the first 32 bits of SHA-256 of seed and key."""
    u = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256), 1, 8), 16, 10).cast("double") / 4294967296.0
    out, upto = None, 0.0
    names = list(shares)
    for n in names[:-1]:
        upto += shares[n]
        out = F.when(u < upto, n) if out is None else out.when(u < upto, n)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def hash_sample(df: DataFrame, key: Column, seed: str, n: int) -> DataFrame:
    """n rows with the smallest hash: a reservoir without an order of arrival.

    A top-n, so every partition sends at most n rows.
    """
    return df.withColumn("h_", F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)).orderBy("h_").limit(n).drop("h_")


def sample_per_cluster(df: DataFrame, cluster: str, key: Column, seed: str, clusters: int) -> DataFrame:
    """One row of each of some clusters: both chosen by the smallest hash."""
    h = F.sha2(F.concat_ws("|", F.lit(seed), key.cast("string")), 256)
    per = df.withColumn("h_", h).groupBy(cluster).agg(F.min(F.struct("h_", *df.columns)).alias("r"))
    return hash_sample(per.select("r.*").drop("h_"), F.col(cluster), seed, clusters)
