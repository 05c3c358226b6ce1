"""Whole-corpus audits: one wide pass per cohort, contract violations, resampled deltas, exposure, reconciliation."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.functions import vectors as V
from foldspan.operators.windows import running_sums
from foldspan.runtime import partitions_for


def measures(rows: DataFrame, q: str = "q", mask: str = "mask", action: str = "action") -> DataFrame:
    """Adds ``legal_, greedy_, own_q_, regret_, margin_`` of each row; null where nothing is legal and finite."""
    pairs = rows.withColumn("l_", V.ranked(V.legal(q, mask)))
    own = F.get(F.filter("l_", lambda x: x["action"] == F.col(action)), F.lit(0))["q"]
    top, second = F.get("l_", F.lit(0)), F.get("l_", F.lit(1))
    return pairs.withColumns({
        "legal_": F.when(F.size("l_") > 0, F.size("l_")), "greedy_": top["action"], "own_q_": own, "regret_": top["q"] - own, "margin_": F.when(top["q"].isNotNull(), F.coalesce(top["q"] - second["q"], F.lit(0.0))),
    }).drop("l_")


def scan(rows: DataFrame, cohort: str, cluster: str, strata: list[str], state: Column, decision: Column, target: str) -> DataFrame:
    """One row per cohort: sizes, distinct states and decisions, agreement, correlation, and
    the share of the target's variance that stays within strata.

    ``rows`` carry the columns of ``measures``.  Every part reduces map-side; the
    distinct counts are plain counts of grouped hashes.
    """
    y, x = F.col(target), F.col("own_q_")
    both = x.isNotNull() & y.isNotNull()
    base = rows.groupBy(cohort).agg(
        F.count("*").alias("rows"), F.count_if(both & (F.col("greedy_") == F.col("action"))).alias("agreed"), F.count_if(both).alias("judged"),
        F.try_divide(F.covar_pop(F.when(both, x), F.when(both, y)), F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))).alias("corr"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"), F.count(y).alias("ny"),
    )
    per = rows.groupBy(cohort, cluster).agg(F.count("*").alias("c")).groupBy(cohort).agg(F.count("*").alias("clusters"), F.min("c").alias("least"), F.percentile("c", F.lit(0.5)).alias("median"), F.max("c").alias("most"))
    cells = rows.groupBy(cohort, *strata).agg(F.count(y).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("ss")).where("n >= 2")
    within = cells.groupBy(cohort).agg(F.sum(F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("w"))
    unique = lambda c, name: rows.select(cohort, c.alias("h")).where("h is not null").groupBy(cohort, "h").agg(F.lit(1).alias("i")).groupBy(cohort).agg(F.count("*").alias(name))
    out = base.join(per, cohort).join(within, cohort, "left").join(unique(state, "states"), cohort, "left").join(unique(decision, "decisions"), cohort, "left")
    spread = F.col("syy") - F.col("sy") * F.col("sy") / F.col("ny")
    return out.select(
        cohort, "rows", "clusters", "least", "median", "most", F.coalesce("states", F.lit(0)).alias("states"), F.coalesce("decisions", F.lit(0)).alias("decisions"), F.try_divide("agreed", "rows").alias("agreement"),
        F.coalesce("corr", F.lit(0.0)).alias("corr"), F.when((F.col("ny") > 1) & (spread > 0), F.coalesce("w", F.lit(0.0)) / spread).otherwise(1.0).alias("within_ratio"),
    )


def histograms(rows: DataFrame, cohort: str, buckets: dict[str, Column]) -> DataFrame:
    """``cohort, histogram, bucket, n`` of all buckets in one pass; null buckets are left out."""
    each = F.array(*[F.struct(F.lit(k).alias("histogram"), c.cast("string").alias("bucket")) for k, c in buckets.items()])
    return rows.select(cohort, F.explode(each).alias("b")).where("b.bucket is not null").groupBy(cohort, "b.histogram", "b.bucket").agg(F.count("*").alias("n"))


def violations(rows: DataFrame, rules: dict[str, Column], key: list[str] | None = None) -> DataFrame:
    """``kind, n`` of every rule, zero where none breaks it.

    ``rules`` are conditions that hold for a violation; null counts as no violation.
    ``key`` adds ``duplicate_context``: rows beyond the first of their key.
    """
    kinds = F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda k: k.isNotNull())
    found = rows.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    names = [*rules]
    if key:
        again = rows.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n")).select(F.lit("duplicate_context").alias("kind"), "n")
        found, names = found.unionByName(again), [*names, "duplicate_context"]
    all_ = rows.sparkSession.createDataFrame([(n,) for n in names], "kind string")
    return all_.join(found, "kind", "left").select("kind", F.coalesce("n", F.lit(0)).alias("n"))


def view_gap_deltas(reps: DataFrame, metric: str, cohort: str = "route") -> DataFrame:
    """``rep, delta1, delta3``: ``(M0 - D1) - |D1 - D2|`` and ``(M0 - D3) - |D1 - D2|`` per replicate."""
    one = lambda r: F.max(F.when(F.col(cohort) == r, F.col(metric)))
    gap = F.abs(one("D1") - one("D2"))
    return reps.groupBy("rep").agg(((one("M0") - one("D1")) - gap).alias("delta1"), ((one("M0") - one("D3")) - gap).alias("delta3"))


def family_deltas(values: DataFrame, times: DataFrame, distance: Callable, cohort: str = "route") -> DataFrame:
    """``rep, delta1, delta3`` of a distance of one's choice between resampled cohorts.

    ``values``: ``place, route, v, n`` sums of a cluster's rows by value; ``times``:
    ``rep, place, times``.  ``distance(va, wa, vb, wb)`` takes values and weights
    of two cohorts, reduced to distinct values first.
    """
    mass = values.join(times, "place").groupBy("rep", F.col(cohort).alias("c"), "v").agg(F.sum(F.col("n") * F.col("times")).alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        side = {c: g.sort_values("v") for c, g in pdf.groupby("c")}
        far = lambda a, b: distance(side[a]["v"].to_numpy(), side[a]["w"].to_numpy(), side[b]["v"].to_numpy(), side[b]["w"].to_numpy()) if a in side and b in side else None
        d1, d3, gap = far("M0", "D1"), far("M0", "D3"), far("D1", "D2")
        ok = lambda x: None if x is None or gap is None else x - gap
        return pd.DataFrame({"rep": [int(pdf["rep"].iloc[0])], "delta1": [ok(d1)], "delta3": [ok(d3)]})

    return mass.groupBy("rep").applyInPandas(run, "rep bigint, delta1 double, delta3 double")


def interval(reps: DataFrame, columns: list[str], p: float = 0.025) -> DataFrame:
    """``measure, lo, hi, above``: percentile interval of each column and whether it lies above zero."""
    long = reps.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("x")) for c in columns])).alias("s")).select("s.*")
    ci = long.groupBy("measure").agg(F.percentile("x", F.lit(p)).alias("lo"), F.percentile("x", F.lit(1 - p)).alias("hi"))
    return ci.withColumn("above", F.coalesce(F.col("lo") > 0, F.lit(False)))


def votes(ci: DataFrame, needed: int, families: str = "family") -> DataFrame:
    """``votes, verdict``: a family votes where both its intervals lie above zero."""
    per = ci.groupBy(families).agg(F.bool_and("above").alias("vote"))
    n = F.count_if("vote")
    return per.agg(n.alias("votes"), F.when(n >= needed, "supported").otherwise("not_supported").alias("verdict"))


def exposure(sizes: DataFrame, cluster: str, n: str, epochs: int, budget: int, order: Callable[[Column, Column], Column]) -> DataFrame:
    """``cluster, consumed``: rows of each cluster read until ``budget`` rows were, over shuffled epochs.

    ``order(epoch, cluster)`` gives the place of a cluster in an epoch.  Running
    sums go through ranges, so an epoch of many clusters is spread over tasks.
    """
    turns = sizes.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    turns = turns.withColumn("o_", order(F.col("epoch"), F.col(cluster)))
    whole = sizes.agg(F.sum(n).alias("all_"))
    upto = running_sums(turns.withColumn("b_", F.col(n)), "epoch", ["o_", cluster], {"b_": F.col(n)}, partitions_for(sizes.sparkSession))
    before = upto.withColumn("b_", F.col("b_") - F.col(n)).join(F.broadcast(whole))  # one row
    taken = F.greatest(F.lit(0), F.least(F.col(n), budget - F.col("epoch") * F.col("all_") - F.col("b_")))
    return before.groupBy(cluster).agg(F.sum(taken).alias("consumed"))


def exposure_report(consumed: DataFrame, value: str = "consumed") -> DataFrame:
    """``total, unique, repeat_rate, gini, top_1, top_5, top_10, effective_n`` over all clusters, those never read included."""
    places = Window.orderBy(F.desc(value))
    # the ranking runs over distinct numbers of rows, each with its count
    per = consumed.groupBy(value).agg(F.count("*").alias("c"))
    up = per.withColumn("above", F.coalesce(F.sum("c").over(places.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    size = consumed.agg(F.count("*").alias("n"), F.sum(value).alias("t"), F.count_if(F.col(value) > 0).alias("u"), F.sum(F.col(value) * F.col(value)).alias("s2"))
    r = up.join(F.broadcast(size))
    top = lambda k: F.try_divide(F.sum(F.col(value) * F.greatest(F.lit(0), F.least(F.col("c"), F.greatest(F.lit(1), F.floor(F.col("n") / k)) - F.col("above")))), F.first("t"))
    low = F.col("n") - F.col("above") - F.col("c")  # clusters with fewer rows
    ranks = F.col("c") * low + F.col("c") * (F.col("c") + 1) / 2
    gini = F.try_divide(F.sum(F.col(value) * (2 * ranks - F.col("c") * (F.col("n") + 1))), F.first("n") * F.first("t"))
    return r.agg(
        F.first("t").alias("total"), F.first("u").alias("unique"), F.try_divide(F.first("t") - F.first("u"), F.first("t")).alias("repeat_rate"), gini.alias("gini"),
        top(100).alias("top_1"), top(20).alias("top_5"), top(10).alias("top_10"), F.try_divide(F.first("t") * F.first("t"), F.first("s2")).alias("effective_n"),
    )


def reconciled(ledger: DataFrame, actual: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``state, n``: entries of a ledger that match what there is, differ, are missing or were never listed."""
    a, b = ledger.withColumnRenamed(value, "told_").withColumn("a_", F.lit(True)), actual.withColumnRenamed(value, "is_").withColumn("b_", F.lit(True))
    state = F.when(F.col("b_").isNull(), "missing").when(F.col("a_").isNull(), "unlisted").when(F.col("told_").eqNullSafe(F.col("is_")), "match").otherwise("differs")
    return a.join(b, keys, "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def rewards(games: DataFrame, mode: str, rank: str, step: str, last: str, points: list[float], model: str | None = None) -> Column:
    """Reward of a row: ``final_rank_mc`` (points less their mean, on every row), ``terminal_rank``
    (on the last row only) or ``model_delta`` (a column supplied)."""
    pt = F.get(F.array(*[F.lit(float(p)) for p in points]), F.col(rank).cast("int") - 1) - sum(points) / len(points)
    if mode == "final_rank_mc":
        return pt
    if mode == "terminal_rank":
        return F.when(F.col(step) == F.col(last), pt).otherwise(0.0)
    if mode == "model_delta" and model:
        return F.col(model)
    raise ValueError(f"unknown reward mode {mode}")
