"""Aggregates that profile a fact table: buckets, support, calibration, weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.functions import vectors as V


def spread(x: Column) -> Column:
    """Population standard deviation from moments, never negative inside the root."""
    return F.sqrt(F.greatest(F.lit(0.0), F.avg(x * x) - F.avg(x) * F.avg(x)))


def scalar_stats(df: DataFrame, keys: Sequence[str | Column], value: str) -> DataFrame:
    """``n, mean, std`` per group over finite values."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    return good.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def category_entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """Entropy (nats) of a category per group, by counting first."""
    counts = df.groupBy(*keys, category).agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("n"), F.count("*").alias("kinds"), (F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("entropy"))


def support(df: DataFrame, keys: list[str], q="q", mask="mask", action="action") -> DataFrame:
    """How the taken action stands among the legal values, per group.

    ``states`` counts all rows; the rest counts rows whose action is legal and
    finite.  The margin needs two legal actions.
    """
    rows = df.where(F.col(q).isNotNull() & F.col(mask).isNotNull() & F.col(action).isNotNull()).withColumn("l_", V.legal(q, mask))
    v = V.values("l_")
    own = F.get(F.filter("l_", lambda x: x["action"] == F.col(action)), F.lit(0))["q"]
    top = F.array_max(v)
    best = F.get(V.ranked("l_"), F.lit(0))["action"]
    second = F.get(F.sort_array(v, asc=False), F.lit(1))
    rows = rows.select(
        *keys,
        own.alias("own"), top.alias("top"), best.alias("best"), F.col(action).alias("act"), (top - second).alias("margin"),
        (F.size(F.filter(v, lambda x: x > own)) + 1).alias("rank"), V.mean(F.transform(v, F.abs)).alias("scale"),
    )
    ok = F.col("own").isNotNull()
    when = lambda c: F.when(ok, F.col(c) if isinstance(c, str) else c)
    return rows.groupBy(*keys).agg(
        F.count("*").alias("states"), F.count_if(ok).alias("legal"), F.avg(when(F.when(F.col("best") == F.col("act"), 1.0).otherwise(0.0))).alias("agreement"), F.avg(when("rank")).alias("mean_rank"),
        F.avg(when(F.col("top") - F.col("own"))).alias("regret"), F.avg(when("margin")).alias("margin"), F.avg(when("own")).alias("own_q"), F.avg(when("top")).alias("top_q"), F.avg(when("scale")).alias("scale"),
    )


def regression(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Correlation, line and identity residual of y on x, per group.

    Undefined figures (no spread) are null.  Rows with a null or non-finite side
    are left out.
    """
    ok = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y)]
    r = F.col(y) - F.col(x)
    g = df.where(ok[0] & ok[1]).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(x).alias("x_mean"), F.stddev_pop(x).alias("x_std"), F.avg(y).alias("y_mean"), F.stddev_pop(y).alias("y_std"), F.covar_pop(x, y).alias("cov"),
        F.avg(r).alias("residual_mean"), F.var_pop(r).alias("rv"),
    )
    vx, vy = F.col("x_std") * F.col("x_std"), F.col("y_std") * F.col("y_std")
    slope = F.when(vx > 0, F.col("cov") / vx)
    return g.select(
        *keys, "n", "x_mean", "x_std", "y_mean", "y_std", F.when((vx > 0) & (vy > 0), F.col("cov") / (F.col("x_std") * F.col("y_std"))).alias("pearson"), slope.alias("slope"),
        (F.col("y_mean") - slope * F.col("x_mean")).alias("intercept"), "residual_mean", F.sqrt("rv").alias("residual_std"), F.when(vy > 0, 1 - F.col("rv") / vy).alias("identity_explained"),
    )


def average_ranks(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    """Ranks with ties averaged, via the table of distinct values.

    The running sum goes over distinct values; rows get their rank by a join, so
    equal values never pile up in a window.
    """
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("c_"))
    w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.withColumn(out, F.coalesce(F.sum("c_").over(w), F.lit(0)) + (F.col("c_") + 1) / 2)
    return df.join(ranks.drop("c_"), [*keys, value])


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation per group, ties averaged."""
    good = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*keys, x, y)
    both = average_ranks(average_ranks(good, keys, x, "rx"), keys, y, "ry")
    return both.groupBy(*keys).agg(F.count("*").alias("n"), F.corr("rx", "ry").alias("rho"))


def contribution(df: DataFrame, cluster: str, shares: Sequence[float] = (0.01, 0.05, 0.1)) -> DataFrame:
    """How evenly clusters contribute rows: quantiles, top shares, Gini, effective size.

    One row.  Windows run over cluster sizes grouped by size, so their length is
    the number of distinct sizes.
    """
    sizes = df.groupBy(cluster).agg(F.count("*").alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("k"))
    up, down = Window.orderBy("n"), Window.orderBy(F.desc("n"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    h = hist.withColumn("lo", F.coalesce(F.sum("k").over(before(up)), F.lit(0))).withColumn("above", F.coalesce(F.sum("k").over(before(down)), F.lit(0))).withColumn("clusters", F.sum("k").over(whole))
    # sum of (2i - m - 1) over the places lo+1 .. lo+k
    spread_ = F.col("k") * (2 * F.col("lo") + F.col("k") - F.col("clusters"))
    top = [F.sum(F.col("n") * F.greatest(F.lit(0), F.least(F.col("k"), F.greatest(F.lit(1), F.ceil(F.col("clusters") * s)) - F.col("above")))) for s in shares]
    at = F.array(*[F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)])
    out = h.agg(
        F.max("clusters").alias("clusters"), F.sum(F.col("n") * F.col("k")).alias("rows"), F.sum(F.col("n") * F.col("n") * F.col("k")).alias("sq"), F.sum(spread_ * F.col("n")).alias("g"),
        *[t.alias(f"top{i}") for i, t in enumerate(top)], F.percentile("n", at, F.col("k")).alias("ps"),
    )
    return out.select(
        "clusters", "rows", *[F.try_divide(F.col(f"top{i}"), F.col("rows")).alias(f"top_{round(100 * s)}pct_share") for i, s in enumerate(shares)],
        F.coalesce(F.try_divide(F.col("g"), F.col("clusters") * F.col("rows")), F.lit(0.0)).alias("gini"), F.coalesce(F.try_divide(F.col("rows") * F.col("rows"), F.col("sq")), F.lit(0.0)).alias("ess"),
        *[F.get("ps", F.lit(i)).alias(c) for i, c in enumerate(("p0", "p25", "p50", "p75", "p90", "p95", "p99", "p100"))],
    )


def merge_partials(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact merge of ``n, mean, std`` partials by their moments."""
    n, m, s = F.col("n"), F.col("mean"), F.col("std")
    g = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(n * m).alias("s1"), F.sum(n * (s * s + m * m)).alias("s2"))
    mean = F.try_divide(F.col("s1"), F.col("n"))
    return g.select(*keys, "n", mean.alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("s2") / F.col("n") - mean * mean)).alias("std"))


def nearest_rank(df: DataFrame, keys: list[str], value: str, ps: Sequence[float]) -> DataFrame:
    """Quantiles by the rule ``ordered[int(n p)]``, from counts of distinct values."""
    good = df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf")))
    counts = good.groupBy(*keys, value).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*keys).orderBy(value)
    run = counts.withColumn("upto", F.sum("c").over(w)).withColumn("n", F.sum("c").over(Window.partitionBy(*keys)))
    pick = [F.min(F.when(F.col("upto") > F.least(F.floor(F.col("n") * p), F.col("n") - 1), F.col(value))).alias(f"q{round(100 * p)}") for p in ps]
    return run.groupBy(*keys).agg(F.max("n").alias("n"), *pick)


def duplicates(df: DataFrame, keys: list[str], content: Column) -> DataFrame:
    """``rows, distinct, dup_rows, dup_rate, most`` of a content hash, per group."""
    counts = df.withColumn("h_", content).where("h_ is not null").groupBy(*keys, "h_").agg(F.count("*").alias("c"))
    return counts.groupBy(*keys).agg(F.sum("c").alias("rows"), F.count("*").alias("distinct"), (F.sum("c") - F.count("*")).alias("dup_rows"), ((F.sum("c") - F.count("*")) / F.sum("c")).alias("dup_rate"), F.max("c").alias("most"))


def overlapping(df: DataFrame, names: Column, value: str) -> DataFrame:
    """``bucket, n, mean, std``: every row counts in each bucket it names."""
    return scalar_stats(df.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("bucket"), value), ["bucket"], value)


def drift(df: DataFrame, a: str, b: str, mask: str, keys: list[str]) -> DataFrame:
    """Change between two value vectors over legal entries.

    Element-pooled means weigh states by their number of actions; per-state means
    do not.
    """
    both = F.zip_with(F.arrays_zip(F.col(a).alias("x"), F.col(b).alias("y")), F.col(mask), lambda p, m: F.struct(p["x"].alias("x"), p["y"].alias("y"), m.alias("m")))
    ok = F.filter(both, lambda p: p["m"] & ~F.isnan(p["x"]) & ~F.isnan(p["y"]) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    rows = df.select(*keys, ok.alias("l")).where(F.size("l") > 0)
    d = F.transform("l", lambda p: F.abs(p["y"] - p["x"]))
    first = lambda f: F.array_position(F.transform("l", lambda p: p[f]), F.array_max(F.transform("l", lambda p: p[f])))
    rows = rows.select(*keys, F.size("l").alias("k"), V.total(d).alias("s"), (first("x") != first("y")).cast("int").alias("changed"))
    return rows.groupBy(*keys).agg(F.count("*").alias("states"), (F.sum("s") / F.sum("k")).alias("pooled_abs"), F.avg(F.col("s") / F.col("k")).alias("per_state_abs"), F.avg("changed").alias("greedy_changed"))


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, weight: str, k: int) -> DataFrame:
    """``i, x``: the inverse weighted CDF at the k midpoints ``(i + 1/2) / k``.

    Piecewise linear: a target between two cumulative weights lies that share of
    the way from the previous value to the next; before the first it takes the
    first value.
    """
    mass = df.where(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*keys, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    by = Window.partitionBy(*keys).orderBy("v")
    cdf = mass.withColumn("hi", F.sum("w").over(by) / F.sum("w").over(Window.partitionBy(*keys)))
    cdf = cdf.withColumn("lo", F.lag("hi", 1, 0.0).over(by)).withColumn("prev", F.coalesce(F.lag("v").over(by), F.col("v")))
    # the midpoints that fall into (lo, hi]
    first = F.greatest(F.lit(0), F.floor(F.col("lo") * k - 0.5 + 1e-12) + 1)
    last = F.least(F.lit(k - 1), F.floor(F.col("hi") * k - 0.5 + 1e-12))
    hit = cdf.where(last >= first).withColumn("i", F.explode(F.sequence(first, last)))
    t = (F.col("i") + 0.5) / k
    return hit.select(*keys, F.col("i").cast("int").alias("i"), (F.col("prev") + (F.col("v") - F.col("prev")) * (t - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("x"))
