"""Reports and audits composed of plain aggregations, and row-level vector measures."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.functions import vectors as V
from foldspan.operators.resample import dense_ids, draw


#: places that are digested together
DIGEST_ROWS = 65_536


def stat_report(log: DataFrame, player: str, segment: str, kind: str, value: str, win: str, lose: str, call: str) -> DataFrame:
    """Raw totals per player over segments, then rates and means from the totals."""
    k, v = F.col(kind), F.col(value)
    per = log.groupBy(player, segment).agg(
        F.count_if(k == win).alias("w"), F.count_if(k == lose).alias("l"), F.count_if(k == call).alias("c"), F.sum(F.when(k == win, v).otherwise(0)).alias("wp"), F.sum(F.when(k == lose, v).otherwise(0)).alias("lp"), F.count("*").alias("t")
    )
    g = per.groupBy(player).agg(F.count("*").alias("rounds"), *[F.sum(c).alias(c) for c in ("w", "l", "c", "wp", "lp", "t")], *[F.count_if(F.col(c) > 0).alias(f"any_{c}") for c in ("w", "l", "c")])
    rate = lambda a, b, n: F.round(F.try_divide(a, b), n)
    return g.select(
        player, "rounds", F.col("w").alias("wins"), F.col("l").alias("deal_ins"), F.col("c").alias("calls"), rate("any_w", "rounds", 8).alias("win_rate"), rate("any_l", "rounds", 8).alias("deal_in_rate"), rate("any_c", "rounds", 8).alias("call_rate"),
        rate("wp", "w", 6).alias("win_points"), rate("lp", "l", 6).alias("deal_in_points"), rate(F.col("wp") - F.col("lp"), F.col("rounds"), 6).alias("round_points"), rate("t", "rounds", 8).alias("turns"),
    )


def classifier_report(rows: DataFrame, key: str, label: str, probs: str, points: Sequence[float]) -> DataFrame:
    """NLL, top-1, Brier, error of expected points, and a calibration proxy per group."""
    y, p = F.col(label), F.col(probs)
    err = F.transform(p, lambda x, i: x - F.when(i == y, 1.0).otherwise(0.0))
    pts = F.array(*[F.lit(float(x)) for x in points])
    best = F.array_position(p, F.array_max(p)) - 1
    return rows.groupBy(key).agg(
        F.count("*").alias("samples"), F.round(F.avg(-F.ln(F.get(p, y))), 8).alias("nll"), F.round(F.avg(F.when(best == y, 1.0).otherwise(0.0)), 8).alias("top1"), F.round(F.avg(V.dot(err, err)), 8).alias("brier"),
        F.round(F.avg(F.abs(V.dot(p, pts) - F.get(pts, y))), 6).alias("points_mae"), F.round(F.avg(V.mean(F.transform(err, F.abs))), 8).alias("ece_proxy"),
    )


def series_summary(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    first, last = F.min_by(value, order), F.max_by(value, order)
    return df.groupBy(key).agg(F.count("*").alias("n"), first.alias("first"), last.alias("last"), (last - first).alias("delta"), F.avg(value).alias("mean"), F.avg(F.abs(value)).alias("abs_mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def relative_l2(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """``sqrt(sum (after - before)^2 / sum before^2)`` per group; null without length."""
    d = F.zip_with(before, after, lambda x, y: y - x)
    return df.groupBy(*keys).agg(F.sqrt(F.try_divide(F.sum(V.dot(d, d)), F.sum(V.dot(before, before)))).alias("relative_l2"))


def ordered_digest(df: DataFrame, keys: list[str], index: str, content: str) -> DataFrame:
    """One SHA-256 per group over its places (8 bytes, high byte first) and raw content hashes, in order.

    A group of more than ``DIGEST_ROWS`` places is digested in pieces of that many
    places, and its digest is that of the pieces' digests, so no row holds a
    group.  ``content`` is a hash as hex text.
    """
    part = F.struct(F.col(index).alias("i"), F.col(content).alias("h"))
    ordered = lambda each: F.unhex(F.array_join(F.transform(F.sort_array(F.collect_list(part)), each), ""))
    pieces = df.groupBy(*keys, F.expr(f"`{index}` div {DIGEST_ROWS}").alias("piece_")).agg(F.sha2(ordered(lambda x: F.concat(F.lpad(F.hex(x["i"]), 16, "0"), x["h"])), 256).alias("h_"))
    all_ = F.transform(F.sort_array(F.collect_list(F.struct("piece_", "h_"))), lambda x: x["h_"])
    return pieces.groupBy(*keys).agg(all_.alias("a_")).select(*keys, F.when(F.size("a_") == 1, F.get("a_", F.lit(0))).otherwise(F.sha2(F.unhex(F.array_join("a_", "")), 256)).alias("digest"))


def first_mismatch(a: DataFrame, b: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Place of the first difference between two ordered streams; null if they agree."""
    j = a.withColumnRenamed(value, "a_").join(b.withColumnRenamed(value, "b_"), [*keys, index], "full_outer")
    return j.groupBy(*keys).agg(F.min(F.when(~F.col("a_").eqNullSafe(F.col("b_")), F.col(index))).alias("first_mismatch"))


def rank_sequence(df: DataFrame, game: str, seat: str, segment: str, gain: str) -> DataFrame:
    """Rank after each segment by the running total, and the rank after the next."""
    run = df.withColumn("s_", F.round(F.sum(gain).over(Window.partitionBy(game, seat).orderBy(segment)), 6))
    run = run.withColumn("rank", F.row_number().over(Window.partitionBy(game, segment).orderBy(F.desc("s_"), seat)))
    return run.select(game, seat, segment, "rank", F.lead("rank").over(Window.partitionBy(game, seat).orderBy(segment)).alias("next_rank"))


def weighted_draws(df: DataFrame, ident: str, weight: str, draws: int, name: str) -> DataFrame:
    """``draw, ident``: a sample with replacement by whole-number weights.

    Cumulative weights come from a range-sorted prefix sum; a draw finds its row
    through a bucket of the weight axis, so rows and draws meet by equi-join.
    """
    spark = df.sparkSession
    placed = dense_ids(df.where(F.col(weight) > 0), ident, "i_")
    blocks = placed.withColumn("blk_", F.floor(F.col("i_") / 4096))
    per = blocks.groupBy("blk_").agg(F.sum(weight).alias("bw_"))
    base = per.select("blk_", F.coalesce(F.sum("bw_").over(Window.orderBy("blk_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base_"))
    w = Window.partitionBy("blk_").orderBy("i_")
    cum = blocks.join(base, "blk_").withColumn("hi_", F.col("base_") + F.sum(weight).over(w)).withColumn("lo_", F.col("hi_") - F.col(weight))
    total = per.agg(F.sum("bw_").alias("t_"))
    width = F.lit(1024)
    spans = cum.withColumn("b_", F.explode(F.sequence(F.floor(F.col("lo_") / width), F.floor((F.col("hi_") - 1) / width))))
    u = spark.range(draws).join(F.broadcast(total)).select(F.col("id").alias("draw"), draw(F.col("t_").cast("bigint"), name, F.col("id")).alias("u_")).withColumn("b_", F.floor(F.col("u_") / width))
    return u.join(spans, "b_").where((F.col("u_") >= F.col("lo_")) & (F.col("u_") < F.col("hi_"))).select("draw", ident)


def run_matrix(conditions: DataFrame, dims: dict[str, list[int]]) -> DataFrame:
    """Every condition with every combination of small dimensions, by explode."""
    out = conditions
    for name, values in dims.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out.select("*", F.concat_ws("-", *[F.col(c).cast("string") for c in out.columns]).alias("run"))


def positional_join(a: DataFrame, b: DataFrame, cluster: str, order: str) -> DataFrame:
    """Two ordered streams joined by place: matched, left over on either side, differing."""
    at = F.row_number().over(Window.partitionBy(cluster).orderBy(order))
    j = a.select(cluster, at.alias("o_"), F.col(order).alias("x_")).join(b.select(cluster, at.alias("o_"), F.col(order).alias("y_")), [cluster, "o_"], "full_outer")
    return j.groupBy(cluster).agg(
        F.count_if(F.col("x_").isNotNull() & F.col("y_").isNotNull()).alias("matched"), F.count_if(F.col("y_").isNull()).alias("left_over"), F.count_if(F.col("x_").isNull()).alias("right_over"), F.count_if(F.col("x_") != F.col("y_")).alias("mismatched")
    )


def roles_by_seat(names: DataFrame, ranks: DataFrame, game: str, points: Sequence[float] = (90.0, 45.0, 0.0, -135.0)) -> DataFrame:
    """Ranks by the role that held each seat of a game."""
    seats = names.select(game, F.posexplode("names").alias("seat", "role"))
    pt = F.get(F.array(*[F.lit(float(p)) for p in points]), F.col("rank") - 1)
    return seats.join(ranks, [game, "seat"]).groupBy("role").agg(F.count("*").alias("games"), F.avg("rank").alias("avg_rank"), F.avg(pt).alias("avg_pt"))


def suit_permutations(df: DataFrame, tiles: str) -> DataFrame:
    """Each row under all six orders of the suits; honours stay."""
    orders = ["".join(p) for p in permutations("mps")]
    return df.withColumn("perm", F.explode(F.array(*map(F.lit, orders)))).withColumn(tiles, F.translate(tiles, "mps", "abc")).withColumn(tiles, _turn(tiles, orders))


def _turn(tiles: str, orders: list[str]) -> Column:
    out = None
    for o in orders:
        turned = F.translate(tiles, "abc", o)
        out = F.when(F.col("perm") == o, turned) if out is None else out.when(F.col("perm") == o, turned)
    return out


def median_distance(df: DataFrame, ident: str, vec: str, pairs: int, name: str, fallback: float = 0.1) -> DataFrame:
    """Median distance of hash-drawn pairs; ``fallback`` where it is 0."""
    placed = dense_ids(df, ident, "place")
    n = placed.agg(F.count("*").cast("bigint").alias("n"))
    drawn = df.sparkSession.range(pairs).join(F.broadcast(n)).select(draw(F.col("n"), name, "a", F.col("id")).alias("a"), draw(F.col("n"), name, "b", F.col("id")).alias("b")).where("a <> b")
    side = lambda k: placed.select(F.col("place").alias(k), F.col(vec).alias(f"v{k}"))
    gap = F.zip_with("va", "vb", lambda x, y: x - y)
    j = drawn.join(side("a"), "a").join(side("b"), "b").select(V.norm(gap).alias("d"))
    m = F.median("d")
    return j.agg(F.count("*").alias("pairs"), F.when(m > 0, m).otherwise(fallback).alias("sigma"))


def local_predictability(neighbours: DataFrame, labels: DataFrame, ident: str, label: str) -> DataFrame:
    """``1 - H(local) / H(global)`` of the labels among each query's neighbours."""

    def entropy(counts: DataFrame, keys: list[str]) -> DataFrame:
        return counts.groupBy(*keys).agg((F.ln(F.sum("c")) - F.sum(F.col("c") * F.ln("c")) / F.sum("c")).alias("h"))

    local = neighbours.join(labels.withColumnRenamed(ident, "r"), "r").groupBy("q", label).agg(F.count("*").alias("c"))
    whole = entropy(labels.groupBy(label).agg(F.count("*").alias("c")), []).withColumnRenamed("h", "g")  # one row
    return entropy(local, ["q"]).join(F.broadcast(whole)).select("q", F.col("h").alias("h_local"), (1 - F.try_divide("h", "g")).alias("predictability"))


def value_decomposition(df: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Change of values split into a common offset and centred parts."""
    rows = df.select(*keys, before, after, V.mean(before).alias("mb"), V.mean(after).alias("ma"))
    centred = F.zip_with(before, after, lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    moved = V.mean(F.transform(centred, lambda p: F.abs((p["y"] - F.col("ma")) - (p["x"] - F.col("mb")))))
    top = lambda c: F.array_position(c, F.array_max(c))
    rows = rows.select(*keys, (F.col("ma") - F.col("mb")).alias("o"), moved.alias("c"), (F.array_max(after) - F.array_max(before)).alias("t"), F.when(top(before) == top(after), 1.0).otherwise(0.0).alias("s"))
    return rows.groupBy(*keys).agg(F.count("*").alias("states"), F.avg("o").alias("offset_mean"), F.avg(F.abs("o")).alias("offset_abs"), F.avg("c").alias("centred_abs"), F.avg("t").alias("top_change"), F.avg("s").alias("same_top"))


def consistency(df: DataFrame, key: str, counts: dict[str, str], single: str) -> DataFrame:
    """Distinct values per group, and whether a field has exactly one."""
    return df.groupBy(key).agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(k) for k, c in counts.items()], (F.count_distinct(single) == 1).alias(f"one_{single}"))


def cross_shard(df: DataFrame, content: str, shard: str, ident: str) -> DataFrame:
    """Content found in several shards: how many, and the ids of the first two."""
    per = df.groupBy(content, shard).agg(F.min(ident).alias("d"))
    g = per.groupBy(content).agg(F.count("*").alias("sources"), F.sort_array(F.collect_list("d")).alias("l")).where("sources > 1")
    return g.select(content, "sources", F.get("l", F.lit(0)).alias("first_id"), F.get("l", F.lit(1)).alias("second_id"))


def cohort_difference(df: DataFrame, keys: list[str], a: Column, b: Column, value: str) -> DataFrame:
    """Means of two cohorts and their difference; null where one is missing."""
    m = lambda c: F.avg(F.when(c, F.col(value)))
    return df.groupBy(*keys).agg(m(a).alias("m0"), m(b).alias("d1")).withColumn("difference", F.col("d1") - F.col("m0"))


def exposure(df: DataFrame, size: str, times: str) -> DataFrame:
    """How evenly clusters were used: used, rows seen, repeats of clusters, effective number."""
    t = F.col(times)
    g = df.agg(F.count("*").alias("clusters"), F.count_if(t > 0).alias("used"), F.sum(F.col(size) * t).alias("rows_seen"), F.sum(t).alias("s"), F.sum(t * t).alias("q"))
    return g.select("clusters", "used", "rows_seen", F.try_divide(F.col("s") - F.col("used"), F.col("s")).alias("repeat_rate"), F.try_divide(F.col("s") * F.col("s"), F.col("q")).alias("ess"))


def gradients(df: DataFrame, keys: list[str], pairs: str, action: str) -> DataFrame:
    """Norm of ``softmax - onehot`` over legal actions, entropy, and its common part."""
    rows = df.withColumn("p_", V.softmax(V.values(pairs)))
    g = F.zip_with("p_", pairs, lambda p, x: p - F.when(x["action"] == F.col(action), 1.0).otherwise(0.0))
    rows = rows.withColumn("g_", g)
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(V.norm("g_")).alias("norm"), F.avg(V.entropy("p_")).alias("entropy"), F.avg(V.total("g_")).alias("common"))


def primary_flags(df: DataFrame, keys: list[str], order: str, action: str, opens: int = 42, limit: int = 37) -> DataFrame:
    """``primary`` and ``fault``: the row after an opening action is auxiliary.

    An auxiliary action must be below ``limit``; an opening action must not be the
    last row.  Auxiliary rows never open, so the row before decides.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    aux = F.coalesce(F.lag(action).over(w) == opens, F.lit(False))
    bad = (aux & ~F.col(action).between(0, limit - 1)) | ((F.col(action) == opens) & F.lead(action).over(w).isNull())
    return df.withColumn("primary", ~aux).withColumn("fault", F.coalesce(bad, F.lit(False)))


def mapped_events(events: DataFrame, rows: DataFrame, on: list[str], ident: str) -> DataFrame:
    """``on, hits, row``: how many rows each event key meets; 1 is a clean mapping.

    Rows are counted per key first, so no event is multiplied.
    """
    per = rows.groupBy(*on).agg(F.count("*").alias("n_"), F.min(ident).alias("row"))
    return events.select(*on).join(per, on, "left").select(*on, F.coalesce("n_", F.lit(0)).alias("hits"), "row")


def weighted_mean(df: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """``sum(w x) / sum(w)`` over rows that have both; null without weight."""
    ok = df.where(F.col(value).isNotNull() & F.col(weight).isNotNull())
    return ok.groupBy(*keys).agg(F.sum(weight).alias("weight"), F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def accuracy_by_group(df: DataFrame, group: str, hit: Column, merged: dict[str, list[str]]) -> DataFrame:
    """Hits and accuracy per group and per merged set of groups, from one count."""
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(hit).alias("hits"))
    names = F.array(F.col(group), *[F.when(F.col(group).isin(v), k) for k, v in merged.items()])
    each = per.select(F.explode(F.filter(names, lambda x: x.isNotNull())).alias("name"), "n", "hits")
    return each.groupBy("name").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits")).withColumn("accuracy", F.try_divide("hits", "n"))


def exposed_counts(counts: DataFrame, weights: DataFrame, cluster: str, key: str, n: str, times: str) -> DataFrame:
    """Counts of clusters added up with how often each was used; unused ones give 0."""
    j = counts.join(weights, cluster, "left")
    return j.groupBy(key).agg(F.sum(F.col(n) * F.coalesce(F.col(times), F.lit(0))).alias("exposed"))


def correlation(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Pearson correlation, 0 where it is not defined."""
    c = F.corr(x, y)
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.when(~F.isnan(c), c), F.lit(0.0)).alias("r"))


def second_moments(df: DataFrame, keys: list[str], vec: str, dim: int) -> DataFrame:
    """``i, j, mean_i, mean_j, m``: means and mean products of vector entries, i <= j.

    Arrow batches are reduced to one sum matrix each, so only sums are shuffled.
    """
    import numpy as np
    import pyarrow as pa

    names = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    kn = len(keys)

    def run(batches):
        for b in batches:
            x = b.column(kn).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            labels = list(zip(*(c.to_pylist() for c in b.columns[:kn]))) if kn else [()] * len(x)
            for label in set(labels):
                part = x[[k for k, v in enumerate(labels) if v == label]]
                full = np.hstack([part, np.ones((len(part), 1))])
                yield pa.RecordBatch.from_arrays([*[pa.array([v], c.type) for v, c in zip(label, b.columns)], pa.array([len(part)], pa.int64()), pa.array([(full.T @ full).ravel().tolist()])], names=[*keys, "n", "s"])

    parts = df.where(F.size(vec) == dim).select(*keys, vec).mapInArrow(run, f"{names}{', ' if kn else ''}n bigint, s array<double>")
    flat = parts.select(*keys, "n", F.posexplode("s").alias("p", "v")).groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    cell = flat.select(*keys, F.floor(F.col("p") / (dim + 1)).cast("int").alias("i"), (F.col("p") % (dim + 1)).cast("int").alias("j"), (F.col("v") / F.col("n")).alias("m"))
    means = cell.where(F.col("j") == dim)
    side = lambda a: means.select(*keys, F.col("i").alias(a), F.col("m").alias(f"mean_{a}"))
    return cell.where(F.col("i") <= F.col("j")).where(F.col("j") < dim).join(side("i"), [*keys, "i"]).join(side("j"), [*keys, "j"]).select(*keys, "i", "j", "mean_i", "mean_j", "m")


def first_best(df: DataFrame, keys: list[str], ident: str, ascending: list[str], descending: list[str]) -> DataFrame:
    """The row that is best by a lexicographic key; the smaller id wins ties."""
    order = F.struct(*[F.col(c) for c in ascending], *[(-F.col(c)).alias(c) for c in descending], F.col(ident))
    return df.groupBy(*keys).agg(F.min_by(F.col(ident), order).alias(ident))


def reasons(df: DataFrame, rules: dict[str, Column], out: str = "reasons") -> DataFrame:
    """The names of the rules that a row breaks, and whether it breaks none."""
    broken = F.filter(F.array(*[F.when(c, n) for n, c in rules.items()]), lambda x: x.isNotNull())
    return df.withColumn(out, broken).withColumn("passed", F.size(out) == 0)


def coverage_readout(votes: int, families: int, exclusive: dict[str, float], gates_ok: bool) -> str:
    """A majority of families and some exclusive mass, if every gate holds."""
    if not gates_ok:
        return "no_verdict_gates_failed"
    return "A_coverage_priority" if 2 * votes > families and any(v > 0 for v in exclusive.values()) else "inconclusive"


def rate_differences(ranks: DataFrame, game: str, label: str, rank: str, a: str, b: str) -> DataFrame:
    """Per rank, the share of games each label took it, in percent points of difference."""
    n = lambda x: F.count_if(F.col(label) == x)
    tot = ranks.agg(n(a).alias("na"), n(b).alias("nb"))
    per = ranks.groupBy(rank).agg(n(a).alias("ca"), n(b).alias("cb")).join(F.broadcast(tot))
    return per.select(rank, (100 * (F.try_divide("cb", "nb") - F.try_divide("ca", "na"))).alias("difference_pp"))
