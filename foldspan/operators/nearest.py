"""Exact nearest rows of a stated query set, and what neighbours tell.

Queries are taken in blocks of bounded size, which travel as rows to every part of
the references; a part keeps its own k best of each query, so only candidates
are shuffled, and the plan is the same for any number of queries.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspan.operators.windows import running_sums
from foldspan.runtime import partitions_for

#: queries of a block and references of a part
BLOCK, PART = 256, 20_000


def nearest(queries: DataFrame, references: DataFrame, ident: str, vec: str, cluster: str, k: int, dim: int) -> DataFrame:
    """``q, r, dist, place``: the k references nearest by ``1 - cosine``.

    References of the query's own cluster are left out; ties go to the smaller
    id.  Vectors are taken as they are, so they should have unit length.
    """
    good = lambda df: df.where((F.size(vec) == dim) & F.col(ident).isNotNull()).select(F.col(ident).cast("bigint").alias("id"), F.col(cluster).cast("bigint").alias("c"), F.col(vec).cast("array<double>").alias("v"))
    asked, held = good(queries), good(references)
    blocks, parts = max(1, -(-asked.count() // BLOCK)), max(1, -(-held.count() // PART))
    # blocks are gathered by place in the shuffle, a few hundred queries each
    asks = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block")).agg(F.collect_list(F.struct("id", "c", "v")).alias("asks"))
    asks = asks.select("asks", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    spread = held.withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(parts)).cast("int"))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"q": np.empty(0, np.int64), "r": np.empty(0, np.int64), "dist": np.empty(0)})]
        if len(left) and len(right):
            r, c, y = left["id"].to_numpy(), left["c"].to_numpy(), np.stack(left["v"].to_numpy())
            for asks in right["asks"]:
                ids, own, x = np.array([a["id"] for a in asks]), np.array([-1 if a["c"] is None else a["c"] for a in asks]), np.array([a["v"] for a in asks], float)
                d = np.round(1 - x @ y.T, 9)
                d[own[:, None] == c[None, :]] = np.inf
                m = min(k, d.shape[1])
                last = np.partition(d, m - 1, axis=1)[:, m - 1 : m]  # ties at the last place are settled below, by id
                q, n = np.nonzero((d <= last) & np.isfinite(d))
                order = np.lexsort((r[n], d[q, n], q))
                q, n = q[order], n[order]
                first = np.flatnonzero(np.diff(q, prepend=-1))
                keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) < k
                out.append(pd.DataFrame({"q": ids[q[keep]], "r": r[n[keep]], "dist": d[q[keep], n[keep]]}))
        return pd.concat(out)

    found = spread.groupBy("part").cogroup(asks.groupBy("part")).applyInPandas(meet, "q bigint, r bigint, dist double")
    w = Window.partitionBy("q").orderBy("dist", "r")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def mean_distance(neighbours: DataFrame) -> DataFrame:
    return neighbours.groupBy("q").agg(F.avg("dist").alias("mean_dist"))


def mid_rank(values: DataFrame, reference: DataFrame, value: str) -> DataFrame:
    """``pct``: mid-rank of each value among the reference values, in [0, 1]."""
    n = reference.agg(F.count(value).alias("n_"))
    both = values.select("q", value, F.lit(0).alias("w")).unionByName(reference.select(F.lit(None).cast("bigint").alias("q"), value, F.lit(1).alias("w")))
    per = both.groupBy(value).agg(F.sum("w").alias("w"))
    # values are nearly all distinct, so their running count goes through ranges, not one window
    spread = running_sums(per.withColumn("all_", F.lit(0)).withColumn("le", F.col("w")), "all_", [value], {"le": F.col("w")}, partitions_for(values.sparkSession))
    upto = spread.withColumn("lt", F.col("le") - F.col("w")).select(value, "le", "lt")
    return values.join(upto, value).join(F.broadcast(n)).select("q", value, ((F.col("le") + F.col("lt")) / (2 * F.col("n_"))).alias("pct"))


def switch_rate(neighbours: DataFrame, facts: DataFrame, denominator: int = 16) -> DataFrame:
    """Per query: neighbours whose action is legal here and ours legal there.

    ``facts``: ``id, action, mask``.  The rate's denominator is fixed.
    """
    a = facts.select(F.col("id").alias("q"), F.col("action").alias("qa"), F.col("mask").alias("qm"))
    b = facts.select(F.col("id").alias("r"), F.col("action").alias("ra"), F.col("mask").alias("rm"))
    n = neighbours.join(a, "q").join(b, "r")
    ok = F.get("qm", F.col("ra")) & F.get("rm", F.col("qa"))
    moved = ok & (F.col("qa") != F.col("ra"))
    return n.groupBy("q").agg((F.count_if(moved) / denominator).alias("switchable_rate"), F.count_distinct(F.when(moved, F.col("ra"))).alias("distinct_alt"), F.count_if(ok).alias("eligible"), F.count_if(moved).alias("switched"))


def action_credit(neighbours: DataFrame, facts: DataFrame, min_groups: int = 2, min_size: int = 4) -> DataFrame:
    """Information that the action gives about the target among neighbours.

    A query needs ``min_groups`` actions with ``min_size`` members; then all
    groups enter.  ``facts``: ``id, action, mask, target``.
    """
    a = facts.select(F.col("id").alias("q"), F.col("action").alias("qa"), F.col("mask").alias("qm"))
    b = facts.select(F.col("id").alias("r"), F.col("action").alias("ra"), F.col("mask").alias("rm"), "target")
    n = neighbours.join(a, "q").join(b, "r").where(F.get("qm", F.col("ra")) & F.get("rm", F.col("qa")))
    cells = n.groupBy("q", "ra", "target").agg(F.count("*").alias("c"))
    groups = cells.groupBy("q", "ra").agg(F.sum("c").alias("g"), F.sum(F.col("c") * F.ln("c")).alias("gl"))
    by_target = cells.groupBy("q", "target").agg(F.sum("c").alias("t")).groupBy("q").agg(F.sum(F.col("t") * F.ln("t")).alias("tl"))
    per = groups.groupBy("q").agg(F.sum("g").alias("n"), F.count_if(F.col("g") >= min_size).alias("groups"), F.sum(F.col("g") * F.ln("g") - F.col("gl")).alias("within"))
    j = per.join(by_target, "q").where(F.col("groups") >= min_groups)
    h, ha = F.ln("n") - F.col("tl") / F.col("n"), F.col("within") / F.col("n")
    return j.select("q", F.col("n").alias("eligible"), F.col("groups").alias("valid_groups"), h.alias("h_state"), ha.alias("h_state_action"), (h - ha).alias("gain"))
