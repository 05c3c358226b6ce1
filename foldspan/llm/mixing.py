"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, the source's
wanted tokens over its tokens.  Within a source, documents stand in order of
size; expected copies are summed along that order, one random offset is added,
and a document is emitted once per whole number its interval crosses.  Copies
of a document thus differ by at most one and never exceed the cap, and as
neighbours in the order have like sizes, tokens hit the share closely.

The prefix sum is taken in two levels: rows are sorted into ranges, numbered
within, and ranges are shifted by the counts before them.  A source that holds
most rows is cut by the ranges like any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldspan.llm import tokens
from foldspan.runtime import cut, partitions_for


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part, now, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        source = batch.column(0)
        change = np.ones(batch.num_rows, bool)
        if batch.num_rows > 1:
            change[1:] = pc.not_equal(source[1:], source[:-1]).to_numpy(zero_copy_only=False)
        change[0] = source[0].as_py() != now
        start = np.maximum.accumulate(np.where(change, np.arange(batch.num_rows), -1))
        place = np.where(start < 0, seen + np.arange(batch.num_rows), np.arange(batch.num_rows) - start)
        now, seen = source[-1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([source, batch.column(1), batch.column(2), pa.array(np.full(batch.num_rows, part), pa.int32()), pa.array(place, pa.int64())], names=["source", "doc_id", "tokens", "part", "place"])


def positions(docs: DataFrame, folder: str = tokens.TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """``source, doc_id, tokens, place``: place in the size order of the source.

    Documents without tokens (null, empty) or without source are left out.
    """
    sized = tokens.count_tokens(docs, ["doc_id", "source"], folder=folder, name=name).where("tokens > 0 and source is not null")
    keyed = sized.select("source", F.col("doc_id").cast("bigint").alias("doc_id"), "tokens", F.xxhash64("doc_id", F.lit(17)).alias("h"))
    order = ["source", "tokens", "h"]
    n = partitions_for(docs.sparkSession)
    keyed = cut(keyed)  # the range partitioner reads its input twice; texts are to be encoded once
    ranges = keyed.repartitionByRange(n, *order).sortWithinPartitions(*order).select("source", "doc_id", "tokens")
    local = cut(ranges.mapInArrow(_number, "source string, doc_id bigint, tokens bigint, part int, place bigint"))
    held = local.groupBy("source", "part").agg(F.count("*").alias("held"))  # ranges x sources
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = held.select("source", "part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("shift"))
    return local.join(shift, ["source", "part"]).select("source", "doc_id", "tokens", (F.col("place") + F.col("shift")).alias("place"))


def plan(targets: DataFrame, sizes: DataFrame, total: float | None = None, seed: int = 1) -> DataFrame:
    """Per mix and source: ``share, cap, tokens, want, rate, offset``.

    Shares are taken relative to the sources that have documents; sources
    without get ``rate`` null.  Without ``total`` a mix is as large as its caps
    allow with every share met (all tokens of its sources where no cap is set);
    with ``total`` a capped source gives what its cap allows.  Rows that name a
    source twice add up, with the smaller cap; null and negative shares count as 0.
    """
    share = F.greatest(F.coalesce("target_share", F.lit(0.0)), F.lit(0.0))
    asked = targets.where("mix is not null and source is not null").groupBy("mix", "source").agg(F.sum(share).alias("target"), F.min("max_repeats").alias("cap"))
    joined = asked.join(sizes, "source", "left").withColumn("usable", F.coalesce((F.col("tokens") > 0) & (F.col("target") > 0) & (F.coalesce("cap", F.lit(1)) > 0), F.lit(False)))
    mix = Window.partitionBy("mix")
    joined = joined.withColumn("share", F.when(F.col("usable"), F.try_divide("target", F.sum(F.when(F.col("usable"), F.col("target"))).over(mix))))
    room = F.min(F.when(F.col("usable") & F.col("cap").isNotNull(), F.try_divide(F.col("cap") * F.col("tokens"), F.col("share")))).over(mix)
    size = F.lit(float(total)) if total is not None else F.coalesce(room, F.sum(F.when(F.col("usable"), F.col("tokens"))).over(mix))
    want = joined.withColumn("want", F.col("share") * size)
    rate = F.try_divide("want", "tokens")
    unit = F.pmod(F.xxhash64("mix", "source", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return want.select("mix", "source", "target", "share", "cap", "tokens", "n_docs", "longest", "want", F.when(rate.isNotNull(), F.least(rate, F.col("cap").cast("double"))).alias("rate"), unit.alias("offset"))


def mixed(docs: DataFrame, targets: DataFrame, total: float | None = None, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """``(taken, shares)``.

    ``taken``: ``mix, source, doc_id, tokens, copies`` of each taken document.
    ``shares``: per mix and source the wanted and the reached share of tokens,
    the documents and tokens at hand and emitted, the most copies of one document
    and its longest one; sources without documents are listed with nothing reached.
    """
    placed = positions(docs)
    sizes = placed.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n_docs"), F.max("tokens").alias("longest"))
    wanted = plan(targets, sizes, total, seed)
    rates = F.broadcast(wanted.where("rate > 0").select("mix", "source", "rate", "offset"))  # as many rows as mix_targets has
    cross = lambda step: F.floor(F.round(F.col("rate") * (F.col("place") + step) + F.col("offset"), 9))
    taken = placed.join(rates, "source").withColumn("copies", (cross(1) - cross(0)).cast("int")).where("copies > 0").select("mix", "source", "doc_id", "tokens", "copies")
    got = taken.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("emitted"), F.count("*").alias("docs_taken"), F.max("copies").alias("most_copies"))
    mix = Window.partitionBy("mix")
    emitted = F.coalesce("emitted", F.lit(0))
    shares = wanted.join(got, ["mix", "source"], "left").select(
        "mix", "source", F.col("target").alias("target_share"), F.round("share", 6).alias("wanted_share"), F.round(F.coalesce(F.try_divide(emitted, F.sum(emitted).over(mix)), F.lit(0.0)), 6).alias("reached_share"),
        F.col("cap").alias("max_repeats"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"), F.coalesce("docs_taken", F.lit(0)).alias("docs_taken"), F.coalesce("tokens", F.lit(0)).alias("tokens"), emitted.alias("emitted"), F.coalesce("longest", F.lit(0)).alias("longest"),
    )
    return taken, shares


def conserved(taken: DataFrame, shares: DataFrame, off: float = 0.02) -> DataFrame:
    """``mix, source, usable, cap_kept, sums_agree, share_reached`` of every wanted mix and source.

    ``sums_agree`` adds the copies up anew.  A source's tokens are off by its longest
    document at most, as documents are drawn in the order of size, and the total by
    those of all sources; ``share_reached`` allows that much, or ``off`` if it is more.
    """
    sums = taken.groupBy("mix", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("again"), F.count("*").alias("rows"), F.max("copies").alias("most"))
    mix = Window.partitionBy("mix")
    all_ = F.sum(F.coalesce("again", F.lit(0))).over(mix)
    one = F.when(F.col("wanted_share").isNotNull(), F.col("longest")).otherwise(0)
    near = F.greatest(F.lit(off), F.try_divide(one + F.col("wanted_share") * F.sum(one).over(mix), all_))
    return shares.join(sums, ["mix", "source"], "left").select(
        "mix", "source", F.col("wanted_share").isNotNull().alias("usable"),
        (F.coalesce("most", F.lit(0)) <= F.coalesce("max_repeats", F.lit(2**31 - 1))).alias("cap_kept"),
        ((F.coalesce("again", F.lit(0)) == F.col("emitted")) & (F.coalesce("rows", F.lit(0)) == F.col("docs_taken")) & (F.coalesce("rows", F.lit(0)) <= F.col("n_docs"))).alias("sums_agree"),
        (F.abs(F.coalesce("wanted_share", F.lit(0.0)) - F.col("reached_share")) <= F.coalesce(near, F.lit(off))).alias("share_reached"),
    )


def left_out(docs: DataFrame) -> DataFrame:
    """``reason, docs``: documents no mix can take."""
    reason = F.when(F.col("text").isNull(), "null text").when(F.col("text") == "", "empty text").when(F.col("source").isNull(), "no source")
    return docs.select(reason.alias("reason")).where("reason is not null").groupBy("reason").agg(F.count("*").alias("docs"))
