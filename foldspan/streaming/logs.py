"""Streaming forms: event-time windows, and state kept until a log's segment ends."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foldspan.runtime import _ensure_checkpoint_dir


def read(spark: SparkSession, folder: str, name: str, ts: str = "ts") -> DataFrame:
    """A table as a stream of files, with a time column that takes watermarks."""
    path = f"{folder}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    # a stream source takes a folder or a pattern, not a single file
    stream = spark.readStream.schema(schema).parquet(path if _is_folder(spark, path) else f"{folder}/{name}[.]parquet")
    return stream.withColumn(ts, F.col(ts).cast("timestamp"))


def _is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def drain(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    Output and offsets go to the shared checkpoint folder; a second run with the
    same offsets would go on where this one stopped.
    """
    spark = stream.sparkSession
    _ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/offsets").trigger(availableNow=True).start(f"{base}/out")
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def windowed_counts(stream: DataFrame, ts: str, keys: list[str], size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts per tumbling window and keys; rows later than ``late`` are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), *keys, "n", "total")


def once(stream: DataFrame, ts: str, key: str, late: str = "7 days") -> DataFrame:
    """Each key once within the watermark, for redelivered rows."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def pending_until(stream: DataFrame, cluster: str, order: str, kind: str, value: str, terminal: str, gamma: float = 0.99) -> DataFrame:
    """Rows wait in state until their cluster's terminal event, then come out with its outcome.

    ``cluster, id, steps, target``: the terminal's value discounted by the rows
    between.  Open rows stay in state.  Rows of one batch are put in order first;
    a cluster's batches must arrive in order, as logs do.
    """
    out = f"{cluster} bigint, event_id bigint, steps int, target double"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting = json.loads(state.get[0]) if state.exists else []
        pdf = pd.concat(list(batches)).sort_values([order, "event_id"])
        done = []
        for i, k, v in zip(pdf["event_id"], pdf[kind], pdf[value]):
            waiting.append(int(i))
            if k == terminal:
                n = len(waiting) - 1
                done += [(key[0], w, n - p, float(v) * gamma ** (n - p)) for p, w in enumerate(waiting)]
                waiting = []
        state.update((json.dumps(waiting),))
        yield pd.DataFrame(done, columns=[cluster, "event_id", "steps", "target"])

    return stream.groupBy(cluster).applyInPandasWithState(step, out, "waiting string", "append", GroupStateTimeout.NoTimeout)


def budgeted(stream: DataFrame, cluster: list[str], segment: str, order: list[str], u: str, p: float = 0.25, per_segment: int = 1, per_cluster: int = 8) -> DataFrame:
    """Streaming form of the exploration budget: counters per cluster live in state.

    Gives ``cluster, segment, order, reason``; equal to the batch form when the
    rows of a cluster arrive in order.
    """
    keep = [*cluster, segment, *order]
    schema = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in keep) + ", reason string"

    def step(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else {"total": 0, "segments": {}}
        pdf = pd.concat(list(batches)).sort_values(order)
        reasons = []
        for seg, x in zip(pdf[segment], pdf[u]):
            used = held["segments"].get(str(seg), 0)
            why = "hanchan_budget_exhausted" if held["total"] >= per_cluster else "kyoku_budget_exhausted" if used >= per_segment else "hash_rejected" if x >= p else "explored"
            if why == "explored":
                held["total"] += 1
                held["segments"][str(seg)] = used + 1
            reasons.append(why)
        state.update((json.dumps(held),))
        yield pdf[keep].assign(reason=reasons)

    return stream.groupBy(*cluster).applyInPandasWithState(step, schema, "held string", "append", GroupStateTimeout.NoTimeout)
