"""Shared inputs of the queries, in Spark and in SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspan.sources.tables import table

FINITE = "{0} is not null and not isnan({0}) and abs({0}) < 1e308"


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """``events`` as an ordered log: cluster ``user_id``, place ``idx`` from 0."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", "ts", "event_type", "value", (F.row_number().over(w) - 1).alias("idx"))


def at_reps(queries: dict, oracle: dict, name: str, reps: int, *swaps: tuple[str, str]) -> None:
    """Registers a query once more with the reference's number of draws, with its SQL so changed."""
    query, sql = queries[name], oracle[name]
    for old, new in swaps:
        if old not in sql:
            raise ValueError(f"{name}: its SQL lacks {old}")
        sql = sql.replace(old, new)
    queries[f"{name}_{reps}"], oracle[f"{name}_{reps}"] = functools.partial(query, reps=reps), sql


EV = "ev AS (SELECT user_id, event_id, ts, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"
SEG = EV + ", seg AS (SELECT *, CAST(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY idx) - 1 AS BIGINT) AS segment FROM ev)"


def seat_scores(spark: SparkSession, d: str) -> DataFrame:
    """Games of four seats: a day of ``events`` by ``user_id % 4``, whole scores with ties."""
    e = table(spark, d, "events")
    return e.groupBy(F.to_date("ts").cast("string").alias("game"), F.pmod("user_id", F.lit(4)).cast("int").alias("seat")).agg(F.floor(F.sum("value") / 400).cast("bigint").alias("score"), F.dayofmonth(F.min("ts")).alias("day"))


SEATS = "g AS (SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS game, CAST(user_id % 4 AS INTEGER) AS seat, CAST(floor(sum(value) / 400) AS BIGINT) AS score, CAST(day(min(ts)) AS INTEGER) AS day FROM events GROUP BY 1, 2)"
POINTS = "CAST(CASE rank WHEN 1 THEN 90.0 WHEN 2 THEN 45.0 WHEN 3 THEN 0.0 ELSE -135.0 END AS DOUBLE)"
LEGAL = "list_filter(list_transform(range(46), lambda i: CASE WHEN mask[i + 1] AND q[i + 1] IS NOT NULL AND isfinite(q[i + 1]) THEN {'a': i, 'q': q[i + 1]} END), lambda x: x IS NOT NULL)"
