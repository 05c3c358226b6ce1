"""Scans of event logs, results, configs and manifests."""

from __future__ import annotations

import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldspan.operators.replay import EVENT


def text_lines(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> DataFrame:
    """``log_id, event_index, line`` of text files, plain or compressed, blank lines left out.

    A file is read as one value, because only that keeps its line order; gzip
    goes by extension.  ``log_id`` is the file's path.  Missing folders raise.
    """
    r = spark.read.option("recursiveFileLookup", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    files = r.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("log_id"), F.split("value", "\r\n|\n").alias("l"))
    return files.select("log_id", F.filter("l", lambda x: F.trim(x) != "").alias("l")).select("log_id", F.posexplode("l").alias("event_index", "line"))


def events(spark: SparkSession, paths: str | list[str], glob: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``(events, bad)``: typed events, and the lines that could not be read.

    One bad line or file never costs the others.
    """
    lines = text_lines(spark, paths, glob)
    parsed = lines.withColumn("e", F.from_json("line", EVENT))
    good = parsed.where("e.type is not null").select("log_id", "event_index", "e.*")
    return good, parsed.where("e.type is null").select("log_id", "event_index", "line")


def files_of(spark: SparkSession, globs: list[str]) -> DataFrame:
    """``path, bytes`` of all files any pattern matches, each once; none at all raises."""
    found = spark.read.format("binaryFile").load(globs).select("path", F.col("length").alias("bytes")).distinct()
    if found.isEmpty():
        raise FileNotFoundError(f"no file matches {globs}")
    return found


def indexed(index: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Files of an index, in the spelling of ``files``; a listed file that is not there raises when read."""
    norm = lambda c: F.regexp_replace(F.regexp_replace(c, r"^file:/+", "/"), "/+", "/")
    there = files.select(norm(F.col("path")).alias("k_"), F.col("path").alias("found_"), "bytes")
    both = index.select(norm(F.col(path)).alias("k_")).distinct().join(there, "k_", "left")
    return both.select(F.coalesce("found_", F.raise_error(F.concat(F.lit("listed file is missing: "), "k_"))).alias("path"), "bytes")


def context_events(lines: DataFrame, schema: str, context: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(events, errors)`` of numbered JSON lines ``log_id, event_index, line``.

    Events are range-sorted by their context key; errors name file and line, from 1.
    A line is an error if it is no JSON object of the schema or lacks part of the key.
    """
    parsed = lines.withColumn("e", F.from_json("line", schema))
    whole = F.col("e").isNotNull()
    for c in context:
        whole = whole & F.col(f"e.{c}").isNotNull()
    good = parsed.where(whole).select("log_id", (F.col("event_index") + 1).alias("line_no"), "e.*")
    bad = parsed.where(~F.coalesce(whole, F.lit(False))).select("log_id", (F.col("event_index") + 1).alias("line_no"), "line")
    return good.repartitionByRange(*context).sortWithinPartitions(*context), bad


def perspectives(logs: DataFrame, names: DataFrame | None = None, label: str | None = None) -> DataFrame:
    """Logs ``log_id, ...`` with the participant each is seen by: one ``label`` for all, or ``names`` per file.

    ``names`` has ``log_id, label``; a log without a name raises when read.
    """
    if label is not None:
        return logs.withColumn("label", F.lit(label))
    named = logs.join(names.select("log_id", F.col("label").alias("l_")), "log_id", "left")
    return named.withColumn("label", F.coalesce("l_", F.raise_error(F.concat(F.lit("no perspective for "), "log_id")))).drop("l_")


def cache(spark: SparkSession, path: str, optional: dict[str, str] | None = None, workers: int = 1, worker: int = 0, fail_fast: bool = True) -> DataFrame:
    """Rows of a Parquet cache that one of ``workers`` takes, by file.

    Optional columns an older cache lacks come out null; without ``fail_fast``
    unreadable files are passed over.
    """
    df = spark.read.option("ignoreCorruptFiles", not fail_fast).option("mergeSchema", True).parquet(path)
    if workers > 1:
        df = df.where(F.pmod(F.xxhash64(F.col("_metadata.file_path")), F.lit(workers)) == worker)
    return df.withColumns({c: F.lit(None).cast(t) for c, t in (optional or {}).items() if c not in df.columns})


def strict_logs(events_: DataFrame, labels: list[str] | None = None, raises: bool = False) -> DataFrame:
    """``log_id, ok, reason`` per log: one start, segments, four different names, one seed.

    The seed must be that in the file's name where it has one (``..._SEED_KEY.ext``),
    and with ``labels`` names must begin with one of them.  ``raises`` turns the
    first violation read into an error.
    """
    start = F.col("type") == "start_game"
    g = events_.groupBy("log_id").agg(F.count_if(start).alias("starts"), F.count_if(F.col("type") == "start_kyoku").alias("segments"), F.max(F.when(start, F.size(F.array_distinct("names")))).alias("names"), F.max(F.when(start, F.size("seed"))).alias("seed"), F.max(F.when(start, F.array_join(F.transform("seed", lambda x: x.cast("string")), "_"))).alias("text_"), F.max(F.when(start, F.transform("names", lambda x: F.regexp_extract(x, "^[^_]+", 0)))).alias("labels_"))
    told = F.regexp_extract("log_id", r"(\d+_\d+)(?:\.[a-z.]+)?$", 1)
    strange = F.size(F.array_except("labels_", F.array(*map(F.lit, labels)))) > 0 if labels else F.lit(False)
    reason = F.when(F.col("starts") != 1, "start_game").when(F.col("segments") < 1, "start_kyoku").when(F.coalesce("names", F.lit(0)) != 4, "names").when(F.coalesce("seed", F.lit(0)) != 2, "seed").when((told != "") & (told != F.col("text_")), "file name").when(strange, "labels")
    if raises:
        reason = F.when(reason.isNotNull(), F.raise_error(F.concat("log_id", F.lit(": "), reason)))
    return g.select("log_id", reason.isNull().alias("ok"), reason.alias("reason"))


def results(spark: SparkSession, path: str, labels: list[str], key: list[str], label: str = "model_label", value: str = "rank") -> DataFrame:
    """A CSV of one row per participant, pivoted to one row per game.

    Duplicate ``key, label`` rows raise when the result is read.
    """
    rows = spark.read.option("header", True).option("inferSchema", False).option("encoding", "UTF-8").csv(path)
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns])
    checked = rows.groupBy(*key, label).agg(F.count("*").alias("n"), F.first(value).alias("v"))
    checked = checked.withColumn("v", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("duplicate result row: "), F.concat_ws("/", *key, label)))).otherwise(F.col("v")))
    return checked.groupBy(*key).pivot(label, labels).agg(F.first("v"))


def json_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def toml_document(path: str) -> dict:
    return tomllib.loads(Path(path).read_text(encoding="utf-8-sig"))


def manifest(df: DataFrame, path_col: str = "path", limit: int | None = None, expected: int | None = None) -> DataFrame:
    """Distinct paths with ``/`` as separator, sorted; the first ``limit`` of them.

    ``expected`` raises when the number of paths differs.
    """
    out = df.select(F.translate(F.trim(path_col), "\\", "/").alias("path")).where("path is not null").distinct()
    if expected is not None and (n := out.count()) != expected:
        raise ValueError(f"expected {expected} paths, found {n}")
    return out.orderBy("path").limit(limit) if limit is not None else out


def last_write_wins(series: DataFrame, keys: list[str], file: str, position: str, value: str, rtol: float = 1e-6, atol: float = 1e-7) -> tuple[DataFrame, DataFrame]:
    """``(series, conflicts)``: per key the value written last, and rewrites that differ."""
    order = F.struct(file, position)
    kept = series.groupBy(*keys).agg(F.max_by(value, order).alias(value))
    w = Window.partitionBy(*keys).orderBy(file, position)
    before = F.lag(value).over(w)
    clash = F.abs(F.col(value) - before) > atol + rtol * F.abs(before)
    return kept, series.withColumn("before", before).withColumn("clash_", clash).where("clash_").drop("clash_")


def latest_pass(ledger: DataFrame, key: str, status: str, position: str) -> DataFrame:
    """Of an append-only ledger, the last passing entry per key."""
    rest = [c for c in ledger.columns if c != key]
    return ledger.where(F.col(status) == "PASS").groupBy(key).agg(F.max_by(F.struct(*rest), position).alias("r")).select(key, "r.*")


def remapped(df: DataFrame, column: str, prefixes: dict[str, str]) -> DataFrame:
    """Paths with the first matching prefix replaced, back-slashes turned round."""
    p = F.translate(F.col(column), "\\", "/")
    out = None
    for a, b in prefixes.items():
        new = F.concat(F.lit(b), F.expr(f"substring(translate(`{column}`, '\\\\', '/'), {len(a) + 1})"))
        out = F.when(p.startswith(a), new) if out is None else out.when(p.startswith(a), new)
    return df.withColumn(column, p if out is None else out.otherwise(p))


def shard_reports(spark: SparkSession, paths: str | list[str], schema: str, expected: int, rules: dict[str, str] | None = None) -> DataFrame:
    """One JSON report per shard; exactly ``expected`` of them, each meeting every rule.

    ``rules`` are SQL conditions by name; a report that breaks one raises when read.
    """
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).json(paths).withColumn("shard_path", F.col("_metadata.file_path"))
    if (n := df.select("shard_path").distinct().count()) != expected:
        raise ValueError(f"expected {expected} shard reports, found {n}")
    for name, rule in (rules or {}).items():
        ok = F.coalesce(F.expr(rule), F.lit(False))
        df = df.withColumn("shard_path", F.when(ok, F.col("shard_path")).otherwise(F.raise_error(F.concat(F.lit(f"{name}: "), "shard_path"))))
    return df


def renamed(events_: DataFrame, names: DataFrame) -> DataFrame:
    """Logs with the names of their start record replaced: ``names`` has ``log_id, new_names``."""
    j = events_.join(names.select("log_id", "new_names"), "log_id", "left")
    new = F.when((F.col("type") == "start_game") & F.col("new_names").isNotNull(), F.col("new_names")).otherwise(F.col("names"))
    return j.withColumn("names", new).drop("new_names")
