"""Writers: versioned Parquet, resumable exports, manifests and reports."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERSION = "foldspan.version"


def write_versioned(df: DataFrame, out: str, name: str, version: int, by: list[str] | None = None) -> None:
    """Parquet with schema name and version on every row group's first column.

    Refuses an existing folder; the committer makes the write atomic.
    """
    first = df.schema[0]
    tagged = df.withMetadata(first.name, {**first.metadata, VERSION: f"{name}:{version}"})
    w = tagged.write.mode("errorifexists").option("compression", "zstd")
    (w.partitionBy(*by) if by else w).parquet(out)


def read_versioned(spark: SparkSession, path: str, name: str, version: int) -> DataFrame:
    """Reads such a folder; another name or version raises."""
    df = spark.read.parquet(path)
    found = df.schema[0].metadata.get(VERSION)
    if found != f"{name}:{version}":
        raise ValueError(f"{path} holds {found}, not {name}:{version}")
    return df


def drop_unreadable(spark: SparkSession, out: str) -> int:
    """Removes Parquet files below ``out`` that cannot be read; how many there were."""
    there = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True).load(out).select("path")
    bad = there.where(F.col("path").isNotNull())
    good = spark.read.option("ignoreCorruptFiles", True).parquet(out).select(F.col("_metadata.file_path").alias("p")).distinct()
    norm = lambda c: F.regexp_replace(c, "^file:/+", "/")
    paths = [r.path for r in bad.join(good, norm(F.col("path")) == norm(F.col("p")), "left_anti").collect()]  # torn files, a few after a lost run
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, False)
    return len(paths)


def write_missing(df: DataFrame, out: str, key: str, rebuild: bool = False) -> int:
    """Appends rows whose key is not there yet; the number of keys written.

    With ``rebuild`` files that cannot be read are removed first, so that their
    rows are written again.
    """
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(out)
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        if rebuild:
            drop_unreadable(spark, out)
        df = df.join(spark.read.parquet(out).select(key).distinct(), key, "left_anti")
    n = df.select(key).distinct().count()
    if n:
        df.write.mode("append").parquet(out)
    return n


def write_events(df: DataFrame, out: str, order: list[str]) -> None:
    """JSON lines, each file sorted by ``order`` and files by its ranges."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists").json(out)


def write_csv(df: DataFrame, out: str, sep: str = ",") -> None:
    df.write.mode("errorifexists").option("header", True).option("sep", sep).csv(out)


def quarantine(bad: DataFrame, out: str) -> None:
    """Failures as JSON lines; an older list is replaced."""
    bad.write.mode("overwrite").json(out)


def export_manifest(jobs: DataFrame) -> DataFrame:
    """One document per manifest: counts, counts per shard, and its paths as JSON.

    Shards are counted before the map is made, so a huge shard stays one number.
    """
    per = jobs.groupBy("manifest_id", F.coalesce("shard", F.lit("unknown")).alias("shard")).agg(F.count("*").alias("n"), F.sum("size_bytes").alias("bytes"))
    return per.groupBy("manifest_id").agg(F.sum("n").alias("file_count"), F.sum("bytes").alias("bytes"), F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct("shard", "n"))))).alias("shard_file_counts"))


def metrics_document(row: dict, run: dict, profile: str, points) -> dict:
    """A schema-tagged report of one result row; non-finite numbers become null."""
    clean = {k: None if isinstance(v, float) and (v != v or abs(v) == float("inf")) else v for k, v in row.items()}
    return {"schema": "foldspan.metrics.v1", "run": run, "metrics": clean, "rank_points_profile": profile, "rank_points_values": [float(p) for p in points]}


def write_document(doc: dict, path: str) -> None:
    Path(path).write_text(json.dumps(doc, indent=2, sort_keys=True, allow_nan=False) + "\n", encoding="utf-8")


def markdown(rows: list[dict], label: str) -> str:
    """Metric rows by participant columns; null as NA, fractions with six digits."""
    show = lambda v: "NA" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    metrics = [k for k in rows[0] if k != label] if rows else []
    head = ["metric", *[str(r[label]) for r in rows]]
    lines = [head, ["---"] * len(head), *[[m, *[show(r[m]) for r in rows]] for m in metrics]]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines) + "\n"
