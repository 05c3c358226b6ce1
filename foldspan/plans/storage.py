"""Queries on sources and sinks: tables are written to a shared folder in the form at hand and scanned again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldspan.plans.common import SEATS, seat_scores
from foldspan.runtime import scratch
from foldspan.sources import readers, sinks
from foldspan.sources.tables import table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINES = "l AS (SELECT file_id, unnest(string_split(replace(body, chr(13), ''), chr(10))) AS line FROM export_jobs), k AS (SELECT * FROM l WHERE trim(line) <> ''), j AS (SELECT CASE WHEN json_valid(line) THEN CASE WHEN json_type(line) = 'OBJECT' THEN json_extract_string(line, '$.type') END END AS type, CASE WHEN json_valid(line) THEN TRY_CAST(json_extract_string(line, '$.actor') AS INTEGER) END AS actor FROM k)"
SCANNED = f"WITH {LINES} SELECT coalesce(type, 'unreadable') AS type, CASE WHEN type IS NOT NULL THEN actor END AS actor, count(*) AS n FROM j GROUP BY 1, 2"


def _logs(spark, d, codec: str) -> str:
    folder = scratch(spark, "logs")
    lines = table(spark, d, "export_jobs").select("file_id", F.posexplode(F.split("body", "\r\n|\n|\r")).alias("no", "line"))
    lines.repartition("file_id").sortWithinPartitions("file_id", "no").select("line").write.option("compression", codec).text(folder)
    return folder


def _scanned(good, bad):
    return good.groupBy("type", "actor").agg(F.count("*").alias("n")).unionByName(bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit("unreadable").alias("type"), F.lit(None).cast("int").alias("actor"), "n"))


@query(SCANNED)
def ndjson_scan(spark, d):
    return _scanned(*readers.events(spark, _logs(spark, d, "none"), "*.txt"))


@query(SCANNED)
def gzip_scan(spark, d):
    return _scanned(*readers.events(spark, _logs(spark, d, "gzip"), "*.gz"))


@query("SELECT true AS each_once, true AS indexed, true AS counted, true AS missing_raises")
def file_index_scan(spark, d):
    """Files of overlapping patterns come once, an index finds them all, and a listed file that is gone raises."""
    folder = _logs(spark, d, "none")
    files = readers.files_of(spark, [f"{folder}/*.txt", f"{folder}/part-*"])
    n = files.count()
    found = readers.indexed(files.select(F.regexp_replace("path", "^file:/+", "/").alias("path")), files).count()
    try:
        readers.manifest(files, expected=n + 1)
        counted = False
    except ValueError:
        counted = readers.manifest(files, expected=n).count() == n
    gone = readers.indexed(files.select(F.concat("path", F.lit(".gone")).alias("path")).limit(1), files)
    try:
        gone.collect()
        raised = False
    except Exception as x:
        raised = "listed file is missing" in str(x)
    return spark.createDataFrame([(n == files.select("path").distinct().count(), found == n, counted, raised)], "each_once boolean, indexed boolean, counted boolean, missing_raises boolean")


KEYS = ["generation_seed", "seed_key", "seat", "kyoku_index", "decision_index"]
_WHOLE = " AND ".join(f"{k} IS NOT NULL" for k in [*KEYS, "action"])


@query(f"SELECT CASE WHEN {_WHOLE} THEN seat END AS seat, count(*) AS n, CAST(sum(CASE WHEN {_WHOLE} THEN action END) AS BIGINT) AS actions, NOT bool_or({_WHOLE}) AS torn FROM decision_snapshots GROUP BY 1")
def context_event_scan(spark, d):
    t = table(spark, d, "decision_snapshots")
    text = F.to_json(F.struct(*KEYS, "action"))
    folder = scratch(spark, "contexts")
    t.select(F.when(F.col("action").isNull(), F.substring(text, 1, 20)).otherwise(text).alias("line")).write.text(folder)
    good, bad = readers.context_events(readers.text_lines(spark, folder, "*.txt"), "generation_seed bigint, seed_key bigint, seat int, kyoku_index int, decision_index int, action int", KEYS)
    rows = good.groupBy("seat").agg(F.count("*").alias("n"), F.sum("action").alias("actions")).withColumn("torn", F.lit(False))
    return rows.unionByName(bad.agg(F.count("*").alias("n")).where("n > 0").select(F.lit(None).cast("int").alias("seat"), "n", F.lit(None).cast("bigint").alias("actions"), F.lit(True).alias("torn")))


@query("SELECT generation_seed, seed_key, count(*) AS n, count(DISTINCT seat < 2) AS roots FROM decision_snapshots WHERE generation_seed IS NOT NULL AND seed_key IS NOT NULL AND seat IS NOT NULL GROUP BY 1, 2")
def multi_root_scan(spark, d):
    t, folder = table(spark, d, "decision_snapshots").select(*KEYS).where("generation_seed is not null and seed_key is not null"), scratch(spark, "roots")
    t.where("seat < 2").write.json(f"{folder}/a")
    t.where("seat >= 2").write.json(f"{folder}/b")
    both = spark.read.schema("generation_seed bigint, seed_key bigint, seat int").json([f"{folder}/a", f"{folder}/b"]).withColumn("root", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    per = both.groupBy("generation_seed", "seed_key", "root").agg(F.count("*").alias("n"))
    return per.groupBy("generation_seed", "seed_key").agg(F.sum("n").alias("n"), F.count("*").alias("roots"))


_STRICT = "g AS (SELECT generation_seed AS g, seed_key AS k, count(DISTINCT kyoku_index) AS segments FROM decision_snapshots WHERE generation_seed IS NOT NULL AND seed_key IS NOT NULL AND seat IS NOT NULL GROUP BY 1, 2)"


@query(f"WITH {_STRICT} SELECT g || '_' || CASE WHEN k % 11 = 0 THEN k + 1000000 ELSE k END || '.mjson' AS log_id, k % 7 <> 0 AND k % 11 <> 0 AND k % 13 <> 0 AND segments > 0 AS ok, CASE WHEN segments = 0 THEN 'start_kyoku' WHEN k % 7 = 0 THEN 'names' WHEN k % 11 = 0 THEN 'file name' WHEN k % 13 = 0 THEN 'labels' END AS reason FROM g")
def strict_log_audit(spark, d):
    """Logs told from snapshots, a few of them with a name twice, a wrong file name or a strange label."""
    t = table(spark, d, "decision_snapshots").where("generation_seed is not null and seed_key is not null and seat is not null")
    logs = t.groupBy(F.col("generation_seed").alias("g"), F.col("seed_key").alias("k")).agg(F.collect_set("kyoku_index").alias("s"))
    name = F.concat_ws("", F.concat_ws("_", F.col("g").cast("string"), F.when(F.col("k") % 11 == 0, F.col("k") + 1000000).otherwise(F.col("k")).cast("string")), F.lit(".mjson"))
    names = F.array(F.lit("M0_a"), F.lit("D1_b"), F.lit("D2_c"), F.when(F.col("k") % 7 == 0, "M0_a").when(F.col("k") % 13 == 0, "X9_d").otherwise("D3_d"))
    start = logs.select(name.alias("log_id"), F.lit("start_game").alias("type"), names.alias("names"), F.array("g", "k").alias("seed"))
    rounds = logs.select(name.alias("log_id"), F.explode("s").alias("x")).select("log_id", F.lit("start_kyoku").alias("type"), F.lit(None).cast("array<string>").alias("names"), F.lit(None).cast("array<bigint>").alias("seed"))
    return readers.strict_logs(start.unionByName(rounds), ["M0", "D1", "D2", "D3"])


@query("SELECT CASE WHEN file_id % 3 = 0 THEN 'a' ELSE 'b' END AS label, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS bytes FROM export_jobs GROUP BY 1")
def perspective_batches(spark, d):
    t = table(spark, d, "export_jobs").select(F.col("file_id").cast("string").alias("log_id"), "size_bytes")
    names = t.select("log_id", F.when(F.col("log_id").cast("bigint") % 3 == 0, "a").otherwise("b").alias("label"))
    return readers.perspectives(t, names).groupBy("label").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("bytes"))


@query(f"WITH {SEATS}, r AS (SELECT game, seat, row_number() OVER (PARTITION BY game ORDER BY score DESC, seat) AS rank FROM g) SELECT game, CAST(max(CASE WHEN seat = 0 THEN rank END) AS VARCHAR) AS s0, CAST(max(CASE WHEN seat = 1 THEN rank END) AS VARCHAR) AS s1, CAST(max(CASE WHEN seat = 2 THEN rank END) AS VARCHAR) AS s2, CAST(max(CASE WHEN seat = 3 THEN rank END) AS VARCHAR) AS s3 FROM r GROUP BY 1")
def result_csv_pivot(spark, d):
    w = Window.partitionBy("game").orderBy(F.desc("score"), "seat")
    rows = seat_scores(spark, d).select("game", F.concat(F.lit("s"), F.col("seat").cast("string")).alias("model_label"), F.row_number().over(w).alias("rank"))
    folder = scratch(spark, "results")
    sinks.write_csv(rows, folder)
    return readers.results(spark, folder, ["s0", "s1", "s2", "s3"], ["game"])


@query("SELECT 'foldspan.metrics.v1' AS schema, n_regionkey AS run, count(*) AS nations, min(n_name) AS first FROM nation GROUP BY 2")
def metrics_documents(spark, d):
    """One pretty JSON document per region, with a byte order mark, read back by its schema."""
    n = table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("run")).agg(F.count("*").alias("nations"), F.min("n_name").alias("first"))
    folder = scratch(spark, "documents")
    text = F.concat(F.lit("﻿"), F.to_json(F.struct(F.lit("foldspan.metrics.v1").alias("schema"), "run", "nations", "first"), {"pretty": "true"}))
    n.repartitionByRange(64, "run").select(text.alias("value")).write.text(folder)
    return readers.json_document(spark, folder, "schema string, run int, nations bigint, first string").where("schema is not null")


@query("SELECT manifest_id AS shard, CAST(count(*) AS BIGINT) AS files FROM export_jobs WHERE manifest_id IS NOT NULL GROUP BY 1")
def shard_report_scan(spark, d):
    per = table(spark, d, "export_jobs").where("manifest_id is not null").groupBy(F.col("manifest_id").alias("shard")).agg(F.count("*").alias("files"))
    folder = scratch(spark, "reports")
    per.write.partitionBy("shard").json(folder)
    read = readers.shard_reports(spark, folder, "files bigint", per.count(), {"files": "files > 0"})
    return read.select(F.regexp_extract("shard_path", r"shard=(-?\d+)", 1).cast("bigint").alias("shard"), "files")


_SERIES = "s AS (SELECT obs_id, log_id, loaded_at, max(q_target) AS v FROM learnability_rows WHERE obs_id IS NOT NULL AND log_id IS NOT NULL AND loaded_at IS NOT NULL AND isfinite(q_target) GROUP BY 1, 2, 3)"


def _series(spark, d):
    t = table(spark, d, "learnability_rows").where("obs_id is not null and log_id is not null and loaded_at is not null and q_target is not null and not isnan(q_target) and abs(q_target) < double('infinity')")
    return t.groupBy("obs_id", "log_id", "loaded_at").agg(F.max("q_target").alias("v"))


@query(f"WITH {_SERIES} SELECT obs_id, round(max_by(v, log_id || CAST(loaded_at AS VARCHAR)), 9) AS v FROM s GROUP BY 1")
def series_last_write(spark, d):
    return readers.last_write_wins(_series(spark, d), ["obs_id"], "log_id", "loaded_at", "v")[0].select("obs_id", F.round("v", 9).alias("v"))


@query(f"WITH {_SERIES}, b AS (SELECT *, lag(v) OVER (PARTITION BY obs_id ORDER BY log_id, loaded_at) AS before FROM s) SELECT obs_id, round(before, 9) AS before, round(v, 9) AS v FROM b WHERE abs(v - before) > 1e-7 + 1e-6 * abs(before)")
def series_conflicts(spark, d):
    bad = readers.last_write_wins(_series(spark, d), ["obs_id"], "log_id", "loaded_at", "v")[1]
    return bad.select("obs_id", F.round("before", 9).alias("before"), F.round("v", 9).alias("v"))


@query("SELECT o_custkey AS shard, max_by(o_totalprice, o_orderkey) AS price, max(o_orderkey) AS line FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def ledger_latest_pass(spark, d):
    t = table(spark, d, "orders").select(F.col("o_custkey").alias("shard"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("line"), F.when(F.col("o_orderstatus") == "F", "PASS").otherwise("FAIL").alias("status"))
    return readers.latest_pass(t, "shard", "status", "line").select("shard", "price", "line")


@query("SELECT count(*) AS n, count(*) AS without, CAST(sum(action) AS BIGINT) AS actions FROM decisions")
def cache_scan(spark, d):
    """A cache taken in turns by three workers, with a column it lacks."""
    folder = scratch(spark, "cache")
    table(spark, d, "decisions").select("obs_id", "action").repartition(12).write.parquet(folder)
    parts = [readers.cache(spark, folder, {"belief": "array<float>"}, 3, k) for k in range(3)]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("belief").isNull()).alias("without"), F.sum("action").alias("actions"))


@query("SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'decisions', count(*) FROM decisions")
def footer_counts(spark, d):
    """Row counts that need the files' footers only."""
    one = lambda t: table(spark, d, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
    return one("orders").unionByName(one("documents")).unionByName(one("decisions"))


@query("SELECT file_id, CASE WHEN starts_with(replace(src_path, chr(92), '/'), '/lake/raw') THEN '/mnt/raw' || substr(replace(src_path, chr(92), '/'), 10) ELSE replace(src_path, chr(92), '/') END AS src_path FROM export_jobs")
def remapped_paths(spark, d):
    return readers.remapped(table(spark, d, "export_jobs").select("file_id", "src_path"), "src_path", {"/lake/raw": "/mnt/raw"})


@query("SELECT DISTINCT replace(trim(src_path), chr(92), '/') AS path FROM export_jobs WHERE src_path IS NOT NULL ORDER BY 1 LIMIT 25")
def manifest_prefix(spark, d):
    return readers.manifest(table(spark, d, "export_jobs"), "src_path", limit=25)


@query("SELECT count(*) AS n, round(sum(c_acctbal), 2) AS total, true AS refuses_other_version, true AS refuses_overwrite FROM customer")
def versioned_round_trip(spark, d):
    folder, t = scratch(spark, "versioned"), table(spark, d, "customer")
    sinks.write_versioned(t, folder, "customers", 2)

    def raises(f) -> bool:
        try:
            f()
        except Exception as x:
            return "customers" in str(x) or "EXISTS" in str(x).upper()
        return False

    other, again = raises(lambda: sinks.read_versioned(spark, folder, "customers", 1)), raises(lambda: sinks.write_versioned(t, folder, "customers", 2))
    return sinks.read_versioned(spark, folder, "customers", 2).agg(F.count("*").alias("n"), F.round(F.sum("c_acctbal"), 2).alias("total")).withColumns({"refuses_other_version": F.lit(other), "refuses_overwrite": F.lit(again)})


@query("SELECT count(*) AS n, CAST(sum(manifest_id) AS BIGINT) AS ids, CAST(count(*) - count(*) FILTER (manifest_id % 2 = 0) AS BIGINT) AS written, CAST(0 AS BIGINT) AS again FROM export_manifests")
def resumable_write(spark, d):
    """Half of a table is there; the rest is appended, and a third run writes nothing."""
    folder, t = scratch(spark, "resumed"), table(spark, d, "export_manifests").select("manifest_id", "file_count")
    t.where("manifest_id % 2 = 0").write.parquet(folder)
    written, again = sinks.write_missing(t, folder, "manifest_id"), sinks.write_missing(t, folder, "manifest_id")
    return spark.read.parquet(folder).agg(F.count("*").alias("n"), F.sum("manifest_id").alias("ids")).withColumns({"written": F.lit(written).cast("bigint"), "again": F.lit(again).cast("bigint")})


@query("SELECT count(*) AS n, CAST(sum(manifest_id) AS BIGINT) AS ids, true AS rebuilt FROM export_manifests")
def rebuilt_write(spark, d):
    """A torn output file is found, removed and its rows are written again."""
    folder, t = scratch(spark, "rebuilt"), table(spark, d, "export_manifests").select("manifest_id", "file_count")
    t.where("manifest_id % 2 = 0").write.parquet(folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/part-torn.parquet")
    out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path)
    out.writeBytes("PAR1 torn")
    out.close()
    n = sinks.write_missing(t, folder, "manifest_id", rebuild=True)
    return spark.read.parquet(folder).agg(F.count("*").alias("n"), F.sum("manifest_id").alias("ids")).withColumn("rebuilt", F.lit(n > 0))


@query("SELECT count(*) AS n, true AS in_order FROM decision_snapshots WHERE action IS NOT NULL")
def sorted_event_files(spark, d):
    """Events written in the order of their context: every file is sorted and ends before the next begins."""
    folder = scratch(spark, "sorted")
    sinks.write_events(table(spark, d, "decision_snapshots").where("action is not null").select(*KEYS, "action"), folder, KEYS)
    rows = readers.text_lines(spark, folder, "*.json")
    key = F.from_json("line", "generation_seed bigint, seed_key bigint, seat int, kyoku_index int, decision_index int")
    w = Window.partitionBy("log_id").orderBy("event_index")
    rows = rows.withColumn("k", key).withColumn("ok", F.coalesce(F.lag("k").over(w) <= F.col("k"), F.lit(True)))
    files = rows.groupBy("log_id").agg(F.count("*").alias("n"), F.bool_and("ok").alias("ok"), F.min("k").alias("lo"), F.max("k").alias("hi"))
    after = F.coalesce(F.lag("hi").over(Window.orderBy("lo")) <= F.col("lo"), F.lit(True))  # one row per file
    return files.withColumn("ok", F.col("ok") & after).agg(F.sum("n").alias("n"), F.bool_and("ok").alias("in_order"))


@query("SELECT o_orderpriority AS status, count(*) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def quarantine_round_trip(spark, d):
    folder, t = scratch(spark, "quarantine"), table(spark, d, "orders")
    sinks.quarantine(t.limit(3), folder)  # an older list, which is replaced
    sinks.quarantine(t.where("o_orderstatus = 'P'").select(F.col("o_orderpriority").alias("status"), F.col("o_orderkey").cast("string").alias("path")), folder)
    return spark.read.schema("status string, path string").json(folder).groupBy("status").agg(F.count("*").alias("n"))


@query(f"WITH {_STRICT} SELECT g || '_' || k AS log_id, CASE WHEN k % 2 = 0 THEN 'new' ELSE 'old' END AS name FROM g")
def renamed_logs(spark, d):
    t = table(spark, d, "decision_snapshots").where("generation_seed is not null and seed_key is not null and seat is not null").select("generation_seed", "seed_key").distinct()
    log = F.concat_ws("_", F.col("generation_seed").cast("string"), F.col("seed_key").cast("string"))
    starts = t.select(log.alias("log_id"), F.lit("start_game").alias("type"), F.array(*[F.lit("old")] * 4).alias("names"))
    names = t.where("seed_key % 2 = 0").select(log.alias("log_id"), F.array(*[F.lit("new")] * 4).alias("new_names"))
    folder = scratch(spark, "renamed")
    readers.renamed(starts, names).write.option("compression", "gzip").json(folder)
    return spark.read.schema("log_id string, type string, names array<string>").json(folder).select("log_id", F.get("names", F.lit(0)).alias("name"))
