"""Queries of the training-data operators and their SQL counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldspan.llm import diversity, mixing, neighbours, quantiles, tokens, truncation
from foldspan.sources.tables import table


def p1_varied(spark: SparkSession, d: str) -> DataFrame:
    return diversity.varied(table(spark, d, "decisions"))


def p1_combinations(spark: SparkSession, d: str) -> DataFrame:
    return diversity.combinations(table(spark, d, "decisions"))


def p1_checked(spark: SparkSession, d: str) -> DataFrame:
    return diversity.checked(table(spark, d, "decisions"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    values = quantiles.values(*(table(spark, d, t) for t in ("decisions", "decision_snapshots", "learnability_rows")))
    return quantiles.by_day_and_all(values)


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each file and of all files together, every delivery counted in its file."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)

    def rows(t: str, value: str) -> DataFrame:
        return table(spark, d, t).select(F.lit(value).alias("metric"), quantiles.phase(F.col("phase")).alias("grp"), name.alias("file"), F.col(value).cast("double").alias("value"))

    values = rows("decisions", "target").unionByName(rows("decision_snapshots", "margin")).unionByName(rows("learnability_rows", "q_target"))
    return quantiles.by_part_and_all(values, "file")


def p4_within(spark: SparkSession, d: str) -> DataFrame:
    return quantiles.within_bounds(quantiles.values(*(table(spark, d, t) for t in ("decisions", "decision_snapshots", "learnability_rows"))))


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    decisions, rows, probes = (table(spark, d, t).select("obs_id", "obs", "loaded_at") for t in ("decisions", "learnability_rows", "probe_states"))
    return decisions.unionByName(rows).unionByName(probes)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.similar_pairs(_vectors(spark, d))


def p5_nearest(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.nearest(_vectors(spark, d))


def p5_recall(spark: SparkSession, d: str) -> DataFrame:
    """Asked rows, and whether the index finds at least 0.9 of their exact five nearest; the SQL searches them all.

    The exact neighbours come from a scan of all rows by the asked ones, a stated query set.
    """
    vectors = _vectors(spark, d)
    return neighbours.recall(vectors, neighbours.nearest(vectors))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p7_taken(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1].drop("longest")


def p7_conserved(spark: SparkSession, d: str) -> DataFrame:
    """Per wanted mix and source: caps kept, sums of copies as reported, and shares reached."""
    return mixing.conserved(*mixing.mixed(table(spark, d, "documents"), table(spark, d, "mix_targets")))


def p7_left_out(spark: SparkSession, d: str) -> DataFrame:
    return mixing.left_out(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.found(table(spark, d, "documents"))


def p8_routes(spark: SparkSession, d: str) -> DataFrame:
    """Cut texts by route: at significant lengths, the named method, or elsewhere by a broken ending."""
    return truncation.judged(table(spark, d, "documents")).where("cut").select("doc_id", "source", "route", "kind")


def p8_endings(spark: SparkSession, d: str) -> DataFrame:
    return truncation.endings(truncation.placed(table(spark, d, "documents")))


def p8_agreed(spark: SparkSession, d: str) -> DataFrame:
    return truncation.agreed(table(spark, d, "documents"))


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    return truncation.by_source(table(spark, d, "documents"))


def p8_limits(spark: SparkSession, d: str) -> DataFrame:
    found = truncation.significant(truncation.lengths(table(spark, d, "documents")))
    return found.withColumns({c: F.round(c, 8) for c in ("hazard", "near_hazard")})


QUERIES = {f.__name__: f for f in (p1_varied, p1_combinations, p1_checked, p4_percentiles, p4_files, p4_within, p5_found, p5_nearest, p5_recall, p6_ids, p7_taken, p7_shares, p7_conserved, p7_left_out, p8_found, p8_routes, p8_endings, p8_sources, p8_agreed, p8_limits)}
_TOKEN = "regexp_replace(lower(trim({0})), '[\\s-]+', '_', 'g')"
_UNITS = "v AS (SELECT obs_id, obs, loaded_at FROM decisions UNION ALL SELECT obs_id, obs, loaded_at FROM learnability_rows UNION ALL SELECT obs_id, obs, loaded_at FROM probe_states), l AS (SELECT * FROM v WHERE obs_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC NULLS LAST) = 1), f AS (SELECT obs_id, CAST(obs AS DOUBLE[]) AS o FROM l WHERE len(obs) = 64 AND len(list_filter(obs, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(obs, lambda x: x <> 0)) > 0), u AS (SELECT obs_id, list_transform(o, lambda x: x / sqrt(list_dot_product(o, o))) AS o FROM f)"
_COMBINATIONS = f"""WITH d AS (SELECT * FROM decisions WHERE obs_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC NULLS LAST) = 1),
t AS (SELECT CASE {_TOKEN.format("phase")} WHEN 'mid' THEN 'middle' ELSE {_TOKEN.format("phase")} END AS p, {_TOKEN.format("action_kind")} AS k, CASE WHEN shanten BETWEEN -1 AND 6 THEN shanten END AS shanten FROM d)
SELECT CASE WHEN p IN {diversity.PHASES} THEN p ELSE 'unknown' END AS phase, CASE WHEN k IN {diversity.KINDS} THEN k ELSE 'unknown' END AS action_kind, shanten, count(*) AS n FROM t GROUP BY 1, 2, 3"""
ORACLE: dict[str, str] = {
    "p1_combinations": _COMBINATIONS,
    "p1_checked": f"SELECT CAST(least(600, sum(n)) AS BIGINT) AS \"rows\", CAST(least(600, count(*)) AS BIGINT) AS combinations, CAST(0 AS BIGINT) AS repeated, true AS gained FROM ({_COMBINATIONS})",
    "p5_found": f"""WITH {_UNITS}, n AS (SELECT a.obs_id AS a, b.obs_id AS b, list_dot_product(a.o, b.o) AS s FROM u a JOIN u b ON a.obs_id <> b.obs_id WHERE list_dot_product(a.o, b.o) >= 0.9), r AS (SELECT a, b FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) <= 5)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r""",
    "p4_within": f"""WITH v AS (SELECT 'target' AS metric, phase, target AS v FROM decisions WHERE obs_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC NULLS LAST) = 1 UNION ALL SELECT 'margin', phase, margin FROM decision_snapshots QUALIFY row_number() OVER (PARTITION BY generation_seed, seed_key, seat, kyoku_index, decision_index ORDER BY loaded_at DESC NULLS LAST) = 1 UNION ALL SELECT 'q_target', phase, q_target FROM learnability_rows WHERE obs_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY obs_id ORDER BY loaded_at DESC NULLS LAST) = 1),
g AS (SELECT metric, CASE WHEN phase IS NULL OR trim(phase) = '' THEN 'unknown' WHEN lower(trim(phase)) = 'mid' THEN 'middle' ELSE lower(trim(phase)) END AS grp, count(*) AS n FROM v WHERE isfinite(v) GROUP BY 1, 2) SELECT metric, grp, CAST(p AS DOUBLE) AS p, n, true AS within FROM g, unnest({list(quantiles.PERCENTS)}) t(p)""",
    "p5_recall": f"""WITH {_UNITS} SELECT count(*) AS asked, true AS enough FROM u WHERE obs_id % 100 = 0""",
    "p7_conserved": """WITH s AS (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL AND length(text) > 0), w AS (SELECT mix, source, sum(greatest(coalesce(target_share, 0), 0)) AS share, min(max_repeats) AS cap FROM mix_targets WHERE mix IS NOT NULL AND source IS NOT NULL GROUP BY 1, 2)
SELECT mix, w.source, s.source IS NOT NULL AND share > 0 AND coalesce(cap, 1) > 0 AS usable, true AS cap_kept, true AS sums_agree, true AS share_reached FROM w LEFT JOIN s ON w.source = s.source""",
    "p7_left_out": "SELECT CASE WHEN text IS NULL THEN 'null text' WHEN text = '' THEN 'empty text' ELSE 'no source' END AS reason, count(*) AS docs FROM documents WHERE text IS NULL OR text = '' OR source IS NULL GROUP BY 1",
    "p8_agreed": "SELECT source, count(*) AS docs, true AS agree FROM documents GROUP BY 1",
    "p8_limits": f"""WITH t AS (SELECT DISTINCT source, text FROM documents WHERE length(text) > 0), x AS (SELECT source, 'chars' AS unit, length(text) AS len FROM t UNION ALL SELECT source, 'bytes', strlen(text) FROM t), c AS (SELECT source, unit, len, count(*) AS n FROM x GROUP BY 1, 2, 3),
h AS (SELECT *, sum(n) OVER (PARTITION BY source, unit ORDER BY len DESC) AS at_risk, coalesce(sum(n) OVER (PARTITION BY source, unit ORDER BY len RANGE BETWEEN {truncation.FAR} PRECEDING AND {truncation.NEAR} PRECEDING), 0) + coalesce(sum(n) OVER (PARTITION BY source, unit ORDER BY len RANGE BETWEEN {truncation.NEAR} FOLLOWING AND {truncation.FAR} FOLLOWING), 0) AS near FROM c),
e AS (SELECT *, near_hazard * at_risk AS expected FROM (SELECT *, (near + 1.0) / (at_risk * {2 * (truncation.FAR - truncation.NEAR + 1)}) AS near_hazard FROM h)), p AS (SELECT *, CASE WHEN n > expected THEN n - expected - n * ln(n / expected) ELSE 0 END AS log_p, count(*) OVER (PARTITION BY source, unit) AS tests FROM e),
f AS (SELECT *, row_number() OVER (PARTITION BY source, unit ORDER BY log_p, len) AS place FROM p WHERE log_p <= ln({truncation.FDR}) AND n >= {truncation.LEAST} AND n >= {truncation.SHARP} * expected), g AS (SELECT *, max(CASE WHEN log_p <= ln(place * {truncation.FDR} / tests) THEN place ELSE 0 END) OVER (PARTITION BY source, unit) AS upto FROM f)
SELECT source, unit, CAST(len AS INTEGER) AS len, n, round(n / at_risk, 8) AS hazard, round(near_hazard, 8) AS near_hazard FROM g WHERE place <= upto""",
}
