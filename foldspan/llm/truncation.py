"""Texts cut off by a field limit or in transfer, and how often sources cut.

Per source, and for lengths in characters and in bytes, the discrete hazard of
ending at a length is the share of the texts that reach it and go no further.
Windows over the table of distinct lengths give the texts at risk and the hazard
of the neighbourhood, to which each length is held; a Chernoff bound serves as
p-value and Benjamini-Hochberg controls the false discoveries.  Texts with an
incomplete or marked ending at a significant length are cut by a limit.

A cut in transfer may fall on any length, where no hazard can show it: there a
text counts as cut only when its ending is broken beyond doubt.  ``route`` keeps
the two apart, and ``endings`` holds every kind of ending to the limits found:
how much more often it stands at significant lengths than elsewhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: neighbourhood of a length: this far, without the closest ones (a byte limit
#: spreads over the width of a character)
NEAR, FAR = 6, 80
FDR, LEAST, SHARP = 0.001, 4, 4.0

_BLANK = r"[\s\x00 ​⁠﻿�]+$"
_MARK = r"(?:\s*(?:\[\s*(?:\.\.\.|…)\s*\]|\(\s*(?:\.\.\.|…)\s*\)|\.\.\.|…))+$"
#: closing quotes, brackets and emphasis that may follow a sentence
_CLOSE = r"[\p{Pe}\p{Pf}\p{Pi}\"']*"
_SENTENCE = r"(?i)[.!?。！？।]" + _CLOSE + r"(?:\s*<ref[^<>]*/>|\s*</ref>|\s*\{\{[^{}]*\}\})*$"


def lengths(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """``source, unit, len, n``: how many different texts have each length.

    Copies of one text say nothing about a limit, so each counts once.
    """
    texts = docs.where(F.length(text) > 0).select(F.col(source).alias("source"), F.length(text).alias("chars"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("h")).distinct()
    units = F.array(*[F.struct(F.lit(u).alias("unit"), F.col(u).alias("len")) for u in ("chars", "bytes")])
    return texts.select("source", F.explode(units).alias("u")).groupBy("source", "u.unit", "u.len").agg(F.count("*").alias("n"))


def hazards(counts: DataFrame) -> DataFrame:
    """Hazard of each length and of its neighbourhood, with a p-value.

    The windows run over distinct lengths of one source, not over texts.
    """
    by = Window.partitionBy("source", "unit").orderBy("len")
    risk = counts.withColumn("at_risk", F.sum("n").over(by.rowsBetween(0, Window.unboundedFollowing)))
    side = [by.rangeBetween(-FAR, -NEAR), by.rangeBetween(NEAR, FAR)]
    around = sum((F.coalesce(F.sum("n").over(w), F.lit(0)) for w in side), F.lit(0))
    # lengths without a text add to the exposure as well: the window is FAR wide on either side
    exposure = F.col("at_risk") * F.lit(2 * (FAR - NEAR + 1))
    return (
        risk.withColumn("near", around)
        .withColumn("near_hazard", (F.col("near") + 1.0) / exposure)
        .withColumn("hazard", F.col("n") / F.col("at_risk"))
        .withColumn("expected", F.col("at_risk") * F.col("near_hazard"))
        .withColumn("log_p", F.when(F.col("n") > F.col("expected"), F.col("n") - F.col("expected") - F.col("n") * F.ln(F.col("n") / F.col("expected"))).otherwise(0.0))
    )


def significant(counts: DataFrame, fdr: float = FDR, least: int = LEAST, sharp: float = SHARP) -> DataFrame:
    """Lengths that end too many texts: ``source, unit, len, n, hazard, near_hazard``.

    Only tests below the rate itself can be rejected, so the ranking window sees
    those few rows; their number is compared with all tests made.
    """
    tested = hazards(counts)
    total = counts.groupBy("source", "unit").agg(F.count("*").alias("tests"))
    few = tested.where((F.col("log_p") <= F.ln(F.lit(fdr))) & (F.col("n") >= least) & (F.col("n") >= sharp * F.col("expected")))
    ranked = few.join(total.withColumnsRenamed({"source": "s", "unit": "u"}), F.col("source").eqNullSafe(F.col("s")) & (F.col("unit") == F.col("u"))).drop("s", "u")
    w = Window.partitionBy("source", "unit").orderBy("log_p", "len")
    held = ranked.withColumn("place", F.row_number().over(w)).withColumn("ok", F.col("log_p") <= F.ln(F.col("place") * F.lit(fdr) / F.col("tests")))
    last = Window.partitionBy("source", "unit").orderBy("place").rowsBetween(0, Window.unboundedFollowing)
    return held.withColumn("reject", F.max("ok").over(last)).where("reject").select("source", "unit", "len", "n", "hazard", "near_hazard")


def ended(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``ending``, how each text ends, and ``ending_kind``, by which sign.

    ``marked``: an ellipsis stands at the end.  ``broken``: it ends within a
    character, within markup opened on its last line, in a table or template
    that is still open, or within a running sentence.  ``item``: a list item that
    may or may not be whole.  ``complete``: a finished sentence or piece of
    markup, or a text that never had sentences (noise, key-value lines); null,
    empty and blank texts too.
    """
    kept = docs.columns
    out = docs.withColumn("bare_", F.regexp_replace(F.coalesce(text, F.lit("")), _BLANK, ""))
    out = out.withColumn("marked_", F.right("bare_", F.lit(16)).rlike(_MARK))
    out = out.withColumn("core_", F.when(F.col("marked_"), F.regexp_replace("bare_", _MARK, "")).otherwise(F.col("bare_")))
    out = out.withColumn("line_", F.substring_index("core_", "\n", -1))
    out = out.withColumn("low_", F.lower("line_"))
    core, line, low = F.col("core_"), F.col("line_"), F.col("low_")
    end_char = F.regexp_replace(F.right(text, F.lit(8)), r"[\s\x00]+$", "").endswith("\ufffd")
    close_after = lambda opening, closing: F.length(F.substring_index(low, opening, -1)) < F.length(F.substring_index(low, closing, -1))

    def still_open(opening, closing):
        # a blank line or a heading after the opening: its closing mark is lost, but the page goes on
        rest = F.substring_index(core, opening, -1)
        return core.contains(opening) & (F.length(rest) < F.length(F.substring_index(core, closing, -1))) & ~rest.rlike(r"\n\s*\n|\n=")

    unclosed = (
        (line.contains("[[") & close_after("[[", "]]"))
        | (line.contains("{{") & close_after("{{", "}}"))
        | still_open("{{", "}}")
        | still_open("{|", "|}")
        | (low.contains("<ref") & close_after("<ref", "</ref>") & close_after("<ref", "/>"))
        | line.rlike(r"<[/a-zA-Z!][^<>]{0,60}$|(?:^|[^{])\{$|(?:^|[^\[])\[$|(?:^|[^=])<$")
        | (line.rlike(r"^=") & ~line.rlike(r"=\s*$") & (F.length(line) <= 240))  # no heading is longer
    )
    is_row = line.rlike(r"^\s*[|!]") & ~core.endswith("|}") & ~core.endswith("}}")
    is_list = line.rlike(r"^[*#:;]")
    cut_item = is_list & ((F.size(F.split(line, "''")) % 2 == 0) | line.rlike(r"\([^()]*$"))
    noise = line.rlike(r"^[\p{Ll}_]+:\s") | ~core.rlike(r"\p{L}") | line.rlike(r"^(.{1,5}?)\1{4,}")
    markup_line = line.rlike(r"^\s*(?:\{\{.*\}\}|<[^<>]+>|\|\}|=+.*=+|<!--.*-->|__[A-Z]+__|(?:\[\[[^\[\]]*\]\]\s*)+)\s*$")
    stamped = line.rlike(r"\(UTC\)$")
    # running prose: a sentence was closed before on the line, or it begins like one and goes on
    after = line.rlike(r"[\p{L}\p{N}\)\]'][.!?。][\p{Pe}\p{Pf}\"']*(?:</?ref|\s|[\p{Lo}\[])")
    prose = after | (
        line.rlike(r"^\s*(?:'{2,5}|[\p{Pi}\p{Ps}\"]|\[\[|\{\{)*[\p{Lu}\p{Lo}\p{N}]") & line.rlike(r"\s\S+\s|\p{Lo}{4}")
    )
    kind = (
        F.when(end_char & (F.length(core) > 0), "character")
        .when(F.col("marked_"), "mark")
        .when(F.length(F.trim(core)) == 0, "none")
        .when(unclosed, "markup")
        .when(is_row, "row")
        .when(cut_item, "item")
        .when(line.rlike(_SENTENCE) | markup_line | stamped | noise, "none")
        .when(is_list & after, "sentence in item")
        .when(is_list & ~line.rlike(r"(?:\]\]|\)|\}\})$"), "plain item")
        .when(~is_list & prose, "sentence")
        .otherwise("none")
    )
    kind = F.coalesce(kind, F.lit("none"))
    out = out.select(*kept, kind.alias("ending_kind"))  # judged once, then named
    return out.withColumn("ending", _verdict(F.col("ending_kind")))


def _verdict(kind: Column) -> Column:
    return F.when(kind == "none", "complete").when(kind == "mark", "marked").when(kind == "plain item", "item").otherwise("broken")


def placed(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id, source, kind, ending, at_limit`` of every document.

    Rows with a null source form a source of their own.
    """
    limits = significant(lengths(docs), fdr)
    # byte limits end within the width of one character
    spread = limits.select(F.col("source").alias("s"), "unit", F.explode(F.sequence(F.col("len") - F.when(F.col("unit") == "bytes", 3).otherwise(0), "len")).alias("limit")).distinct()
    chars, octets = (spread.where(F.col("unit") == u).select("s", "limit", F.lit(True).alias(u)) for u in ("chars", "bytes"))
    ends = ended(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.length("text").alias("nc"), F.octet_length("text").alias("nb"), F.col("ending_kind").alias("kind"), "ending")
    both = (
        ends.join(chars, F.col("source").eqNullSafe(F.col("s")) & (F.col("nc") == F.col("limit")), "left").drop("s", "limit")
        .join(octets, F.col("source").eqNullSafe(F.col("s")) & (F.col("nb") == F.col("limit")), "left").drop("s", "limit")
    )
    at_limit = F.coalesce("chars", F.lit(False)) | F.coalesce("bytes", F.lit(False))
    return both.select("doc_id", "source", "kind", "ending", at_limit.alias("at_limit"))


def endings(where: DataFrame) -> DataFrame:
    """``source, kind, at_limit, elsewhere, lift``: how much more often each kind stands at significant lengths.

    ``lift`` is null for a source without significant lengths.
    """
    counts = where.groupBy("source", "kind").agg(F.count_if("at_limit").alias("at_limit"), F.count_if(~F.col("at_limit")).alias("elsewhere"))
    w = Window.partitionBy("source")  # a few kinds
    lift = F.try_divide(F.col("at_limit") / F.nullif(F.sum("at_limit").over(w), F.lit(0)), F.col("elsewhere") / F.nullif(F.sum("elsewhere").over(w), F.lit(0)))
    return counts.withColumn("lift", F.round(lift, 3))


def judged(docs: DataFrame, fdr: float = FDR) -> DataFrame:
    """``doc_id, source, kind, ending, at_limit, route, cut`` of every document.

    ``route`` is ``limit`` or ``elsewhere`` for cut texts, null for the others.
    Null and empty texts are never cut.  Repeated rows are judged alike; texts
    are used whole.
    """
    where = placed(docs, fdr)
    cut_off = F.when(F.col("at_limit"), F.col("ending").isin("broken", "item", "marked")).otherwise(F.col("ending") == "broken")
    route = F.when(cut_off, F.when(F.col("at_limit"), "limit").otherwise("elsewhere"))
    return where.select("doc_id", "source", "kind", "ending", "at_limit", route.alias("route"), cut_off.alias("cut"))


def found(docs: DataFrame) -> DataFrame:
    """``doc_id`` of each document whose text was cut off."""
    return judged(docs).where("cut").select("doc_id")


def by_source(docs: DataFrame) -> DataFrame:
    """``source, docs, cut, at_limit, share`` per source."""
    return judged(docs).groupBy("source").agg(F.count("*").alias("docs"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & F.col("at_limit")).alias("cut_at_limit")).withColumn("share", F.round(F.col("cut") / F.col("docs"), 6))


def agreed(docs: DataFrame) -> DataFrame:
    """``source, docs, agree``: whether ``by_source`` adds up to the rows ``found`` gives."""
    rows = docs.groupBy("source").agg(F.count("*").alias("docs"))
    hits = found(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy(F.col("source").alias("s")).agg(F.count("*").alias("hits"))
    told = by_source(docs).select(F.col("source").alias("t"), F.col("docs").alias("n"), "cut", "cut_at_limit")
    both = rows.join(told, F.col("source").eqNullSafe(F.col("t")), "left").join(hits, F.col("source").eqNullSafe(F.col("s")), "left")
    return both.select("source", "docs", F.coalesce((F.col("docs") == F.col("n")) & (F.col("cut") == F.coalesce("hits", F.lit(0))) & (F.col("cut_at_limit") <= F.col("cut")), F.lit(False)).alias("agree"))
