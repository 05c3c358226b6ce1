"""Consolidating millions of tiny event files into few sorted, well-sized ones.

Sorted-run consolidation.  Each small file is parsed once into a run: its records
in the order of ``event_index``, which most files hold already.  The key space
``(log, event_index, file_id)`` is cut into ranges of equal bytes, from a sample of
the runs' keys; runs are cut at the borders, so a hot log, and even any number of
copies of one record, is spread over tasks.  The pieces of a range come sorted
by their first key (Spark's external sorter spills them), and are merged as they
stream past: whatever lies before the first key of the next piece is final, so
memory holds the pieces that overlap and no more.  The merge itself is a stable
sort that finds the presorted runs and merges them.

Copies of a record are adjacent after the merge.  Inside a range all but the
first row of a run of equal keys are copies; the first row of a range is settled
by the key range table, whose size is the number of ranges.  Output files are
rolled by bytes and each file's key range, counts and size are recorded.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldspan.runtime import cut, partitions_for

TARGET_BYTES = 128 << 20
#: output files of a key range, and sampled keys per range
FILES_A_RANGE, POINTS = 4, 60

_MARKED = (
    "kind string, range_no int, out_no int, log string, event_index bigint, file_id bigint, line_no int, "
    "line string, n_records bigint, n_copies bigint, n_bytes bigint, last_log string, last_index bigint"
)


def canonical_path(path: Column) -> Column:
    """One spelling per source path.

    Trims blanks, drops a ``file:`` scheme, decodes percent escapes, turns
    back-slashes round, and resolves empty, ``.`` and ``..`` steps.  Null stays
    null.  The directory is part of the result.
    """
    p = F.trim(F.regexp_replace(path, r"[\s ]+$", ""))
    p = F.regexp_replace(p, r"^(?i)file:(//(?=/))?", "")
    p = F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p)
    p = F.trim(F.translate(p, "\\", "/"))
    steps = F.filter(F.split(p, "/"), lambda s: (s != "") & (s != "."))
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, s)),
    )
    return F.concat(F.lit("/"), F.array_join(walked, "/"))


def event_lines(jobs: DataFrame) -> DataFrame:
    """The records of every file: ``log, event_index, file_id, line_no, line``.

    ``line_no`` counts all lines of the body from 1, blank ones included; both
    line endings are taken.  Lines that are not one whole JSON object with a
    whole-number ``event_index`` are no records and are left out, as are files
    without body or path.
    """
    cleaned = jobs.select(
        F.col("file_id").cast("bigint").alias("file_id"),
        canonical_path(F.col("src_path")).alias("log"),
        F.posexplode(F.split(F.col("body"), "\r\n|\n|\r")).alias("pos", "line"),
    ).where(F.col("log").isNotNull() & F.col("line").contains("event_index"))
    parsed = cleaned.withColumn("v", F.try_parse_json(F.trim("line")))
    return parsed.select(
        "log",
        F.try_variant_get("v", "$.event_index", "bigint").alias("event_index"),
        "file_id",
        (F.col("pos") + 1).alias("line_no"),
        F.trim("line").alias("line"),
    ).where("event_index is not null")


def _whole(index: object) -> int | None:
    if isinstance(index, str) and re.fullmatch(r"\s*[+-]?\d{1,18}\s*", index):
        return int(index)
    if isinstance(index, float) and index.is_integer():
        index = int(index)
    return index if isinstance(index, int) and not isinstance(index, bool) and abs(index) < 1 << 62 else None


def _refuse(constant: str):
    raise ValueError(constant)


_RUN = "log string, file_id bigint, in_order boolean, n_bytes bigint, idx array<bigint>, nos array<int>, lines array<string>"
_PIECE = "range_no int, log string, first bigint, file_id bigint, idx array<bigint>, nos array<int>, lines array<string>"


def _parse(keep_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = json.JSONDecoder(parse_constant=_refuse).decode
        for batch in batches:
            logs, ids, sorted_, sizes, idx, nos, lines, ends = [], [], [], [], [], [], [], [0]
            for file_id, log, body in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if "\r" in body:
                    body = body.replace("\r\n", "\n").replace("\r", "\n")
                found = []
                for no, line in enumerate(body.split("\n"), 1):
                    if "event_index" not in line:
                        continue
                    try:
                        event = decode(line)
                    except (ValueError, RecursionError):
                        continue
                    i = _whole(event.get("event_index")) if isinstance(event, dict) else None
                    if i is not None:
                        found.append((i, no, line.strip(" ") if keep_lines else None))
                if not found:
                    continue
                own = [f[0] for f in found]
                in_order = all(a <= b for a, b in zip(own, own[1:]))
                if not in_order:
                    found.sort(key=lambda f: f[:2])
                logs.append(log), ids.append(file_id), sorted_.append(in_order)
                idx += [f[0] for f in found]
                nos += [f[1] for f in found]
                if keep_lines:
                    lines += (own := [f[2] for f in found])
                    sizes.append(sum(len(x.encode("utf-8", "surrogatepass")) + 1 for x in own))
                else:
                    sizes.append(len(found))
                ends.append(len(idx))
            at = pa.array(ends, pa.int32())
            text = pa.ListArray.from_arrays(at, pa.array(lines, pa.string())) if keep_lines else pa.nulls(len(ids), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(logs, pa.string()), pa.array(ids, pa.int64()), pa.array(sorted_, pa.bool_()), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(at, pa.array(idx, pa.int64())), pa.ListArray.from_arrays(at, pa.array(nos, pa.int32())), text],
                names=[f.split()[0] for f in _RUN.split(", ")],
            )

    return run


def runs(jobs: DataFrame, keep_lines: bool = True) -> DataFrame:
    """One sorted run per file with records: ``log, file_id, in_order, n_bytes, idx, nos, lines``.

    Records are as ``event_lines`` states.  ``in_order`` tells whether the file was
    sorted as it stood; the others are sorted here, each a small file.  Without
    lines ``n_bytes`` counts records.
    """
    files = jobs.select(F.col("file_id").cast("bigint").alias("file_id"), canonical_path(F.col("src_path")).alias("log"), "body").where("log is not null and body is not null")
    return files.mapInArrow(_parse(keep_lines), _RUN)


def borders(held: DataFrame, ranges: int) -> list[tuple[str, int, int]]:
    """First keys of all ranges but the first, so that ranges hold about equal bytes.

    ``POINTS`` sampled keys per range are sorted in the cluster; only every
    ``POINTS``-th comes to the driver, one border for each range (512 MB at the
    usual target).
    """
    if ranges < 2:
        return []
    records = held.agg(F.sum(F.size("idx"))).first()[0] or 0
    if not records:
        return []
    share = min(1.0, POINTS * ranges / records)
    keys = held.select("log", "file_id", F.explode(F.arrays_zip("idx", "nos")).alias("p")).select("log", F.col("p.idx").alias("idx"), "file_id", F.col("p.nos").alias("no"))
    points = keys.where(F.pmod(F.xxhash64("log", "idx", "file_id", "no"), F.lit(1 << 30)) < int(share * (1 << 30)))
    step = max(1, round(records * share / ranges))
    parts = max(1, POINTS * ranges // 100_000)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(np.arange((-seen - 1) % step, batch.num_rows, step)))
            seen += batch.num_rows

    order = ["log", "idx", "file_id"]
    points = points.select(*order)
    points = points.repartitionByRange(parts, *order) if parts > 1 else points.coalesce(1)
    picked = points.sortWithinPartitions(*order).mapInArrow(pick, "log string, idx bigint, file_id bigint")
    return sorted({tuple(r) for r in picked.collect()})


def _cut_runs(borders_b):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = borders_b.value
        for batch in batches:
            idx, base = batch.column("idx"), np.asarray(batch.column("idx").offsets)
            flat = np.asarray(idx.values)
            row, start, where = [], [], []
            for r, (log, file_id) in enumerate(zip(batch.column("log").to_pylist(), batch.column("file_id").to_pylist())):
                s, e = int(base[r]), int(base[r + 1])
                lo, hi = bisect_right(at, (log, int(flat[s]), file_id)), bisect_right(at, (log, int(flat[e - 1]), file_id))
                row.append(r), start.append(s), where.append(lo)
                for b in range(lo, hi):
                    _, i, f = at[b]
                    place = s + (bisect_left if file_id >= f else bisect_right)(flat[s:e], i)
                    if place > start[-1]:
                        row.append(r), start.append(place), where.append(b + 1)
                    else:
                        where[-1] = b + 1
            if not row:
                continue
            edges = pa.array([*start, int(base[-1])], pa.int32())
            rows = pa.array(row)
            lines = batch.column("lines")
            cut_lines = pa.ListArray.from_arrays(edges, lines.values) if lines.null_count == 0 else pa.nulls(len(row), lines.type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(where, pa.int32()), batch.column("log").take(rows), pa.array(flat[start], pa.int64()), batch.column("file_id").take(rows), pa.ListArray.from_arrays(edges, idx.values), pa.ListArray.from_arrays(edges, batch.column("nos").values), cut_lines],
                names=[f.split()[0] for f in _PIECE.split(", ")],
            )

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of pieces that come in the order of ``log, first``, in the order of all keys."""
    names = ["log", "event_index", "file_id", "line_no", "line"]
    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.list_value_length(batch.column("idx")).to_numpy()
        row = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
        idx = batch.column("idx").flatten()
        lines = batch.column("lines").flatten() if batch.column("lines").null_count == 0 else pa.nulls(len(idx), pa.string())
        new = pa.table([batch.column("log").take(row), idx, batch.column("file_id").take(row), batch.column("nos").flatten(), lines], names=names)
        rows = new if held is None else pa.concat_tables([held, new])
        code = rows.column("log").combine_chunks().dictionary_encode()
        rank = np.argsort(np.argsort(np.array(code.dictionary.to_pylist(), object)))
        log, at = rank[code.indices.to_numpy()], rows.column("event_index").to_numpy()
        order = np.lexsort((rows.column("line_no").to_numpy(), rows.column("file_id").to_numpy(), at, log))
        log, at = log[order], at[order]
        # what lies before the first key of the last piece can get no more rows
        last = log[-1] if len(log) else 0
        done = np.searchsorted(log, last) + np.searchsorted(at[log == last], batch.column("first")[-1].as_py())
        rows = rows.take(pa.array(order))
        yield from rows.slice(0, done).combine_chunks().to_batches(max_chunksize=65_536)
        held = rows.slice(done)
    if held is not None:
        yield from held.combine_chunks().to_batches(max_chunksize=65_536)


def _merge(target_bytes: int, keep_lines: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        names = [f.split()[0] for f in _MARKED.split(", ")]
        types = [{"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[f.split()[1]] for f in _MARKED.split(", ")]
        schema = pa.schema(list(zip(names, types)))

        def table(n: int, **cols) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(cols[c], t) if c in cols and not isinstance(cols[c], (pa.Array, pa.ChunkedArray)) else cols[c].cast(t) if c in cols else pa.nulls(n, t) for c, t in zip(names, types)], schema=schema)

        last: tuple[str, int] | None = None
        out_no, file = 0, None
        size = lambda lines: pc.fill_null(pc.binary_length(lines), 0)
        for batch in _merged(batches):
            n = batch.num_rows
            if not n:
                continue
            log, idx = batch.column("log"), batch.column("event_index")
            same = [False] * n
            if n > 1:
                same[1:] = pc.and_(pc.equal(log[1:], log[:-1]), pc.equal(idx[1:], idx[:-1])).to_pylist()
            first = (log[0].as_py(), idx[0].as_py())
            if last is not None:
                same[0] = first == last
            else:
                yield table(1, kind=["first"], range_no=[part], log=[first[0]], event_index=[first[1]], file_id=batch.column("file_id")[:1], line_no=batch.column("line_no")[:1], n_bytes=size(batch.column("line")[:1]))
            copy = np.array(same)
            kept = np.where(copy, 0, size(batch.column("line")).to_numpy() + 1)
            upto = np.cumsum(kept)
            outs = np.zeros(n, np.int32)
            at = 0
            while at < n:
                if file is None or (file["n_bytes"] >= target_bytes and not copy[at]):
                    if file is not None:
                        yield table(1, kind=["file"], range_no=[part], out_no=[out_no], **{k: [v] for k, v in file.items()})
                        out_no += 1
                    file = {"log": log[at].as_py(), "event_index": idx[at].as_py(), "n_records": 0, "n_copies": 0, "n_bytes": 0}
                # the file takes rows until it is full, and the copies that follow its last record
                before = upto[at] - kept[at]
                full = int(np.searchsorted(upto, before + max(1, target_bytes - file["n_bytes"])))
                more = np.flatnonzero(~copy[full + 1 :]) if full < n else []
                end = full + 1 + int(more[0]) if len(more) else n
                outs[at:end] = out_no
                n_copies = int(copy[at:end].sum())
                file["n_copies"] += n_copies
                file["n_records"] += end - at - n_copies
                file["n_bytes"] += int(upto[end - 1] - before)
                file["last_log"], file["last_index"] = log[end - 1].as_py(), idx[end - 1].as_py()
                at = end
            last = (log[n - 1].as_py(), idx[n - 1].as_py())
            copies = pa.array(same)
            dup = batch.filter(copies)
            if dup.num_rows:
                yield table(dup.num_rows, kind=["copy"] * dup.num_rows, range_no=[part] * dup.num_rows, log=dup.column("log"), event_index=dup.column("event_index"), file_id=dup.column("file_id"), line_no=dup.column("line_no"))
            if keep_lines:
                kept = batch.filter(pc.invert(copies))
                if kept.num_rows:
                    yield table(kept.num_rows, kind=["record"] * kept.num_rows, range_no=[part] * kept.num_rows, out_no=pa.array(outs).filter(pc.invert(copies)), **{c: kept.column(c) for c in ("log", "event_index", "file_id", "line_no", "line")})
        if last is not None:
            yield table(1, kind=["last"], range_no=[part], log=[last[0]], event_index=[last[1]])
            yield table(1, kind=["file"], range_no=[part], out_no=[out_no], **{k: [v] for k, v in file.items()})

    return run


def merge_runs(jobs: DataFrame, target_bytes: int = TARGET_BYTES, keep_lines: bool = True, ranges: int | None = None) -> DataFrame:
    """The marked stream of the sorted merge, materialised once.

    Rows of kind ``record`` (kept lines), ``copy``, ``file`` (one output file
    with its key range), ``first`` and ``last`` (edges of each key range).
    Unless given, there is a range for every ``FILES_A_RANGE`` targets of bytes.
    """
    spark = jobs.sparkSession
    held = cut(runs(jobs, keep_lines))  # bodies are parsed once
    if ranges is None:
        ranges = max(1, -(-(held.agg(F.sum("n_bytes")).first()[0] or 0) // (FILES_A_RANGE * target_bytes)))
    at = borders(held, ranges)
    pieces = held.select("log", "file_id", "idx", "nos", "lines").mapInArrow(_cut_runs(spark.sparkContext.broadcast(at)), _PIECE)
    sorted_ = pieces.repartitionById(len(at) + 1, F.col("range_no")).sortWithinPartitions("log", "first", "file_id")
    return cut(sorted_.mapInArrow(_merge(target_bytes, keep_lines), _MARKED))


def edge_copies(marked: DataFrame) -> DataFrame:
    """First rows of ranges whose record began in an earlier range.

    The window runs over two rows per range, never over data.
    """
    edges = marked.where("kind in ('first', 'last')").select("kind", "range_no", "log", "event_index", "file_id", "line_no", "n_bytes")
    w = Window.orderBy("range_no", "kind")
    return (
        edges.withColumn("prev_log", F.lag("log").over(w))
        .withColumn("prev_index", F.lag("event_index").over(w))
        .where("kind = 'first' and prev_log = log and prev_index = event_index")
        .select("range_no", "log", "event_index", "file_id", "line_no", "n_bytes")
    )


def repeated_lines(jobs: DataFrame, ranges: int | None = None) -> DataFrame:
    """``file_id, line_no`` of every line that repeats a record held elsewhere.

    The copy with the smallest ``(file_id, line_no)`` is the record and is left
    out.  Nulls in path, body or shard, empty files, blank or torn lines and
    both line endings are handled as ``event_lines`` states; an empty table
    gives an empty result.
    """
    marked = merge_runs(jobs, keep_lines=False, ranges=ranges or partitions_for(jobs.sparkSession))
    return marked.where("kind = 'copy'").select("file_id", "line_no").unionByName(edge_copies(marked).select("file_id", "line_no"))


def consolidated(jobs: DataFrame, target_bytes: int = TARGET_BYTES, ranges: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Kept records with their output file, and the range metadata per file.

    Returns ``(records, files)``: records carry ``range_no, out_no, log,
    event_index, file_id, line_no, line``; files carry the first and last key,
    record, copy and byte counts of each output file.  Every event record is
    present once; a source file is never needed again.  Unless given, key ranges
    hold ``FILES_A_RANGE`` times ``target_bytes``, and files are rolled in each.
    """
    marked = merge_runs(jobs, target_bytes, keep_lines=True, ranges=ranges)
    edges = edge_copies(marked)
    records = (
        marked.where("kind = 'record'")
        .join(F.broadcast(edges.select("file_id", "line_no")), ["file_id", "line_no"], "left_anti")
        .select("range_no", "out_no", "log", "event_index", "file_id", "line_no", "line")
    )
    late = edges.select("range_no", F.lit(0).alias("out_no"), F.lit(1).alias("late"), F.col("n_bytes").alias("late_bytes"))
    files = (
        marked.where("kind = 'file'")
        .join(F.broadcast(late), ["range_no", "out_no"], "left")
        .select(
            "range_no",
            "out_no",
            F.col("log").alias("first_log"),
            F.col("event_index").alias("first_index"),
            "last_log",
            "last_index",
            (F.col("n_records") - F.coalesce("late", F.lit(0))).alias("n_records"),
            (F.col("n_copies") + F.coalesce("late", F.lit(0))).alias("n_copies"),
            (F.col("n_bytes") - F.coalesce(F.col("late_bytes") + 1, F.lit(0))).alias("n_bytes"),
        )
    )
    return records, files


def write_consolidated(jobs: DataFrame, out: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write the merged records below ``out`` and return the range metadata.

    One folder per key range and output file; each holds one sorted file, as a
    range is written by the task that merged it.  Refuses an existing folder.
    """
    records, files = consolidated(jobs, target_bytes)
    records.select("range_no", "out_no", "log", "event_index", "line").write.mode("errorifexists").partitionBy("range_no", "out_no").parquet(f"{out}/data")
    files.coalesce(1).write.mode("errorifexists").parquet(f"{out}/ranges")
    return files


def files_check(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """One row: ``n_records, n_copies, n_bytes, in_order, sized`` of the range metadata.

    ``in_order``: no file begins before its predecessor ends.  ``sized``: files
    are at most a quarter and one range's last file more than bytes over target.
    The window runs over output files, never over data.
    """
    first, last = F.struct(F.col("first_log").alias("l"), F.col("first_index").alias("i")), F.struct(F.col("last_log").alias("l"), F.col("last_index").alias("i"))
    w = Window.orderBy("range_no", "out_no")
    checked = files.withColumn("ok", (first <= last) & F.coalesce(F.lag(last).over(w) <= first, F.lit(True)))
    most = F.ceil(F.sum("n_bytes") / target_bytes) * 1.25 + F.count_distinct("range_no")
    return checked.agg(
        F.coalesce(F.sum("n_records"), F.lit(0)).alias("n_records"), F.coalesce(F.sum("n_copies"), F.lit(0)).alias("n_copies"), F.sum("n_bytes").alias("n_bytes"),
        F.coalesce(F.bool_and("ok"), F.lit(True)).alias("in_order"), F.coalesce(F.count("*") <= most, F.lit(True)).alias("sized"),
    )


def manifest_check(manifests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Listed against actual files, one row per manifest.

    ``listed`` and ``shard_total`` are null where the manifest's ``files`` or
    ``shard_file_counts`` are null; ``missing`` counts listed logs without a
    job, ``unlisted`` jobs' logs that the manifest leaves out.
    """
    listed = manifests.select("manifest_id", F.explode("files").alias("p")).select("manifest_id", canonical_path(F.col("p")).alias("log")).where("log is not null").distinct()
    actual = jobs.select("manifest_id", canonical_path(F.col("src_path")).alias("log"), "file_id").where("manifest_id is not null")
    logs = actual.select("manifest_id", "log").where("log is not null").distinct()
    both = listed.withColumn("a", F.lit(1)).join(logs.withColumn("b", F.lit(1)), ["manifest_id", "log"], "full_outer")
    gaps = both.groupBy("manifest_id").agg(F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNull()).alias("unlisted"))
    held = actual.groupBy("manifest_id").agg(F.count("*").alias("held"))
    return (
        manifests.select(
            "manifest_id",
            F.when(F.col("files").isNotNull(), F.size("files")).cast("bigint").alias("listed"),
            F.when(F.col("shard_file_counts").isNotNull(), F.aggregate(F.map_values("shard_file_counts"), F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))).alias("shard_total"),
        )
        .join(held, "manifest_id", "left")
        .join(gaps, "manifest_id", "left")
        .select("manifest_id", "listed", "shard_total", F.coalesce("held", F.lit(0)).alias("held"), F.coalesce("missing", F.lit(0)).alias("missing"), F.coalesce("unlisted", F.lit(0)).alias("unlisted"))
    )
