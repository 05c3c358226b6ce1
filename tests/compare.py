"""Runs queries beside their SQL on DuckDB and compares sorted values."""

from __future__ import annotations

import sys
import time
import traceback
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings decisions decision_snapshots learnability_rows probe_states game_states snapshots export_manifests export_jobs mix_targets".split()

#: queries without SQL that may give nothing on the smallest tables
MAY_BE_EMPTY = ("p8_found", "p8_routes")


def _plain(v):
    if v is None or type(v).__name__ in ("NAType", "NaTType") or (isinstance(v, float) and v != v):
        return "~"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(v, bool):
        return str(v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return str([_plain(x) for x in v])
    if type(v).__name__ == "Decimal":
        v = float(v)
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return repr(float(v) + 0.0)
    return str(v)


def rows(frame) -> tuple[list[str], list[tuple]]:
    cols = sorted(frame.columns)
    return cols, sorted(tuple(_plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None))


def differences(spark, folder: str, name: str, query, sql: str | None) -> str | None:
    got = query(spark, folder).toPandas()
    if sql is None:
        return "no columns" if not len(got.columns) else None if len(got) or name in MAY_BE_EMPTY else "no rows"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = con.execute(sql).df()
    (a, x), (b, y) = rows(got), rows(want)
    if a != b:
        return f"columns {a} / {b}"
    if len(x) != len(y):
        return f"rows {len(x)} / {len(y)}"
    bad = [(p, q) for p, q in zip(x, y) if p != q]
    return f"{len(bad)} of {len(x)} rows, {a}: spark {bad[0][0]} sql {bad[0][1]}" if bad else None


def main() -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    import __spark_entry__ as e
    from foldspan.runtime import session

    spark = session(8)
    spark.sparkContext.setLogLevel("OFF")
    folder, wanted = sys.argv[1], sys.argv[2:]
    sql, failed = e.oracle_sql(), 0
    for name, query in e.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        began = time.time()
        try:
            why = differences(spark, folder, name, query, sql.get(name))
        except Exception as x:
            why = str(x)[:600] if len(wanted) != 1 else traceback.format_exc()[-1500:]
        failed += why is not None
        print(f"{'ok  ' if why is None else 'FAIL'} {name} {'' if sql.get(name) else '(no sql) '}{time.time() - began:.1f}s {why or ''}"[:900], flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main())
