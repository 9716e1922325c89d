"""Runs registered queries beside their DuckDB SQL and compares names, rows and values."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value)
    return str(value)


def compare(spark, con, name: str, folder: str, run, sql: str | None):
    """(ok, message, seconds); without SQL only the schema and rows are looked at."""
    started = time.time()
    df = run(spark, folder)
    columns = sorted(df.columns)
    got = sorted(tuple(_cell(v) for v in r) for r in df.select(*columns).collect())
    took = time.time() - started
    if sql is None:
        return True, f"rows={len(got)} (no SQL)", took
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return False, f"columns {columns} != {sorted(names)}", took
    order = [names.index(c) for c in columns]
    want = sorted(tuple(_cell(r[k]) for k in order) for r in cursor.fetchall())
    if got == want:
        return True, f"rows={len(got)}", took
    if len(got) != len(want):
        return False, f"rows {len(got)} != {len(want)}; {got[:1]} | {want[:1]}", took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    diff = [(c, a, b) for c, a, b in zip(columns, *bad[0]) if a != b]
    return False, f"{len(bad)} of {len(got)} rows differ, first {diff[:4]}", took


def main() -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from tidepanel.session import build_session

    folder = sys.argv[1]
    wanted = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = build_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, failed = connect(folder), entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(name == w or (w.endswith("*") and name.startswith(w[:-1])) for w in wanted):
            continue
        try:
            ok, message, took = compare(spark, con, name, folder, run, sqls.get(name))
        except Exception as error:  # keep going, report at the end
            ok, message, took = False, f"{type(error).__name__}: {str(error)[:700]}", 0.0
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {took:.2f}s {message}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main())
