"""Run registered queries and their SQL side by side; used by tests and by hand.

    python tests/compare.py SF_DIR [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[:-8]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_cell(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, query, sql, sf_dir):
    """'' when equal, else what differs."""
    df = query(spark, sf_dir)
    got_cols, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.execute(sql)
    want_cols, want = [d[0] for d in rel.description], rel.fetchall()
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} != {sorted(want_cols)}"
    a, b = _rows(got_cols, got), _rows(want_cols, want)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}"
    if not a:
        return "no rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first {bad[0][0]} != {bad[0][1]}" if bad else ""


def session(cpus: int = 8):
    from pagemill.session import build_session
    spark = build_session("compare", f"local[{cpus}]", **{
        "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.sql.shuffle.partitions": "8", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    return spark


if __name__ == "__main__":
    from __spark_entry__ import oracle_sql, queries

    sf, names = sys.argv[1], sys.argv[2:]
    spark, con = session(), duck(sf)
    sqls, failed = oracle_sql(), []
    for name, query in queries().items():
        if name not in sqls or names and name not in names:
            continue
        start = time.time()
        try:
            note = compare(spark, con, name, query, sqls[name], sf)
        except Exception as e:  # report and go on
            note = f"{type(e).__name__}: {str(e)[:700]}"
        print(f"{name:22s} {time.time() - start:6.1f}s {'ok' if not note else 'FAIL ' + note}", flush=True)
        if note:
            failed.append(name)
    print("failed:", failed)
