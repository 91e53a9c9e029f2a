"""Run registered queries on Spark and DuckDB and compare whole results.

    python tests/oracle.py [sf_dir] [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return 0.0 if v == 0 else float(f"{v:.9g}")
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def compare(columns_a, rows_a, columns_b, rows_b) -> str | None:
    if sorted(columns_a) != sorted(columns_b):
        return f"columns {sorted(columns_a)} vs {sorted(columns_b)}"
    if len(rows_a) != len(rows_b):
        return f"rows {len(rows_a)} vs {len(rows_b)}"

    def table(cols, rows):
        order = sorted(range(len(cols)), key=lambda i: cols[i])
        return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [(x is None, str(type(x).__name__), str(x)) for x in r])

    a, b = table(columns_a, rows_a), table(columns_b, rows_b)
    left = {tuple(map(str, r)) for r in a} - {tuple(map(str, r)) for r in b}
    right = {tuple(map(str, r)) for r in b} - {tuple(map(str, r)) for r in a}
    if left or right:
        pick = lambda rows: sorted(rows, key=lambda r: r[::-1])[:3]
        return f"{len(left)} differ {sorted(columns_a)}\n   spark {pick(left)}\n   sql   {pick(right)}"
    for x, y in zip(a, b):
        if x != y or [type(i) for i in x] != [type(i) for i in y]:
            return f"{sorted(columns_a)}\n   spark {x}\n   sql   {y}"
    return None


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return len(rows), None
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    return len(rows), compare(df.columns, rows, cols, cur.fetchall())


def main(argv: list[str]) -> int:
    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    wanted = argv[1:]
    from __spark_entry__ import oracle_sql, queries
    from demandgrid.session import local_session

    spark, con, sqls, bad = local_session(), connect(sf_dir), oracle_sql(), 0
    for name, fn in queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        t = time.time()
        try:
            k, err = check(spark, con, name, fn, sqls.get(name), sf_dir)
        except Exception as e:  # report and go on
            k, err = -1, f"{type(e).__name__}: {str(e)[:600]}"
        bad += err is not None
        mark = "FAIL" if err else ("ok" if name in sqls else "ok (rows only)")
        print(f"{name:36s} {k:7d} rows {time.time() - t:6.2f}s {mark}" + (f"\n   {err}" if err else "") + (" EMPTY" if k == 0 else ""), flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
