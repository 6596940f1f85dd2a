"""Run registered queries beside their SQL twins and compare whole results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (float, decimal.Decimal)):
        f = float(v)
        return None if math.isnan(f) else round(f, 6) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v)
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def canonical(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=lambda r: [str(x) for x in r])


def duck(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    """'' when equal, else a short description of the difference."""
    df = fn(spark, sf)
    mine = canonical(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(mine)}"
    cur = con.execute(sql)
    cols = [d[0] for d in cur.description]
    theirs = canonical(cols, cur.fetchall())
    if sorted(cols) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} vs {sorted(cols)}"
    if len(mine) != len(theirs):
        return f"ROWS {len(mine)} vs {len(theirs)}"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"VALUES {sorted(cols)}\n   spark {str(a)[:600]}\n   sql   {str(b)[:600]}"
    return "" if mine else "empty"


if __name__ == "__main__":
    import __spark_entry__ as entry
    from quirework.session import build_session

    args = sys.argv[1:]
    sf = args[0] if args else "/root/testdata/sf0.001"
    names = args[1:]
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf)
    qs, sqls = entry.queries(), entry.oracle_sql()
    bad = 0
    for n, fn in qs.items():
        if names and n not in names:
            continue
        t = time.time()
        try:
            res = compare(spark, con, sf, n, fn, sqls.get(n))
        except Exception as e:  # noqa: BLE001
            res = f"FAIL {type(e).__name__} {str(e)[:700]}"
        if res and not res.startswith("rows only"):
            bad += 1
        print(f"{'ok ' if not res else '   '} {n} {time.time() - t:.1f}s {res}", flush=True)
    print(f"{bad} differences")
