"""Run registered queries next to their SQL oracle and compare whole results."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return int(x) if x == int(x) and abs(x) < 1e15 else float(f"{x:.9g}")
    if isinstance(x, dt.date) and not isinstance(x, dt.datetime):
        return dt.datetime(x.year, x.month, x.day)
    if hasattr(x, "item"):
        return plain(x.item())
    return x


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=repr)


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def check(spark, con, sf, name, fn, sql):
    """(ok, message) for one query."""
    start = time.time()
    df = fn(spark, sf)
    got = df.collect()
    took = time.time() - start
    if sql is None:
        return True, f"{len(got)} rows, no oracle, {took:.1f}s"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(names)}"
    a, b = normal(got, df.columns), normal(want, names)
    if a == b:
        return True, f"{len(a)} rows, {took:.1f}s"
    extra = [r for r in a if r not in b][:3] if len(a) < 5000 else []
    lost = [r for r in b if r not in a][:3] if len(a) < 5000 else []
    return False, f"{len(a)} vs {len(b)} rows {sorted(names)}\n   spark {extra}\n   oracle {lost}"


if __name__ == "__main__":
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from tabsight.session import local_session

    sf = "/root/testdata/" + (sys.argv[1] if len(sys.argv) > 1 else "sf0.01")
    wanted = sys.argv[2:]
    spark, con = local_session(), connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and name not in wanted:
            continue
        try:
            ok, text = check(spark, con, sf, name, fn, oracles.get(name))
        except Exception as e:  # noqa: BLE001
            ok, text = False, f"{type(e).__name__}: {str(e)[:1500]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, text, flush=True)
    print("failures:", bad)
