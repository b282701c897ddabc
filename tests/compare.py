"""Run registered queries in Spark and their SQL twins in DuckDB, and compare."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import numpy as np
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, (list, tuple, np.ndarray)):
        return tuple(_cell(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, _cell(x)) for k, x in sorted(v.items()))
    if isinstance(v, (bool, np.bool_)):
        return bool(v)
    if isinstance(v, (int, np.integer)):
        return int(v)
    if isinstance(v, (float, np.floating)):
        return "nan" if math.isnan(v) else float(v)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_cell(r[i]) for i in order) for r in data]
    return [cols[i] for i in order], sorted(out, key=repr)


def compare(spark, con, run, sql, sf_dir) -> str | None:
    """None if equal, else a short description of the difference."""
    df = run(spark, sf_dir)
    scols, srows = rows(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if srows else "no rows"
    cur = con.execute(sql)
    dcols, drows = rows([d[0] for d in cur.description], cur.fetchall())
    if scols != dcols:
        return f"columns {scols} vs {dcols}"
    if len(srows) != len(drows):
        return f"{len(srows)} rows vs {len(drows)}"
    bad = [(a, b) for a, b in zip(srows, drows) if a != b]
    if bad:
        return f"{len(bad)}/{len(srows)} rows differ: spark {bad[0][0]} duck {bad[0][1]}"
    types = [(c, type(a), type(b)) for r, q in zip(srows, drows) for c, a, b in zip(scols, r, q)
             if a is not None and type(a) is not type(b)]
    return f"types differ: {types[0]}" if types else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from conftest import local_session

    sf = sys.argv[1]
    names = sys.argv[2:] or list(entry.queries())
    spark = local_session()
    con = duck(sf)
    sqls = entry.oracle_sql()
    failed = 0
    for name in names:
        t = time.time()
        try:
            problem = compare(spark, con, entry.queries()[name], sqls.get(name), sf)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:int(os.environ.get("ERROR_CHARS", "1500"))]}"
        failed += problem is not None
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - t:.1f}s {problem or ''}", flush=True)
    print(f"{len(names)} queries, {failed} failed")
