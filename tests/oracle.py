"""Compare registered queries with their SQL twins: python tests/oracle.py [name part ...]."""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(f"{v:.12g}") + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(canon(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is not None, str(x)) for x in r))


def compare(df, con, sql):
    """None when equal, else a short description of the difference."""
    sc, sr = rows_of(df.columns, [tuple(r) for r in df.collect()])
    res = con.sql(sql)
    dc, dr = rows_of(list(res.columns), res.fetchall())
    if sc != dc:
        return f"columns {sc} != {dc}"
    if len(sr) != len(dr):
        return f"rows {len(sr)} != {len(dr)}; spark {sr[:3]} duck {dr[:3]}"
    bad = [(a, b) for a, b in zip(sr, dr) if a != b]
    if bad:
        return f"{len(bad)}/{len(sr)} rows differ, e.g. spark {bad[0][0]} duck {bad[0][1]}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from tabaudit.session import local_session

    folder = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark, con = local_session("8"), duck(folder)
    sql, wanted, bad = oracle_sql(), sys.argv[1:], 0
    for name, fn in queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            if name in sql:
                diff = compare(df, con, sql[name])
                n = "same" if diff is None else "?"
            else:
                diff, n = None, f"{len(df.collect())} (rows only)"
        except Exception as e:  # report and go on with the next query
            diff, n = f"{type(e).__name__}: {str(e)[:1500]}", "?"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name:32s} {time.time() - t:6.1f}s rows={n}", "" if diff is None else f"\n    {diff}", flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
