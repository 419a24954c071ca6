"""Compare registered queries with their SQL on DuckDB.

    python tests/check_queries.py [--sf /root/testdata/sf0.01] [name ...]
"""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = "/root/testdata/sf0.01"


def norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


def duck(sf):
    import duckdb
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return con


def compare(spark, con, case, sf):
    df = case.run(spark, sf)
    got = df.collect()
    if case.sql is None:
        return len(got), None
    cur = con.execute(case.oracle())
    names = [d[0] for d in cur.description]
    want = rows_of(names, cur.fetchall())
    have = rows_of(df.columns, got)
    if sorted(names) != sorted(df.columns):
        return len(got), f"columns {sorted(names)} / {sorted(df.columns)}"
    if want != have:
        extra = [r for r in have if r not in set(want)][:2]
        miss = [r for r in want if r not in set(have)][:2]
        return len(got), f"rows {len(have)} / {len(want)}\n   spark only {extra}\n   sql only   {miss}"
    return len(got), ""


if __name__ == "__main__":
    from sentrylake.session import local_session
    from sentrylake.workloads import all_cases
    args = sys.argv[1:]
    sf = SF
    if "--sf" in args:
        i = args.index("--sf")
        sf = args[i + 1]
        del args[i:i + 2]
    spark, con = local_session(8), duck(sf)
    bad = 0
    for case in all_cases():
        if args and not any(case.name == a or (a.endswith("*") and case.name.startswith(a[:-1])) for a in args):
            continue
        t = time.time()
        try:
            n, problem = compare(spark, con, case, sf)
        except Exception as exc:  # noqa: BLE001
            n, problem = -1, f"{type(exc).__name__}: {str(exc)[:600]}"
        bad += bool(problem)
        word = "FAIL" if problem else ("rows" if problem is None else "ok")
        print(f"{word:5}{case.name:32}{n:8} {time.time() - t:6.1f}s {problem or ''}", flush=True)
    print("failures:", bad)
