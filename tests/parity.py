"""Compare queries with their SQL on a directory of test tables: python tests/parity.py DIR [NAME ...]"""

from __future__ import annotations

import math
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat()
    if hasattr(v, "as_tuple"):
        return round(float(v), 5)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def connect(folder: str):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


def compare(spark, con, folder: str, run, sql: str) -> str:
    """Empty if equal, else what differs."""
    df = run(spark, folder)
    a = rows(df.columns, df.collect())
    cur = con.execute(sql)
    b = rows([x[0] for x in cur.description], cur.fetchall())
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if a[1] != b[1]:
        only = [(x, y) for x, y in zip(a[1], b[1]) if x != y][:2]
        return f"{len(a[1])} and {len(b[1])} rows; {only}"
    return ""


if __name__ == "__main__":
    import __spark_entry__ as e
    from corpusloom.session import local_session

    spark, con = local_session(os.cpu_count()), connect(sys.argv[1])
    names = sys.argv[2:] or list(e.queries())
    sqls = e.oracle_sql()
    for n in names:
        t = time.time()
        try:
            said = compare(spark, con, sys.argv[1], e.queries()[n], sqls[n]) if n in sqls else f"no SQL, {e.queries()[n](spark, sys.argv[1]).count()} rows"
        except Exception as x:
            said = f"ERROR {str(x)[:400]}"
        print(f"{n}: {said or 'equal'} ({time.time() - t:.1f} s)", flush=True)
