"""Run queries beside their SQL in DuckDB and compare rows, as the driver does."""

from __future__ import annotations

import math
import sys
from decimal import Decimal
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, Decimal):
        return round(float(v), 6)
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v)


def rows_of(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def compare(spark, con, name: str, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    theirs = rows_of(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"{name}: columns {sorted(df.columns)} and {sorted(names)}"
    if mine == theirs:
        return ""
    a, b = set(mine) - set(theirs), set(theirs) - set(mine)
    return f"{name}: {len(mine)} and {len(theirs)} rows; {len(a)} only Spark {sorted(a)[:2]}; {len(b)} only SQL {sorted(b)[:2]}"


if __name__ == "__main__":
    import time

    sys.path.insert(0, str(Path(__file__).parents[1]))
    import __spark_entry__ as e
    from conftest import session

    spark, d = session(), sys.argv[1]
    con, qs, sql = connect(d), e.queries(), e.oracle_sql()
    for n in sys.argv[2:] or [x for x in qs if x in sql]:
        t = time.time()
        try:
            print(n, "ok" if not (m := compare(spark, con, n, qs[n], sql[n], d)) else m, round(time.time() - t, 1), flush=True)
        except Exception as x:
            print(n, "ERROR", type(x).__name__, str(x)[:600].replace("\n", " "), flush=True)
