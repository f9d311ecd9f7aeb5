"""Compare registered queries with their SQL run by DuckDB on the same files."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

SQL_NAMES = {"string": "VARCHAR", "int": "INTEGER"}


def connect(folder: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def canonical(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, bool) or value is None:
        return repr(value)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(canonical(v) for v in value) + "]"
    if isinstance(value, dict):
        return canonical(list(value.values()))
    if hasattr(value, "asDict"):
        return canonical(list(value.asDict().values()))
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def compare(spark, folder, con, name, fn, sql):
    start = time.time()
    df = fn(spark, folder)
    got = rows_of(df.columns, df.collect())
    took = time.time() - start
    if sql is None:
        return f"rows {len(got[1])}", took
    start = time.time()
    cur = con.execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    sql_took = time.time() - start
    theirs = {d[0]: str(d[1]).upper() for d in cur.description}
    types = [f"{n} {t}/{theirs.get(n)}" for n, t in df.dtypes if SQL_NAMES.get(t, t.upper()) != theirs.get(n)]
    if got == want:
        note = f" types: {', '.join(types)}" if types else ""
        return f"ok {len(got[1])} (sql {sql_took:.1f}s){note}", took
    detail = [f"columns {got[0]} / {want[0]}"] if got[0] != want[0] else []
    if len(got[1]) != len(want[1]):
        detail.append(f"count {len(got[1])} / {len(want[1])}")
    missing = sorted(set(want[1]) - set(got[1]))[:3]
    extra = sorted(set(got[1]) - set(want[1]))[:3]
    return "MISMATCH " + "; ".join([*detail, f"only sql {missing}", f"only spark {extra}"]), took


def main(argv):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from foldwise.session import local_session

    folder = argv[0]
    wanted = argv[1:]
    spark = local_session()
    con = connect(folder)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name, fn in queries.items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            verdict, took = compare(spark, folder, con, name, fn, oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - a report line per query
            verdict, took = f"ERROR {type(exc).__name__}: {str(exc)[:900]}", 0.0
        bad += verdict.startswith(("MISMATCH", "ERROR"))
        print(f"{name:34s} {took:6.2f}s  {verdict}", flush=True)
    print(f"{bad} bad")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
