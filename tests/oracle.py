"""Compare every registered query with its SQL in DuckDB: columns, row count and values.

    python -m tests.oracle [folder] [name-prefix ...]
"""

from __future__ import annotations

import datetime
import decimal
import sys
import time

import duckdb

from stewardry.plans import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def canonical(value):
    if value is None:
        return "\0null"
    if isinstance(value, bool):
        return f"b{value}"
    if isinstance(value, int):
        return f"i{value}"
    if isinstance(value, float):
        return f"f{value:.9g}"
    if isinstance(value, decimal.Decimal):
        return f"d{value}"
    if isinstance(value, datetime.datetime):
        return f"t{value.replace(tzinfo=None).isoformat()}"
    return f"{type(value).__name__[0]}{value}"


def rows_of(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(canonical(row[i]) for i in order) for row in rows)


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    query = QUERIES[name]
    started = time.time()
    df = query(spark, folder)
    got = rows_of(df.columns, df.collect())
    spark_s = time.time() - started
    if query.sql is None:
        return bool(got), f"{len(got)} rows (no SQL) {spark_s:.1f}s"
    started = time.time()
    cur = con.execute(query.sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    sql_s = time.time() - started
    note = f"{len(got)} rows  spark {spark_s:.1f}s  sql {sql_s:.1f}s"
    if sorted(columns) != sorted(df.columns):
        return False, f"columns differ: {sorted(df.columns)} vs {sorted(columns)}"
    if got != want:
        extra, missing = sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3]
        return False, f"{note}; sql rows {len(want)}\n    only spark: {extra}\n    only sql:   {missing}"
    return bool(got), note + ("" if got else "  EMPTY")


def main() -> None:
    from tests.conftest import make_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    spark, con = make_session(), connect(folder)
    names = [n for n in QUERIES if not args or any(n.startswith(a) for a in args)]
    bad = 0
    for name in names:
        try:
            ok, note = compare(spark, con, name, folder)
        except Exception as error:  # keep going: one broken query must not hide the others
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print("ok  " if ok else "FAIL", name, note, flush=True)
    print(f"{len(names) - bad} of {len(names)} match")


if __name__ == "__main__":
    main()
