"""Compare registered queries with their SQL in DuckDB: python tests/compare.py SF_DIR [name ...]."""

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def norm(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return v


def key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(norm(r[i]) for i in order) for r in rows), key=key)


def compare(spark, con, fn, sql, sf):
    """(spark rows, differences as text)."""
    df = fn(spark, sf)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(got), ""
    cur = con.execute(sql)
    want_cols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return len(got), f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return len(got), f"rows {len(got)} != {len(want)}"
    bad = [(a, b) for a, b in zip(got, want) if a != b]
    return len(got), f"{len(bad)} rows differ, first {bad[0]}" if bad else ""


if __name__ == "__main__":
    import __spark_entry__ as entry
    from gridcohort.session import session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = session("local[8]", "compare", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    queries, oracles = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            n, problem = compare(spark, con, queries[name], oracles.get(name), sf)
        except Exception as e:
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        failed += bool(problem)
        kind = "sql" if name in oracles else "rows"
        print(f"{'BAD ' if problem else 'ok  '}{name:32s} {kind:5s} {n:8d} rows {time.time() - start:6.2f}s {problem}", flush=True)
    print("failed:", failed)
    spark.stop()
