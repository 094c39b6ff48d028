"""Run a registered query in Spark and its oracle in DuckDB and compare values."""

from __future__ import annotations

import datetime
import decimal
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def oracle_connection(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.isoformat() if (v.hour or v.minute or v.second) else v.date().isoformat()
    if isinstance(v, datetime.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    """Returns (problem or None, rows, spark seconds)."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    cols, got = canonical(df.columns, rows)
    if sql is None:
        return (None if rows else "no rows"), len(rows), took
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    ocols, want = canonical(names, res.fetchall())
    if cols != ocols:
        return f"columns {cols} != {ocols}", len(rows), took
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}", len(rows), took
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} rows differ, e.g. {bad[0]}", len(rows), took
    return None, len(rows), took


if __name__ == "__main__":
    import sys

    import __spark_entry__ as entry
    from fieldmark.session import local_session

    sf_dir = sys.argv[1]
    only = sys.argv[2:]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = oracle_connection(sf_dir)
    oracles = entry.oracle_sql()
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        try:
            problem, n, took = compare(spark, con, name, fn, oracles.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001
            problem, n, took = f"{type(e).__name__}: {str(e)[:1500]}", -1, 0.0
        flag = "ok  " if problem is None else "FAIL"
        print(f"{flag} {name:32s} rows={n:7d} {took:6.2f}s {'' if name in oracles else '(no oracle)'} {problem or ''}", flush=True)
