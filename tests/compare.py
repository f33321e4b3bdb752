"""Run registered queries on Spark and DuckDB and compare the rows.

    python -m tests.compare --sf 0.01 [query ...]
"""

from __future__ import annotations

import argparse
import math
import time
import traceback

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return v


def _key(row):
    return tuple((v is None, str(type(v).__name__ if v is None else ""), f"{v:.3f}" if isinstance(v, float) else str(v)) for v in row)


def spark_rows(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(_cell(r[c]) for c in cols) for r in df.collect()), key=_key)


def duck_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, sorted((tuple(_cell(r[i]) for i in idx) for r in cur.fetchall()), key=_key)


def difference(a, b, tolerance=0.0):
    (ca, ra), (cb, rb) = a, b
    if ca != cb:
        return f"columns differ: {ca} / {cb}"
    if len(ra) != len(rb):
        return f"row counts differ: {len(ra)} / {len(rb)}; first rows {ra[:2]} / {rb[:2]}"
    bad = []
    for x, y in zip(ra, rb):
        for c, u, v in zip(ca, x, y):
            if u is None and v is None:
                continue
            if type(u) is not type(v):
                bad.append((c, u, v, "type"))
            elif isinstance(u, float) and tolerance:
                if abs(u - v) > tolerance * max(1.0, abs(u)):
                    bad.append((c, u, v))
            elif u != v:
                bad.append((c, u, v))
        if len(bad) > 6:
            break
    return f"values differ: {bad[:7]}" if bad else ""


def main():
    from plumbline.plans import catalogue
    from tests.conftest import make_session

    ap = argparse.ArgumentParser()
    ap.add_argument("names", nargs="*")
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--group", default="")
    args = ap.parse_args()
    folder = f"/root/testdata/sf{args.sf}"
    spark = make_session()
    con = connect(folder)
    if args.group:
        import importlib

        todo = [q for g in args.group.split(",") for q in importlib.import_module(f"plumbline.plans.{g}").QUERIES]
    else:
        todo = catalogue.all_queries()
    if args.names:
        todo = [q for q in todo if q.name in args.names]
    failed = 0
    for q in todo:
        t = time.time()
        try:
            got = spark_rows(q.run(spark, folder))
            dt = time.time() - t
            if q.sql is None:
                print(f"rows  {q.name:28s} {len(got[1]):7d} rows {dt:6.2f}s {got[1][:1]}")
                continue
            t = time.time()
            want = duck_rows(con, q.oracle())
            d = difference(got, want)
            failed += bool(d)
            print(f"{'FAIL' if d else 'ok  '}  {q.name:28s} {len(got[1]):7d} rows {dt:6.2f}s duck {time.time() - t:5.2f}s {d}")
        except Exception as e:  # noqa: BLE001
            failed += 1
            msg = str(e)
            print(f"ERR   {q.name:28s} {type(e).__name__}: {msg[:700]}")
            if "--trace" in str(args):
                traceback.print_exc()
    print(f"{failed} failed of {len(todo)}")


if __name__ == "__main__":
    main()
