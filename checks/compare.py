"""Run queries beside their SQL: ``python -m checks.compare [sf_dir] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


def cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    return str(x) if x is not None else None


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def compare(spark, con, sf, query, sql):
    """(ok, message)."""
    started = time.time()
    df = query(spark, sf)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    middle = time.time()
    if sql is None:
        return True, f"{len(got)} rows, no SQL, {middle - started:.1f}s"
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    types = {d[0]: str(d[1]) for d in result.description}
    want_columns, want = rows_of(columns, result.fetchall())
    took = f"spark {middle - started:.1f}s duckdb {time.time() - middle:.1f}s"
    if got_columns != want_columns:
        return False, f"columns {got_columns} != {want_columns}"
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = {n: (t, types[n]) for n, t in df.dtypes if kinds.get(t, t).upper() != types[n].upper()}
    note = f" types differ: {odd}" if odd else ""
    if len(got) != len(want):
        return False, f"{len(got)} rows != {len(want)} {took}{note}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        g, w = bad[0]
        diff = [(n, a, b) for n, a, b in zip(got_columns, g, w) if a != b]
        return False, f"{len(bad)} of {len(got)} rows differ, first in {str(diff)[:600]} {took}{note}"
    return True, f"{len(got)} rows equal {took}{note}"


def main(argv):
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from checks import ORACLES, QUERIES
    from rotativa.session import local_session

    sf = argv[0] if argv else "/root/testdata/sf0.001"
    names = argv[1:] or list(QUERIES)
    spark = local_session(8, **{"spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in names:
        try:
            ok, message = compare(spark, con, sf, QUERIES[name], ORACLES.get(name))
        except Exception as error:  # noqa: BLE001
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, message, flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)} of {len(names)} ok; failed: {failed}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
